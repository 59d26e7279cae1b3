"""Rules of single functions, on edge cases that the tables don't hold."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text, values
from millrace.operators import joins, windows
from millrace.sources import files
from millrace.streaming import replay


def test_units_cover_the_text_without_overlap():
    rng = random.Random(1)
    for n in (0, 1, 639, 640, 641, 5000):
        t = "".join(rng.choice("ab .!") for _ in range(n))
        cut = text.units(t)
        assert "".join(t[u["start"] : u["stop"]] for u in cut) == t
        assert all(u["stop"] - u["start"] >= 640 for u in cut[:-1])


def test_spans_are_replaced_from_the_right():
    assert text.replace_spans("abcdef", [(0, 1, "XX"), (3, 5, "")]) == "XXbcf"


@pytest.mark.parametrize("charset", ["utf-8", "shift_jis", "euc-jp"])
def test_charsets_are_found(charset):
    assert files.decode("競馬のニュース、東京".encode(charset))[1] == "競馬のニュース、東京"


def test_workbook_round_trip():
    rows = [["a", "b <&>"], ["", "ü"]]
    assert files.sheet_rows(files.workbook(rows)) == rows


def test_lifecycle_needs_its_order():
    state = "scheduled"
    for kind in ("purchase", "signup", "view", "purchase", "signup"):
        state = replay.lifecycle_step(state, kind)
    assert state == "finished"


def test_occurrences_take_longest_first(spark):
    df = spark.createDataFrame([(1, "Red widget red wid"), (2, None), (3, "")], "id long, text string")
    surfaces = spark.createDataFrame([("red",), ("red widget",), ("wid",), ("",), (None,)], "s string")
    for most in (100, 1):  # in one pass and in several
        got = {r["id"]: [s["surface"] for s in r["spans"]] for r in joins.occurrences(df, surfaces, most).collect()}
        assert got == {1: ["red widget", "red", "wid"], 2: [], 3: []}
    assert {len(r["spans"]) for r in joins.occurrences(df, surfaces.limit(0)).collect()} == {0}


def test_occurrences_match_brute_force(spark):
    rng = random.Random(15)
    make = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    surfaces, texts = sorted({make(rng.randrange(1, 5)) for _ in range(30)}), [make(60) for _ in range(20)]
    got = {r["id"]: [(s["start"], s["surface"]) for s in r["spans"]] for r in joins.occurrences(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(s,) for s in surfaces], "s string"), 7).collect()}
    for i, t in enumerate(texts):
        taken = []
        for s in sorted(surfaces, key=lambda s: (-len(s), s)):
            taken += [(k, s) for k in range(len(t)) if t.startswith(s, k) and not any(k < a + len(x) and a < k + len(s) for a, x in taken)][:1]
            while more := [(k, s) for k in range(len(t)) if t.startswith(s, k) and not any(k < a + len(x) and a < k + len(s) for a, x in taken)]:
                taken.append(more[0])
        assert got[i] == sorted(taken)


@pytest.mark.parametrize(
    "written",
    [
        ("$1,250,000", "1.25 million dollars", "USD 1"),
        ("３０ million yen", "30,000,000円", "3000万円", "¥30 million"),
        ("two hundred and five", "205"),
        ("twenty-five thousand", "25,000", "2.5万"),
        ("3:05 pm", "15:05"),
        ("12:00 am", "0:00"),
        ("May 3", "5月 3"),
        ("7.50%", "7.5 %"),
    ],
)
def test_equal_quantities_have_equal_tokens(written):
    first, *others = (text.quantities(w) for w in written if w != "USD 1")
    assert first and all(x == first for x in others)


def test_quantities_leave_words_alone():
    assert text.quantities("someone may march often") == [] and text.quantities(None) == []
    assert text.quantities("1,2 and 3") == ["number:1", "number:2", "number:3"]


def test_matching_augments(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 3, 1), (2, 5, 5)], "sample long, left long, right long")
    assert {r["sample"]: r["matched"] for r in joins.maximum_matching(df).collect()} == {1: 2, 2: 1}


def test_resolution_needs_exactly_one(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    c = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, v int")
    assert {r["k"]: (r["state"], r["resolved"]) for r in joins.resolved(t, c, ["k"], "v").collect()} == {"a": ("exact", 1), "b": ("conflict", None), "c": ("missing", None)}


def test_overlaps_touch(spark):
    df = spark.createDataFrame([(1, "k", 1, 3), (2, "k", 3, 4), (3, "k", 5, 6)], "id int, k string, s int, e int")
    assert {r["id"]: r["overlaps"] for r in joins.overlapping(df, "k", "s", "e", "id").collect()} == {1: False, 2: True, 3: False}


def test_keyset_pages_meet(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(30)], "a long, b long")
    seen, cursor = [], (99, 99)
    while True:
        page = windows.keyset_page(df, ["a", "b"], cursor, 7).collect()
        seen += [r["b"] for r in page[:7]]
        if len(page) <= 7:
            break
        cursor = (page[6]["a"], page[6]["b"])
    assert seen == list(range(29, -1, -1))


def test_authority_blocks_on_disagreement(spark):
    df = spark.createDataFrame([("x", "v", 50), ("x", "v", 50), ("x", "w", 10), ("y", "v", 50), ("y", "w", 50), ("z", " ", 50), ("z", "w", 10)], "k string, v string, r int")
    got = {r["k"]: (r["value"], r["blocked"]) for r in values.merged_by_authority(df, "k", "v", "r").collect()}
    assert got == {"x": ("v", False), "y": (None, True), "z": ("w", False)}


def test_bounded_scan_refuses(spark):
    assert files.bounded(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        files.bounded(spark.range(6), 5)


def test_upsert_keeps_values_over_blanks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, ""), (3, "c")], "k int, v string")
    assert {r["k"]: r["v"] for r in files.upserted(old, new, "k", ["v"]).collect()} == {1: "a", 2: "b", 3: "c"}


def test_nfkc_folds(spark):
    assert spark.createDataFrame([("  ＡＢＣ ß ",)], "t string").select(text.nfkc_casefold(F.col("t"))).first()[0] == "abc ss"


def test_exact_measures(spark):
    from millrace.functions import measures

    weights = [("57", "kg", "57", "parsed"), ("１２６ｌｂ", "", "57.2", "parsed"), ("9-4", "stone_lb", "59", "parsed"), ("9-14", "stone_lb", None, "unresolved"), ("57", "", None, "unresolved"), ("1000kg", "", None, "unresolved"), ("0kg", "", None, "unresolved"), (" ", "kg", None, "missing"), (None, "kg", None, "missing"), ("57.5公斤", "", "57.5", "parsed")]
    df = spark.createDataFrame([(i, *w[:2]) for i, w in enumerate(weights)], "i int, raw string, unit string").select("i", measures.weight(F.col("raw"), F.col("unit")).alias("w"))
    for r in df.collect():
        kilos = None if r.w.kilos is None else f"{r.w.kilos.normalize():f}"
        assert (kilos, r.w.state) == weights[r.i][2:], weights[r.i]
    margins = [("1½L", "", None, 3, 2), ("½ length", "", None, 1, 2), ("1.1/2", "length", None, 3, 2), ("2/6", "length", None, 1, 3), ("2.50l", "", None, 5, 2), ("Hd", "", "头差", None, None), ("1/0l", "", None, None, None), ("3", "", None, None, None), ("0l", "", None, 0, 1), ("2 lengths more", "", None, None, None)]
    df = spark.createDataFrame([(i, *m[:2]) for i, m in enumerate(margins)], "i int, raw string, unit string").select("i", measures.margin(F.col("raw"), F.col("unit")).alias("m"))
    for r in df.collect():
        assert (r.m.label, r.m.num, r.m.den) == margins[r.i][2:], margins[r.i]
    prices = [("5/2", "fractional", 5, 2, "parsed"), ("5/0", "fractional", None, None, "unresolved"), ("0.9", "decimal", None, None, "unresolved"), ("1.0", "decimal", 1, 1, "parsed"), ("0.9", "hong_kong", 9, 10, "parsed"), ("3", "moneyline", None, None, "unresolved"), (None, "decimal", None, None, "missing")]
    df = spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(prices)], "i int, raw string, form string").select("i", measures.odds(F.col("raw"), F.col("form")).alias("o"))
    for r in df.collect():
        assert (r.o.num, r.o.den, r.o.state) == prices[r.i][2:], prices[r.i]


def test_strict_documents():
    from millrace.functions.measures import refusal

    assert refusal('{"a": [1, {"a": null}]}') is None
    assert refusal('{"a": {"b": 1, "b": 1}}') == "duplicate_json_key"
    assert refusal("[NaN]") == refusal("[1e999]") == "nonfinite_value"
    assert refusal("[" * 65 + "]" * 65) is None and refusal("[" * 66 + "]" * 66) == "document_limit"
    assert refusal("[" + "1," * 99_999 + "1]") == "document_limit"
    assert refusal("{") == refusal("") == refusal(None) == refusal("[" * 100_000) == "invalid_json"


def test_ledgers_equal_a_plain_loop(spark):
    import pyarrow.parquet as pq

    from millrace.plans import catalog
    from millrace.streaming import ledgers  # noqa: F401

    sf = "/root/testdata/sf0.001"
    events = sorted(pq.read_table(f"{sf}/events.parquet").to_pylist(), key=lambda e: (e["ts"], e["event_id"]))
    caps, breaks = {}, {}
    users: dict = {}
    for e in events:
        u = users.setdefault(e["user_id"], {"open": False, "spent": {}, "failures": 0, "since": None})
        u["open"] = u["open"] and e["event_type"] != "purchase"
        amount = round(e["value"] * 100)
        slots = [("article_budget_exhausted", ("a", e["event_type"]), 40_000), ("budget_exhausted_month", ("m", e["ts"].year, e["ts"].month), 60_000), ("budget_exhausted_day", ("d", e["ts"].date()), 7_500)]
        over = [name for name, slot, cap in slots if u["spent"].get(slot, 0) + amount > cap]
        caps[e["event_id"]] = "unreconciled_bill" if u["open"] else over[0] if over else "reserved"
        if caps[e["event_id"]] == "reserved":
            for _, slot, _ in slots:
                u["spent"][slot] = u["spent"].get(slot, 0) + amount
            u["open"] = e["event_type"] == "error"
        tripped = u["failures"] >= 2
        if tripped and int(e["ts"].timestamp()) < int(u["since"].timestamp()) + 6 * 3600:
            breaks[e["event_id"]] = "denied"
            continue
        breaks[e["event_id"]] = "probe" if tripped else "admitted"
        u["failures"], u["since"] = (u["failures"] + 1 if e["event_type"] == "error" else 0), e["ts"]
    assert {r.event_id: r.verdict for r in catalog.QUERIES["str_s14_period_caps"](spark, sf).collect()} == caps
    assert {r.event_id: r.verdict for r in catalog.QUERIES["str_s9_circuit_breaker"](spark, sf).collect()} == breaks
    assert {"reserved", "unreconciled_bill"} < set(caps.values()) and set(breaks.values()) == {"admitted", "probe", "denied"}


def test_ledger_steps():
    from types import SimpleNamespace as Row

    from millrace.streaming import ledgers

    def verdicts(step, state, rows):
        out = []
        for r in rows:
            state, v = step(state, r)
            out.append(v)
        return out

    spend = lambda kind, day, amount: Row(event_type=kind, day=day, month=day[:7], amount=amount)
    start = (False, "", 0, "", 0, "{}")
    assert verdicts(ledgers.reserve, start, [spend("view", "2024-01-01", 7_000), spend("view", "2024-01-01", 501), spend("view", "2024-01-01", 500), spend("view", "2024-01-02", 7_500)]) == ["reserved", "budget_exhausted_day", "reserved", "reserved"]
    days = [spend("ab"[i % 2], f"2024-01-{i + 1:02d}", 7_500) for i in range(9)]
    assert verdicts(ledgers.reserve, start, [*days, spend("c", "2024-02-01", 7_500)]) == ["reserved"] * 8 + ["budget_exhausted_month", "reserved"]
    assert verdicts(ledgers.reserve, start, [spend("a", f"2024-{i + 1:02d}-01", 7_500) for i in range(6)])[-1] == "article_budget_exhausted"
    assert verdicts(ledgers.observe, ("", -1), [Row(digest="x", instant=5), Row(digest="y", instant=4), Row(digest="x", instant=6), Row(digest="y", instant=6)]) == ["changed", "stale", "unchanged", "changed"]
