"""Term states, offsets of normalised text, quantities and numbered broken lines, on small fixtures and against plain loops."""

import random
import re
import unicodedata

import pytest

from millrace.functions.text import normal_offsets, quantities, replace_normalised
from millrace.operators.joins import term_states
from millrace.sources.files import read_json_lines, scratch

TERMS = "surface string, term_id long, registry boolean, reviewed boolean"


def states(spark, texts, terms, evidence=(), common=()):
    out = term_states(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, TERMS), spark.createDataFrame(list(evidence), "id long, term_id long"), list(common))
    return sorted((r["id"], r["start"], r["stop"], r["surface"], r["term_id"], r["state"]) for r in out.collect())


def test_states_of_terms(spark):
    terms = [("Blue Star", 1, True, True), ("star", 2, False, True), ("star", 1, False, True), ("moon", 3, False, False), ("sun", 4, True, True), ("sun", 5, False, True), ("may", 6, True, True), ("", 7, True, True), (None, 8, True, True), ("x", None, True, True)]
    texts = [(1, "blue star, STAR and moon"), (2, "star sun may"), (3, "moon may"), (4, None), (5, ""), (6, "x")]
    evidence = [(2, 2), (2, 2), (3, 3), (3, 6), (9, 1)]
    assert states(spark, texts, terms, evidence, ["May"]) == [
        (1, 0, 9, "blue star", 1, "confirmed"),
        (1, 11, 15, "star", None, "conflict"),
        (1, 20, 24, "moon", 3, "uncertain"),
        (2, 0, 4, "star", 2, "confirmed"),
        (2, 5, 8, "sun", 4, "confirmed"),
        (2, 9, 12, "may", 6, "uncertain"),
        (3, 0, 4, "moon", 3, "confirmed"),
        (3, 5, 8, "may", 6, "confirmed"),
    ]
    assert states(spark, texts, terms[:2] + terms[:2], [(1, 1), (1, 2)]) == [(1, 0, 9, "blue star", 1, "confirmed"), (1, 11, 15, "star", 2, "confirmed"), (2, 0, 4, "star", 2, "confirmed")]
    assert states(spark, [], terms) == [] and states(spark, texts, []) == []


def test_states_match_a_plain_loop(spark):
    rng = random.Random(8)
    words = ["ab", "cd", "ef", "gh", "ij"]
    terms = [(rng.choice(words), rng.randrange(6), rng.random() < 0.3, rng.random() < 0.5) for _ in range(25)]
    texts = [(i, " ".join(rng.choice([*words, "zz"]) for _ in range(8))) for i in range(40)]
    evidence = [(rng.randrange(40), rng.randrange(6)) for _ in range(60)]
    want = []
    for i, text in texts:
        for m in re.finditer("|".join(words), text):
            own = [t for t in terms if t[0] == m[0]]
            if any(t[2] for t in own):
                own = [t for t in own if t[2]]
            ids = {t[1] for t in own}
            if not ids:
                continue
            named = [k for k in ids if (i, k) in evidence]
            if len(ids) > 1 and len(named) != 1:
                want.append((i, m.start(), m.end(), m[0], None, "conflict"))
                continue
            reviewed = all(any(t[3] for t in own if t[1] == k) for k in ids)
            state = "confirmed" if named else "uncertain" if m[0] == "gh" or not (any(t[2] for t in own) or reviewed) else "confirmed"
            want.append((i, m.start(), m.end(), m[0], named[0] if named else min(ids), state))
    assert states(spark, texts, terms, evidence, ["gh"]) == want


@pytest.mark.parametrize("text", ["", "abc", "ＡＢＣ e\u0301 ﬁx", "ｶﾞｷﾞ ㌀", "각 \u1100\u1161\u11a8", "\u0301a", "a\u0323\u0302b", "½ Ⅷ ㍿", "𝔞\u0300"])
def test_offsets_of_normalised_text(text):
    normal, starts, stops = normal_offsets(text)
    assert normal == unicodedata.normalize("NFKC", text) and len(normal) == len(starts) == len(stops)
    assert starts == sorted(starts) and stops == sorted(stops) and all(0 <= a < b <= len(text) for a, b in zip(starts, stops, strict=True))
    for a, b in set(zip(starts, stops, strict=True)):
        assert "".join(c for c, s in zip(normal, starts, strict=True) if s == a) == unicodedata.normalize("NFKC", text[a:b])


def test_offsets_of_random_text():
    rng = random.Random(6)
    marks = [*map(chr, range(0x300, 0x315)), "\u0323", "ﾞ", "ﾟ", "\u3099", "\u1161", "\u11a8", "\u09be", "\u0fb5"]
    for _ in range(3000):
        text = "".join(rng.choice(marks) if rng.random() < 0.4 else chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x900, 0xDFF), rng.randrange(0x1100, 0x1200), rng.randrange(0x3040, 0x3400), rng.randrange(0xFB00, 0xFFE0)])) for _ in range(8))
        normal, starts, _ = normal_offsets(text)
        assert normal == unicodedata.normalize("NFKC", text) and starts == sorted(starts)


def test_replacement_in_the_text_as_written():
    pattern, values = re.compile(r"\b(the|été|10)\b"), {"the": "<1>", "été": "<2>", "10": "<3>"}
    swapped = lambda t: replace_normalised(t, pattern, values)
    assert swapped("ＴＨＥ ﬁne ｶﾞ the ete\u0301 e\u0301te\u0301 ⑩ STRASSE ß The") == "<1> ﬁne ｶﾞ <1> ete\u0301 <2> <3> STRASSE ß <1>"
    assert swapped("") == "" and swapped("then") == "then" and swapped(" ＴＨＥ ") == " <1> "


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("two dozen eggs and a dozen", ["number:24", "number:12"]),
        ("3 trillion and two trillion", ["number:3000000000000", "number:2000000000000"]),
        ("-5 and minus 5 and negative five, +5", ["number:-5", "number:-5", "number:-5", "number:5"]),
        ("from 3-5, a 4 - 2", ["number:3", "number:5", "number:4", "number:2"]),
        ("one half, 0.5, ½ and a half", ["number:0.5"] * 4),
        ("two thirds, ⅔", ["fraction:2/3"] * 2),
        ("two and a half, 2½ and 2.5", ["number:2.5"] * 3),
        ("-$5 and -5%", ["money:USD:-5", "percent:-5"]),
        ("ｔｗｅｎｔｙ-ｏｎｅ", ["number:21"]),
        ("1⁄0", ["number:1", "number:0"]),
    ],
)
def test_quantities(text, tokens):
    assert quantities(text) == tokens


def test_broken_lines_have_their_numbers(spark):
    import os

    folder = scratch(spark).removeprefix("file://")
    os.makedirs(folder)
    rng, want, n_good = random.Random(7), set(), 0
    for name in ("a.txt", "b.txt", "c.txt"):
        lines = []
        for k in range(1, 3000 if name == "a.txt" else 40):
            x = rng.random()
            lines.append("{broken" if x < 0.1 else "" if x < 0.2 else f'{{"id": {k}, "s": "é{k}"}}')
            n_good += lines[-1].startswith('{"')
            want |= {(name, k, lines[-1])} if lines[-1] == "{broken" else set()
        with open(f"{folder}/{name}", "w") as f:
            f.write("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # a file of many splits
    try:
        good, bad = read_json_lines(spark, f"file://{folder}", "id long, s string")
        assert {tuple(r) for r in bad.collect()} == want and bad.count() == len(want) and good.count() == n_good
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
