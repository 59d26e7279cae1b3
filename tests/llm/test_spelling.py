"""Spelling variants against plain comparison of all pairs of words, and the registered query against its contract."""

import random
import re
import zlib
from collections import Counter

import pytest

from millrace.llm import spelling

ROWS = "doc_id long, text string, lang string, source string, n long, word string, form string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}
    form, out = {}, []
    beside = {w: [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)] for w in words}
    for w, found in beside.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(beside[w]), form[w] and words[form[w]]))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 1, "x", "y") for i, t in rows], ROWS)


def texts(rng, n):
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([6, 7, 8, 9, 12, 15]))) for _ in range(25)]
    base += ["prefixed" + a + b for a in "abcdef" for b in "ghij"] + [a + b + "suffixed" for a in "abcd" for b in "efgh"]
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(base[: rng.choice([3, 10, len(base)])])
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "z" + w[at:], w[:at] + "ÿ" + w[at + 1 :]])
            out.append(rng.choice([w, w.upper() if w.isascii() else w, w.capitalize()]))
        yield rng.choice([" ", "-", "1"]).join(out)


@pytest.mark.parametrize("small", [128, 3])
def test_variants_match_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(spelling, "SMALL", small)
    rng = random.Random(small)
    rows = list(enumerate(texts(rng, 150)))
    want = plain(rows)
    assert sorted((tuple(r) for r in spelling.variants(table(spark, rows)).collect()), key=lambda r: r[0]) == want
    assert len(want) > 100 and any(r[1] for r in want) and max(r[4] for r in want) > 4


def test_chains_and_ties(spark):
    # 2, 20, 200, 2000: each the near word of the one before; of two forms with one count the smaller word wins
    counts = {"chainaaaa": 2, "chainaaab": 20, "chainaabb": 200, "chainabbb": 2000, "tiesbbbb": 2, "tiesbbba": 40, "tiesbbbc": 40, "loneword": 5}
    rows = [(next(i for i in range(9) if zlib.crc32(f"{i}:{w}".encode()) % 31), " ".join([w] * n)) for w, n in counts.items()]
    got = {r["word"]: r for r in spelling.variants(table(spark, rows)).collect()}
    assert sorted((tuple(r) for r in got.values()), key=lambda r: r[0]) == plain(rows)
    assert got["chainaaaa"]["root"] == "chainabbb" and got["tiesbbbb"]["form"] == "tiesbbba" and got["loneword"]["n_near"] == 0


def test_query_and_edges(spark, tmp_path):
    long = "q" * 20_000
    rows = [(0, None), (1, ""), (2, "1234 !!"), (3, f"{long} {long}"), (4, f"{long}x {long}x"), (5, "Straßen STRAßEN straßen Ärzteschaft ärzteschaft Ärzteschaft"), (5, "straßen"), (None, "straßen straßen"), (6, "short a bc")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling.op13_spelling(spark, str(tmp_path))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == plain(rows)
    table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert spelling.op13_spelling(spark, f"{tmp_path}/none").count() == 0


def test_pairs_in_a_group():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([5, 6]))) for _ in range(60)})
    for own in (words, words[:6], words[:2], [w for w in words if len(w) == 6]):
        got = {tuple(sorted((own[i], own[j]))) for i, j in spelling.near_in_group(own, 5)}
        want = {(a, b) for a in own for b in own if a < b and near(a, b) and min(len(a), len(b)) == 5}
        assert got == want
