"""The heavy-light set join against plain comparison of all pairs, and the registered query against its contract."""

import random
import re

import pytest

from millrace.llm import ngram_join

ROWS = "doc_id long, text string, lang string, source string, n_chars long, cls int, prefix string"


def plain(rows, k, num, den):
    """(doc_id, size, component) with all pairs of texts compared."""
    sets, component = [], {}
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            component[g] = min(component.get(g, d), d)
    return sorted((d, len(s), component.get(g)) for (d, _), s, g in zip(rows, sets, group, strict=True) if d is not None)


def got(frame):
    assert frame.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    return sorted(tuple(r) for r in frame.collect() if r[0] is not None)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 1, 2, "x") for i, t in rows], ROWS)


def near_copies(rng, n):
    """Texts of all sizes in families whose members lie around the threshold, with passages that many share."""
    passage = " ".join(f"p{i}" for i in range(30))
    out = []
    for f in range(n):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 3, 4, 5, 9, 10, 11, 13, 15, 16, 17, 20, 24, 30, 45, 60, 120, 300]))]
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(own) + 1)
                if rng.random() < 0.5:
                    own.insert(at, f"x{rng.randrange(99)}")
                elif len(own) > 1:
                    own.pop(min(at, len(own) - 1))
            out.append(" ".join(own) + (" " + passage if f % 3 == 0 else ""))
    return out


@pytest.mark.parametrize("k, num, den, light", [(4, 85, 100, None), (4, 85, 100, 0), (4, 85, 100, 24), (2, 80, 100, 16)])
def test_join_matches_all_pairs(spark, monkeypatch, k, num, den, light):
    if light is not None:
        monkeypatch.setattr(ngram_join, "boundary_of", lambda *_: light)
    rng = random.Random(k + num)
    rows = list(enumerate(near_copies(rng, 70)))
    assert got(ngram_join.ngram_components(table(spark, rows), k, num, den)) == plain(rows, k, num, den)


@pytest.mark.parametrize("pairs", [2, 0])
def test_long_lists_in_blocks(spark, monkeypatch, pairs):
    """One large family: chains of texts that don't link with its least member, in lists of many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "PAIRS_A_SET", pairs)
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 4)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(200):
        own = list(base)
        for at in range(i % 40):  # each step of a chain changes a little more
            own[at] = f"v{at}"
        if i % 7 == 0:
            own[rng.randrange(60)] = f"z{i}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert got(ngram_join.ngram_components(table(spark, rows), 4, 85, 100)) == plain(rows, 4, 85, 100)


def test_query_and_edges(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "two one"), (6, long), (7, long + " end"), (8, long[: len(long) // 2]), (9, "x" * 1_000_000), (9, "x" * 1_000_000), (10, "Ä b c d e"), (11, "ä b c d e"), (None, "one two"), (None, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = ngram_join.op12_ngram_join(spark, str(tmp_path))
    assert found.count() == len(rows)
    assert got(found) == plain(rows, 4, 85, 100) and (4, 1, 3) in got(found) and (7, 59_998, 6) in got(found)
    assert sorted((r["n_shingles"], r["component_id"]) for r in found.collect() if r["doc_id"] is None) == [(0, None), (1, 3)]
    table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert got(ngram_join.op12_ngram_join(spark, f"{tmp_path}/none")) == []


def test_boundary_follows_costs():
    few, many = {10: 5, 12: 5, 20: 5}, {n: 1_000 for n in range(1, 25)}
    assert ngram_join.boundary_of(few, 1_000.0, 85, 100) >= 20
    assert ngram_join.boundary_of(many, 0.01, 85, 100) <= 6
    assert 6 < ngram_join.boundary_of(many, 8.0, 85, 100) < 24


def test_subsets_name_every_pair():
    """Two sets of light sizes share a subset's name exactly where their overlap suffices, for every pair of sizes."""
    for a in range(1, 25):
        for b in range(a, 25):
            c = ngram_join.least_overlap(a, b, 85, 100)
            assert ((a, b, c) in ngram_join.subset_sizes(a, 24, 85, 100)) == (c <= a and c < b) == ((a, b, c) in ngram_join.subset_sizes(b, 24, 85, 100))
