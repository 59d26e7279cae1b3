"""Cycle paths and fuzzy names against brute force."""

import difflib
import random

import pytest

from millrace.operators import fuzzy, sets


def back(edges, start):
    """The shortest way back by breadth-first search; of several predecessors the least."""
    near = {}
    for a, b in sorted(set(edges)):
        near.setdefault(a, []).append(b)
    if start in near.get(start, ()):
        return [start, start]
    came, level = {}, {b: start for b in near.get(start, ())}
    while level:
        came |= level
        last = sorted(n for n in level if start in near.get(n, ()))
        if last:
            path = [last[0], start]
            while path[0] != start:
                path.insert(0, came[path[0]])
            return path
        level = {b: min(a for a in level if b in near.get(a, ())) for n in level for b in near.get(n, ()) if b not in came}
    return None


@pytest.mark.parametrize("nodes, n", [(8, 12), (30, 45), (60, 200)])
def test_cycle_paths(spark, nodes, n):
    rng = random.Random(n)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)] + [(nodes + i, nodes + i + 1) for i in range(20)] + [(nodes + 20, nodes), (999, 999), (500, 1), (3, 501)]
    got = {r["start"]: r["path"] for r in sets.shortest_cycles(spark.createDataFrame([*edges, *edges[:5], (None, 1), (1, None)], "a long, b long")).collect()}
    want = {a: path for a in {e[0] for e in edges} if (path := back(edges, a))}
    assert got == want and got[999] == [999, 999] and len(got[nodes]) == 22 and 500 not in got


def test_cycles_of_one_way_edges_have_no_cap(spark):
    to = {k: (k * 7 + 3) % 120 for k in range(1, 120)}
    got = {r["start"]: r["path"] for r in sets.shortest_cycles(spark.createDataFrame(list(to.items()), "a long, b long")).collect()}
    assert got == {k: p for k in to if (p := back(list(to.items()), k))} and max(got) >= 50
    assert sets.shortest_cycles(spark.createDataFrame([], "a long, b long")).count() == 0


def names(rng, n):
    base = ["prix de diane", "grand national", "kentucky derby", "tenno sho spring", "tenno sho autumn", "a", "ab", "supplier 001", "supplier 002", "x" * 230 + "yz"]
    out = []
    for _ in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(own) + 1)
            own[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "é", "a"])
        out.append("".join(own))
    return out


@pytest.mark.parametrize("threshold", [0.88, 0.8, 0.7])
def test_similar_texts_are_all_found(spark, threshold):
    rng = random.Random(int(threshold * 100))
    left, right = ([(rng.choice("AB"), x) for x in names(rng, 120)] for _ in range(2))
    got = {(r["region"], r["text"], r["other"]): r["ratio"] for r in fuzzy.similar_texts(spark.createDataFrame(left, "region string, text string"), spark.createDataFrame(right, "region string, text string"), threshold).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(p, a, b): ratio(a, b) for p, a in set(left) for q, b in set(right) if p == q and a != b and a and b and ratio(a, b) >= threshold}
    assert got == want and len(want) > 50
    with pytest.raises(ValueError):
        fuzzy.rare_pairs(spark.createDataFrame(left, "region string, text string"), 0.6)


def test_proposals(spark):
    known = [(1, "jp", "Tenno Sho Spring", None, None), (2, "jp", "Tenno  Sho (Spring)", 1990, 2000), (3, "jp", "Tenno Sho Autumn", None, None), (3, "jp", "Tenno Sho Sprint", 1980, None), (4, "fr", "Prix de Diane", None, None), (5, "jp", "Same Name", None, 1999), (6, "jp", "same name", 2000, None), (7, "jp", "Same Name", 1990, None)]
    asked = [(10, " tenno sho  SPRING", "jp", 1995), (11, "Tenno Sho Sprin", "jp", 1995), (12, "Tenno Sho Sprin", "jp", 1970), (13, "Prix de Diane", "jp", 1995), (14, None, "jp", 1995), (15, "Same Name", "jp", 1995), (16, "Same Name", "jp", 1985), (17, "prix de dianne", "fr", None), (18, "", "fr", 1995), (19, "x", None, 1995)]
    got = {r["request"]: r for r in fuzzy.proposals(spark.createDataFrame(asked, "request long, name string, region string, year int"), spark.createDataFrame(known, "series long, region string, name string, first_year int, last_year int")).collect()}
    ranks = lambda k: [(c["series"], c["score"]) for c in got[k]["candidates"]]
    assert len(got) == len(asked) and (got[10]["status"], got[10]["series"], got[10]["candidates"]) == ("matched", 1, None)
    score = lambda a, b: round(difflib.SequenceMatcher(None, a, b).ratio(), 4)
    one = score("tenno sho sprin", "tenno sho spring")
    assert ranks(11) == [(1, one), (3, one), (2, score("tenno sho sprin", "tenno sho (spring)"))] and ranks(12) == [(1, one)]
    assert [got[k]["reason"] for k in (13, 14, 15, 16, 17, 18, 19)] == ["no_authoritative_mapping"] * 2 + ["ambiguous_exact_name", "exact_historical_name", "fuzzy_match_requires_review"] + ["no_authoritative_mapping"] * 2
    assert ranks(15) == [(5, 1.0), (7, 1.0)] and got[16]["series"] == 5 and ranks(13) == []


def test_registered_mapping_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{sf}/part.parquet").collect()
    got = {r["request"]: r for r in fuzzy.join16_mapping(spark, sf).collect()}
    assert len(got) == len(part) + spark.read.parquet(f"{sf}/supplier.parquet").count()
    for p in part:
        k, name = p["p_partkey"], p["p_name"]
        at, year = k % len(name), 1990 + k % 20
        name = name[:at] + name[at + 1 :] if k % 3 == 0 else name
        name = " ".join(name.lower().split())
        best = {}
        for q in part:
            first = 1985 + q["p_size"] % 10
            if q["p_brand"] == p["p_brand"] and first <= year <= first + 12:
                ratio = difflib.SequenceMatcher(None, name, q["p_name"]).ratio()
                if ratio >= 0.88:
                    best[q["p_size"]] = max(best.get(q["p_size"], 0), ratio)
        exact = sorted(s for s, r in best.items() if r == 1)
        want = ("exact_historical_name", exact[0]) if len(exact) == 1 else ("ambiguous_exact_name" if exact else "fuzzy_match_requires_review" if best else "no_authoritative_mapping", None)
        assert (got[k]["reason"], got[k]["series"]) == want
