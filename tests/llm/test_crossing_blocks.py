"""Large nodes of op5's trees whose classes lie in several components: rows, and pairs that meet."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import near_duplicates
from millrace.llm.common import Workspace


def node(spark, n, home, pivot):
    """A large node of n classes, of which `home` lie in one component and the others in none."""
    groups = spark.createDataFrame([(i // 128, i, pivot) for i in range(n)], "grp long, set_id long, pivot long")
    labels = spark.createDataFrame([(i, n - home) for i in range(n - home, n)], "node long, label long")
    return groups, labels


def test_rows_of_a_large_node(spark):
    """A pivot outside the largest component: before, each of 3,000 classes met six blocks twice."""
    groups, labels = node(spark, 3000, 1500, 0)
    assert near_duplicates._crossing_blocks(groups, labels, Workspace(spark, "crossing")).count() <= 3000


@pytest.mark.parametrize("home", [1, 30, 75])
def test_pairs_meet_once(spark, monkeypatch, home):
    monkeypatch.setattr(near_duplicates, "WIDE", 16)
    groups, labels = node(spark, 80, home, 3)
    met, by = Counter(), defaultdict(list)
    for r in near_duplicates._crossing_blocks(groups, labels, Workspace(spark, "crossing")).collect():
        by[r["grp"]].append((r["set_id"], r["label"], r["side"]))
    for rows in by.values():
        met.update(tuple(sorted((a, b))) for (a, x, s), (b, y, t) in itertools.combinations(rows, 2) if x != y and (s != t or s == 0))
    label = lambda i: 80 - home if i >= 80 - home else i
    assert met == Counter(p for p in itertools.combinations(range(80), 2) if label(p[0]) != label(p[1]))


def test_involved_cuts_groups_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CROSS", 8)
    rng, draw = np.random.default_rng(7), random.Random(7)
    base = rng.integers(1 << 30, size=near_duplicates.COORDS)
    rows = [(g, i, [int(x) if rng.random() < 0.8 else int(rng.integers(1 << 30)) for x in base], 100, draw.randrange(30), draw.randrange(3)) for g in range(3) for i in range(40 * g, 40 * g + 40)]
    least = 64 * (0.8 - 4.5 * (0.8 * 0.2 / 64) ** 0.5)
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[4] != b[4] and (a[5] != b[5] or a[5] == 0) and sum(x == y for x, y in zip(a[2], b[2], strict=True)) >= least}
    by = defaultdict(list)
    for r in near_duplicates.involved(spark.createDataFrame(rows, "grp long, set_id long, tokens array<int>, n_shingles long, label long, side int"), 0.8).collect():
        by[r["grp"]].append(r)
    met = Counter()
    for held in by.values():
        assert max(Counter(r["side"] for r in held).values()) <= 8
        met.update(tuple(sorted((a["set_id"], b["set_id"]))) for a, b in itertools.combinations(held, 2) if a["label"] != b["label"] and (a["side"] != b["side"] or a["side"] == 0))
    assert want and want <= set(met) and max(met[p] for p in want) == 1
