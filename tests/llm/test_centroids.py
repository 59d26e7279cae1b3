"""Exponion search against plain Lloyd's rounds, and the registered query against its contract."""

import hashlib
import math
import random

import numpy as np
import pytest

from millrace.llm import centroids
from millrace.llm.common import Workspace

ROWS = "vec_id long, embedding array<float>, label int, v string, cluster string"


def plain(rows, k, rounds, seed=3, scale=1024):
    """{vec_id: (cluster, distance)} and the last centroids, with Python's integers."""
    vectors = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    at = [v for _, v in sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = {}
        for _, v in vectors:
            own.setdefault(nearest(v)[1], []).append(v)
        at = [[sum(x) // len(x) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(at)]
    return [(i, *nearest(v)[::-1]) for i, v in vectors], at


def table(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], ROWS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_query_matches_plain_rounds(spark, tmp_path):
    rng = random.Random(4)
    middle = [[rng.uniform(-0.5, 0.5) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.08) for x in middle[i % 12]]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(3, rows[3][1])]  # copies, a repeated row
    bad = [(2000, None), (2001, [0.1] * 63), (2002, [0.1] * 65), (2003, [None] + [0.1] * 63), (2004, [math.nan] + [0.1] * 63), (2005, [-math.inf] + [0.1] * 63), (2006, [])]
    got = centroids.op11_centroids(spark, table(spark, tmp_path, rows + bad))
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    want, at = plain(rows, 8, 10)
    sums = {j: sum(d for _, c, d in want if c == j) for j in range(8)}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    assert sorted(map(tuple, got.collect())) == sorted((i, j, d, sums[j], sum(sums.values()), names[j]) for i, j, d in want)


def test_ties_empty_clusters_and_few_vectors(spark, tmp_path):
    # two places, many copies: most of eight centroids lie at the same place, the smaller number takes all
    rows = [(i, [0.5 if i % 2 else -0.5] * 64) for i in range(40)] + [(99, [0.0] * 64)]
    got = centroids.op11_centroids(spark, table(spark, tmp_path / "a", rows)).collect()
    want, _ = plain(rows, 8, 10)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want) and len({r["cluster"] for r in got}) < 8
    few = [(1, [0.25] * 64), (2, [-1.0] * 64), (None, [0.25] * 64)]
    got = centroids.op11_centroids(spark, table(spark, tmp_path / "b", few)).collect()
    assert len(got) == 3 and all(r["distance"] == 0 for r in got) and {r["cluster"] for r in got} <= {0, 1, 2}
    empty = centroids.op11_centroids(spark, table(spark, tmp_path / "c", []))
    assert empty.count() == 0 and len(empty.columns) == 6
    huge = [(1, [1e30] * 64), (2, [-1e30] + [3e15] * 63), (3, [0.0] * 64), (4, [7e8] * 64)]
    got = {r["vec_id"]: r for r in centroids.op11_centroids(spark, table(spark, tmp_path / "d", huge * 9)).collect()}
    assert set(got) == {1, 2, 3, 4} and all(0 <= r["distance"] <= centroids.LARGEST for r in got.values())


@pytest.mark.parametrize("k", [1, 2, 40])
def test_many_clusters(spark, k):
    rng = np.random.default_rng(k)
    x = np.floor(rng.integers(-6, 7, (20, 3))[rng.integers(0, 20, 700)] * 5 + rng.integers(-3, 4, (700, 3))).astype(np.int64)
    work = Workspace(spark, "test")
    vectors = work.save(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<bigint>"), "vectors")
    found, at = centroids.cluster(vectors, x[:k], 6, work)
    now = x[:k].copy()
    for _ in range(6):
        own = ((x[:, None] - now[None]) ** 2).sum(-1).argmin(1)
        now = np.array([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else now[j] for j in range(k)])
    d2 = ((x[:, None] - now[None]) ** 2).sum(-1)
    assert at.tolist() == now.tolist()
    assert sorted(map(tuple, found.collect())) == [(i, int(d2[i].argmin()), int(d2[i].min())) for i in range(len(x))]
    with pytest.raises(ValueError):
        centroids.cluster(vectors, np.zeros((centroids.MOST_CLUSTERS + 1, 3), np.int64), 1, work)


def test_search_scans_few_centroids():
    """In well-parted data the bounds and balls save nearly all distances once centroids have settled."""
    rng = np.random.default_rng(8)
    at = rng.integers(-10_000, 10_000, (256, 8))
    own = rng.integers(0, 256, 5_000)
    x = at[own] + rng.integers(-60, 60, (5_000, 8))
    g = centroids.Geometry.of(at, at)
    found, upper, lower, first = centroids.search(x, np.zeros(5_000, np.int64), np.full(5_000, np.inf), np.zeros(5_000), g)
    assert (found == ((x[:, None] - at[None]) ** 2).sum(-1).argmin(1)).all()
    _, _, _, again = centroids.search(x, found, upper, lower, g)
    _, _, _, near = centroids.search(x, found, np.full(5_000, np.inf), np.zeros(5_000), g)
    assert first >= 256 * 4_900 and again == 0 and near < 0.05 * first
