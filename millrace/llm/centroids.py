"""Centroid clustering: Lloyd's rounds with exponion search (Newling and Fleuret 2016).

Vectors of integers lie in a table with what is known of each: its cluster, an upper bound of the distance to that
centroid and a lower bound of the distance to any other. A round reads the table once, in Arrow batches:

1. The bounds move by as much as the centroids have. Where the upper bound is below the lower one, or below half the
   distance from the centroid to its nearest other, the vector stays, and no distance is computed.
2. Else the own distance u is computed. If that doesn't settle it, the nearest and the second nearest centroid lie in
   the ball of radius 2 u + s around the own centroid, s being that one's distance to its nearest other. Each centroid has
   a list of all others sorted by distance, so a binary search tells which to scan. The ball includes its border, and
   bounds are rounded outwards, so that a tie is always seen; it goes to the smaller number.
3. Sums change by the vectors that changed cluster only: each task adds up its own, and the driver gets one
   row for each cluster and component.

Distances are exact integers, in double precision where that holds them, else as Python's integers. The driver
and every task hold the centroids and the distances between them: k * (k + d) numbers, k being a parameter of at
most MOST_CLUSTERS. Nothing else leaves the tasks, no vector is shuffled, and the table of the round before is deleted.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part and have no row.
Repeated rows are clustered each. A null vec_id takes part, and comes last in the choice of first centroids; equal ids
are ordered by their vectors. Fewer vectors than clusters: as many clusters as vectors. Ties go to the smaller number. An empty
cluster keeps its centroid. Components beyond 2^62 count as 2^62; distances and inertias beyond a long are given as the
largest long. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read_table

MOST_CLUSTERS = 2_048
#: Components are cut here, so that they fit a long.
MOST = 1 << 62
LARGEST = (1 << 63) - 1
#: Relative slack by which bounds are rounded outwards; double precision errs by far less.
SLACK = 1e-9
STATE = "vec_id long, v array<bigint>, before int, cluster int, upper double, lower double"


def in_doubles(d: int) -> int:
    """Components up to this have all squared distances, and what is added up for them, exact in double precision."""
    return math.isqrt((1 << 53) // (8 * max(d, 1)))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c, both int64."""
    most = in_doubles(c.shape[1])
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= most:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
    x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def squared_own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to the same row of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= in_doubles(x.shape[1]):
        return ((x - c) ** 2).sum(axis=1).astype(np.float64)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(axis=1)


def root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


@dataclass
class Geometry:
    """Centroids of a round: their sorted lists of others, the distance to the nearest other, and how far each has moved."""

    at: np.ndarray
    order: np.ndarray
    apart: np.ndarray
    nearest: np.ndarray
    moved: np.ndarray
    moved_other: np.ndarray

    @staticmethod
    def of(at: np.ndarray, before: np.ndarray) -> Geometry:
        k = len(at)
        between = root(squared(at, at))
        np.fill_diagonal(between, -1)  # itself comes first, before centroids at the same place
        order = np.argsort(between, axis=1, kind="stable").astype(np.int32)
        apart = np.take_along_axis(between, order, axis=1)
        moved = root(squared_own(at, before))
        other = np.array([np.delete(moved, j).max(initial=0) for j in range(k)]) if k <= 2 else _largest_other(moved)
        return Geometry(at, order, apart, apart[:, 1] if k > 1 else np.full(k, np.inf), moved, other)


def _largest_other(moved: np.ndarray) -> np.ndarray:
    first, second = np.argsort(-moved, kind="stable")[:2]
    out = np.full(len(moved), moved[first])
    out[first] = moved[second]
    return out


def search(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New cluster and bounds of the rows of x, and how many distances were computed."""
    own = own.copy()
    upper = (upper + g.moved[own]) * (1 + SLACK)
    lower = lower - g.moved_other[own] - SLACK * (np.abs(lower) + g.moved_other[own])
    half = g.nearest[own] / 2 * (1 - SLACK)
    left = np.flatnonzero(~(upper < np.maximum(lower, half)))
    computed = len(left)
    upper[left] = root(squared_own(x[left], g.at[own[left]])) * (1 + SLACK)
    left = left[~(upper[left] < np.maximum(lower[left], half[left]))]
    # how much of the own centroid's list lies in the ball; rows of one centroid and about as long a list are scanned together
    reach = np.empty(len(left), np.int64)
    ball = (2 * upper[left] + g.nearest[own[left]]) * (1 + SLACK)
    for a in np.unique(own[left]):
        mine = own[left] == a
        reach[mine] = np.searchsorted(g.apart[a], ball[mine], side="right")
    level = np.ceil(np.log2(np.maximum(reach, 1))).astype(np.int64)
    start = own[left].astype(np.int64)
    for both in np.unique(start * 64 + level):
        rows = left[start * 64 + level == both]
        columns = g.order[both // 64][: 1 << int(both % 64)]
        for i in range(0, len(rows), max(1, (1 << 20) // len(columns))):
            part = rows[i : i + max(1, (1 << 20) // len(columns))]
            d2 = squared(x[part], g.at[columns])
            computed += d2.size
            least = d2.min(axis=1)
            own[part] = np.where(d2 == least[:, None], columns[None, :], len(g.at)).min(axis=1)
            upper[part] = root(least) * (1 + SLACK)
            d2[np.arange(len(part)), np.argmax(columns[None, :] == own[part][:, None], axis=1)] = LARGEST * LARGEST if d2.dtype == object else np.inf
            lower[part] = root(d2.min(axis=1)) * (1 - SLACK) if len(columns) > 1 else np.inf
    return own, upper, lower, computed


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def assign(state: DataFrame, g: Geometry) -> DataFrame:
    """The state after one more assignment."""
    held = state.sparkSession.sparkContext.broadcast(g)  # k * (k + d) numbers, k <= MOST_CLUSTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                before, upper, lower = (b.column(i).to_numpy() for i in (3, 4, 5))
                own, upper, lower, _ = search(_matrix(b.column(1)), before, upper, lower, held.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(before), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower)], ["vec_id", "v", "before", "cluster", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, first: bool) -> DataFrame:
    """(cluster, dim, s): what each cluster's sums and, as the last dim, its count gain; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.concatenate((_matrix(b.column(0)), np.ones((b.num_rows, 1), np.int64)), axis=1)
            x = x.astype(object) if np.abs(x).max() > 1 << 40 else x
            for sign, column in ((1, b.column(2)),) if first else ((1, b.column(2)), (-1, b.column(1))):
                names = column.to_numpy()
                for c in np.unique(names):
                    sums[int(c)] = sums.get(int(c), 0) + sign * x[names == c].sum(axis=0).astype(object)
        for c, s in sums.items():
            values = [str(t) for t in s]
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)], ["cluster", "dim", "s"])

    moved = state.select("v", "before", "cluster")
    moved = moved if first else moved.filter("cluster <> before")
    return moved.mapInArrow(run, "cluster int, dim int, s string").groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def cluster(vectors: DataFrame, first: np.ndarray, rounds: int, work: Workspace) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of vectors (vec_id, v) after so many rounds from the centroids `first` (k x d), and the last centroids."""
    if not 0 < len(first) <= MOST_CLUSTERS:
        raise ValueError(f"1 to {MOST_CLUSTERS} clusters, not {len(first)}")
    at, before = first, first
    totals = np.zeros((len(first), first.shape[1] + 1), object)
    state = vectors.select("vec_id", "v", F.lit(-1).alias("before"), F.lit(0).alias("cluster"), F.lit(math.inf).alias("upper"), F.lit(0.0).alias("lower"))
    for n in range(rounds):
        after = work.save(assign(state, Geometry.of(at, before)), f"round{n}")
        work.drop(state)
        state = after
        gained = changes(state, n == 0).collect()  # k * (d + 1) rows at most
        if not gained and n:
            before = at
            break  # nothing moved: the centroids are those of the round before, and further rounds change nothing
        for c, dim, s in gained:
            totals[c, dim] += int(s)
        at, before = np.array([[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else old for row, old in zip(totals, at.tolist(), strict=True)], np.int64), at
    state = work.save(assign(state, Geometry.of(at, before)), "last")
    held = vectors.sparkSession.sparkContext.broadcast(at)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d2 = squared_own(_matrix(b.column(1)), held.value[b.column(2).to_numpy()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([min(int(d), LARGEST) for d in d2], pa.int64())], ["vec_id", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(measured, "vec_id long, cluster int, distance long"), at


def whole_vectors(table: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of `dims` finite components, as floor(scale * x)."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf))
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(c.cast("double") * float(scale)), F.lit(-MOST)), F.lit(MOST)))
    return table.filter(x.isNotNull() & (F.size(x) == dims) & ~bad).select(F.col("vec_id").cast("long"), whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest sha256 with the seed: a top-k of each task, then of those."""
    rows = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def clustered(vectors: DataFrame, k: int, rounds: int, seed: int, work: Workspace) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of vectors (vec_id, v), a table that can be read again."""
    spark = vectors.sparkSession
    first = first_centroids(vectors, k, seed)
    if not len(first):
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    found, at = cluster(vectors, first, rounds, work)
    found = work.save(found, "clusters")
    sums = {c: int(s) for c, s in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows at most
    total = min(sum(sums.values()), LARGEST)
    names = spark.createDataFrame([(c, min(s, LARGEST), total, hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "centroids")
    vectors = work.save(whole_vectors(read_table(spark, sf_dir, "embeddings"), VECTOR, 64, 1024), "vectors")
    return clustered(vectors, 8, 10, 3, work)


VECTOR = "embedding"


def _oracle(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The same rounds as a chain of common tables: assignments a0 to a10 and centroids c0 to c10."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform({VECTOR}, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len({VECTOR}) = {dims} AND len(list_filter({VECTOR}, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS j, v AS c FROM v ORDER BY j LIMIT {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{n}) GROUP BY vec_id)")
        if n < rounds:
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT j, list((s - ((s % t) + t) % t) // t ORDER BY i) AS m FROM (SELECT j, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS t FROM (SELECT j, unnest(v) AS x, unnest(range({dims})) AS i FROM a{n}) GROUP BY j, i) GROUP BY j) USING (j))"
            )
    return f"WITH {', '.join(parts)} SELECT vec_id, j::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"


ORACLE = _oracle()
