"""Approximate nearest neighbours by inner product: random-projection trees with a shared priority queue.

Equal vectors form a class; only classes are indexed, each with its `top` + 1 smallest ids, which is all that
a list of `top` neighbours can name of it (ties go to the smaller id and only the query itself is left out).

Index. Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so that the largest inner
product is the smallest distance (queries have 0 there). A tree projects on one direction a level (differences
of random members of a bounded, hash-chosen sample, made orthogonal) and cuts every node at its median. Trees are
split until a leaf holds about LEAF vectors. The upper levels take their medians from the sample; levels for which
the sample is too thin take them from all vectors, by one distributed aggregate a level.

Search. A query descends all trees at once through one priority queue, ordered by the sum of the distances to
the splits that a path crosses to the far side, and takes the first `budget` leaves. The budget is measured:
for a bounded sample of the queries the true neighbours are found by comparing them with all vectors, and the
budget is the number of leaves after which the queue has met a share `target` of them. So clustered vectors
are asked in few leaves, and vectors without structure in as many as the recall takes.

Neighbouring leaves of a tree lie together in cells of about CELL vectors, cut by a hash where a cell is larger;
a task holds the vectors of one cell part and streams the queries that chose leaves of it. Scores are computed in
double precision on the original vectors, each keeps its `top` + 1 best ids, and lists are merged by query.
Cells are asked in rounds, and a query brings to each the worst score of its full list, its floor; a cell names only ids
that reach it. The first tree's rounds take layers of the vectors, chosen by a hash: CELL vectors, then each three times as
many as all before, so that about 3 * `top` of a layer reach the floor whatever its size; the other trees, which mostly find
the same vectors again, follow in one round. So the rows that cells make grow with the queries and the logarithm of the
vectors, and lists are the same as if every cell had sent its best.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; fewer candidates than `top` gives them all; rows that repeat a vec_id count as one neighbour, at their
best score, and each query row gets its own list; an empty table or no query gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Workspace, read_table

TOP = 20
TREES = 4
#: Vectors that directions and upper medians are fitted to.
FIT_VECTORS = 16_384
#: Sample members that a node's median needs at least; thinner nodes are split on all vectors.
FIT_MEMBERS = 16
LEAF = 100
#: Bounds the broadcast trees: 2^20 numbers a tree.
MOST_LEVELS = 20
CELL = 8_192
#: Queries whose true neighbours set the budget, and the share of those that the leaves have to meet.
MEASURED = 256
TARGET = 0.95


class Forest:
    """For each tree the directions of its levels and, for each level, the cuts of its nodes."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.directions, self.cuts = [], []
        for _ in range(trees):
            rows = []
            while len(rows) < MOST_LEVELS:
                k = min(width, MOST_LEVELS - len(rows))
                pairs = rng.integers(len(sample), size=(2, k))
                rows += list(np.linalg.qr((sample[pairs[0]] - sample[pairs[1]] + 1e-9 * rng.normal(size=(k, width))).T)[0].T)
            self.directions.append(np.array(rows))
            self.cuts.append([])
            p = sample @ self.directions[-1].T
            node = np.zeros(len(sample), np.int64)
            for level in range(levels):
                order = np.lexsort((p[:, level], node))
                n = np.bincount(node, minlength=1 << level)
                middle = np.minimum(np.cumsum(n) - n + n // 2, len(sample) - 1)
                self.cuts[-1].append(p[order, level][middle])
                node = 2 * node + (p[:, level] >= self.cuts[-1][-1][node])

    @property
    def levels(self) -> int:
        return len(self.cuts[0])

    def project(self, x: np.ndarray, tree: int) -> np.ndarray:
        return x @ self.directions[tree].T

    def route(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each vector."""
        p, node = self.project(x, tree), np.zeros(len(x), np.int64)
        for level, cuts in enumerate(self.cuts[tree]):
            node = 2 * node + (p[:, level] >= cuts[node])
        return node

    def order(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue."""
        queue = [(0.0, t, 0, 0) for t in range(len(self.cuts))]
        own = [(x @ q).tolist() for x in self.directions]
        levels, push = self.levels, heapq.heappush
        while queue:
            off, t, level, node = heapq.heappop(queue)
            p, cuts = own[t], self.cuts[t]
            while level < levels:
                m = p[level] - cuts[level][node]
                level += 1
                near = 2 * node + (m >= 0)
                push(queue, (off + abs(m), t, level, near ^ 1))
                node = near
            yield t, node


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the usable vectors, in their own precision."""
    element = table.schema[vector].dataType.elementType
    v = F.col(vector).cast("array<float>" if isinstance(element, FloatType) else "array<double>")
    usable = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    usable = usable.filter(F.size("v") == (sizes[0] if sizes else 0))
    return usable.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(v_type(usable))).otherwise(x)))  # -0.0 is 0.0


def v_type(table: DataFrame) -> str:
    return table.schema["v"].dataType.elementType.simpleString()


def search(table: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", top: int = TOP, target: float = TARGET, leaf: int = LEAF, cell: int = CELL, fit_vectors: int = FIT_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with is_query(key column), its nearest other rows."""
    spark = table.sparkSession
    work = Workspace(spark, "nearest")
    rows = _vectors(table, key, vector)
    # a vector that a third of all rows share sends `top` + 1 rows a task: the rank's limit is applied before the shuffle
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("k") <= top + 1)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    classes = work.save(few.groupBy("v").agg(F.collect_set("id").alias("ids")).select("v", "ids", square.alias("square")), "classes")
    asked = rows.filter(is_query(F.col("id")))
    queries = work.save(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("q"), "v"), "queries")
    n, norm = classes.agg(F.count("*"), F.max("square")).first()
    n_queries = queries.count()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def lift(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(norm - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)

    part_of = lambda df, most, total: df if total <= most else df.filter(F.pmod(F.xxhash64(F.lit("fit"), "v"), F.lit(1 << 30)) < int(most / total * (1 << 30)))
    sample = np.array([r[0] for r in part_of(classes, fit_vectors, n).select("v").orderBy("v").limit(2 * fit_vectors).collect()], float)  # 2 * fit_vectors rows at most
    wanted = min(MOST_LEVELS, max(0, math.ceil(math.log2(n / leaf))))
    forest = Forest(lift(sample), TREES, min(wanted, max(0, int(math.log2(max(1, len(sample) / FIT_MEMBERS))))))
    while forest.levels < wanted:
        _split_on(classes, forest, lift)
    sent = spark.sparkContext.broadcast(forest)  # TREES * 2^MOST_LEVELS numbers at most
    budget = _budget(classes, part_of(queries, MEASURED, n_queries), sent, lift, top, target)
    v = f"array<{v_type(queries)}>"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tree of which the query takes leaves."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = batch.slice(lo, 256)
                row, tree, leaves = [], [], []
                for i, x in enumerate(_matrix(own.column(1))):
                    chosen: dict[int, list[int]] = {}
                    for k, (t, at) in enumerate(sent.value.order(np.append(x, 0.0))):
                        if k == budget:
                            break
                        chosen.setdefault(t, []).append(at)
                    row += [i] * len(chosen)
                    tree += chosen
                    leaves += chosen.values()
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), own.column(0).take(at), own.column(1).take(at), pa.array(leaves, pa.list_(pa.int64()))], ["tree", "q", "v", "leaves"])

    taken = work.save(queries.mapInArrow(ask, f"tree int, q long, v {v}, leaves array<long>"), "taken")
    none = lambda kind: F.lit(None).cast(kind)

    def dealt(members: DataFrame, trees: list[int], size: float, best: DataFrame | None) -> DataFrame:
        """The cells of these members (v, ids; about `size`) in these trees, each with the queries that ask it."""
        shift = min(forest.levels, max(0, int(math.log2(max(1, cell / (size / (1 << forest.levels)))))))

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lifted = lift(_matrix(batch.column(0)))
                for t in trees:
                    at = sent.value.route(lifted, t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at >> shift), pa.array(at), *batch.columns], ["tree", "cell", "leaf", "v", "ids"])

        def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    own = batch.slice(lo, 256)
                    row, cells, leaves = [], [], []
                    for i, found in enumerate(own.column(3).to_pylist()):
                        found = np.sort(np.array(found, np.int64))
                        first = np.append(0, np.flatnonzero(np.diff(found >> shift)) + 1)
                        row += [i] * len(first)
                        cells += (found[first] >> shift).tolist()
                        leaves += np.split(found, first[1:])
                    at = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([own.column(0).take(at), pa.array(cells, pa.int64()), own.column(1).take(at), own.column(2).take(at), own.column(4).take(at), pa.array(leaves, pa.list_(pa.int64()))], ["tree", "cell", "q", "v", "floor", "leaves"])

        vectors = members.select("v", "ids").mapInArrow(index, f"tree int, cell long, leaf long, v {v}, ids array<long>")
        # cells that ties or thin medians made larger than a task should hold are cut by a hash
        large = vectors.groupBy("tree", "cell").count().filter(F.col("count") > 2 * cell).select("tree", "cell", F.ceil(F.col("count") / cell).alias("parts"))
        large = work.save(large, "large")
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        held = vectors.join(large, ["tree", "cell"], "left").select("tree", "cell", F.pmod(F.xxhash64("v"), parts).alias("part"), F.lit(0).alias("kind"), "leaf", none("long").alias("q"), "v", "ids", none("double").alias("floor"))
        asking = taken.filter(F.col("tree").isin(trees))
        if best is None:
            asking = asking.withColumn("floor", F.lit(float("-inf")))
        else:
            full = best.groupBy("q").agg(F.min("score").alias("floor"), F.count("*").alias("found")).filter(F.col("found") > top).select("q", "floor")
            asking = asking.join(full, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        sought = asking.select("tree", "q", "v", "leaves", "floor").mapInArrow(by_cell, f"tree int, cell long, q long, v {v}, floor double, leaves array<long>").join(large, ["tree", "cell"], "left")
        sought = sought.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select("tree", "cell", "part", F.lit(1).alias("kind"), none("long").alias("leaf"), "q", "v", F.col("leaves").alias("ids"), "floor")
        return held.unionByName(sought).repartition("tree", "cell", "part").sortWithinPartitions("tree", "cell", "part", "kind", "leaf")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell part lie together, its vectors (by leaf) before its queries."""
        now, pieces, ready = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)] if len(key) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (here := tuple(key[a, :3])) != now:
                    now, pieces, ready = here, [], None
                own = batch.slice(a, b - a)
                if key[a, 3] == 0:
                    pieces.append(own)
                    continue
                if not pieces:
                    continue
                ready = ready or _Cell(pa.Table.from_batches(pieces))
                for lo in range(0, b - a, 256):
                    yield ready.best(own.slice(lo, 256), top + 1)

    # where the layers of the first tree end, as shares of all vectors
    ends = [0.0, *[share for k in range(MOST_LEVELS) if (share := cell * 4**k / n) < 1], 1.0]
    place = F.pmod(F.xxhash64(F.lit("layer"), "v"), F.lit(1 << 30)) / (1 << 30)
    rounds = [(classes.filter((place >= a) & (place < b)), [0], (b - a) * n) for a, b in zip(ends[:-1], ends[1:], strict=True)] + [(classes, list(range(1, TREES)), n)]
    best = None
    for members, trees, size in rounds:
        found = dealt(members, trees, size, best).mapInArrow(rank, "q long, id long, score double")
        both = found if best is None else found.unionByName(best)
        scored = both.groupBy("q", "id").agg(F.max("score").alias("score"))
        now = work.save(scored.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("k") <= top + 1).drop("k"), "best")
        if best is not None:
            work.drop(best)
        best = now
    work.drop(taken)
    listed = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "id"))).alias("near"))
    named = queries.join(listed, "q").select("v", "near")
    out = asked.join(named, "v").select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, top).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.d")).alias("score"))


class _Cell:
    """The vectors of one cell part, sorted by leaf, each with its ids."""

    def __init__(self, table: pa.Table):
        self.x = _matrix(table.column("v").combine_chunks())
        self.leaves, self.column = np.unique(table.column("leaf").to_numpy(), return_inverse=True)
        ids = table.column("ids").combine_chunks()
        self.ids, self.first = ids.flatten().to_numpy(), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))

    def best(self, queries: pa.RecordBatch, most: int) -> pa.RecordBatch:
        """(q, id, score) of each query's best ids in the leaves it chose, ties by id; none that its floor exceeds."""
        q = _matrix(queries.column("v"))
        chosen = queries.column("ids")
        owner = np.repeat(np.arange(len(q)), chosen.value_lengths().to_numpy())
        leaf = chosen.flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.leaves, leaf), len(self.leaves) - 1)
        hit = self.leaves[at] == leaf
        mask = np.zeros((len(q), len(self.leaves)), bool)
        mask[owner[hit], at[hit]] = True
        scores = np.where(mask[:, self.column], q @ self.x.T, -np.inf)
        k = min(most, scores.shape[1])
        least = np.maximum(-np.partition(-scores, k - 1, axis=1)[:, k - 1], queries.column("floor").to_numpy())
        names = queries.column("q").to_pylist()
        out: list[list[np.ndarray]] = [[], [], []]
        for i in range(len(q)):
            j = np.flatnonzero((scores[i] >= least[i] - 1e-9) & (scores[i] > -np.inf))  # products may differ in their last bits by place
            exact = (self.x[j] * q[i]).sum(axis=1)
            n = self.first[j + 1] - self.first[j]
            ids = self.ids[np.repeat(self.first[j] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            exact = np.repeat(exact, n)
            kept = np.lexsort((ids, -exact))[:most]
            for column, value in zip(out, (np.full(len(kept), names[i]), ids[kept], exact[kept]), strict=True):
                column.append(value)
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([e, *c])) for e, c in zip(empty, out, strict=True)], ["q", "id", "score"])


def _split_on(classes: DataFrame, forest: Forest, lift) -> None:
    """One more level of every tree, cut at the medians of all vectors; one row a node comes back."""
    level = forest.levels
    sent = classes.sparkSession.sparkContext.broadcast(forest)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lift(_matrix(batch.column(0)))
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(sent.value.route(x, t)), pa.array(sent.value.project(x, t)[:, level])], ["tree", "node", "p"])

    found = classes.select("v").mapInArrow(places, "tree int, node long, p double").groupBy("tree", "node").agg(F.percentile_approx("p", 0.5, 1000).alias("cut"))
    cuts = np.zeros((TREES, 1 << level))
    for tree, node, cut in found.collect():  # TREES * 2^level rows, bounded by MOST_LEVELS
        cuts[tree, node] = cut
    for t in range(TREES):
        forest.cuts[t].append(cuts[t])
    sent.unpersist()


def _budget(classes: DataFrame, queries: DataFrame, sent, lift, top: int, target: float) -> int:
    """Leaves after which the queue has met a share `target` of the true neighbours of these queries (bounded by MEASURED)."""
    spark = classes.sparkSession
    asked = queries.select("q", "v").orderBy("q").limit(2 * MEASURED).collect()
    if not asked:  # the hash chose none of a few queries
        return len(sent.value.cuts) << sent.value.levels
    matrix = spark.sparkContext.broadcast(np.array([r["v"] for r in asked], float))  # 2 * MEASURED vectors at most

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            scores = matrix.value @ x.T
            for row, q in zip(scores, matrix.value, strict=True):  # a query isn't its own neighbour
                like = np.flatnonzero(row >= q @ q - 1e-9)
                row[like[(x[like] == q).all(axis=1)]] = -np.inf
            k = min(top, len(x))
            at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            lifted = lift(x)
            routes = np.stack([sent.value.route(lifted, t) for t in range(TREES)], axis=1)
            flat = at.ravel()
            score = np.take_along_axis(scores, at, axis=1).ravel()
            keep = score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(scores)), k)[keep]), pa.array(score[keep]), pa.array(list(routes[flat[keep]]), pa.list_(pa.int64()))], ["i", "score", "leaves"])

    near = classes.select("v").mapInArrow(nearest, "i long, score double, leaves array<long>")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "leaves"))).filter(F.col("k") <= top)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting = [set(enumerate(x)) for x in near]
                for k, leaf in enumerate(sent.value.order(np.append(matrix.value[i], 0.0))):
                    out += [k + 1] * sum(leaf in x for x in waiting)
                    waiting = [x for x in waiting if leaf not in x]
                    if not waiting:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["place"])

    met = near.groupBy("i").agg(F.collect_list("leaves").alias("near")).mapInArrow(places, "place long").toPandas()["place"].to_numpy()  # top numbers a measured query
    return int(np.quantile(met, target, method="higher")) if len(met) else 1


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), lambda key: F.pmod(key, F.lit(20)) == 0)
