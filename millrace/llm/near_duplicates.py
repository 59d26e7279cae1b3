"""Near-duplicate documents: chosen-path set similarity join (Christiani, Pagh and Sivertsen 2018).

1. A document's set of word shingles gets a 128-bit digest and COORDS minwise tokens (the set's MinHash under
   COORDS hash functions). Documents with one set form a class with a number; only classes go on, copies stay members.
2. Trees. In each of `trees` independent trees a node holds classes. A node branches on 1 / threshold
   coordinates in expectation, chosen by a hash of the node; for each chosen coordinate a class goes to the
   child named by its minwise token there. All trees are grown at once, level by level. A node of at most SMALL
   classes is a leaf; one that keeps ALIKE of its parent's classes holds documents that no coordinate parts, and
   isn't branched on any more; so the depth follows from the data, up to LEVELS. Leaves and last nodes whose
   classes are the same as another's are compared once, but each tree branches on its own large nodes: where one
   parts a pair, the others still try. The roots' coordinates are drawn without replacement (up to COORDS trees).
   The number of trees follows from the target recall of a pair at the threshold at the deepest level.
3. Leaves are compared exhaustively on their minwise tokens and set sizes. Pairs that could reach the
   threshold (4.5 standard deviations below it) are candidates; of a leaf with many candidates only a
   spanning forest goes on at first.
4. Candidates are verified on full sets, recomputed from the texts of both. One text a class and hub travels: the
   spokes of a hub (the smaller class of each pair) meet it in chunks of HUB. Texts that no candidate names are
   left out of the shuffle by a bitmap of bounded size.
5. Components of verified links. Where a group has candidates that weren't sent and still holds several components, the
   classes that have a candidate in another component are compared between components (never within one), on
   full sets inside the task: no candidate pair leaves it, only links.

Nodes that stay large hold large groups of alike classes. They are cut to blocks of SMALL / 2 classes which all get
the node's least class as a pivot; classes outside the node's largest component are then compared with every class of
it, on sketches in pairs of blocks of WIDE classes, and what may link goes on in pairs of blocks of CROSS. Each pair of
blocks meets once; the rows of a node are its classes times its blocks, so they still grow with the square of what no
component holds, over WIDE. So no task holds an unbounded group, and no pair is given up for a node's size. Tokens and
full sets are joined once a class, not once a group that holds it. Joins on keys that many rows may share (a class of
copies, a component, a pivot) have a saved table on the other side, so that Spark splits them.

Edge cases: null text and text without words have an empty set, are linked with nothing and are components
of their own; a text of fewer words than a shingle has one shingle, the whole sequence; repeated rows and
equal texts are one class; a null doc_id takes part, but names no component unless all of its are null; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, as_strings, mix64, read_table, row_key, text_slices, white_space_chunks

COORDS = 64
SMALL = 256
LEVELS = 6
#: Share of a parent's classes from which on a child is taken as a group of alike documents.
ALIKE = 0.85
RECALL = 0.9999
#: Spokes that meet a hub's text in one task group.
HUB = 64
#: Bytes of text that a Python worker shingles at once.
SLICE = 1 << 20
#: Bits of the bitmap that keeps texts without a candidate from being shuffled: BITS_A_CLASS for each class, at most.
BITS_A_CLASS, MOST_BITS = 16, 1 << 27
#: Leaves of up to so many classes send all candidates on at once.
FEW = 8
#: Classes on each side of a pair of blocks of a large node: of sketches (some 300 bytes a class), and of full sets.
WIDE, CROSS = 2048, 512
_SEEDS = mix64(np.arange(1, 2 * COORDS + 1, dtype=np.uint64))
_MUL, _ADD = _SEEDS[:COORDS] | np.uint64(1), _SEEDS[COORDS:]


def survival(threshold: float, levels: int = LEVELS) -> float:
    """Probability that one tree keeps a pair at the threshold together down to its last level.

    A node branches on one coordinate, or on two with probability 1 / threshold - 1, and each keeps the pair with
    the probability of the threshold.
    """
    below, two = 1.0, 1 / threshold - 1
    for _ in range(levels - 1):
        one = threshold * below
        below = (1 - two) * one + two * (1 - (1 - one) ** 2)
    return threshold * below


def trees_for(threshold: float, recall: float = RECALL, levels: int = LEVELS) -> int:
    """Trees so that a pair at the threshold is found with that probability, even at the deepest level."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, levels)))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    uniq, at, offsets = white_space_chunks(texts)
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    word = np.fromiter((xxhash.xxh3_64_intdigest(u.encode().translate(lower)) for u in uniq), np.uint64, len(uniq))[at]
    n = len(word)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled[: n - j] = (rolled[: n - j] ^ word[j:]) * np.uint64(0x9E3779B97F4A7C15)
        rolled[: n - j] ^= rolled[: n - j] >> np.uint64(32)
    rolled = mix64(rolled)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            yield np.array([xxhash.xxh3_64_intdigest(word[a:b].tobytes(), seed=1)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def minwise(own: np.ndarray) -> np.ndarray:
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 4096):
        out = np.minimum(out, (own[i : i + 4096, None] * _MUL + _ADD).min(axis=0))
    return (out >> np.uint64(33)).astype(np.int32)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, doc_key, n_shingles, digest (null for an empty set) and tokens (COORDS ints)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(2))
            for a, b in text_slices(texts, SLICE):
                sets = list(shingle_sets(texts.slice(a, b - a), k))
                tokens = np.concatenate([minwise(s) for s in sets if len(s)] or [np.zeros(0, np.int32)])
                sizes = np.array([len(s) for s in sets], np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, COORDS, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), batch.column(1).slice(a, b - a), pa.array(sizes), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))], ["doc_id", "doc_key", "n_shingles", "digest", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("doc_key"), "text").mapInArrow(sketch, "doc_id long, doc_key binary, n_shingles long, digest binary, tokens array<int>")


def grow(classes: DataFrame, threshold: float, trees: int, work: Workspace) -> DataFrame:
    """(grp, set_id, pivot): leaves as groups of at most SMALL classes, plus the blocks of large nodes. classes: set_id, tokens."""
    rng = np.random.default_rng(5)
    drawn = np.concatenate([rng.permutation(COORDS) for _ in range(-(-trees // COORDS))])[:trees]
    roots = F.array(*[F.xxhash64(F.lit(t), F.element_at("tokens", int(c) + 1)) for t, c in enumerate(drawn)])
    none = F.lit(None).cast("long")
    nodes = classes.select("set_id", F.explode(roots).alias("node"), none.alias("parent_n"))
    leaves, saved = [], []
    for level in range(LEVELS):
        # what a node holds, summed map-side; of those that don't branch, nodes of the same classes are kept once
        sums = nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("mark"), F.min("set_id").alias("pivot"), F.max("parent_n").alias("parent_n")).filter("n > 1")
        last = F.lit(level == LEVELS - 1) | F.coalesce(F.col("n") >= ALIKE * F.col("parent_n"), F.lit(False))
        sums = sums.withColumn("branches", (F.col("n") > SMALL) & ~last)
        once = sums.groupBy("n", "mark", "pivot", "branches", F.when(F.col("branches"), F.col("node")).alias("own")).agg(F.min("node").alias("node"))
        held = work.save(nodes.select("node", "set_id").join(once.drop("mark", "own"), "node"), f"level{level}")
        saved.append(held)
        leaves.append(held.filter(F.col("n") <= SMALL).select(F.col("node").alias("grp"), "set_id", none.alias("pivot")))
        block = F.pmod(F.xxhash64("set_id"), F.ceil(F.col("n") / (SMALL // 2)))
        leaves.append(held.filter((F.col("n") > SMALL) & ~F.col("branches")).select(F.xxhash64("node", block).alias("grp"), "set_id", "pivot"))
        large = held.filter("branches")
        if large.isEmpty():
            break
        extra = int(1000 * (1 / threshold - 1))
        # a class has few nodes (two a tree and level at most): it gets its tokens once for all of them
        inside = large.groupBy("set_id").agg(F.collect_list(F.struct("node", "n")).alias("inside")).join(classes.select("set_id", "tokens"), "set_id")
        children = inside.select("set_id", F.explode(F.flatten(F.transform("inside", lambda x: _children(x, extra)))).alias("child")).select("set_id", "child.node", "child.parent_n")
        nodes = work.save(children, f"children{level}")  # the next level reads them twice: they are joined and made once
        saved.append(nodes)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    out = work.save(out, "groups")
    work.drop(*saved)
    return out


def _children(x: Column, extra: int) -> Column:
    """The one or two children (node, parent_n) of node x (node, n) for a class with these tokens."""
    chosen = lambda j: F.element_at("tokens", (F.pmod(F.xxhash64(F.lit(j), x.node), F.lit(COORDS)) + 1).cast("int"))
    child = lambda j: F.struct(F.xxhash64(F.lit(j), x.node, chosen(j)).alias("node"), x.n.alias("parent_n"))
    two = F.pmod(F.xxhash64(F.lit("two"), x.node), F.lit(1000)) < extra
    return F.when(two, F.array(child(0), child(1))).otherwise(F.array(child(0)))


def _pairs(tokens: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Estimated similarity of all pairs of a small group where it may reach the threshold, else 0."""
    agree = (tokens[:, None, :] == tokens[None, :, :]).mean(axis=2)
    least = threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / COORDS)
    fits = np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-9
    out = np.where(fits & (agree >= least), agree, 0.0)
    np.fill_diagonal(out, 0)
    return out


def _strip(tokens: np.ndarray, sizes: np.ndarray, lo: int, hi: int, threshold: float) -> np.ndarray:
    """Which pairs of rows lo to hi with all rows may reach the threshold."""
    agree = np.zeros((hi - lo, len(tokens)), np.int16)
    for c in range(COORDS):
        agree += tokens[lo:hi, c, None] == tokens[None, :, c]
    least = threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / COORDS)
    fits = np.minimum(sizes[lo:hi, None], sizes[None, :]) >= threshold * np.maximum(sizes[lo:hi, None], sizes[None, :]) - 1e-9
    return fits & (agree >= least * COORDS)


def _forest(est: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest (Prim)."""
    n = len(est)
    out, free = [], np.ones(n, bool)
    best, by = np.zeros(n), np.full(n, -1)
    for _ in range(n):
        at = int(np.argmax(np.where(free, best, -1)))
        if by[at] >= 0 and best[at] > 0:
            out.append((int(by[at]), at))
        free[at] = False
        better = free & (est[at] > best)
        best[better], by[better] = est[at][better], at
    return out


def by_group(batches: Iterator[pa.RecordBatch], handle) -> Iterator[list]:
    """handle(table) of every run of rows with one grp, rows being sorted by it; a group's rows are of bounded number."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        grp = table.column("grp").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(grp[1:] != grp[:-1]) + 1))
        held = table.slice(cuts[-1])  # the last group waits for more rows
        yield [x for i, j in zip(cuts[:-1], cuts[1:], strict=True) for x in handle(table.slice(i, j - i))]
    if held is not None:
        yield handle(held)


def _sketch(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray]:
    tokens = table.column("tokens").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDS)
    return table.column("set_id").to_pylist(), tokens, table.column("n_shingles").to_numpy()


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    found = list(dict.fromkeys(found))
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])


def compare(groups: DataFrame, threshold: float) -> DataFrame:
    """First candidates of each group (grp, set_id, tokens, n_shingles, block), and what they leave open.

    Rows (a, b) are pairs: all candidates of a few classes, else a spanning forest. Rows (a, null, grp) name, for groups
    that aren't blocks, classes whose part of the group has candidates beyond its tree.
    """

    def one(table: pa.Table) -> list[tuple]:
        if table.num_rows < 2:
            return []
        ids, tokens, sizes = _sketch(table)
        est = _pairs(tokens, sizes, threshold)
        if len(ids) <= FEW:
            return [(min(ids[i], ids[j]), max(ids[i], ids[j]), None) for i, j in zip(*np.nonzero(np.triu(est)), strict=True)]
        forest = _forest(est)
        out: list[tuple] = [(min(ids[i], ids[j]), max(ids[i], ids[j]), None) for i, j in forest]
        if not table.column("block")[0].as_py():
            part = np.arange(len(ids))
            for i, j in forest:  # Prim's order: i is in its tree already
                part[j] = part[i]
            degrees = np.bincount(part, (est > 0).sum(axis=1), len(ids))
            more = degrees > 2 * (np.bincount(part, minlength=len(ids)) - 1)
            grp = table.column("grp")[0].as_py()
            out += [(ids[i], None, xxhash.xxh3_64_intdigest(np.array([grp, ids[part[i]]], np.int64).tobytes()) - (1 << 63)) for i in np.flatnonzero(more[part])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_group(batches, one):
            found = list(dict.fromkeys(found))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["a", "b", "grp"])

    dealt = groups.select("grp", "set_id", "tokens", "n_shingles", "block").repartition("grp").sortWithinPartitions("grp", "set_id")
    return dealt.mapInArrow(run, "a long, b long, grp long").distinct()


def involved(groups: DataFrame, threshold: float) -> DataFrame:
    """Those rows of groups (grp, set_id, tokens, n_shingles, label, side) with a candidate of another label.

    Each group is cut to blocks of CROSS classes of one side; a pair of blocks is a group of the result, with sides
    1 and 2, or 0 for a block with itself. side: see _across().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_group(batches, one):
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["grp", "set_id", "label", "side"])

    def one(table: pa.Table) -> list[tuple]:
        ids, tokens, sizes = _sketch(table)
        label, side = table.column("label").to_numpy(), table.column("side").to_numpy()
        grp, out = table.column("grp")[0].as_py(), []
        turns = np.concatenate(([0], np.flatnonzero(side[1:] != side[:-1]) + 1, [len(ids)]))
        blocks = [(lo, min(lo + CROSS, end)) for start, end in zip(turns[:-1], turns[1:], strict=True) for lo in range(start, end, CROSS)]
        for u, (start, end) in enumerate(blocks):
            hits = np.zeros((len(blocks) - u, end - start), bool), np.zeros(len(ids) - start, bool)
            for lo in range(start, end, 128):
                hi = min(lo + 128, end)
                est = _across(tokens[start:], sizes[start:], label[start:], side[start:], lo - start, hi - start, threshold)
                hits[1][:] |= est.any(axis=0)
                for v, (a, b) in enumerate(blocks[u:]):
                    hits[0][v, lo - start : hi - start] = est[:, a - start : b - start].any(axis=1)
            for v, (a, b) in enumerate(blocks[u:], u):
                if hits[0][v - u].any():
                    name = xxhash.xxh3_64_intdigest(np.array([grp, u, v], np.int64).tobytes()) - (1 << 63)
                    out += [(name, ids[x], int(label[x]), int(v > u)) for x in start + np.flatnonzero(hits[0][v - u])]
                    out += [(name, ids[x], int(label[x]), 2) for x in a + np.flatnonzero(hits[1][a - start : b - start]) if v > u]
        return out

    dealt = groups.select("grp", "set_id", "tokens", "n_shingles", "label", "side").repartition("grp").sortWithinPartitions("grp", "side", "set_id")
    return dealt.mapInArrow(run, "grp long, set_id long, label long, side int")


def _across(tokens: np.ndarray, sizes: np.ndarray, label: np.ndarray, side: np.ndarray, lo: int, hi: int, threshold: float) -> np.ndarray:
    """Candidates of rows lo to hi with all rows, of other labels. Side 0 is compared with all, 1 and 2 with other sides only."""
    return _strip(tokens, sizes, lo, hi, threshold) & (label[lo:hi, None] != label[None, :]) & ((side[lo:hi, None] != side[None, :]) | (side[lo:hi, None] == 0))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections, as a product of incidence matrices over shingles that two sets share."""
    own = np.concatenate(sets)
    names, at, n = np.unique(own, return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place[at]
    row, col = row[n[at] > 1], col[n[at] > 1]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = int((n > 1).sum())
    for lo in range(0, width, 2048):
        i, j = np.searchsorted(col, [lo, lo + 2048])
        m = np.zeros((len(sets), min(2048, width - lo)), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        out += m @ m.T
    return out


def link_across(groups: DataFrame, threshold: float, num: int, den: int) -> DataFrame:
    """(a, b): verified links between different labels of each group, without those that others of the group imply.

    groups: grp, set_id, tokens, n_shingles, label, side (see _across()) and shingles.
    """

    def one(table: pa.Table) -> list[tuple[int, int]]:
        if table.num_rows < 2:
            return []
        ids, tokens, sizes = _sketch(table)
        label, side = table.column("label").to_pylist(), table.column("side").to_numpy()
        number = {x: i for i, x in enumerate(dict.fromkeys(label))}
        label = np.array([number[x] for x in label])
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        first, second = [], []
        for lo in range(0, len(ids), 128):  # in strips: the estimate holds a cube of strip * group * COORDS
            hi = min(lo + 128, len(ids))
            i, j = np.nonzero(_across(tokens, sizes, label, side, lo, hi, threshold))
            first.append(i[i + lo < j] + lo)
            second.append(j[i + lo < j])
        i, j = np.concatenate(first), np.concatenate(second)
        if not len(i):
            return []
        if len(i) > 4 * len(ids):
            rows = np.unique(np.concatenate((i, j)))
            at = np.full(len(ids), -1)
            at[rows] = np.arange(len(rows))
            both = _overlaps([sets[r] for r in rows])[at[i], at[j]]
        else:
            both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
        both = both.astype(np.int64)
        good = den * both >= num * (sizes[i] + sizes[j] - both)
        parent = list(range(len(number)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
            a, b = root(label[x]), root(label[y])
            if a != b:
                parent[a] = b
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_group(batches, one):
            yield _edges(found)

    dealt = groups.select("grp", "set_id", "tokens", "n_shingles", "label", "side", "shingles").repartition("grp").sortWithinPartitions("grp", "set_id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_id, text) of one document of each wanted class; wanted is a saved table with distinct set_id.

    A bitmap of the wanted documents' keys, MOST_BITS at most, goes to all tasks that scan docs; where it fills up
    it lets more texts through to the join, never fewer.
    """
    asked = classes.select("set_id", "doc_key").join(wanted.select("set_id"), "set_id", "left_semi")
    n = wanted.count()
    size = min(MOST_BITS, max(1 << 10, 1 << math.ceil(math.log2(BITS_A_CLASS * n + 1))))
    bit = F.pmod(F.xxhash64("doc_key"), F.lit(size))
    words = asked.select(F.floor(bit / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # MOST_BITS / 64 rows at most
    marks = np.zeros(size // 64, np.int64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(marks.view(np.uint8))  # MOST_BITS / 8 bytes

    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            at = batch.to_numpy()
            yield pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    # only the bits' places go to Python: texts stay in Spark's rows
    texts = docs.select(row_key("doc_id", "text").alias("doc_key"), "text").filter(F.arrow_udf(marked, "boolean")(bit))
    # repeated rows share their key: one of them is kept, map-side first
    return asked.join(texts.groupBy("doc_key").agg(F.first("text").alias("text")), "doc_key").select("set_id", "text")


def sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(set_id, shingles): full sets, recomputed from one document of each wanted class."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(1))
            for a, b in text_slices(texts, SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in shingle_sets(texts.slice(a, b - a), k)], pa.binary())], ["set_id", "shingles"])

    return texts_of(wanted, classes, docs).mapInArrow(shingled, "set_id long, shingles binary")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int, work: Workspace) -> DataFrame:
    """Those of the saved pairs (a, b) with den * |intersection| >= num * |union| on the full sets."""
    chunks = work.save(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).alias("chunks")), "hubs")
    dealt = pairs.join(chunks, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b")
    ends = dealt.select("hub", "chunk", F.col("b").alias("set_id")).unionByName(dealt.select("hub", "chunk", F.col("hub").alias("set_id")).distinct())
    ends = work.save(ends, "ends")
    wanted = work.save(ends.select("set_id").distinct(), "wanted")
    sent = ends.join(texts_of(wanted, classes, docs), "set_id").select("hub", "chunk", (F.col("set_id") != F.col("hub")).alias("spoke"), "set_id", "text")
    sent = sent.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "spoke")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            texts = as_strings(batch.column(4))
            hubs, spoke, ids = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in text_slices(texts, SLICE):
                for i, found in enumerate(shingle_sets(texts.slice(a, b - a), k), a):
                    if not spoke[i]:
                        hub, own = hubs[i], found
                    elif hub == hubs[i]:
                        both = len(np.intersect1d(own, found, assume_unique=True))
                        if den * both >= num * (len(own) + len(found) - both):
                            out.append((hub, ids[i]))
            yield _edges(out)

    return sent.mapInArrow(check, "a long, b long")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, label) of all ends of edges (a, b), label being the component's least node.

    Alternating large-star and small-star (Kiveris et al. 2014): each round is two joins of the edges with
    their nodes' least neighbours, and rounds grow with the logarithm of a component's diameter.
    """

    used: list[DataFrame] = []

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.filter("v < u")
        least = work.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        used.append(least)
        joined = both.join(least, "u")
        if large:
            moved = joined.filter("v > u").select("v", "m")
        else:
            moved = joined.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        return moved.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    now = work.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row == mark or not row[0]:
            break
        mark = row
        middle = work.save(star(now, True), "star")
        after = work.save(star(middle, False), "star")
        work.drop(now, middle, *used)
        used.clear()
        now = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and label, doc_key) of every row of docs (doc_id, text); links at num / den."""
    spark, threshold = docs.sparkSession, num / den
    work = Workspace(spark, "neardup")
    docs = docs.select("doc_id", "text")
    base = work.save(sketches(docs, k), "sketches")
    numbered = base.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("doc_key").alias("doc_key"), F.first("tokens").alias("tokens"), F.first("n_shingles").alias("n_shingles"))
    classes = work.save(numbered.withColumn("set_id", F.monotonically_increasing_id()), "classes")  # a number is given once, when it is written
    groups = grow(classes.select("set_id", "tokens"), threshold, trees_for(threshold), work)
    sketch = classes.select("set_id", "tokens", "n_shingles")
    pivots = groups.filter("pivot is not null").select("grp", F.col("pivot").alias("set_id")).distinct()
    # a class gets its tokens once, for all of its groups; a pivot is in as many groups as its node has blocks, each a row
    inside = groups.filter("pivot is null or pivot <> set_id").groupBy("set_id").agg(F.collect_set(F.struct("grp", F.col("pivot").isNotNull().alias("block"))).alias("inside"))
    members = inside.join(sketch, "set_id").select("set_id", "tokens", "n_shingles", F.inline("inside"))
    first = work.save(compare(members.unionByName(pivots.withColumn("block", F.lit(True)).join(sketch, "set_id")), threshold), "candidates")
    links = work.save(verify(first.filter("b is not null").select("a", "b"), classes, docs, k, num, den, work), "links")
    labels = work.save(components(links, work), "labels")
    left_open = first.filter("b is null").select("grp", F.col("a").alias("set_id"))
    across = _crossing_leaves(left_open, labels, work).unionByName(involved(_crossing_blocks(groups, labels, work).join(sketch, "set_id"), threshold))
    across = work.save(across, "across")
    work.drop(groups, first)
    if not across.isEmpty():
        full = sets_of(work.save(across.select("set_id").distinct(), "asked"), classes, docs, k)
        inside = across.groupBy("set_id").agg(F.collect_list(F.struct("grp", "label", "side")).alias("inside"))
        held = inside.join(sketch, "set_id").join(full, "set_id").select("set_id", "tokens", "n_shingles", "shingles", F.inline("inside"))
        more = work.save(link_across(held, threshold, num, den), "more")
        links = links.unionByName(more)
        labels = work.save(components(links, work), "labels2")
    work.drop(across)
    named = work.save(classes.select("set_id", "digest", "least").join(labels, F.col("set_id") == F.col("node"), "left").select("digest", "least", F.coalesce("label", "set_id").alias("label")), "named")
    least = work.save(named.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    by_class = work.save(named.join(least, "label").select("digest", "label", "component_id"), "components")
    out = base.select("doc_id", "n_shingles", "digest", "doc_key").join(by_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "label", "doc_key")


def _labelled(rows: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    return work.save(rows.join(labels, F.col("set_id") == F.col("node"), "left").select(*rows.columns, F.coalesce("label", "set_id").alias("label")), "labelled")


def _crossing_leaves(left_open: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """(grp, set_id, label, side): parts of leaves with candidates beyond their tree that still hold several components."""
    named = _labelled(left_open, labels, work)
    several = named.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("grp")
    return named.join(several, "grp", "left_semi").select("grp", "set_id", "label", F.lit(0).alias("side"))


def _crossing_blocks(groups: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """(grp, set_id, label, side): pairs of blocks of large nodes that hold several components, to be compared again.

    Classes of the node's largest component (home) need no comparison with each other; the others (out) meet all.
    """
    named = _labelled(groups.filter("pivot is not null").select("set_id", "pivot").distinct(), labels, work)
    # large nodes, those of all trees with one pivot taken together
    parts = named.groupBy("pivot", "label").agg(F.count("*").alias("n"))
    nodes = parts.groupBy("pivot").agg(F.max(F.struct("n", "label")).alias("home"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / WIDE)
    nodes = nodes.select("pivot", F.col("home.label").alias("home"), blocks(F.col("home.n")).alias("k_home"), blocks(F.col("n") - F.col("home.n")).alias("k_out")).filter("k_out > 0")
    large = work.save(named.join(work.save(nodes, "nodes"), "pivot").withColumn("block", F.pmod(F.xxhash64("set_id"), F.when(F.col("label") == F.col("home"), F.col("k_home")).otherwise(F.col("k_out")))), "large")
    numbers = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    rows = lambda df, kind, i, j, side: df.select(F.xxhash64("pivot", F.lit(kind), i, j).alias("grp"), "set_id", "label", side.cast("int").alias("side"))
    home, out = large.filter("label = home").withColumn("other", numbers("k_out")), large.filter("label <> home")
    # a block of out meets itself with the first block of home
    met = out.withColumn("other", numbers("k_home"))
    own = out.withColumn("other", numbers("k_out")).filter("other <> block")
    found = rows(met, "home", F.col("block"), F.col("other"), F.when(F.col("other") == 0, 0).otherwise(2))
    found = found.unionByName(rows(home, "home", F.col("other"), F.col("block"), F.lit(1)))
    return found.unionByName(rows(own, "out", F.least("block", "other"), F.greatest("block", "other"), F.when(F.col("block") < F.col("other"), 1).otherwise(2)))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: one with its least doc_id; of repeated rows one stays, with or without words."""
    columns = docs.columns
    # a component has few rows with its least doc_id, and they are reduced map-side
    found = near_duplicates(docs, k, num, den).filter("kept")
    of = F.when(F.col("label").isNotNull(), F.struct("label", F.lit(None).cast("binary").alias("key"))).otherwise(F.struct("label", F.col("doc_key").alias("key")))
    chosen = found.groupBy(of).agg(F.min("doc_key").alias("key")).select("key").distinct()
    # columns lie in a struct, so that none of theirs can clash with one of ours
    held = docs.select(row_key("doc_id", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"))
    one = held.join(chosen, "key", "left_semi").dropDuplicates(["key"])
    return one.select(*[F.col(f"doc.`{c}`").alias(c) for c in columns])


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return near_duplicates(docs, 3, 85, 100).drop("label", "doc_key")
