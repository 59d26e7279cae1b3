"""N-gram Jaccard join: size-aware heavy-light set join (Deng, Tao and Li 2018) of documents' shingle sets.

Documents with one set form a class; classes are joined, copies stay members. Two sizes a <= b need an overlap of
c(a, b) = ceil(num * (a + b) / (num + den)).

* Light sets, of at most `boundary` shingles, enumerate their subsets: for each pair of sizes that can link, a set names all its
  subsets of c shingles. Sets that share one overlap enough, so no pair is made: all sets of a subset are tied to
  the least set of the smaller size.
* Heavy sets scan inverted lists. Shingles have a global order, frequent ones last (a bounded dictionary of the most
  frequent ones; any order is right), and only the first n - ceil(num / den * n) + 1 shingles of a set are listed, which two
  linked sets can't both be without. Lists are cut by size class: what links lies in one class or the next.
* The boundary has the least cost: the subsets that the light sets name, against the lists that they would scan,
  from the number of sets of each size and the mean length of a list.

A list is never expanded into pairs. Lists of the same sets are scanned once. Long ones are dealt to blocks, each with the
list's pivot; a block sends a spanning forest of the pairs that may link, and those are verified on full sets. Lists that
then hold several components are compared again, across components only, block by block: classes outside the pivot's component
meet the whole list. A few pairs for each set are sent on; where there are more, the full sets are compared inside the task. So all links are found or implied. Before sets
travel, signatures of 2 to 4 bits a shingle refuse pairs: bits that only one set has count shingles that only it has, so no link
is refused. Blocks are sized by the sets' length, so that a task holds a bounded number of shingles.

What stays quadratic: a list of n sets, of which m don't reach its pivot's component although they share a
shingle that is rare in the corpus, takes n * m comparisons of signatures.

Edge cases: null text and text without words have an empty set, are linked with nothing and are components of their own; a
text of fewer words than a shingle has one shingle, the whole sequence; very long texts are read whole, in slices of
bounded size; repeated rows and equal texts are one class; a null doc_id takes part, but names no component unless all of its are
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitmap, Workspace, as_strings, mix64, read_table, row_key, text_slices
from .near_duplicates import _forest, _overlaps, components, sets_of, shingle_sets, verify

#: Frequent shingles that come last in the order of prefixes, the most frequent ones.
MOST_FREQUENT = 1 << 16
#: Shingles that a task counts at a time, and the count from which on it reports one.
HELD, REPORTED = 1 << 18, 16
#: No set of more shingles is light, whatever the costs.
MOST_LIGHT = 24
#: Cost of a subset in entries of a list scanned.
SUBSET_COST = 1.0
#: Sets of a block at most, and shingles that the sets of a block may hold together.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
#: Lists of up to so many sets send all pairs that may link at once.
FEW = 3
#: Groups of up to so many sets are compared in plain Python, larger ones in numpy.
FEW_ROWS = 12
#: Up to so many pairs across components for each set of a list are sent on; a list with more is compared inside one task.
PAIRS_A_SET = 2
LEAST_BITS = 1_024
#: Bytes of text handed to numpy at once.
SLICE = 4 << 20


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    return -(-num * (a + b) // (num + den))


def size_classes(num: int, den: int) -> np.ndarray:
    """First sizes of the classes: what links with a size lies in its class or in one beside it."""
    first = [1]
    while first[-1] < 1 << 40:
        first.append(first[-1] * den // num + 1)
    return np.array(first, np.int64)


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """The most frequent shingles, ascending by frequency: each task counts its own and reports those it has often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            texts = as_strings(batch.column(0))
            for a, b in text_slices(texts, SLICE):
                sets = {s.tobytes(): s for s in shingle_sets(texts.slice(a, b - a), k)}
                own, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                names, at = np.unique(np.concatenate((names, own)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, n)), len(names)).astype(np.int64)
                if len(names) > HELD:
                    top = np.argpartition(counts, len(names) - HELD)[-HELD:]
                    names, counts = names[top], counts[top]
        often = counts >= REPORTED
        yield pa.RecordBatch.from_arrays([pa.array(names[often].view(np.int64)), pa.array(counts[often])], ["token", "n"])

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()  # MOST_FREQUENT rows at most
    return rows.column("token").to_numpy().view(np.uint64)[::-1].copy()


def signature(own: np.ndarray) -> bytes:
    bits = LEAST_BITS
    while bits < 2 * len(own):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(own & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def prefixes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, doc_key, n_shingles, digest (null for an empty set), prefix, signature, the size's class and, of sets that may be light, all tokens."""
    last = frequent(docs, k)
    place = np.argsort(last)
    held = docs.sparkSession.sparkContext.broadcast((last[place], place))  # MOST_FREQUENT entries at most
    first = size_classes(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ranks = held.value
        for batch in batches:
            texts = as_strings(batch.column(2))
            for a, b in text_slices(texts, SLICE):
                sets = list(shingle_sets(texts.slice(a, b - a), k))
                sizes = np.array([len(s) for s in sets], np.int64)
                tokens = np.concatenate(sets)
                at = np.minimum(np.searchsorted(names, tokens), max(len(names) - 1, 0))
                late = names[at] == tokens if len(names) else np.zeros(len(tokens), bool)
                kept, start = [], 0
                for s in sets:
                    own = late[start : start + len(s)]
                    p = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    early = s[~own][:p]
                    if len(early) < p:
                        rest = s[own]
                        early = np.concatenate((early, rest[np.argsort(ranks[at[start : start + len(s)][own]])][: p - len(early)]))
                    kept.append(early)
                    start += len(s)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(pa.int64()),
                        batch.column(1).slice(a, b - a),
                        pa.array(sizes),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).view(np.int64))),
                        pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array((np.searchsorted(first, sizes, side="right") - 1).astype(np.int32)),
                        pa.array([s.tobytes() if 0 < len(s) <= MOST_LIGHT else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "doc_key", "n_shingles", "digest", "prefix", "signature", "cls", "tokens"],
                )

    return docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("doc_key"), "text").mapInArrow(run, "doc_id long, doc_key binary, n_shingles long, digest binary, prefix array<bigint>, signature binary, cls int, tokens binary")


def subset_sizes(n: int, boundary: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(a, b, c) of all pairs of sizes a <= b <= boundary with n among them that can link although the sets differ."""
    pairs = [(n, b) for b in range(n, boundary + 1)] + [(a, n) for a in range(1, n)]
    found = [(a, b, least_overlap(a, b, num, den)) for a, b in pairs]
    return [(a, b, c) for a, b, c in found if c <= a and c < b]


def boundary_of(sizes: dict[int, int], mean_list: float, num: int, den: int) -> int:
    """The largest size that sets have to be light, by least cost; sizes: sets by their number of shingles, up to MOST_LIGHT."""
    scan = {n: count * (n - -(-num * n // den) + 1) * mean_list for n, count in sizes.items()}

    def cost(boundary: int) -> float:
        named = sum(count * math.comb(n, c) for n, count in sizes.items() if n <= boundary for _, _, c in subset_sizes(n, boundary, num, den))
        return SUBSET_COST * named + sum(s for n, s in scan.items() if n > boundary)

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


@cache
def _left_out(n: int, m: int) -> np.ndarray:
    return np.array(list(combinations(range(n), m)), np.int64).reshape(math.comb(n, m), m)


def light_links(classes: DataFrame, boundary: int, num: int, den: int, work: Workspace) -> DataFrame:
    """(a, b): links that tie together all light sets which share a subset large enough."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, int, bool]] = []
            for set_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint64)
                one, two = mix64(own), mix64(own ^ np.uint64(0x9E3779B97F4A7C15))
                for a, b, c in subset_sizes(len(own), boundary, num, den):
                    gone = _left_out(len(own), len(own) - c)
                    pair = np.uint64(a * (MOST_LIGHT + 1) + b)
                    out.append((mix64(one.sum() - one[gone].sum(axis=1) + pair), mix64(two.sum() - two[gone].sum(axis=1) - pair), set_id, len(own) == a))
            if out:
                n = [len(x[0]) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]).view(np.int64)) for i in (0, 1)] + [pa.array(np.repeat([x[2] for x in out], n)), pa.array(np.repeat([x[3] for x in out], n))], ["one", "two", "set_id", "small"])

    keys = classes.filter(F.col("n_shingles") <= boundary).select("set_id", "tokens").mapInArrow(named, "one long, two long, set_id long, small boolean")
    keys = work.save(keys, "subsets")
    # of a key that many sets name, one row of each task is shuffled here, and the join splits it
    ties = work.save(keys.groupBy("one", "two").agg(F.min(F.when(F.col("small"), F.col("set_id"))).alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null").drop("n"), "ties")
    return keys.join(ties, ["one", "two"]).filter("set_id <> least").select(F.least("least", "set_id").alias("a"), F.greatest("least", "set_id").alias("b")).distinct()


def heavy_lists(classes: DataFrame, lists: DataFrame, boundary: int, num: int, den: int, work: Workspace) -> DataFrame:
    """(grp, set_id, n, pivot, most): the inverted lists of shingles that several sets have in their prefix, by size class.

    grp is a list's part of one size class and the next; most, the size of its largest set, is beyond the boundary. Of
    lists with the same sets one stays.
    """
    sent = classes.sparkSession.sparkContext.broadcast(Bitmap.of(lists.select("token"), each=16))  # 16 MB at most

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(3)
            flat = tokens.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(tokens.offsets.to_numpy()))
            at = sent.value.holds(flat)
            rows = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(flat[at]), *[batch.column(i).take(rows) for i in range(3)]], ["token", "set_id", "size", "cls"])

    postings = classes.select("set_id", "n_shingles", "cls", "prefix").mapInArrow(listed, "token long, set_id long, size long, cls int")
    low = F.explode(F.array(F.col("cls"), F.col("cls") - 1))
    parts = postings.join(lists.select("token"), "token").select("set_id", "size", "cls", "token", low.alias("low")).select("set_id", "size", (F.col("low") == F.col("cls")).alias("is_low"), F.xxhash64("token", "low").alias("grp"))
    parts = work.save(parts, "lists")
    sums = parts.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("mark"), F.min("set_id").alias("pivot"), F.max("size").alias("most"), F.min("size").alias("least"), F.bool_or("is_low").alias("low"))
    # two sets of a list are a pair, whose sizes tell already whether it can link
    fits = (F.col("n") > 2) | (F.col("least") * den >= F.col("most") * num)
    once = sums.filter((F.col("n") > 1) & F.col("low") & (F.col("most") > boundary) & fits).groupBy("n", "mark", "pivot", "most").agg(F.min("grp").alias("grp"))
    once = work.save(once.drop("mark"), "once")
    held = work.save(parts.select("grp", "set_id").join(once, "grp"), "held")
    work.drop(parts, once)
    return held


def block_size() -> F.Column:
    return F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.col("most"))))


def groups_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """(grp, column, ...) of every run of rows with one grp, rows being sorted by it and each column a list; a group's rows are of bounded number."""
    now, held = None, [[] for _ in columns]
    for batch in batches:
        grp = batch.column("grp").to_pylist()
        values = [batch.column(c).to_pylist() for c in columns]
        start = 0
        for end in [*(np.flatnonzero(np.diff(np.array(grp, np.int64))) + 1).tolist(), len(grp)]:
            if start == end:
                continue
            if grp[start] != now:
                if now is not None:
                    yield (now, *held)
                now, held = grp[start], [[] for _ in columns]
            for own, all_values in zip(held, values, strict=True):
                own += all_values[start:end]
            start = end
    if now is not None:
        yield (now, *held)


def _folded(signatures: list[bytes]) -> list[int]:
    """Signatures as integers, all folded to the shortest one's length."""
    width, out = min(map(len, signatures)), []
    for s in signatures:
        bits, n = int.from_bytes(s, "little"), len(s)
        while n > width:
            n //= 2
            bits = bits >> 8 * n | bits & (1 << 8 * n) - 1
        out.append(bits)
    return out


def may_link(sizes: list[int], signatures: list[bytes], num: int, den: int, apart=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of a group that sizes and signatures allow to link, with the bits both have; in strips of rows.

    apart(i, j), for arrays of rows, refuses pairs that needn't be compared.
    """
    n, bits = len(sizes), _folded(signatures)
    if n <= FEW_ROWS:
        found = []
        for i in range(n):
            for j in range(i + 1, n):
                need = -(-num * (sizes[i] + sizes[j]) // (num + den))
                both = bits[i] & bits[j]
                if min(sizes[i], sizes[j]) >= need and sizes[i] - (bits[i] ^ both).bit_count() >= need and sizes[j] - (bits[j] ^ both).bit_count() >= need:
                    found.append((i, j, both.bit_count()))
        i, j, both = np.array(found, np.int64).reshape(-1, 3).T
        good = slice(None) if apart is None else apart(i, j)
        yield i[good], j[good], both[good]
        return
    width = min(map(len, signatures))
    words = np.stack([np.frombuffer(b.to_bytes(width, "little"), np.uint64) for b in bits])
    size, own = np.array(sizes), np.bitwise_count(words).sum(axis=1, dtype=np.int32)
    for lo in range(0, n, 128):
        hi = min(lo + 128, n)
        both = np.zeros((hi - lo, n), np.int32)
        for w in range(words.shape[1]):
            both += np.bitwise_count(words[lo:hi, w, None] & words[None, :, w])
        need = -(-num * (size[lo:hi, None] + size[None, :]) // (num + den))
        good = (np.minimum(size[lo:hi, None], size[None, :]) >= need) & ((size - own)[lo:hi, None] + both >= need) & ((size - own)[None, :] + both >= need)
        i, j = np.nonzero(np.triu(good, lo + 1))
        kept = slice(None) if apart is None else apart(i + lo, j)
        yield i[kept] + lo, j[kept], both[i[kept], j[kept]]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    found = list(dict.fromkeys(found))
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in range(2)], ["a", "b"])


def _in_parts(rows: Iterator, most: int = 1 << 14) -> Iterator[list]:
    held: list = []
    for found in rows:
        held += found
        if len(held) >= most:
            yield held
            held = []
    yield held


def first_pairs(held: DataFrame, sketch: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): of each list, or block of a long one with its pivot, a spanning forest of the pairs that may link; all of a few sets."""

    def one(ids: list[int], sizes: list[int], signatures: list[bytes]) -> list[tuple[int, int]]:
        parts = list(may_link(sizes, signatures, num, den))
        i, j, both = (np.concatenate([p[x] for p in parts]) for x in range(3))
        if len(ids) > FEW and len(i):
            weight = np.zeros((len(ids), len(ids)))
            weight[i, j] = weight[j, i] = 1 + both
            i, j = zip(*_forest(weight), strict=True)
        return [(min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in zip(i, j, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _in_parts(one(*rest) for _, *rest in groups_of(batches, ["set_id", "n_shingles", "signature"])):
            yield _pairs(found)

    blocks = F.ceil(F.col("n") / block_size())
    dealt = held.select(F.xxhash64("grp", F.pmod(F.xxhash64("set_id"), blocks)).alias("grp"), "set_id", "pivot")
    members = dealt.select("grp", "set_id").unionByName(dealt.select("grp", F.col("pivot").alias("set_id"))).distinct()
    sent = members.join(sketch, "set_id").select("grp", "set_id", "n_shingles", "signature")
    return sent.repartition("grp").sortWithinPartitions("grp", "set_id").mapInArrow(run, "a long, b long").distinct()


def left_open(held: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """(grp, set_id, label, side): lists that still hold several components; of long ones pairs of blocks.

    Rows of side 0 are to be compared with all of their grp, those of side 1 with side 0 only.
    """
    named = held.filter(F.col("n") > FEW).join(labels, F.col("set_id") == F.col("node"), "left").select("grp", "set_id", "n", "pivot", "most", F.coalesce("label", "set_id").alias("label"))
    named = work.save(named, "named")
    open_lists = named.groupBy("grp").agg(F.min("label").alias("least"), F.max("label").alias("last")).filter("least < last").select("grp")
    named = work.save(named.join(open_lists, "grp", "left_semi").withColumn("size", block_size()), "open")
    short = named.filter("n <= size").select("grp", "set_id", "label", F.lit(0).alias("side"))
    # long lists with one pivot are taken together
    long = named.filter("n > size").groupBy("pivot", "set_id", "label").agg(F.min("size").alias("size"))
    home = long.select("pivot").distinct().join(labels, F.col("pivot") == F.col("node"), "left").select("pivot", F.coalesce("label", "pivot").alias("home"))
    long = work.save(long.join(work.save(home, "home"), "pivot").withColumn("out", F.col("label") != F.col("home")), "long")
    size = F.min("size")
    counts = work.save(long.groupBy("pivot").agg(F.ceil(F.count("*") / size).alias("k"), F.ceil(F.count_if("out") / size).alias("k_out")).filter("k_out > 0"), "blocks")
    long = long.join(counts, "pivot")
    pair = lambda i, j: F.xxhash64("pivot", i, j)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    strip = F.pmod(F.xxhash64(F.lit("out"), "set_id"), F.col("k_out"))
    outer = long.filter("out").withColumn("i", strip).withColumn("j", all_of("k")).select(pair("i", "j").alias("grp"), "set_id", "label", F.lit(0).alias("side"))
    rest = long.withColumn("j", F.pmod(F.xxhash64("set_id"), F.col("k"))).withColumn("i", all_of("k_out")).select(pair("i", "j").alias("grp"), "set_id", "label", F.lit(1).alias("side"))
    return short.unionByName(outer.unionByName(rest).groupBy("grp", "set_id", "label").agg(F.min("side").alias("side")))


def _across(label: list[int], side: list[int]):
    label, side = np.array(label), np.array(side)
    return lambda i, j: (label[i] != label[j]) & (side[i] + side[j] < 2)


def across(groups: DataFrame, num: int, den: int) -> DataFrame:
    """What may link across components in groups (grp, set_id, label, side, n_shingles, signature).

    Rows (a, b) are pairs, where a group has few; else rows (a, null, grp, label, side) name the sets that are in one.
    """

    def one(grp: int, ids: list[int], label: list[int], side: list[int], sizes: list[int], signatures: list[bytes]) -> list[tuple]:
        hit, pairs = np.zeros(len(ids), bool), []
        for i, j, _ in may_link(sizes, signatures, num, den, _across(label, side)):
            hit[i] = hit[j] = True
            if len(pairs) <= PAIRS_A_SET * len(ids):
                pairs += [(min(ids[x], ids[y]), max(ids[x], ids[y]), None, None, None) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        return pairs if len(pairs) <= PAIRS_A_SET * len(ids) else [(ids[i], None, grp, label[i], side[i]) for i in np.flatnonzero(hit)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        for found in _in_parts(one(*group) for group in groups_of(batches, ["set_id", "label", "side", "n_shingles", "signature"])):
            found = list(dict.fromkeys(found))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], ["a", "b", "grp", "label", "side"])

    dealt = groups.select("grp", "set_id", "label", "side", "n_shingles", "signature").repartition("grp").sortWithinPartitions("grp", "set_id")
    return dealt.mapInArrow(run, "a long, b long, grp long, label long, side int")


def links_across(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links on full sets (shingles) across the components of each group, without those that others of the group imply."""

    def one(ids: list[int], label: list[int], side: list[int], sizes: list[int], signatures: list[bytes], shingles: list[bytes]) -> list[tuple[int, int]]:
        parent = {x: x for x in label}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets = [np.frombuffer(x, np.uint64) for x in shingles]
        size, out = np.array(sizes), []
        for i, j, _ in may_link(sizes, signatures, num, den, _across(label, side)):
            if len(i) > 4 * len(ids):
                rows, at = np.unique(np.concatenate((i, j)), return_inverse=True)
                both = _overlaps([sets[r] for r in rows])[at[: len(i)], at[len(i) :]].astype(np.int64)
                good = den * both >= num * (size[i] + size[j] - both)
                i, j = i[good], j[good]
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                a, b = root(label[x]), root(label[y])
                if a != b:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                        parent[a] = b
                        out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return out

    columns = ["set_id", "label", "side", "n_shingles", "signature", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _in_parts(one(*rest) for _, *rest in groups_of(batches, columns)):
            yield _pairs(found)

    return groups.select("grp", *columns).repartition("grp").sortWithinPartitions("grp", "set_id").mapInArrow(run, "a long, b long").distinct()


def ngram_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text): documents link where den * |both| >= num * |either|."""
    work = Workspace(docs.sparkSession, "ngram-join")
    docs = docs.select("doc_id", "text")
    base = work.save(prefixes(docs, k, num, den), "prefixes")
    kinds = base.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("doc_key").alias("doc_key"), *[F.first(c).alias(c) for c in ("n_shingles", "prefix", "signature", "cls", "tokens")])
    classes = work.save(kinds.withColumn("set_id", F.monotonically_increasing_id()), "classes")  # a number is given once, when it is written
    rows = work.save(base.select("doc_id", "n_shingles", "digest"), "rows")
    work.drop(base)  # prefixes and signatures are in classes
    sketch = classes.select("set_id", "n_shingles", "signature")
    lists = work.save(classes.select(F.explode("prefix").alias("token")).groupBy("token").count().filter("count > 1"), "tokens")
    mean = lists.agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).cast("double")).first()[0] or 1.0
    sizes = dict(classes.filter(F.col("n_shingles") <= MOST_LIGHT).groupBy("n_shingles").count().collect())  # MOST_LIGHT rows at most
    boundary = boundary_of(sizes, mean, num, den)
    light = work.save(light_links(classes, boundary, num, den, work), "light")
    held = heavy_lists(classes.filter(F.col("n_shingles") * den >= num * (boundary + 1)), lists, boundary, num, den, work)
    pairs = work.save(first_pairs(held, sketch, num, den), "pairs")
    work.drop(lists)
    links = light.unionByName(work.save(verify(pairs, classes, docs, k, num, den, work), "links"))
    labels = work.save(components(links, work), "labels")
    again = work.save(across(left_open(held, labels, work).join(sketch, "set_id"), num, den), "across")
    if not again.isEmpty():
        second = work.save(again.filter("b is not null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "second")
        links = links.unionByName(work.save(verify(second, classes, docs, k, num, den, work), "links2"))
        crowded = again.filter("b is null").select("grp", F.col("a").alias("set_id"), "label", "side")
        if not crowded.isEmpty():
            full = sets_of(work.save(crowded.select("set_id").distinct(), "asked"), classes, docs, k)
            links = links.unionByName(work.save(links_across(crowded.join(sketch, "set_id").join(full, "set_id"), num, den), "more"))
        labels = work.save(components(links, work), "labels2")
    work.drop(held, pairs, again)
    named = work.save(classes.select("set_id", "digest", "least").join(labels, F.col("set_id") == F.col("node"), "left").select("digest", "least", F.coalesce("label", "set_id").alias("label")), "named")
    least = work.save(named.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    by_class = work.save(named.join(least, "label").select("digest", "component_id"), "components")
    out = rows.join(by_class, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents"), 4, 85, 100)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM w),
kinds AS MATERIALIZED (SELECT s, min(doc_id) AS k FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
t AS MATERIALIZED (SELECT k, len(s) AS n, unnest(s) AS t FROM kinds),
links AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.t = b.t AND a.k <> b.k AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a AS k, a AS c FROM links UNION SELECT l.a AS k, r.c FROM reach r JOIN links l ON l.b = r.k),
least AS (SELECT k, min(c) AS c FROM reach GROUP BY k)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(l.c, x.k, d.doc_id) AS component_id
FROM s d LEFT JOIN kinds x ON x.s = list_sort(d.s) LEFT JOIN least l ON l.k = x.k
"""
