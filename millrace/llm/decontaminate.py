"""Benchmark decontamination by spaced seeds.

A spaced seed is a fixed mask over SPAN consecutive tokens; it hashes only the tokens at its cared-for
positions, so that substitutions elsewhere don't break a hit. An item shorter than SPAN is cut into one piece
more than the substitutions that it may have, so that one piece is whole; pieces are seeds without gaps.

1. The seeds of all benchmark items are a table (seed, item). A bitmap of them, of bounded size, goes to the
   tasks that scan the documents: they hash each document's windows, one vectorised pass a mask, and send
   on the seeds that the bitmap holds, with the text, for the few documents that have any.
2. Documents' seeds are joined with the items' seeds; what is left is distinct pairs of document and item.
3. Each document meets its items in a task, in which hits name alignments. The aligned stretch is verified,
   the alignments with most hits first, until one suffices. An item's token agrees if the document has it on that
   diagonal or, after an insertion or a deletion, in a run of 3 tokens on a diagonal within DRIFT of it or in a run
   of FAR_RUN tokens on one within REACH. At least `least_share` must agree of one of
   - the item's whole length,
   - the part of it that the document can hold, where the document starts or ends inside the item,
   - any STRETCH tokens of it in a row, however long the item is,
   and at least `least_tokens` tokens in all. The share that is reported is that of the whole item.

Tokens are runs of letters and digits, lower-cased. Nothing of the benchmark but the bitmap is held whole
anywhere. A seed that a document repeats counts once until step 3, where positions of equal seeds are
marked on diagonals by vectors, so repetitive texts stay cheap.

Edge cases: null or empty texts and items hit nothing, and so do items of fewer than `least_tokens` tokens; repeated
items are reported under each of their ids; repeated documents are searched once and all reported; an empty table
of either kind finds nothing; extra columns are kept where a function says so, and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitmap, Workspace, as_strings, mix64, read_table, row_key, text_slices

# Fixed masks: 6 of 11 tokens; any two substitutions at least 4 tokens apart leave one of them a hit in a
# passage of 15 tokens (tested by brute force in tests/llm).
MASKS = ("11101000111", "11011001011", "10110011101", "11111100000")
SPAN = 11
LEAST_SHARE = 0.8
LEAST_TOKENS = 8
DRIFT = 3
#: Tokens in a row that count as an overlap of a longer item; the length of n-gram that is common for decontamination.
STRETCH = 13
#: How far text may be inserted or deleted inside an item, and the run that has to agree beyond.
REACH, FAR_RUN = 64, 5
REMEMBERED = 500_000
WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Hashes(dict):
    """64-bit hashes of tokens, remembered."""

    def __missing__(self, token: str) -> int:
        self[token] = found = xxhash.xxh3_64_intdigest(token)
        return found

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(ids: np.ndarray, mask: str, at: np.ndarray | None = None) -> np.ndarray:
    """Seeds of the windows of ids under the mask, at all places or at those given."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n if at is None else len(at), xxhash.xxh3_64_intdigest(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out = (out ^ (ids[k : k + n] if at is None else ids[at + k])) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mix64(out)


def pieces(n: int, least_share: float) -> list[tuple[int, int]]:
    """(start, length) of an item of n tokens cut so that one piece survives all substitutions it may have."""
    k = int(n * (1 - least_share) + 1e-9) + 1
    size = n // k
    return [(i * size, size) for i in range(k)]


def seeds(ids: np.ndarray, least_share: float) -> list[tuple[str, int, int]]:
    """(mask, place, seed) of an item."""
    if len(ids) >= SPAN:
        return [(m, p, int(h)) for m in MASKS for p, h in enumerate(windows(ids, m))]
    return [("1" * size, a, int(windows(ids[a : a + size], "1" * size)[0])) for a, size in pieces(len(ids), least_share)] if len(ids) else []


class Document:
    """One document's tokens and seeds, to be searched for items."""

    def __init__(self, words: list[str], hashes: Hashes):
        self.ids = hashes.of(words)
        self.sorted: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def places(self, mask: str) -> tuple[np.ndarray, np.ndarray]:
        if mask not in self.sorted:
            found = windows(self.ids, mask)
            order = np.argsort(found, kind="stable")
            self.sorted[mask] = found[order], order
        return self.sorted[mask]

    def search(self, own: np.ndarray, least_share: float, least_tokens: int) -> tuple[int, float] | None:
        """(tokens that agree, share of the item) of the first alignment that suffices."""
        if len(own) < least_tokens or not len(self.ids):
            return None
        hits = np.zeros(len(self.ids) + len(own), np.int32)  # by diagonal, shifted by the item's length
        for mask, place, seed in seeds(own, least_share):
            found, order = self.places(mask)
            lo, hi = np.searchsorted(found, np.uint64(seed), "left"), np.searchsorted(found, np.uint64(seed), "right")
            hits[order[lo:hi] - place + len(own)] += 1
        at = np.flatnonzero(hits)
        for shift in (at[np.argsort(-hits[at], kind="stable")] - len(own)).tolist():
            agree, share, held = verify(self.ids, own, shift, least_share)
            if held and agree >= least_tokens:
                return agree, share
        return None


def _suffices(held: np.ndarray, lo: int, hi: int, least_share: float) -> bool:
    """Whether the tokens held are enough of the item, of its part from lo to hi, or of a stretch."""
    n = len(held)
    sums = np.concatenate(([0], np.cumsum(held)))
    whole = sums[-1] >= least_share * n
    part = sums[hi] - sums[lo] >= least_share * (hi - lo)
    return bool(whole or part or (n > STRETCH and (sums[STRETCH:] - sums[:-STRETCH]).max() >= least_share * STRETCH))


def verify(ids: np.ndarray, own: np.ndarray, shift: int, least_share: float) -> tuple[int, float, bool]:
    """Item tokens that the document has on the diagonal or on one that runs on from it, their share, and whether they suffice."""
    n = len(own)
    lo, hi = max(0, -shift), min(n, len(ids) - shift)  # all of the item, unless the document starts or ends inside it
    near = ids[max(0, shift - REACH) : max(0, shift + n + REACH)]
    if not _suffices(np.isin(own, near), lo, hi, least_share):  # more than these can't agree
        return 0, 0.0, False

    def on(d: int) -> np.ndarray:
        agree = np.zeros(n, bool)
        a, b = max(0, -(shift + d)), min(n, len(ids) - shift - d)
        if b > a:
            agree[a:b] = ids[a + shift + d : b + shift + d] == own[a:b]
        return agree

    def solid(agree: np.ndarray, run: int) -> np.ndarray:
        """Those that lie in runs of so many agreeing tokens."""
        out = np.zeros(n, bool)
        starts = np.logical_and.reduce([agree[k : max(0, n - run + 1) + k] for k in range(run)]) if n >= run else out[:0]
        if starts.any():
            for k in range(run):
                out[k : n - run + 1 + k] |= starts
        return out

    held = on(0)
    for d in (x for k in range(1, REACH + 1) for x in (-k, k)):
        if held.all():
            break
        held |= solid(on(d), 3 if abs(d) <= DRIFT else FAR_RUN)
    count = int(held.sum())
    return count, count / n, _suffices(held, lo, hi, least_share)


OVERLAPS = "array<struct<item_id:bigint,agree:int,share:double>>"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(key, overlaps) of the documents (doc_id, text) that hold items: key is row_key("doc_id", "text"). A saved table."""
    work = Workspace(docs.sparkSession, "overlaps")
    items = work.save(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text").filter("text is not null"), "items")

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = hashes.of(tokens(text))
                if len(own) >= max(1, least_tokens):
                    found = seeds(own, least_share)
                    yield pa.RecordBatch.from_arrays([pa.array([m for m, _, _ in found], pa.string()), pa.array(np.array([h for _, _, h in found], np.uint64).view(np.int64)), pa.array([item] * len(found), pa.int64())], ["mask", "seed", "item"])

    table = work.save(items.select("item", "text").mapInArrow(item_seeds, "mask string, seed long, item long").distinct(), "seeds")
    masks = sorted(r["mask"] for r in table.select("mask").distinct().collect())  # MASKS, and one a length below SPAN
    sent = docs.sparkSession.sparkContext.broadcast(Bitmap.of(work.save(table.select("seed").distinct(), "bits")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bitmap = Hashes(), sent.value
        for batch in batches:
            texts = as_strings(batch.column(1))
            for a, b in text_slices(texts):
                # the texts of a slice are hashed in a row; windows that reach over an end are left out
                own = [tokens(t) for t in texts.slice(a, b - a).to_pylist()]
                ends = np.cumsum([len(x) for x in own])
                ids = hashes.of([w for x in own for w in x])
                row, seed = [], []
                for m in masks:
                    h = windows(ids, m)
                    at = bitmap.holds(h)
                    of = np.searchsorted(ends, at, "right")
                    inside = at + len(m) <= ends[of] if len(at) else np.zeros(0, bool)
                    row.append(of[inside])
                    seed.append(h[at[inside]].view(np.int64))
                found = np.unique(np.stack([np.concatenate(row), np.concatenate(seed)], axis=1), axis=0)
                hit, n = np.unique(found[:, 0], return_counts=True)
                kept = batch.slice(a, b - a).take(pa.array(hit))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(found[:, 1]))
                yield pa.RecordBatch.from_arrays([*kept.columns, lists], ["key", "text", "seeds"])

    keyed = docs.select(row_key("doc_id", "text").alias("key"), "text").filter("text is not null")
    hit = keyed.mapInArrow(scan, "key binary, text string, seeds array<long>") if masks else keyed.limit(0).withColumn("seeds", F.array().cast("array<long>"))
    hit = work.save(hit.groupBy("key").agg(F.first("text").alias("text"), F.first("seeds").alias("seeds")), "hits")
    pairs = hit.select("key", F.explode("seeds").alias("seed")).join(table.select("seed", "item"), "seed").select("key", "item").distinct()
    pairs = work.save(pairs, "pairs")
    none = F.lit(None).cast("long")
    asked = hit.join(pairs.select("key").distinct(), "key", "left_semi").select("key", none.alias("item_id"), "text", F.lit(0).alias("kind"))
    both = asked.unionByName(pairs.join(items, "item").select("key", "item_id", "text", F.lit(1).alias("kind")))
    dealt = both.repartition("key").sortWithinPartitions("key", "kind")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document comes before its items."""
        hashes, now, doc = Hashes(), None, None
        for batch in batches:
            out: list[tuple] = []
            for key, item, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    now, doc = key, Document(tokens(text), hashes)
                elif key == now and (found := doc.search(hashes.of(tokens(text)), least_share, least_tokens)):
                    out.append((key, item, *found))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.float64()))], ["key", "item_id", "agree", "share"])

    found = dealt.mapInArrow(check, "key binary, item_id long, agree int, share double")
    return work.save(found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item_id", "agree", "share"))).cast(OVERLAPS).alias("overlaps")), "overlaps")  # the items of one document


def with_overlaps(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """doc_id and overlaps (empty: none) of every row of docs (doc_id, text)."""
    found = find_overlaps(docs, benchmark, **limits)
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("key"))
    return keyed.join(found, "key", "left").select("doc_id", F.coalesce("overlaps", F.array().cast(OVERLAPS)).alias("overlaps"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """docs without the rows that hold a benchmark passage, all columns kept."""
    found = find_overlaps(docs, benchmark, **limits)
    # columns lie in a struct, so that none of theirs can clash with one of ours
    held = docs.select(row_key("doc_id", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return held.join(found, "key", "left_anti").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_overlaps(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc_id").cast("long"), (F.size("overlaps") > 0).alias("contaminated"), F.size("overlaps").alias("n_items"), F.array_max(F.transform("overlaps", lambda o: o["share"])).alias("best_share"), F.array_sort(F.transform("overlaps", lambda o: o["item_id"])).alias("item_ids"))
