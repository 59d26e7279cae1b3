"""Shared parts of the training-data operators: tables, the shared folder, text chunking."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A text slice handed to numpy at once, in bytes: bounds a Python worker's memory.
SLICE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the session has it.

    Only a local-mode session without that setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
    if checkpoint.isDefined():
        return checkpoint.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


class Workspace:
    """Tables written to the shared folder to cut lineage; a lost executor never loses them.

    Tables stay until drop() or the end of the driver's process, as results read them lazily.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._millrace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_millrace_path", None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone at exit
            pass


WORD_CHARACTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters. Python's word characters take in numerals such as superscripts, which are no letters and end a run."""
    runs = WORD_CHARACTERS.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [x for run in runs for x in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def bounded_sample(rows: DataFrame, work: Workspace, key: str, text: str, most: int) -> DataFrame:
    """The rows, in the order of their keys' hashes, whose texts have `most` characters in all; whole texts only.

    A text of more than a sixteenth of `most` is left out, and those after it count. rows: a bounded sample.
    """
    saved = work.save(rows.withColumn("sample_row", F.monotonically_increasing_id()), "sample")
    order = Window.orderBy(F.xxhash64(key), key, "sample_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = saved.select(key, "sample_row", F.coalesce(F.length(text), F.lit(0)).alias("size")).filter(F.col("size") <= most // 16)
    held = sized.withColumn("through", F.sum("size").over(order)).filter(F.col("through") <= most)  # a bounded sample's ids and sizes
    return saved.join(held.select("sample_row"), "sample_row").drop("sample_row")


def row_key(*columns: str) -> Column:
    """128 bits that name a row by these columns."""
    part = lambda *x: F.lpad(F.hex(F.xxhash64(*x)), 16, "0")
    return F.unhex(F.concat(part(*columns), part(F.lit(1), *reversed(columns))))


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """[from, to) row ranges of about `most` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            ends.append((start, i))
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        ends.append((start, len(sizes)))
    return iter(ends)


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts as large_string without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunked(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks, each position's chunk number, and each row's first position (n + 1 numbers)."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.values.dictionary_encode()
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


def white_space_chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """chunked() over the runs of characters other than 0x20 and 0x09-0x0D."""
    uniq, at, offsets = chunked(pc.ascii_split_whitespace(texts))
    if "" in uniq:  # before leading and after trailing white space
        keep = at != uniq.index("")
        before = np.concatenate(([0], np.cumsum(keep)))
        at, offsets = at[keep], before[offsets]
    return uniq, at, offsets


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]] along the first axis; empty segments give 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Bitmap:
    """A Bloom filter over 64-bit hashes, of bounded size: what it lets through is joined exactly afterwards."""

    PROBES = 3

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, 8 * len(bits)

    @staticmethod
    def place(hashes: np.ndarray, probe: int, size: int) -> np.ndarray:
        return (mix64(hashes.view(np.uint64) + np.uint64((probe + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(size - 1)).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that it may hold; each probe looks at what the ones before left."""
        left = np.arange(len(hashes))
        for k in range(self.PROBES):
            at = self.place(hashes[left] if k else hashes, k, self.size)
            left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        return left

    @staticmethod
    def of(hashes: DataFrame, each: int = 32, most: int = 1 << 27) -> "Bitmap":
        """hashes: one column of longs, a saved table. `each` bits a hash, `most` at most: most / 64 rows reach the driver."""
        size = 1 << 10
        while size < min(most, each * hashes.count()):
            size *= 2

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size // 8, np.uint8)
            for batch in batches:
                for k in range(Bitmap.PROBES):
                    at = Bitmap.place(batch.column(0).to_numpy(), k, size)
                    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            words = bits.view(np.int64)
            used = np.flatnonzero(words)
            for a in range(0, len(used), 1 << 16):
                own = used[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(words[own])], ["word", "bits"])

        found = hashes.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(size // 64, np.int64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        return Bitmap(words.view(np.uint8))
