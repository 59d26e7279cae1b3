"""Token ids in flat shard files with a minimal perfect hash index.

Writing. Documents are range-partitioned by doc_id and sorted; every task encodes its documents and
writes one shard: a payload of raw little-endian ids, and a companion with the documents' start offsets.
File names carry the attempt, and only rows of the attempt that Spark commits name a file, so retried or
speculative tasks can't mix. Ids of vocabularies up to 65,536 are stored in two bytes, else in four.

Index. A key (doc_id, k) stands for the k-th shard that holds rows of doc_id (k > 0 only where repeated
rows of one id span shards). Keys are hashed to index parts of bounded size; each part holds a minimal
perfect hash function built level by level: keys alone in their slot of a bit array stay, the others
go to the next, smaller level; a key's number is the rank of its bit. Beside it lie per number a 64-bit
fingerprint, shard, ordinal and row count. A lookup costs a few bit probes and one comparison of
fingerprints, and an id the files don't hold is answered by "absent".

Encoding is done by the tokenizers library on distinct chunks only. A text is cut before every single
space that stands between two characters that aren't white space; byte-level pre-tokenisation never joins
such chunks. Texts with any other arrangement of spaces are encoded whole. The ids are those of the plain call of
the tokenizer: a special token's string in a text becomes that token's id.

Edge cases: null text counts as empty (its only id is the end id); a null doc_id sorts first and is keyed
like any other; repeated rows are separate documents that lie side by side; extra columns are ignored; an
empty table gives no shard.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, as_strings, chunked, mix64, text_slices

#: Chunks a worker remembers; beyond, it forgets all and starts anew.
REMEMBERED = 600_000
#: Keys in one part of the index: bounds what a task or a lookup holds in memory.
KEYS_PER_PART = 500_000
#: Ids in a shard before a task starts its next one, and shards that one task can number.
SHARD_TOKENS, SHARDS_PER_TASK = 1 << 28, 1 << 20
#: Ids read from a shard at once, one document at least: for a single key, and at most.
FIRST_READ, READ_TOKENS = 1 << 14, 1 << 22
MAGIC = b"MRTOK1\0\0"


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # special strings in a text become their ids, as the plain call has it; one that takes the white space beside
        # it, or holds any, would reach over a cut
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized or any(c.isspace() for c in t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        size = self.tokenizer.get_vocab_size()
        self.opens = np.zeros(size, bool)  # ids whose first byte is a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = [], [], []
        self.total = 0

    def _learn(self, chunks: list[str]) -> None:
        """Encodes new chunks, each with its leading space, in one call; ids split where a space opens a token."""
        plain = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace()] if self.plain else []
        known = self.known
        for c in set(chunks).difference(plain):
            known[c] = -1  # white space beside the cut: the text is encoded whole
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(part):  # a chunk holds another token that opens with a space
                each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([" " + c for c in part], add_special_tokens=False)]
                ids, at = np.concatenate(each), np.concatenate(([0], np.cumsum([len(e) for e in each])[:-1]))
            n = len(self.starts)
            known.update(zip(part, range(n, n + len(part)), strict=True))
            self.starts += (at + self.total).tolist()
            self.sizes += np.diff(np.append(at, len(ids))).tolist()
            self.flat.append(ids)
            self.total += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids."""
        if len(self.known) > REMEMBERED:
            self._forget()
        uniq, at, offsets = chunked(pc.split_pattern(texts, " "))
        known = self.known
        self._learn([c for c in uniq if c not in known])
        number = np.fromiter((known[c] for c in uniq), np.int64, len(uniq))
        flat = np.concatenate(self.flat) if self.flat else np.zeros(0, np.uint32)
        self.flat = [flat]
        starts, sizes = np.append(np.array(self.starts, np.int64), 0), np.append(np.array(self.sizes, np.int64), 0)
        which = number[at]
        first = offsets[:-1]
        bad = np.logical_or.reduceat(which < 0, first) if len(at) else np.zeros(0, bool)
        which[first] = -1  # a text's first chunk has no leading space
        size = sizes[which]
        ends = np.cumsum(size)
        ids = flat[np.repeat(starts[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[offsets]
        out, lengths = [], np.zeros(len(texts), np.int64)
        heads = self.tokenizer.encode_batch_fast([uniq[k] for k in at[first]], add_special_tokens=False)
        for i in range(len(texts)):
            if bad[i]:
                whole = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
                out.append(np.array(whole, np.uint32))
                lengths[i] = len(whole)
            else:
                head = np.array(heads[i].ids, np.uint32)
                out += (head, ids[bounds[i] : bounds[i + 1]])
                lengths[i] = len(head) + bounds[i + 1] - bounds[i]
        return np.concatenate(out) if out else np.zeros(0, np.uint32), lengths


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _read(uri: str) -> np.ndarray:
    store, path = _store(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


class Shard:
    """A shard opened for reading: its start offsets (SHARD_TOKENS bounds them) and ranges of its payload."""

    HEADER = 16

    def __init__(self, name: str):
        store, path = _store(name + ".ids")
        self.file = store.open_input_file(path)
        head = self.file.read(self.HEADER)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a shard: {name}")
        self.kind = np.dtype(f"<u{head[len(MAGIC)]}")
        self.pos = _read(name + ".pos").view("<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at [start, stop)."""
        self.file.seek(self.HEADER + start * self.kind.itemsize)
        return np.frombuffer(self.file.read((stop - start) * self.kind.itemsize), self.kind)

    def close(self) -> None:
        self.file.close()


ROWS = "shard long, ordinal long, doc_id long, first long, n_tokens long, file string"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, work: Workspace, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards below `folder`; returns the saved table of documents as they lie in the files.

    A task starts a new shard after SHARD_TOKENS ids. docs should be a table as read from files: equal rows are
    told apart by their place in it.
    """
    store, path = _store(folder)
    store.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        wide = np.dtype("<u2") if len(enc.opens) <= 1 << 16 else np.dtype("<u4")
        task = TaskContext.get()
        sink, shard, name, at, n, starts = None, task.partitionId() * SHARDS_PER_TASK - 1, "", 0, 0, []

        def close() -> None:
            sink.close()
            out_store, out_path = _store(name + ".pos")
            with out_store.open_output_stream(out_path) as f:
                f.write(np.concatenate([*starts, [at]]).astype("<u8").tobytes())

        for batch in batches:
            texts = as_strings(batch.column(1))
            for a, b in text_slices(texts):
                if sink is not None and at >= shard_tokens:
                    close()
                    sink = None
                if sink is None:
                    shard, at, n, starts = shard + 1, 0, 0, []
                    name = f"{folder}/shard-{shard:012d}-{task.taskAttemptId()}"
                    out_store, out_path = _store(name + ".ids")
                    sink = out_store.open_output_stream(out_path)
                    sink.write(MAGIC + bytes([wide.itemsize]) + bytes(7))
                ids, sizes = enc.encode(texts.slice(a, b - a))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                sizes = sizes + 1
                sink.write(ids.astype(wide).tobytes())
                first = at + np.cumsum(sizes) - sizes
                starts.append(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, shard)), pa.array(np.arange(n, n + b - a)), batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(first), pa.array(sizes), pa.array([name] * (b - a))], ["shard", "ordinal", "doc_id", "first", "n_tokens", "file"])
                at, n = at + int(sizes.sum()), n + b - a
        if sink is not None:
            close()

    # equal ids are dealt by text and place too, so that one id, or one row, with a third of all rows doesn't fill one task
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    laid = keyed.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place").select("doc_id", "text")
    return work.save(laid.mapInArrow(write, ROWS), "rows")


class PerfectHash:
    """A minimal perfect hash function over distinct 64-bit hashes, level by level in bit arrays."""

    GAMMA = 1.5

    def __init__(self, levels: list[np.ndarray], seed: int = 1):
        self.levels, self.seed = levels, seed
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - bits + base)
            base += int(bits.sum())
        self.size = base

    @staticmethod
    def slot(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> "PerfectHash":
        """Distinct hashes; keys that share one need another seed (see build_index)."""
        levels, left = [], hashes
        while len(left):
            at = cls.slot(left, len(levels), size := max(1, int(len(left) * cls.GAMMA)))
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers 0..n-1 of keys in the set; any number, or -1, for others."""
        found, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self.slot(hashes[left], k, len(bits))
            hit = bits[at]
            found[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return found


def key_hash(doc_id: np.ndarray, null: np.ndarray, k: np.ndarray, seed: int) -> np.ndarray:
    x = mix64(doc_id.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))
    return mix64(x ^ (k.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))


PRINT = 0  # seed of the fingerprint; a part's own hash has the first seed from 1 on that tells all its keys apart


def _key_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False), null, batch.column(1).to_numpy(zero_copy_only=False)


def _part_file(folder: str, part: int, attempt: int) -> str:
    return f"{folder}/index-{part:08d}-{attempt}.mph"


def build_index(rows: DataFrame, folder: str, work: Workspace) -> tuple[DataFrame, int]:
    """Writes the index parts; returns the table (part, file) of committed parts and the number of parts."""
    segments = rows.groupBy("doc_id", "shard").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n_rows"))
    from pyspark.sql import Window

    # shards of one id: few, as the rows were reduced to one an id and shard
    keys = segments.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("shard")) - 1)
    keys = work.save(keys.withColumn("last", F.lead("shard").over(Window.partitionBy("doc_id").orderBy("shard")).isNull()), "keys")
    parts = max(1, -(-keys.count() // KEYS_PER_PART))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        table = pa.Table.from_batches(held)  # the parts of this task: KEYS_PER_PART keys each, about
        for part in np.unique(table.column("part").to_numpy()):
            own = table.filter(pc.equal(table.column("part"), int(part))).combine_chunks()
            batch = own.select(["doc_id", "k"]).to_batches()[0]
            columns = _key_columns(batch)
            seed, hashes = 1, key_hash(*columns, 1)
            while len(np.unique(hashes)) < len(hashes):
                seed, hashes = seed + 1, key_hash(*columns, seed + 1)
            mph = PerfectHash.build(hashes)
            order = np.argsort(mph.number(hashes))
            name = _part_file(folder, int(part), TaskContext.get().taskAttemptId())
            out = io.BytesIO()
            np.savez(out, prints=key_hash(*columns, PRINT)[order], **{c: own.column(c).to_numpy()[order] for c in ("shard", "ordinal", "n_rows", "last")}, **{f"level{i}": np.packbits(b) for i, b in enumerate(mph.levels)}, sizes=np.array([len(b) for b in mph.levels]), seed=np.int64(seed))
            store, path = _store(name)
            with store.open_output_stream(path) as f:
                f.write(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int64()), pa.array([name])], ["part", "file"])

    dealt = keys.withColumn("part", _part(parts)).repartition(parts, "part").select("doc_id", "k", "shard", "ordinal", "n_rows", "last", "part")
    return work.save(dealt.mapInArrow(build, "part long, file string"), "index"), parts


def _part(parts: int):
    return F.pmod(F.xxhash64(F.lit(7), F.col("doc_id"), F.col("k").cast("long")), F.lit(parts)).cast("long")


class IndexPart:
    def __init__(self, uri: str):
        held = np.load(io.BytesIO(_read(uri).tobytes()))
        self.mph = PerfectHash([np.unpackbits(held[f"level{i}"], count=int(n)).astype(bool) for i, n in enumerate(held["sizes"])], int(held["seed"]))
        self.prints, self.columns = held["prints"], [held[c] for c in ("shard", "ordinal", "n_rows", "last")]

    def look_up(self, doc_id: np.ndarray, null: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which keys the files hold, and those keys' shard, ordinal, number of rows and whether it is the last shard."""
        number = self.mph.number(key_hash(doc_id, null, k, self.mph.seed))
        held = number >= 0
        held[held] = self.prints[number[held]] == key_hash(doc_id, null, k, PRINT)[held]
        return held, [c[number[held]] for c in self.columns]


def look_up(keys: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """(doc_id, k, shard, ordinal, n_rows, last) of the keys (doc_id, k) that the files hold.

    Keys are dealt by index part and each task opens the parts it is asked for, one at a time.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, IndexPart] | None = None
        for batch in batches:
            files = batch.column(2).to_numpy(zero_copy_only=False)
            for name in dict.fromkeys(files):
                own = batch.filter(pa.array(files == name))
                if opened is None or opened[0] != name:
                    opened = (name, IndexPart(name))
                held, values = opened[1].look_up(*_key_columns(own))
                kept = own.filter(pa.array(held))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1).cast(pa.int64()), *(pa.array(v) for v in values)], ["doc_id", "k", "shard", "ordinal", "n_rows", "last"])

    dealt = keys.select(F.col("doc_id").cast("long"), F.col("k").cast("long").alias("k"), _part(parts).alias("part"))
    # one row a part on the other side: its number is keys / KEYS_PER_PART
    named = dealt.join(index, "part").repartition("part").sortWithinPartitions("part").select("doc_id", "k", "file")
    return named.mapInArrow(probe, "doc_id long, k long, shard long, ordinal long, n_rows long, last boolean")


def read_documents(found: DataFrame, files: DataFrame) -> DataFrame:
    """Reads ids of look_up()'s segments from the payloads: doc_id, shard, ordinal, n_tokens, first, ids_crc32.

    files: (shard, file, start), start being the ids in all earlier shards.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, shard = None, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for doc_id, ordinal, n_rows, file, start in zip(*columns, strict=True):
                if file != opened:
                    if shard:
                        shard.close()
                    opened, shard, have, ids, span = file, Shard(file), 0, np.zeros(0, np.uint32), 0
                pos = shard.pos
                for o in range(ordinal, ordinal + n_rows):
                    a, b = int(pos[o]), int(pos[o + 1])
                    if a < have or b > have + len(ids):
                        # whole documents, more and more of them while keys follow each other
                        span = min(2 * span, READ_TOKENS) if a == have + len(ids) else FIRST_READ
                        last = max(o + 1, int(np.searchsorted(pos, a + span, "right")) - 1)
                        have, ids = a, shard.ids(a, int(pos[last]))
                    out[0].append(doc_id)
                    out[1].append(start + a)
                    out[2].append(b - a)
                    out[3].append(zlib.crc32(ids[a - have : b - have].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])
        if shard:
            shard.close()

    dealt = found.join(files, "shard").repartition("shard").sortWithinPartitions("shard", "ordinal").select("doc_id", "ordinal", "n_rows", "file", "start")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes docs to shards with an index and returns one row a document, read back through the index."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    work = Workspace(spark, "tokens")
    folder = f"{work.root}/shards"
    rows = write_shards(docs, folder, tokenizer, end_id, work, shard_tokens)
    index, parts = build_index(rows, folder, work)
    # one row a shard
    sums = rows.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"))
    files = work.save(sums.withColumn("start", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n"), "files")
    keys = rows.groupBy("doc_id", "shard").count().withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("shard")) - 1)
    return read_documents(look_up(keys.select("doc_id", "k"), index, parts), files)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_and_read_back(docs, public_tokenizers.path("byte_bpe_50k.json"))
