"""URL filter: sorted digest array, memory-mapped and probed by vectorised binary search.

Rules are (host, path) strings with a verdict. Each rule's `host + path` is hashed to a 64-bit
xxhash; the digests lie sorted in a flat file beside the rules' full strings. An executor maps the
file into memory once, probes all candidate keys of a batch with one `searchsorted`, and confirms
each digest hit against the stored full string, so a collision can't decide.

A rule fits its host and all subdomains when the url's path starts with the rule's path. The longest
fitting rule string wins; between equal lengths the longer host, then `block`.

Edge cases: a null url, or one without `://`, has empty host and path and no rule. Extra columns are
kept out of the result. An empty rule list allows everything. Repeated rules count once; a rule string
given with both verdicts blocks. A url of any length is judged whole, in time and memory that grow with its length.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read_table

_OPEN: dict[str, "DigestArray"] = {}


class Ranges:
    """Bytes of a file in a store that isn't mounted, read by range."""

    def __init__(self, file):
        self.file = file

    def __getitem__(self, at: slice) -> np.ndarray:
        self.file.seek(at.start)
        return np.frombuffer(self.file.read(at.stop - at.start), np.uint8)


class DigestArray:
    """The rules as one flat byte string: counts, path lengths, hosts' label counts, digests, offsets, hosts' lengths, verdicts, strings."""

    def __init__(self, raw: np.ndarray | Ranges):
        n, n_lengths, n_labels = raw[0:24].view("<i8").tolist()
        at = 24

        def part(size: int, kind: str) -> np.ndarray:
            nonlocal at
            at += size
            return raw[at - size : at].view(kind)

        self.lengths, self.labels = part(8 * n_lengths, "<i8").tolist(), part(8 * n_labels, "<i8").tolist()
        self.digests, self.offsets, self.hosts, self.block = part(8 * n, "<u8"), part(8 * (n + 1), "<i8"), part(8 * n, "<i8"), part(n, "u1")
        self.raw, self.start = raw, at

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """rules: (verdict, host, path)."""
        kept: dict[tuple[str, str], bool] = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"no such verdict: {verdict!r}")
            kept[host, path] = kept.get((host, path), False) or verdict == "block"
        rows = sorted((xxhash.xxh64_intdigest((h + p).encode()), (h + p).encode(), len(h.encode()), b) for (h, p), b in kept.items())
        strings = [r[1] for r in rows]
        lengths, labels = sorted({len(p) for _, p in kept}), sorted({h.count(".") + 1 for h, _ in kept})
        return b"".join((
            np.array([len(rows), len(lengths), len(labels)], "<i8").tobytes(),
            np.array(lengths + labels, "<i8").tobytes(),
            np.array([r[0] for r in rows], "<u8").tobytes(),
            np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype("<i8").tobytes(),
            np.array([r[2] for r in rows], "<i8").tobytes(),
            np.array([r[3] for r in rows], "u1").tobytes(),
            *strings,
        ))

    @classmethod
    def opened(cls, uri: str) -> "DigestArray":
        """The array in the shared folder, opened once a worker."""
        if uri not in _OPEN:
            store, path = fs.FileSystem.from_uri(uri)
            _OPEN[uri] = cls(np.memmap(path, np.uint8, "r") if isinstance(store, fs.LocalFileSystem) else Ranges(store.open_input_file(path)))
        return _OPEN[uri]

    def string(self, k: int) -> bytes:
        return self.raw[self.start + int(self.offsets[k]) : self.start + int(self.offsets[k + 1])].tobytes()

    def find(self, keys: list[tuple[bytes, int]]) -> np.ndarray:
        """Rule number of each (host + path, bytes of host), or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return found
        want = np.array([xxhash.xxh64_intdigest(k) for k, _ in keys], np.uint64)
        at = np.searchsorted(self.digests, want)
        for i in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == want)):
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == want[i]:  # all rules of that digest
                if self.hosts[k] == keys[i][1] and self.string(k) == keys[i][0]:
                    found[i] = k
                    break
                k += 1
        return found


def candidates(host: str, path: str, lengths: list[int], labels: list[int]) -> list[tuple[bytes, int]]:
    """Rule keys that could fit: each domain suffix of as many labels as rules have with each path prefix of a length that rules have.

    Labels are counted from the end, so that a host costs no more than the longest rule, however many dots it has.
    """
    out, at, k = [], len(host), 0
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    for n in labels:
        while k < n and at >= 0:
            at, k = host.rfind(".", 0, at), k + 1
        if k < n:
            break  # fewer labels than that
        suffix = host[at + 1 :]
        size = len(suffix.encode())
        out += [((suffix + p).encode(), size) for p in prefixes]
    return out


def _split(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}
RESULT = "page_id long, host string, path string, rule string, verdict string"


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Judges each url: key, host, path, rule (null if none fits), verdict.

    rules: (verdict, host, path). For rules that are a table already, see filter_urls_by_join.
    """
    uri = Workspace(pages.sparkSession, "rules").path("digests")
    uri = uri if "://" in uri or uri.startswith("file:") else "file://" + uri
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        f.write(DigestArray.build(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.opened(uri)
        for batch in batches:
            split = [_split(u) for u in batch.column(1).to_pylist()]
            keys, owner = [], []
            for i, (h, p) in enumerate(split):
                if h or p:
                    own = candidates(h, p, array.lengths, array.labels)
                    keys += own
                    owner += [i] * len(own)
            best: dict[int, tuple] = {}
            hits = array.find(keys)
            for j in np.flatnonzero(hits >= 0):
                k, i = int(hits[j]), owner[j]
                s = array.string(k).decode()
                rank = (len(s), int(array.hosts[k]), bool(array.block[k]), s)
                if i not in best or rank > best[i]:
                    best[i] = rank
            rule = [best[i][3] if i in best else None for i in range(len(split))]
            verdict = [("block" if best[i][2] else "allow") if i in best else default for i in range(len(split))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).mapInArrow(judge, RESULT)


def filter_urls_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """filter_urls for rule tables of any size (columns verdict, host, path): a shuffle join on the digest.

    Both sides are dealt by `xxhash64(host, path)`; full strings are compared in the join condition.
    """
    after = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)"))
    host = F.translate(F.coalesce(F.regexp_extract(after, r"^[^/?#]*", 0), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    # saved, so that Spark splits keys that many urls share, and that a url's number is given once
    work = Workspace(pages.sparkSession, "rules")
    rules = work.save(rules.groupBy("host", "path").agg(F.min(F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("open")), "rules")
    # distinct path lengths: bounded by the longest path, never by the number of rules
    lengths = F.array(*[F.lit(r["n"]) for r in rules.select(F.length("path").alias("n")).distinct().collect()]).cast("array<int>")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("uid"))
    urls = work.save(urls, "urls")
    # and of hosts' labels: a url has no more suffixes than rules have label counts
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    labels = F.array(*[F.lit(r["n"]) for r in rules.select((dots("host") + 1).alias("n")).distinct().collect()]).cast("array<int>")
    suffixes = F.transform(F.filter(labels, lambda n: n <= dots("host") + 1), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    suffixed = urls.filter("host <> '' or path <> ''").select("uid", "path", F.explode(suffixes).alias("sub"))
    keyed = suffixed.select("uid", F.col("sub").alias("host"), "path", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n")).select("uid", "host", F.expr("substr(path, 1, n)").alias("path"))
    best = keyed.join(rules, ["host", "path"]).groupBy("uid").agg(F.max(F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), (1 - F.col("open")).alias("block"), F.concat("host", "path").alias("rule"))).alias("best"))
    out = urls.join(best, "uid", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.block") == 1, "block").otherwise("allow").alias("verdict"))


#: The rules of the registered query.
QUERY_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), QUERY_RULES)


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT h.*, verdict, rhost || rpath AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
