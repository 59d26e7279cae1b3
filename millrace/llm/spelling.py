"""Spelling variant grouping: even-partition pigeonhole join (Li, Deng, Wang and Feng 2011) of words at one edit.

1. Words are counted per task, then summed.
2. A word of length l is cut evenly in two segments, whose places depend on l only. One edit leaves one of them whole, so
   two words of length l that are near share its first or its last segment, and a word of length l + 1 that is near holds
   one of them as its own beginning or, shifted by one, as its end. Each word is indexed under its two segments and probes
   with the substrings that words of its length and of one less could share.
3. A segment that more than SMALL words share is split by the same rule: the part of the words that may differ, the window,
   is cut evenly again, and the words meet under the segment with either half of the window, until their number is small or
   the window is one code point. So groups stay bounded: words that agree outside such a window differ in a letter.
4. The words of a group are compared within a task, and each pair found is verified to be one edit apart; pairs that were
   found under both halves are made one.
5. Each word takes its most frequent near word as form where that is frequent enough; chains of forms are followed to
   their ends by pointer doubling, a few rounds, as counts grow tenfold at each step.

Edge cases: null and empty texts and texts without letters have no words. Very long texts and words are read whole; a word of a
million letters is a word like others. A null doc_id counts as an empty one in the checksum. Repeated rows count each. Ties of
frequency go to the smaller word in code-point order. Rare and short words take no part, and an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, as_strings, read_table, text_slices
from .ngram_join import groups_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as its variant.
TIMES = 10
#: One in so many (document, run) pairs loses a code point.
EVERY = 31
#: Words that share a segment without its being split.
SMALL = 128
#: Different words that a task counts before it hands their counts on.
HELD = 200_000


def words_of(doc_id: int | None, text: str) -> Counter:
    """Lower-cased runs of letters of a text with their counts; where the checksum asks for it, a run without one code point."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words long and frequent enough."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_strings(batch.column(1))
            for a, b in text_slices(texts):
                for doc_id, text in zip(ids[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
                    for word, n in words_of(doc_id, text).items():
                        if len(word) >= LEAST_LENGTH:
                            held[word] += n
                    if len(held) > HELD:
                        yield handed()
                        held.clear()
        yield handed()

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def split_windows(rows: DataFrame) -> DataFrame:
    """Each row's two halves: rows (word, n, l, lo, hi) name a word, the length l of the group's shorter words and their window [lo, hi).

    A half's group is named by what lies outside its window; longer words, of l + 1, have a window longer by one.
    """
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi"))))
    cut = rows.withColumn("h", halves).select("word", "n", "l", F.col("h.lo").alias("lo"), F.col("h.hi").alias("hi"))
    longer = F.length("word") - F.col("l")
    # half empty windows (lo = hi) hold only words longer by one code point, and the word they extend
    outside = [F.expr("substring(word, 1, lo)"), F.substring("word", F.col("hi") + longer + 1, F.length("word"))]
    return cut.withColumn("grp", F.xxhash64("l", "lo", "hi", *outside))


def near_in_group(words: list[str], l: int) -> list[tuple[int, int]]:
    """Pairs of different words one edit apart, words being of length l or l + 1, not both longer."""
    short, long = [i for i, w in enumerate(words) if len(w) == l], [i for i, w in enumerate(words) if len(w) == l + 1]
    if len(words) <= 6:
        out = [(i, j) for x, i in enumerate(short) for j in short[x + 1 :] if sum(a != b for a, b in zip(words[i], words[j], strict=True)) == 1]
        return out + [(i, j) for i in short for j in long if one_longer(words[i], words[j])]
    codes = lambda at, n: np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(-1, n)
    out = []
    if not short:
        return out
    a, r = codes(short, l), codes(long, l + 1) if long else None
    step = max(1, (1 << 22) // (len(words) * (l + 1)))
    for lo in range(0, len(short), step):
        own = a[lo : lo + step]
        i, j = np.nonzero((own[:, None] != a[None]).sum(axis=2) == 1)
        out += [(short[x + lo], short[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if x + lo < y]
        if r is not None:
            ahead = np.logical_and.accumulate(own[:, None] == r[None, :, :l], axis=2).sum(axis=2)
            behind = np.logical_and.accumulate((own[:, None] == r[None, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
            i, j = np.nonzero(ahead + behind >= l)
            out += [(short[x + lo], long[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    return out


def one_longer(short: str, long: str) -> bool:
    at = next((i for i, (a, b) in enumerate(zip(short, long, strict=False)) if a != b), len(short))
    return short[at:] == long[at + 1 :]


def near_pairs(words: DataFrame, work: Workspace) -> DataFrame:
    """(word, near, near_n): each word of words (word, n), a saved table, with each word one edit apart, once."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, n, l in groups_of(batches, ["word", "n", "l"]):
            pairs = near_in_group(own, l[0])
            if pairs:
                both = [*pairs, *((j, i) for i, j in pairs)]
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i, _ in both]), pa.array([own[j] for _, j in both]), pa.array([n[j] for _, j in both], pa.int64())], ["word", "near", "near_n"])

    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("l"))
    rows = split_windows(rows.select("word", "n", "l", F.lit(0).alias("lo"), F.col("l").alias("hi")))
    found, level = None, 0
    while True:
        rows = work.save(rows, f"rows{level}")
        # counted map-side; a group without a shorter word, or of one word, holds no pair
        groups = rows.groupBy("grp").agg(F.count("*").alias("m"), F.bool_or(size == F.col("l")).alias("some")).filter((F.col("m") > 1) & F.col("some"))
        named = work.save(rows.join(work.save(groups.select("grp", "m"), f"groups{level}"), "grp"), f"named{level}")
        whole = (F.col("m") <= SMALL) | (F.col("hi") - F.col("lo") <= 1)
        ready = named.filter(whole).select("grp", "word", "n", "l").repartition("grp").sortWithinPartitions("grp", "word")
        pairs = work.save(ready.mapInArrow(compared, "word string, near string, near_n long"), f"pairs{level}")
        found = pairs if found is None else found.unionByName(pairs)
        left = named.filter(~whole)
        work.drop(rows)
        if left.isEmpty():
            return found.distinct()
        rows, level = split_windows(left.select("word", "n", "l", "lo", "hi")), level + 1


def roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """(word, root): the end of each word's chain of forms (word, form), a saved table of the words that have one."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = work.save(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not step.filter("moved").isEmpty()
        now = step.drop("moved")
        if not moved:
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of docs (doc_id, text)."""
    work = Workspace(docs.sparkSession, "spelling")
    words = work.save(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_pairs(words, work).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    form = F.when(F.col("form_n") >= TIMES * F.col("n"), F.col("best.near"))
    found = work.save(found.select("word", "n", form.alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form.isNotNull(), F.col("form_n")).alias("form_n")), "forms")
    ends = roots(work.save(found.filter("form is not null").select("word", "form"), "chains"), work)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, run, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT run, m, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM bytes, crc),
w AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, m FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
gaps AS MATERIALIZED (SELECT word, n, length(word) AS l, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gaps g JOIN w ON w.word = g.rest
  UNION SELECT w.word, g.word FROM gaps g JOIN w ON w.word = g.rest),
near AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, max(n) AS top, min(b) FILTER (n = m) AS form FROM (SELECT a, b, w.n, max(w.n) OVER (PARTITION BY a) AS m FROM pairs JOIN w ON w.word = b) GROUP BY a),
f AS MATERIALIZED (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN form END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain USING (word) JOIN f e ON e.word = chain.at AND e.form IS NULL
"""
