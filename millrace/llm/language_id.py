"""Language identification: known words first, then shorter and shorter character n-grams.

Fitting counts words by language over a bounded, hash-chosen sample of the labelled training rows
(FIT_DOCS rows expected, whole texts, FIT_CHARS characters at most) and, from the distinct words and their counts, character n-grams of lengths 1 to 5. Everything
is counted on the executors. The model has an entry for every word and n-gram of the sample, however rare: a
64-bit hash and a number a language, sorted by hash.

Scoring. A word is a run of letters, lower-cased. A known word adds its log frequency in each language.
An unknown word backs off: the longest n-gram length at which any of its n-grams is known, from 5 down to
1, adds the mean log frequency of those n-grams. The text's language has the largest mean over all words;
the score is the posterior over languages of that mean times min(words, EVIDENCE).

Edge cases: null text and text without a letter give `und` and score 0. A text with letters that no n-gram
knows gets the most frequent training language and that language's share of the training words. Ties go to
the smaller language name. Without any training row every text is `und`. Rows repeated in training count
as often as they occur; extra columns are ignored. Letters are Unicode's: numerals such as a superscript two are none.
Texts and words of any length are read whole: an unknown word of n letters takes n steps a length of n-grams.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, as_strings, bounded_sample, letter_runs, read_table, segment_sums, text_slices, white_space_chunks

FIT_DOCS = 20_000
#: Characters of the sample's texts at most: they bound the model that the driver gathers and broadcasts.
FIT_CHARS = 1 << 28
LONGEST = 5
EVIDENCE = 40
REMEMBERED = 200_000
REMEMBERED_CHARS = 1 << 24
#: Text that a scoring task takes apart at once, in bytes, and new chunks of it whose words' n-grams it holds: their strings take some twenty times the text.
SCORED_BYTES, SCORED_CHUNKS = 2 << 20, 16_384
#: Distinct words that a fitting task counts before it sends its counts on.
COUNTED = 40_000


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _words(labelled: DataFrame) -> DataFrame:
    """(lang, gram, count) of whole words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(letter_runs((text or "").lower()))
            if sum(map(len, held.values())) > COUNTED:
                yield from flush(held)
                held = {}
        yield from flush(held)

    def flush(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "gram", "count"])

    out = labelled.select("text", "lang").mapInArrow(count, "lang string, gram string, count long")
    return out.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def _counts(words: DataFrame) -> DataFrame:
    """(lang, n, gram, count): words with n 0, and their n-grams, cut from each word once and counted in the task first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for lang, word, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                marked = f"<{word}>"
                for n in range(1, LONGEST + 1):
                    for a in range(0, len(marked) - n + 1, COUNTED):
                        for i in range(a, min(a + COUNTED, len(marked) - n + 1)):
                            held[lang, n, marked[i : i + n]] += count
                        if len(held) > COUNTED:
                            yield flush(held)
                            held = Counter()
        if held:
            yield flush(held)

    def flush(held: Counter) -> pa.RecordBatch:
        lang, n, gram = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(gram, pa.string()), pa.array(held.values(), pa.int64())], ["lang", "n", "gram", "count"])

    cut_up = words.select("lang", "gram", "count").mapInArrow(cut, "lang string, n int, gram string, count long")
    grams = cut_up.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    return words.select("lang", F.lit(0).alias("n"), "gram", "count").unionByName(grams)


class Model:
    """Log frequencies by language of words and n-grams: for each length sorted hashes and their rows."""

    def __init__(self, languages: list[str], shares: np.ndarray, keys: list[np.ndarray], rows: list[np.ndarray]):
        self.languages, self.shares, self.keys, self.rows = languages, shares, keys, rows
        self.known: dict[str, int] = {}
        self.known_chars = 0
        self.sums = np.zeros((0, len(languages) + 2), np.float32)

    @staticmethod
    def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS, key: str = "doc_id", fit_chars: int = FIT_CHARS) -> "Model":
        """labelled: key, text, lang (not null). The sample is chosen by a hash of the key alone."""
        work = Workspace(labelled.sparkSession, "language")
        total = labelled.count()
        if total > fit_docs:
            labelled = labelled.filter(F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1 << 30)) < int(fit_docs / total * (1 << 30)))
        labelled = bounded_sample(labelled.select(key, "text", "lang").filter("text <> ''"), work, key, "text", fit_chars)
        counts = work.save(_counts(work.save(_words(labelled), "words")), "counts")
        sums = {(r["n"], r["lang"]): (r["tokens"], r["types"]) for r in counts.groupBy("n", "lang").agg(F.sum("count").alias("tokens"), F.count("*").alias("types")).collect()}
        languages = sorted({lang for _, lang in sums})
        tokens = lambda n: np.array([sums.get((n, x), (0, 0))[0] for x in languages], float)
        each = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("count"))), F.lit(0)).cast("float").alias(f"c{k}") for k, x in enumerate(languages)]
        # the sample's words and n-grams as hashes: their number is bounded by the sample
        found = counts.groupBy("n", F.xxhash64("gram").alias("h")).agg(*each).toArrow() if languages else None
        work.drop(counts)
        keys, rows = [], []
        for n in range(LONGEST + 1):
            types = sum(t for (m, _), (_, t) in sums.items() if m == n)
            if not languages:
                keys.append(np.zeros(0, np.int64))
                rows.append(np.zeros((0, 0), np.float32))
                continue
            at = np.flatnonzero(found.column("n").to_numpy() == n)
            h = found.column("h").to_numpy()[at]
            order = np.argsort(h)
            keys.append(h[order])
            below = np.log(tokens(n) + 0.5 * types + 1)
            rows.append(np.stack([np.log(found.column(f"c{k}").to_numpy()[at][order] + np.float32(0.5)) - np.float32(below[k]) for k in range(len(languages))], axis=1))
        shares = tokens(0) / max(1.0, tokens(0).sum())
        return Model(languages, shares, keys, rows)

    def find(self, n: int, names: list[str]) -> np.ndarray:
        """Each name's row among those of length n, or -1."""
        keys = self.keys[n]
        if not len(keys):
            return np.full(len(names), -1)
        h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in names), np.uint64, len(names)).view(np.int64)  # as Spark's xxhash64
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies by language of each word, and whether it or any of its n-grams is known."""
        at = self.find(0, words)
        out, scored = np.zeros((len(words), len(self.languages))), at >= 0
        out[scored] = self.rows[0][at[scored]]
        left = np.flatnonzero(~scored)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            own = [grams(words[i], n) for i in left]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in own])
            at = self.find(n, [g for x in own for g in x])
            hit = at >= 0
            n_hits = np.bincount(owner[hit], minlength=len(left))
            for k in range(len(self.languages)):
                out[left, k] = np.bincount(owner[hit], self.rows[n][at[hit], k], len(left)) / np.maximum(n_hits, 1)
            scored[left] = n_hits > 0
            left = left[n_hits == 0]
        return out, scored

    def chunks(self, chunks: list[str]) -> np.ndarray:
        """A row a chunk: sums by language over its words, then the numbers of scored words and of words."""
        found = [letter_runs(c.lower()) for c in chunks]
        uniq = {w: i for i, w in enumerate(dict.fromkeys(w for x in found for w in x))}
        value, scored = self.words(list(uniq))
        owner = np.repeat(np.arange(len(chunks)), [len(x) for x in found])
        at = np.fromiter((uniq[w] for x in found for w in x), np.int64, len(owner))
        columns = [np.bincount(owner, value[at, k], len(chunks)) for k in range(len(self.languages))]
        return np.stack([*columns, np.bincount(owner, scored[at], len(chunks)), np.bincount(owner, minlength=len(chunks))], axis=1).astype(np.float32)

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        uniq, at, offsets = white_space_chunks(texts)
        if len(self.known) > REMEMBERED or self.known_chars > REMEMBERED_CHARS:
            self.known.clear()
            self.known_chars = 0
            self.sums = self.sums[:0]
        known = self.known
        if new := [c for c in uniq if c not in known]:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.known_chars += sum(map(len, new))
            self.sums = np.concatenate([self.sums, *[self.chunks(new[i : i + SCORED_CHUNKS]) for i in range(0, len(new), SCORED_CHUNKS)]])
        number = np.fromiter((known[c] for c in uniq), np.int64, len(uniq))
        width = len(self.languages) + 2
        sums = np.stack([segment_sums(self.sums[number[at], k], offsets) for k in range(width)], axis=1)
        n, letters = np.rint(sums[:, -2]), np.rint(sums[:, -1]) > 0
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        mean = np.round(sums[:, :-2] / np.maximum(n, 1)[:, None], 9)
        power = mean * np.minimum(n, EVIDENCE)[:, None]
        power -= power.max(axis=1, keepdims=True)
        post = np.exp(power)
        post /= post.sum(axis=1, keepdims=True)
        post[n == 0] = self.shares
        best = post.argmax(axis=1)  # the first of equals: the smaller name
        score = np.where(letters, post[np.arange(len(best)), best], 0.0)
        return [self.languages[b] if x else "und" for b, x in zip(best, letters, strict=True)], score


def predict(docs: DataFrame, model: Model, *keep: str | Column) -> DataFrame:
    """keep columns, then lang_pred and score, for every row of docs (text). A caller that keeps columns of any name keeps a struct.

    Only texts go to Python and only the two results come back: kept columns stay in Spark's rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 8 + 4 * languages bytes for each word and n-gram of the sample

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for batch in batches:
            texts = as_strings(batch)
            lang, found = [], [np.zeros(0)]
            for a, b in text_slices(texts, SCORED_BYTES):
                own, s = m.score(texts.slice(a, b - a))
                lang += own
                found.append(np.clip(s, 0, 1))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(found))], ["lang_pred", "score"])

    judge = F.arrow_udf(score, "lang_pred string, score double").asNondeterministic()  # so that a filter on its results doesn't run it again
    kept = docs.select(*keep)
    rows = docs.select(F.struct(*keep).alias("kept"), judge("text").alias("found"))
    return rows.select(*[F.col("kept").getField(c).alias(c) for c in kept.columns], "found.lang_pred", "found.score")


def held_out(key: str = "doc_id", of: int = 5, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == rest, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = Model.fit(docs.filter(F.col("lang").isNotNull() & ~held_out()))
    return predict(docs, model, "doc_id", held_out().alias("held_out"))
