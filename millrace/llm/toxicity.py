"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's bag holds the hashes of the word and of its character n-grams (3 to 6, with word ends); its
vector is the mean of their embeddings. A window of WINDOW words is the mean of its words' vectors, and a
linear softmax over two classes reads it. A document's score is that of its most toxic window, in training
as in scoring, so that a short passage counts alike in short and long texts. Embeddings and softmax are
trained together by Adam on the cross-entropy, over the FEATURES buckets whose
means differ most between the classes (t statistic LEAST_T or more). Unseen inflections and misspellings share n-grams, and so
vectors, with words seen in training.

Only those buckets are trained: with all of them the model learns the few toxic texts by heart and finds none that
are held out (README has the figures).

Fitting uses a bounded, hash-chosen sample of the labelled training rows: FIT_DOCS rows expected, one a doc_id, with
their whole texts, in the order of a hash until they have FIT_CHARS characters. Everything is seeded and reruns agree.

As the classifier is linear in the averages, a word adds one number to its window; workers remember that
number by word and scoring is a lookup and a running sum.

Edge cases: null and empty texts, and texts without a letter, score 0. Without labelled rows of both classes
every document scores 0. Several labels of one document: any toxic label makes it toxic. Repeated document
rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, as_strings, bounded_sample, read_table, text_slices, white_space_chunks
from .language_id import held_out

FIT_DOCS = 8_000
FIT_CHARS = 1 << 26
WINDOW = 256
MIN_DOCS = 5
FEATURES = 2_048
LEAST_T = 3.5
DIM = 8
BUCKETS = 1 << 17
EPOCHS = 20
BATCH = 128
RATE = 0.01
DECAY = 1e-4
THRESHOLD = 0.7
REMEMBERED = 600_000
LETTERS = re.compile(r"[^\W\d_]+")


def parts_of(word: str) -> set[str]:
    marked = f"<{word}>"
    found = {marked[i : i + n] for n in (3, 4, 5, 6) for i in range(len(marked) - n + 1)}
    found.add(marked)
    return found


def bucket(part: str) -> int:
    return xxhash.xxh3_64_intdigest(part) % BUCKETS


def windows(n: int) -> np.ndarray:
    """Window bounds over n words: WINDOW words each, the last with up to half as many more."""
    k = max(1, (n + WINDOW // 2) // WINDOW)
    return np.append(np.arange(k) * WINDOW, n)


class Model:
    def __init__(self, weights: dict[str, float] | None, bias: float):
        """weights: what each n-gram seen in training, in a chosen bucket, adds to the two logits' difference."""
        self.weights, self.bias = weights, bias
        self.known: dict[str, list[float]] = {}

    @staticmethod
    def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> "Model":
        toxic = np.asarray(toxic, bool)
        if not len(toxic) or toxic.all() or not toxic.any():
            return Model(None, 0.0)
        vocabulary: dict[str, int] = {}
        docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in LETTERS.findall(t.lower())], np.int64) for t in texts]
        usable = np.array([i for i, d in enumerate(docs) if len(d)], np.int64)
        if not len(usable) or toxic[usable].all() or not toxic[usable].any():
            return Model(None, 0.0)
        docs, toxic = [docs[i] for i in usable], toxic[usable]
        bags = [np.array([bucket(x) for x in parts_of(w)]) for w in vocabulary]
        size = np.array([len(b) for b in bags])
        flat, starts = np.concatenate(bags), np.cumsum(size) - size

        def spread(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The buckets of words, and what each adds to its word's mean."""
            n = size[words]
            return flat[np.repeat(starts[words] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(1 / n, n)

        # buckets whose mean in a text differs between the classes beyond chance; the rest would be learnt by heart
        sums, squares, holders = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS)), np.zeros(BUCKETS, np.int64)
        for d, y in zip(docs, toxic.astype(int), strict=True):
            buckets, value = spread(d)
            own, at = np.unique(buckets, return_inverse=True)
            mean = np.bincount(at, value) / len(d)
            sums[y, own] += mean
            squares[y, own] += mean**2
            holders[own] += 1
        n = np.array([(~toxic).sum(), toxic.sum()])[:, None]
        variance = np.maximum(squares / n - (sums / n) ** 2, 0)
        t = (sums[1] / n[1] - sums[0] / n[0]) / np.sqrt((variance / n).sum(axis=0) + 1e-12)
        t[holders < MIN_DOCS] = 0
        kept = np.argsort(-np.abs(t), kind="stable")[:FEATURES]
        kept = np.sort(kept[np.abs(t[kept]) >= LEAST_T])
        if not len(kept):
            return Model(None, 0.0)
        place = np.full(BUCKETS, -1)
        place[kept] = np.arange(len(kept))

        rows, first = [], [0]
        for d in docs:
            w = windows(len(d))
            for a, b in zip(w[:-1], w[1:], strict=True):
                buckets, value = spread(d[a:b])
                at = place[buckets]
                rows.append(np.bincount(at[at >= 0], value[at >= 0] / (b - a), len(kept)).astype(np.float32))
            first.append(len(rows))
        x, first = np.stack(rows), np.array(first)
        scale = 1 / (x.std(axis=0) + 1e-6)
        x *= scale

        rng = np.random.default_rng(seed)
        state = [rng.normal(0, 0.01, (len(kept), DIM)), rng.normal(0, 0.5, (DIM, 2)), np.log([1 - toxic.mean(), toxic.mean()])]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in state]
        step = 0
        for _ in range(EPOCHS):
            for chosen in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
                table, out, bias = state
                own = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
                logits = (x[own] @ table) @ out + bias
                ends = np.cumsum(first[chosen + 1] - first[chosen])
                margin = logits[:, 1] - logits[:, 0]
                best = np.array([a + int(np.argmax(margin[a:b])) for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)])
                z = logits[best] - logits[best].max(axis=1, keepdims=True)
                grad = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
                grad[np.arange(len(best)), toxic[chosen].astype(int)] -= 1
                grad /= len(best)
                seen = x[own[best]]
                grads = [seen.T @ (grad @ out.T) + DECAY * table, (seen @ table).T @ grad + DECAY * out, grad.sum(axis=0)]
                step += 1
                for p, g, (m, v) in zip(state, grads, moments, strict=True):  # Adam
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        table, out, bias = state
        value = scale * (table @ (out[:, 1] - out[:, 0]))
        holds = np.logical_or.reduceat(place[flat] >= 0, starts)
        weights = {x: float(value[at]) for w, h in zip(vocabulary, holds, strict=True) if h for x in parts_of(w) if (at := place[bucket(x)]) >= 0}
        return Model(weights, float(bias[1] - bias[0]))

    def chunk(self, chunk: str) -> list[float]:
        get, out = self.weights.get, []
        for w in LETTERS.findall(chunk.lower()):
            found = parts_of(w)
            out.append(sum(map(get, found, repeat(0.0))) / len(found))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        uniq, at, offsets = white_space_chunks(texts)
        known = self.known
        for c in uniq:
            if c not in known:
                known[c] = self.chunk(c)
        own = [known[c] for c in uniq]
        size = np.array([len(o) for o in own], np.int64)
        flat = np.array([x for o in own for x in o])
        starts = np.cumsum(size) - size
        n = size[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        values = flat[np.repeat(starts[at] - ends[1:] + n, n) + np.arange(ends[-1])] if len(at) and len(flat) else np.zeros(0)
        bounds = ends[offsets]
        run = np.concatenate(([0.0], np.cumsum(values)))
        out = np.zeros(len(texts))
        for i in range(len(texts)):
            a, b = bounds[i], bounds[i + 1]
            if b > a:
                w = windows(b - a) + a
                x = ((run[w[1:]] - run[w[:-1]]) / np.diff(w)).max() + self.bias
                out[i] = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        return out


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (null: unlabelled), both training rows only."""
    work = Workspace(docs.sparkSession, "toxicity")
    # the sample is chosen among the labels, so that only its documents' texts are shuffled to them
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = marked.count()
    if total > fit_docs:
        marked = marked.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < int(fit_docs / total * (1 << 30)))
    chosen = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * fit_docs))  # at most 2 * FIT_DOCS rows of 12 bytes
    # of rows that share a doc_id one counts
    rows = docs.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    held = bounded_sample(rows, work, "doc_id", "text", fit_chars).toPandas().sort_values("doc_id")  # fit_chars characters at most
    return Model.fit(held["text"].tolist(), held["toxic"].to_numpy() > 0)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = as_strings(batch.column(2))
            for a, b in text_slices(texts):
                s = m.score(texts.slice(a, b - a))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.int64()), own.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.filter(~held_out("doc_id", 3, 1)))
    return score_documents(docs, model)
