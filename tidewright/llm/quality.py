"""Quality classifier with supervised subword embeddings.

A document's features are its words, the byte n-grams of each word (with marks for the word's start and end), one mark
for each word that repeats the word before it, and one constant. Features are hashed into buckets; each bucket has a
learned vector; a document is the average of its features' vectors; two softmax outputs give the score. Vectors and
output weights are learned by plain stochastic gradient descent in numpy, on a bounded sample of the labelled rows
(`sample`, chosen by a hash of doc_id). As the output is linear in the average, a trained model is applied as one
number per bucket, and that table's size is fixed by `buckets`.

Defined cases: null text is empty; of several labels of a doc_id the largest counts; an empty text is scored by the constant alone; rows without a label are never read
for training; without labels of both kinds every score is 0.5; repeated rows get equal scores; whole texts are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import in_small_batches
from .textcode import Words, chunks, column, seeded

BUCKETS = 1 << 17
DIMENSIONS = 8
EPOCHS = 6
#: Fewer examples get more epochs, up to this many steps.
STEPS = 20_000
RATE = 1.0
SAMPLE = 4000
N_GRAMS = (3, 4, 5)
CUTOFF = 0.7
#: Bytes of text that are scored together; more takes more memory of a worker.
CHUNK = 1 << 19
_CONSTANT, _REPEAT = 0, 1


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Features:
    """Of a chunk: distinct words, each with its buckets; token i is word `of[i]`; `first` as in Words."""

    def __init__(self, texts: pa.Array, buckets: int):
        w = Words(texts)
        h = w.hashes()
        self.first, self.texts = w.first, w.texts
        _, at, self.of = np.unique(h, return_index=True, return_inverse=True)
        start, size = w.start[at], (w.end - w.start)[at]
        padded = np.concatenate([w.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        words, grams = [np.arange(len(at))], [seeded(h[at], 0)]
        for n in N_GRAMS:
            many = np.maximum(size - n + 1, 0)
            word = np.repeat(np.arange(len(at)), many)
            j = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
            key = eight[start[word] + j] & np.uint64((1 << (8 * n)) - 1)
            edge = (j == 0) * np.uint64(1 << 60) + (j == many[word] - 1) * np.uint64(1 << 61)
            words.append(word)
            grams.append(seeded(key | edge, n))
        word, bucket = np.concatenate(words), (np.concatenate(grams) % np.uint64(buckets - 2)).astype(np.int64) + 2
        order = np.argsort(word, kind="stable")
        self.bucket = bucket[order]
        self.word_first = np.searchsorted(word[order], np.arange(len(at) + 1))
        self.repeats = np.zeros(len(h), bool)
        if len(h):
            self.repeats[1:] = h[1:] == h[:-1]
            inner = self.first[:-1]
            self.repeats[inner[inner < len(h)]] = False

    def sums(self, value: np.ndarray) -> np.ndarray:
        """The average of `value` over each text's features."""
        own = np.add.reduceat(value[self.bucket], self.word_first[:-1]) if len(self.bucket) else np.zeros(0)
        many = np.diff(self.word_first)
        total = np.zeros(self.texts)
        count = np.ones(self.texts)
        total += value[_CONSTANT]
        doc = np.repeat(np.arange(self.texts), np.diff(self.first))
        total += np.bincount(doc, own[self.of] + value[_REPEAT] * self.repeats, self.texts)
        count += np.bincount(doc, many[self.of] + self.repeats, self.texts)
        return total / count

    def rows(self):
        """(buckets, weights that sum to one) of each text."""
        for d in range(self.texts):
            a, b = self.first[d], self.first[d + 1]
            words, times = np.unique(self.of[a:b], return_counts=True)
            parts = [self.bucket[self.word_first[w] : self.word_first[w + 1]] for w in words]
            ids = np.concatenate([*parts, [_CONSTANT, _REPEAT]])
            n = np.concatenate([np.repeat(times, [len(p) for p in parts]), [1, self.repeats[a:b].sum()]]).astype(np.float32)
            ids, inverse = np.unique(ids, return_inverse=True)
            n = np.bincount(inverse, n, len(ids)).astype(np.float32)
            yield ids.astype(np.int32), n / n.sum()


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> np.ndarray:
    """One number per bucket: the difference of the two outputs that its vector makes."""
    if len(set(labels.tolist())) < 2:
        return np.zeros(buckets)
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32)
    out = np.zeros((2, dimensions), np.float32)
    epochs = max(epochs, STEPS // len(examples))
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in r.permutation(len(examples)):
            ids, weight = examples[i]
            own = vectors[ids]
            hidden = weight @ own
            z = out @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = rate * (1 - done / steps)
            # as in averaged-embedding text classifiers, the hidden gradient goes to every feature in full
            vectors[ids] = own - np.minimum(1, weight * len(ids))[:, None] * (step * (p @ out))
            out -= step * np.outer(p, hidden)
            done += 1
    return (vectors @ (out[1] - out[0])).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> np.ndarray:
    """Learns from at most `sample` labelled rows that aren't held out."""
    ids = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    ids = ids.groupBy("doc_id").agg(F.max("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(ids), F.col("_id") == F.col("doc_id"))
    got = text.select("doc_id", "_quality", "text").toArrow()
    got = got.take(pa.array(np.lexsort([got.column("doc_id").to_numpy()]))) if got.num_rows else got
    examples: list = []
    for chunk in chunks(got.to_batches(), "text", 1 << 20):
        examples += Features(column(chunk, "text"), buckets).rows()
    return train(examples, np.asarray(got.column("_quality").to_pylist(), np.int64), buckets)


def _scores(chunk: pa.RecordBatch, value: np.ndarray) -> np.ndarray:
    z = Features(column(chunk, "text"), len(value)).sums(value)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def scored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id and score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches):
        for chunk in chunks(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([column(chunk, "doc_id"), pa.array(_scores(chunk, shared.value))], names=["doc_id", "score"])

    return in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: np.ndarray, cutoff: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is the cutoff or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for chunk in chunks(batches, "text", CHUNK):
            yield chunk.filter(pa.array(_scores(chunk, shared.value) >= cutoff))

    return in_small_batches(docs).mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
