"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, unit_hash

BITS = 20
#: Training rows of each class, expected; they are drawn by hash, so the bound holds at every size.
SAMPLE = 3000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1
#: Letters of a word's beginning that also count as a word, so that inflected forms share weight.
STEM = 6
SEED, THRESHOLD = 7, 0.7
#: Longer words are not kept in the cache.
KEPT_CHARS = 64
_WORD = re.compile(r"[^\W_]+")


class WordHashes:
    """64-bit hashes of words, with a cache bounded in entries of at most KEPT_CHARS characters."""

    def __init__(self, entries: int = 400_000):
        self._entries, self._cache = entries, {}

    def of(self, words: list[str]) -> np.ndarray:
        cache = self._cache
        distinct = set(words)
        missing = distinct.difference(cache)
        if missing:
            if len(cache) + len(missing) > self._entries:
                cache.clear()
                missing = distinct
            for w in missing:
                cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        out = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        for w in missing:
            if len(w) > KEPT_CHARS:
                del cache[w]
        return out


@lru_cache(1)
def shared_hashes() -> WordHashes:
    """One cache for all tasks of a Python worker."""
    return WordHashes()


def features(words: WordHashes, text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed unigrams, stems, bigrams and skip-grams (one word left out) of a whole text; repeats included."""
    found = _WORD.findall((text or "").lower())
    h, stems = words.of(found), words.of([w[:STEM] + "*" for w in found])
    shift = np.uint64(64 - bits)
    one, two, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    parts = [h * one >> shift, stems * one >> shift, (h[:-1] * two + h[1:]) * one >> shift, (h[:-2] * skip + h[2:]) * two >> shift]
    return np.concatenate(parts).astype(np.int64)


@dataclass
class Ftrl:
    """FTRL-proximal with per-coordinate rates; weights whose |z| stays within l1 are exactly 0."""

    size: int
    alpha: float = ALPHA
    beta: float = BETA
    l1: float = L1
    l2: float = L2
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)
    bias: float = 0.0
    bias_n: float = 0.0

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        """One example with features ``at``, each once."""
        w = self.weights(at)
        gap = sigmoid(w.sum() + self.bias) - label
        n = self.n[at]
        sigma = (np.sqrt(n + gap * gap) - np.sqrt(n)) / self.alpha
        self.z[at] += gap - sigma * w
        self.n[at] = n + gap * gap
        self.bias_n += gap * gap
        self.bias -= self.alpha * gap / (self.beta + math.sqrt(self.bias_n))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


@dataclass
class Model:
    """Sparse weights: at most 2**bits, whatever the input; that bounds the broadcast."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, bits: int = BITS) -> Model:
    """Learn from the labelled rows outside the held-out fold, about ``sample`` of each class.

    Rows are drawn by a hash of doc_id, so no data are ordered or gathered beyond the sample.  Texts are hashed where
    they are read; one task gets their features once and goes over them in each epoch's order, so its memory is the
    weights and the sample's features, 16 bytes a word at most.  The classes' true shares go into the bias.
    Of repeated labels the larger holds; null labels go.  Without rows of both classes the model is all zero.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    counts: dict[int, int] = {}
    for r in known.groupBy((F.col("_toxic") > 0).cast("int").alias("y")).count().collect():
        counts[int(r["y"])] = int(r["count"])
    if not (counts.get(0) and counts.get(1)):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, bits)
    order = unit_hash(F.lit(SEED), F.col("doc_id"))
    share = F.when(F.col("_toxic") > 0, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))
    drawn = known.where(order <= share * float(2**62)).select(F.col("doc_id").alias("_doc"), (F.col("_toxic") > 0).cast("int").alias("y"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("_doc"))  # 2 * sample ids
    orders = F.array(*[F.xxhash64(F.lit(e), "doc_id") for e in range(epochs)])
    hashed = pa.schema([("orders", pa.list_(pa.int64())), ("doc_id", pa.int64()), ("y", pa.int32()), ("at", pa.binary())])

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared_hashes()
        for batch in batches:
            at = [np.unique(features(words, t, bits)).astype("<u4").tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at, pa.binary())], schema=hashed)

    sampled = map_batches(rows.select(orders.alias("orders"), F.col("doc_id").cast("long"), "y", "text"), hash_texts, "orders array<long>, doc_id long, y int, at binary")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(1 << bits), [0, 0]
        held = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        for epoch in range(epochs):
            held.sort(key=lambda row: (row[0][epoch], row[1], row[3]))
            for _, _, y, at in held:
                model.learn(np.frombuffer(at, "<u4").astype(np.int64), y)
                seen[y] += 1
        if not held:
            return
        at = np.flatnonzero(np.abs(model.z) > model.l1)
        got = (at.astype(np.uint32), model.weights(at).astype(np.float32), model.bias, seen)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], ["model"])

    got = map_batches(sampled.repartition(1), fit, "model binary").first()
    if got is None:  # no labelled document is there
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, bits)
    at, weight, bias, seen = pickle.loads(got[0])
    if min(seen):
        bias += math.log(counts[1] / counts[0]) - math.log(seen[1] / seen[0])
    return Model(at.astype(np.int64), weight, bias, bits)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every whole text; null and empty texts score as the bias does.

    A feature counts once a document.  Row by row: repeated rows stay, no rows give no rows, and only doc_id
    and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = shared.value, shared_hashes()
        dense = np.zeros(1 << m.bits, np.float32)
        dense[m.at] = m.weight
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                at = features(words, text, m.bits)
                at = np.unique(at[dense[at] != 0])
                scores.append(sigmoid(float(dense[at].sum(dtype=np.float64)) + m.bias))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model learnt from ``labels.toxic``."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
