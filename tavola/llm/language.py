"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learnt with follow-the-regularised-leader under an elastic net; a temperature is fitted afterwards on
rows that the weights have not seen.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, unit_hash

BITS = 15
#: Training rows of each language, expected; drawn by hash.  One in CALIBRATE of them is for the temperature.
SAMPLE, CALIBRATE = 1200, 5
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
SEED = 8
MAX_LANGUAGES = 1000
#: Documents whose best language has a lower probability are rejected by the pipeline.
LEAST_SCORE = 0.4
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str | None, bits: int = BITS) -> np.ndarray | None:
    """Counts of hashed n-grams of 1 to 3 characters over a whole text; None if it has no letter.

    Texts are lower-cased; a run of other characters than letters counts as one space.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = codes[keep] * np.uint32(0x9E3779B1)
    two = (c[:-1] ^ c[1:] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ c[2:] * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
    shift = np.uint32(32 - bits)
    return np.bincount(np.concatenate([c >> shift, two >> shift, three >> shift]).astype(np.int64), minlength=1 << bits)


@dataclass
class Model:
    """languages, idf and weights (2**bits rows): fixed size for a number of languages."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int = BITS


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """Over all rows: in how many documents each hashed n-gram is, and the number of documents with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = ngram_counts(text, bits)
                if counts is not None:
                    total += counts > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["at", "n"])

    out = np.zeros((1 << bits) + 1, np.int64)  # the last place, -1, has the number of documents
    for r in map_batches(docs.select("text"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out[:-1], int(out[-1])


def train(docs: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, bits: int = BITS) -> Model | None:
    """Learn from text and lang outside the held-out fold; None if nothing can be learnt.

    Document frequencies come from all rows of the fold, weights from about ``sample`` rows of each language
    drawn by a hash of doc_id.  One task reads the sample as a stream, so its memory is the weights.
    """
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    found = {r["lang"]: int(r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(found)
    df, n = document_frequencies(known, bits)
    if not languages or not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    spark = docs.sparkSession
    shares = F.broadcast(spark.createDataFrame([(k, i, min(1.0, sample / found[k])) for i, k in enumerate(languages)], "_lang string, y int, _share double"))
    order = unit_hash(F.lit(SEED), F.col("doc_id"))
    drawn = known.join(shares, F.col("lang") == F.col("_lang")).where(order <= F.col("_share") * float(2**62))
    calibrate = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(CALIBRATE)) == 0
    passes = F.when(calibrate, F.array(F.lit(epochs))).otherwise(F.sequence(F.lit(0), F.lit(epochs - 1)))
    stream = drawn.select(F.explode(passes).alias("epoch"), "doc_id", "text", "y").withColumn("_order", F.xxhash64("epoch", "doc_id"))
    stream = stream.repartition(1).sortWithinPartitions("epoch", "_order", "doc_id", "text").select("text", "y", "epoch")
    shared = spark.sparkContext.broadcast(idf)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, weigh = len(languages), shared.value
        z, g2 = np.zeros((1 << bits, k)), np.zeros((1 << bits, k))
        bias, bias_g2 = np.zeros(k), np.zeros(k)
        logits, truths = [], []

        def weights(at: np.ndarray | slice) -> np.ndarray:
            return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2))

        for batch in batches:
            for text, y, epoch in zip(*(c.to_pylist() for c in batch.columns)):
                counts = ngram_counts(text, bits)
                if counts is None:
                    continue
                at, x = tf_idf(counts, weigh)
                w = weights(at)
                raw = x @ w + bias
                if epoch == epochs:
                    logits.append(raw)
                    truths.append(y)
                    continue
                gap = softmax(raw)
                gap[y] -= 1
                g = x[:, None] * gap[None, :]
                old = g2[at]
                new = old + g * g
                z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
                g2[at] = new
                bias_g2 += gap * gap
                bias -= ALPHA * gap / (BETA + np.sqrt(bias_g2))
        got = (weights(slice(None)).astype(np.float32), bias, fit_temperature(logits, truths))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], ["model"])

    weights, bias, temperature = pickle.loads(map_batches(stream, fit, "model binary").first()[0])
    return Model(languages, idf.astype(np.float32), weights, bias, temperature, bits)


def fit_temperature(logits: list[np.ndarray], truths: list[int]) -> float:
    """The temperature of least log loss, from 1/8 to 8; 1 without rows."""
    if not logits:
        return 1.0
    x, y = np.stack(logits), np.array(truths)

    def loss(t: float) -> float:
        s = x / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    return min((2.0 ** (e / 8) for e in range(-24, 25)), key=loss)


def _free(name: str, taken: tuple[str, ...]) -> str:
    while name in taken:
        name = "_" + name
    return name


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred and score for every whole text.

    A null text or one without letters is ``und`` with score 0, as is everything without a model.  Equal
    probabilities go to the first language by name.  A kept column of the same name makes them _lang_pred or _score.
    Row by row: repeated rows stay, no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = len(keep)
    lang_pred, score = (_free(n, keep) for n in ("lang_pred", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(kept).to_pylist():
                counts = ngram_counts(text, m.bits) if m else None
                if counts is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                at, x = tf_idf(counts, m.idf)
                p = softmax((x @ m.weights[at] + m.bias) / m.temperature)
                best = int(p.argmax())
                names.append(m.languages[best])
                scores.append(min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:kept], lang_pred, score])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + f", `{lang_pred}` string, `{score}` double"
    return map_batches(rows, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model learnt from ``docs`` itself."""
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told, with probability ``least_score`` or more.

    Where nothing can be learnt (no row outside the held-out fold has a language and letters), only null texts
    and texts without a letter go.  Whole texts count, however long.
    """
    model = train(docs)
    if model is None:
        return docs.where(F.coalesce(F.regexp_like(F.col("text").cast("string"), F.lit(r"\p{L}")), F.lit(False)))
    found = predict(docs, model, tuple(docs.columns))
    lang_pred, score = found.columns[-2:]
    return found.where((F.col(lang_pred) != UNDETERMINED) & (F.col(score) >= least_score)).select(*docs.columns)
