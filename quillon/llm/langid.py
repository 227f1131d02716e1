"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Code-point n-grams of the lower-cased whole text are hashed; a text's row is tf * idf, scaled to length 1. The idf
counts every learnable document. The weights are learned on a bounded sample by follow-the-regularised-leader
(per-coordinate, elastic-net penalties, so most weights are exactly zero), and the probabilities are calibrated by one
temperature fitted on rows the weights were not trained on.

A null text, or one without a letter, is UND with score 0; so is every text if there is nothing to learn from.
Of languages with one probability the first in order is predicted. Learning takes one text of each id and language, that
with the smallest hash. Repeated rows each get their row; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import as_batch, class_sample, fold, pieces, unused, window_of

UND = "und"
BITS = 14
SIZE = 1 << BITS
ORDERS = (1, 2, 3)
SAMPLE_PER_CLASS = 500  # bound of the training sample, documents of each language
SAMPLE_CHARS = 50_000  # bound of a training row: of a longer text so many characters, from a place its hash picks
MAX_LANGUAGES = 200  # bound of the classes: the most frequent values of lang
MIN_SCORE = 0.5  # below it keep_identified rejects a text
PART = 1 << 20  # code points hashed at a time
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def buckets(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text, by bucket."""
    counts = np.zeros(SIZE, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for n in ORDERS:
        for at in range(0, len(codes) - n + 1, PART):
            c = codes[at : at + PART + n - 1]
            h = c[: len(c) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint32(0x01000193) ^ c[k : len(c) - n + 1 + k]
            counts += np.bincount((h * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS), minlength=SIZE)
    return counts


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a text's row: logarithmic tf times idf, length 1."""
    col = np.flatnonzero(counts)
    val = (1 + np.log(counts[col])) * idf[col]
    return col, val / max(float(np.sqrt(val @ val)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial FTRL-proximal: the weights are a function of the sums z and n, zero where |z| <= l1."""

    def __init__(self, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        self.z, self.n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, col: np.ndarray) -> np.ndarray:
        z, n = self.z[col], self.n[col]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, col: np.ndarray, val: np.ndarray, y: int) -> None:
        w = self.weights(col)
        p = softmax(val @ w)
        p[y] -= 1
        g = val[:, None] * p[None, :]
        n = self.n[col]
        self.z[col] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[col] = n + g * g


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores that makes the labels likeliest."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 241))
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(rows: list[tuple[str, str]], idf: np.ndarray, epochs: int = 4) -> dict | None:
    """Weights, classes and temperature from (text, language) rows; a fifth of them fits the temperature alone."""
    classes = sorted({lang for _, lang in rows})
    if not classes:
        return None
    data = [(*tf_idf(buckets(t), idf), classes.index(lang)) for t, lang in rows]
    held, fit = [d for i, d in enumerate(data) if i % 5 == 0], [d for i, d in enumerate(data) if i % 5] or data
    model, order = Ftrl(len(classes)), np.random.default_rng(3)
    for _ in range(epochs):
        for i in order.permutation(len(fit)):
            model.learn(*fit[i])
    w = model.weights(np.arange(SIZE))
    t = temperature(np.array([v @ w[c] for c, v, _ in held]), np.array([y for *_, y in held]))
    return {"classes": classes, "weights": w, "idf": idf, "temperature": t}


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, all documents) of docs (text)."""

    def run(batches):
        schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
        total, docs_seen = np.zeros(SIZE, np.int64), 0
        for batch in pieces(batches, "text"):
            for text in batch.column("text").to_pylist():
                docs_seen += 1
                total += buckets(text) > 0
        col = np.flatnonzero(total)
        yield as_batch(schema, np.append(col, -1).astype(np.int32), np.append(total[col], docs_seen))

    out = np.zeros(SIZE, np.int64)
    n = 0
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # SIZE + 1 rows at most
        if r["bucket"] < 0:
            n = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, n


def fit_languages(docs: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_chars: int = SAMPLE_CHARS, most_classes: int = MAX_LANGUAGES) -> dict | None:
    """The model of docs (doc_id, text, lang): all of them count for the idf, about per_class a language for the weights, of
    up to most_chars characters each (see window_of), of the most_classes most frequent languages."""
    learnable = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang").where("text is not null and lang is not null")
    df, n = document_frequencies(learnable)
    chosen = class_sample(learnable, "doc_id", "lang", per_class, most_classes)
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    rows = chosen.withColumn("text", window_of(F.col("text"), most_chars)).collect()
    rows = sorted(((r["doc_id"], r["text"], r["lang"]) for r in rows), key=lambda r: (r[0] * 2654435761 % 1000003, *r))
    return train([(t, lang) for _, t, lang in rows], np.log((1 + n) / (1 + df)) + 1)


def predict(m: dict | None, texts: list, letters: list) -> tuple[list[str], list[float]]:
    """Language and probability of each text."""
    names, scores = [], []
    for text, has_letter in zip(texts, letters, strict=True):
        if m is None or not has_letter:
            names.append(UND)
            scores.append(0.0)
            continue
        col, val = tf_idf(buckets(text), m["idf"])
        p = softmax(val @ m["weights"][col] / m["temperature"])
        best = int(p.argmax())
        names.append(m["classes"][best])
        scores.append(float(p[best]))
    return names, scores


def has_letters(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """Predictions for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
        for batch in pieces(batches, "text"):
            found = predict(shared.value, batch.column("text").to_pylist(), batch.column("letters").to_pylist())
            yield as_batch(schema, batch.column("doc_id"), batch.column("held_out"), *found)

    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.select("doc_id", "text", held, has_letters(F.col("text")).alias("letters")).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: dict | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language the model tells with min_score or more, all columns as they are; those with a
    letter if there is no model."""
    shared, names, letters = docs.sparkSession.sparkContext.broadcast(model), docs.columns, unused("letters", docs)

    if model is None:
        return docs.where(has_letters(F.col("text")))

    def run(batches):
        for batch in pieces(batches, "text"):
            lang, score = predict(shared.value, batch.column("text").to_pylist(), batch.column(letters).to_pylist())
            keep = [name != UND and s >= min_score for name, s in zip(lang, score, strict=True)]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return docs.withColumn(letters, has_letters(F.col("text"))).mapInArrow(run, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The documents that the registered query may learn from."""
    return docs.where(fold(F.col("doc_id"), 3) != 1)
