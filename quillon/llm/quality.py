"""Quality rules: exact base counts, then a hashed n-gram logistic model with a fixed threshold.

The model reads hashed words and hashed character n-grams (byte n-grams of the UTF-8 text), each kind as a mean of
weights, is trained in numpy on a bounded sample of labelled rows and calibrated (Platt) on a part it was not trained
on. Texts are scored whole in Arrow batches. Null and empty texts have no words and fail the base rule; with no
labelled rows of both classes the model has no opinion (probability 1) and the base rule decides alone. Repeated rows
each get their row; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import PLAIN_SPACE, as_batch, class_sample, one_text_each, pieces, raw, window_of

SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
BITS = 15
SIZE = 1 << BITS
ORDERS = (3, 4)
MIX = np.array([0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x27D4EB2F165667C5, 0x369DEA0F31A53F85, 0x5851F42D4C957F2D], np.int64)  # odd numbers
MIN_QUALITY = 0.25  # fixed threshold on the calibrated probability that a row is good
SAMPLE_PER_CLASS = 1500  # bound of the training sample, rows of each label
SAMPLE_CHARS = 50_000  # bound of a training row: of a longer text so many characters, from a place its hash picks
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more; ids number the words, equal for equal words."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    mixed = sum(ids[k : k + n] * odd for k, odd in enumerate(MIX))
    mixed.sort()
    if (mixed[1:] != mixed[:-1]).all():  # equal windows have equal sums, so none is found twice
        return 0
    two = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
    five, count = np.unique(four[:n] * (int(ids.max()) + 1) + ids[4:], return_inverse=True, return_counts=True)[1:]
    twice = count[five] > 1
    if not twice.any():
        return 0
    mark = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    mark[at] += 1
    np.subtract.at(mark, at + WINDOW, 1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int, np.ndarray, dict]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, word numbers, words by number)."""
    words = text.split()
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    blank = sum(text.count(c) for c in (PLAIN_SPACE[i : i + 1] for i in range(len(PLAIN_SPACE))))
    chars = len(text) - blank - (len(text) - len(text.translate(None, CONTINUED)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, symbols, dup, repeat_words(ids), ids, index


CONTINUED = bytes(range(128, 192))  # bytes that continue a UTF-8 character


def char_buckets(text: bytes) -> np.ndarray:
    """Bucket of every byte n-gram."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(b) >= n:
            h = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint32(0x01000193) ^ b[k : len(b) - n + 1 + k]
            out.append((h * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def word_buckets(index: dict[bytes, int]) -> np.ndarray:
    """Bucket of every distinct word, by number."""
    return np.fromiter((zlib.crc32(w) >> (32 - BITS) for w in index), np.int64, len(index))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sparse row: columns 0..SIZE-1 are words, SIZE..2*SIZE-1 character n-grams; shares of each kind."""
    *_, ids, index = base_counts(text)
    words = word_buckets(index)[ids] if len(ids) else np.zeros(0, np.int64)
    chars = char_buckets(text)
    col, val = [], []
    for k, x in enumerate((words, chars)):
        if len(x):
            c, n = np.unique(x, return_counts=True)
            col.append(c.astype(np.int64) + k * SIZE)
            val.append(n / len(x))
    return (np.concatenate(col), np.concatenate(val)) if col else (np.zeros(0, np.int64), np.zeros(0))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[bytes, int]], epochs: int = 12, rate: float = 1.0, l2: float = 1e-6) -> dict:
    """Adagrad logistic regression on four fifths of the rows, Platt scaling on the rest."""
    data = [(*features(t), y) for t, y in rows]
    held = [d for i, d in enumerate(data) if i % 5 == 0]
    fit = [d for i, d in enumerate(data) if i % 5]
    w, g2, bias = np.zeros(2 * SIZE), np.full(2 * SIZE, 1e-8), 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(fit)):
            c, v, y = fit[i]
            d = sigmoid(w[c] @ v + bias) - y
            g = d * v + l2 * w[c]
            g2[c] += g * g
            w[c] -= rate * g / np.sqrt(g2[c])
            bias -= 0.02 * d
    z = np.array([w[c] @ v + bias for c, v, _ in held])
    y = np.array([y for *_, y in held], float)
    a, b = 1.0, 0.0
    for _ in range(2000):
        d = sigmoid(a * z + b) - y
        a, b = a - 0.05 * float(np.mean(d * z)), b - 0.05 * float(np.mean(d))
    return {"words": w[:SIZE].astype(np.float32), "chars": w[SIZE:].astype(np.float32), "bias": bias, "a": max(a, 1e-3), "b": b}


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_chars: int = SAMPLE_CHARS) -> dict | None:
    """The model, from about per_class labelled rows of each class, of up to most_chars characters each (see window_of);
    None if a class has no rows."""
    chosen = class_sample(labels.selectExpr("cast(doc_id as long) key", "cast(cast(quality as int) > 0 as int) quality").groupBy("key").agg(F.max("quality").alias("quality")), "key", "quality", per_class)
    texts = docs.selectExpr("cast(doc_id as long) key", "cast(text as string) text").where("text is not null")
    rows = one_text_each(texts.join(F.broadcast(chosen), "key"), "quality").withColumn("text", window_of(F.col("text"), most_chars)).collect()
    rows = sorted({(r["key"], r["text"], r["quality"]) for r in rows}, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))
    if len({q for *_, q in rows}) < 2:
        return None
    return train([(t.encode(), int(q > 0)) for _, t, q in rows])


def judge(m: dict | None, text: bytes | None, threshold: float) -> tuple:
    """Counts, base_failed, kept and probability of a text."""
    text = text or b""
    *counts, ids, index = base_counts(text)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
    p = 1.0
    if m is not None:
        z = m["bias"]
        if len(ids):
            z += float(m["words"][word_buckets(index)][ids].mean(dtype=np.float64))
        if text:
            z += mean_weight(m["chars"], text)
        p = float(sigmoid(m["a"] * z + m["b"]))
    return *counts, failed, not failed and p >= threshold, p


def quality_rules(docs: DataFrame, model: dict | None, threshold: float = MIN_QUALITY) -> DataFrame:
    """Base counts, calibrated probability and verdict for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("quality", pa.float64())])
        for batch in pieces(batches, "text"):
            rows = [judge(shared.value, text, threshold) for text in raw(batch, "text")]
            yield as_batch(schema, batch.column("doc_id"), *map(list, zip(*rows, strict=True)))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: dict | None, threshold: float = MIN_QUALITY) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.array([judge(shared.value, text, threshold)[6] for text in raw(batch, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def mean_weight(weights: np.ndarray, text: bytes, step: int = 1 << 20) -> float:
    """Mean weight of all byte n-grams, gathered a part of a long text at a time."""
    total = count = 0.0
    for at in range(0, len(text), step):
        last = at + step >= len(text)
        for n in ORDERS:
            part = text[at : len(text) if last else at + step + n - 1]
            b = np.frombuffer(part, np.uint8).astype(np.uint32)
            if len(b) < n:
                continue
            h = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint32(0x01000193) ^ b[k : len(b) - n + 1 + k]
            x = weights[(h * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS)]
            total, count = total + float(x.sum(dtype=np.float64)), count + len(x)
    return total / count if count else 0.0
