"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a step are a word (one of a learned vocabulary, else unknown) and its characters (mean of hashed character
trigram vectors). The network reads windows of WINDOW words that overlap by WINDOW - STRIDE words; every window of
every text is scored. A document's logit is that of its highest window, calibrated (Platt) on documents that were not
trained on. Training is multiple-instance: first all windows with their document's label, then of each toxic document
the window that scores highest.

Null and empty texts are read as a text without words: they get the score of one empty window. Without labelled rows
of both classes all scores are 0. Repeated rows each get their row; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD_BYTES, as_batch, class_sample, fold, one_text_each, pieces, raw, window_of

WINDOW, STRIDE = 48, 32
VOCABULARY, MIN_DOCS = 2000, 8  # learned words, each in so many training documents
CHAR_BITS = 12
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 10, 6, 10, 8
SAMPLE_PER_CLASS = 1200  # bound of the training sample, documents of each label
SAMPLE_CHARS = 200_000  # bound of a training row: of a longer text so many characters, from a place its hash picks
BATCH = 1024
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def starts_of(n: int) -> range:
    """First words of the windows of a text of n words."""
    return range(0, max(n - (WINDOW - STRIDE), 1), STRIDE)


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first bucket of each word) of the byte trigrams of ' word '."""
    text = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    h = (text[:-2] * np.uint32(65599) + text[1:-1]) * np.uint32(65599) + text[2:]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)
    keep = np.ones(len(h), bool)
    for back in (1, 2):  # trigrams over the end of a word
        keep[(ends - back)[ends - back < len(h)]] = False
    firsts = np.concatenate(([0], np.cumsum(sizes - 2)[:-1]))
    return h[keep].astype(np.int64), firsts


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_weights(words: int, rng) -> dict[str, np.ndarray]:
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    draw = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
    p = {"word": draw(words, WORD_DIM) * 0.1 * np.sqrt(words), "char": draw(1 << CHAR_BITS, CHAR_DIM) * 0.1 * np.sqrt(1 << CHAR_BITS)}
    for way in "fb":
        p |= {f"W{way}": draw(d, 3 * h), f"U{way}": draw(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
    return {k: v.astype(np.float32) for k, v in (p | {"A": draw(2 * h, ATTENTION), "a": draw(ATTENTION), "o": draw(2 * h), "bias": np.zeros(1)}).items()}


def gru(x: np.ndarray, mask: np.ndarray, U: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, B, H) of gate inputs x (T, B, 3H); a masked step keeps the state. Also what the way back needs."""
    t_n, b, h3 = x.shape
    n = h3 // 3
    h, out, kept = np.zeros((b, n), np.float32), np.empty((t_n, b, n), np.float32), []
    for t in range(t_n):
        u = h @ U
        zr = 1 / (1 + np.exp(-(x[t, :, : 2 * n] + u[:, : 2 * n])))
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(x[t, :, 2 * n :] + r * u[:, 2 * n :])
        z = z * mask[t][:, None]
        kept.append((h, z, r, c, u[:, 2 * n :]))
        h = h + z * (c - h)
        out[t] = h
    return out, kept


def gru_back(dout: np.ndarray, kept: list, mask: np.ndarray, U: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the gate inputs, gradient of U)."""
    t_n, b, n = dout.shape
    dx, dU, dh = np.zeros((t_n, b, 3 * n), np.float32), np.zeros_like(U), np.zeros((b, n), np.float32)
    for t in range(t_n - 1, -1, -1):
        h, z, r, c, uc = kept[t]
        dh = dh + dout[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z)  # masked steps have z = 0
        dr = dc * uc * r * (1 - r)
        du = np.concatenate([dz, dr, dc * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dc], axis=1)
        dU += h.T @ du
        dh = dh * (1 - z) + du @ U.T
    return dx, dU


def word_vectors(p: dict, vocabulary: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """Inputs of the words; row 0 is the padding of short windows."""
    out = np.zeros((len(words) + 1, WORD_DIM + CHAR_DIM), np.float32)
    if words:
        out[1:, :WORD_DIM] = p["word"][[vocabulary.get(w, 0) for w in words]]
        tri, firsts = trigrams(words)
        out[1:, WORD_DIM:] = np.add.reduceat(p["char"][tri], firsts, axis=0) / np.diff(np.append(firsts, len(tri)))[:, None]
    return out


def pooled(p: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(attention-pooled states, attention, its hidden layer)."""
    hidden = np.tanh(states @ p["A"])
    e = hidden @ p["a"] + (mask - 1) * 1e4
    e = np.exp(e - e.max(axis=0, keepdims=True))
    att = e / e.sum(axis=0, keepdims=True)
    return np.einsum("tb,tbh->bh", att, states), att, hidden


def logits(p: dict, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Logits of windows; ids (T, B) number rows of the gate inputs, 0 is padding."""
    mask = (ids > 0).astype(np.float32)
    f, _ = gru(gates[0][ids], mask, p["Uf"])
    b, _ = gru(gates[1][ids[::-1]], mask[::-1], p["Ub"])
    return pooled(p, np.concatenate([f, b[::-1]], axis=2), mask)[0] @ p["o"] + p["bias"][0]


def gates_of(p: dict, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return vectors @ p["Wf"] + p["cf"], vectors @ p["Wb"] + p["cb"]


def step(p: dict, vocabulary: dict, words: list[bytes], ids: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of a batch of windows."""
    vectors = word_vectors(p, vocabulary, words)
    mask, n = (ids > 0).astype(np.float32), len(y)
    x = vectors[ids]
    f, kf = gru(x @ p["Wf"] + p["cf"], mask, p["Uf"])
    b, kb = gru((x @ p["Wb"] + p["cb"])[::-1], mask[::-1], p["Ub"])
    states = np.concatenate([f, b[::-1]], axis=2)
    context, att, hidden = pooled(p, states, mask)
    d = ((sigmoid(context @ p["o"] + p["bias"][0]) - y) / n).astype(np.float32)
    g = {"o": context.T @ d, "bias": np.array([d.sum()])}
    dcontext = d[:, None] * p["o"]
    datt = np.einsum("bh,tbh->tb", dcontext, states)
    de = att * (datt - (att * datt).sum(axis=0, keepdims=True))
    dhidden = de[:, :, None] * p["a"] * (1 - hidden * hidden)
    g |= {"a": np.einsum("tb,tba->a", de, hidden), "A": np.einsum("tbh,tba->ha", states, dhidden)}
    dstates = att[:, :, None] * dcontext + dhidden @ p["A"].T
    dxf, g["Uf"] = gru_back(dstates[:, :, :HIDDEN], kf, mask, p["Uf"])
    dxb, g["Ub"] = gru_back(dstates[::-1, :, HIDDEN:], kb, mask[::-1], p["Ub"])
    dxb = dxb[::-1]
    dx = dxf @ p["Wf"].T + dxb @ p["Wb"].T
    for way, dgate in (("f", dxf), ("b", dxb)):
        g[f"W{way}"], g[f"c{way}"] = np.einsum("tbd,tbg->dg", x, dgate), dgate.sum(axis=(0, 1))
    dvec = np.zeros_like(vectors)
    np.add.at(dvec, ids.ravel(), dx.reshape(-1, dx.shape[2]))
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    if words:
        np.add.at(g["word"], [vocabulary.get(w, 0) for w in words], dvec[1:, :WORD_DIM])
        tri, firsts = trigrams(words)
        sizes = np.diff(np.append(firsts, len(tri)))
        np.add.at(g["char"], tri, np.repeat(dvec[1:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
    return g


def windows(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, window ids (B, T) from 1 on with 0 as padding, text of each window)."""
    index: dict[bytes, int] = dict.fromkeys(w for words in texts for w in words)
    index = {w: i + 1 for i, w in enumerate(index)}
    rows, owner = [], []
    for k, words in enumerate(texts):
        ids = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
        starts = starts_of(len(words))
        padded = np.zeros(starts[-1] + WINDOW, np.int32)
        padded[: len(ids)] = ids
        rows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
        owner += [k] * len(starts)
    return list(index), np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int32), np.array(owner, np.int64)


def window_logits(m: dict, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(logit of every window, text of each)."""
    p = m["weights"]
    words, ids, owner = windows(texts)
    gates = gates_of(p, word_vectors(p, m["vocabulary"], words))
    out = [logits(p, gates, np.ascontiguousarray(ids[a : a + BATCH].T)) for a in range(0, len(ids), BATCH)]
    return np.concatenate(out) if out else np.zeros(0), owner


def highest(z: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, owner, z)
    return out


def train(rows: list[tuple[bytes, int]], prior: float | None = None, epochs: int = 8, rate: float = 0.01) -> dict:
    """The model of (text, label) rows; prior is the share of label 1 in what the sample stands for."""
    rng = np.random.default_rng(11)
    texts, y = [words_of(t) for t, _ in rows], np.array([v for _, v in rows], np.float32)
    counts = Counter(w for words in texts for w in set(words))
    vocabulary = {w: i + 1 for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if n >= MIN_DOCS}
    p = start_weights(len(vocabulary) + 1, rng)
    m = {"weights": p, "vocabulary": vocabulary, "a": 1.0, "b": 0.0}
    fit = [i for i in range(len(texts)) if i % 5]
    held = [i for i in range(len(texts)) if i % 5 == 0]
    words, ids, owner = windows([texts[i] for i in fit])
    label = y[fit][owner]
    mean, var, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        use = np.arange(len(ids))
        if epoch:  # of each toxic document the highest window; of the others as many, the highest first
            z = window_logits(m, [texts[i] for i in fit])[0]
            order = np.lexsort((-z, owner))
            top = order[np.concatenate(([True], np.diff(owner[order]) > 0))]
            rest = np.flatnonzero(label == 0)
            use = np.concatenate([top, rng.choice(rest, min(len(rest), len(top)), replace=False)])
        rng.shuffle(use)
        for a in range(0, len(use), 128):
            own = ids[use[a : a + 128]]
            names, local = np.unique(own, return_inverse=True)
            local = local.reshape(own.shape) + (names[0] > 0)
            g = step(p, vocabulary, [words[i - 1] for i in names if i], np.ascontiguousarray(local.T), label[use[a : a + 128]])
            t += 1
            for k in p:
                mean[k] += 0.1 * (g[k] - mean[k])
                var[k] += 0.001 * (g[k] * g[k] - var[k])
                p[k] -= (rate * mean[k] / (1 - 0.9**t) / (np.sqrt(var[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    z, own = window_logits(m, [texts[i] for i in held])
    z = np.clip(highest(z, own, len(held)), -20, 20)
    yh = y[held]
    share = float(yh.mean())
    prior = share if prior is None else prior
    weight = np.where(yh > 0, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    a, b = 1.0, 0.0
    for _ in range(4000):
        d = weight * (sigmoid(a * z + b) - yh)
        a, b = a - 0.02 * float(np.mean(d * z)), b - 0.02 * float(np.mean(d))
    return m | {"a": max(a, 1e-3), "b": b}


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_chars: int = SAMPLE_CHARS) -> dict | None:
    """The model, from about per_class labelled rows of each class, of up to most_chars characters each (see window_of);
    None if a class has no rows."""
    marked = labels.selectExpr("cast(doc_id as long) key", "cast(cast(toxic as int) > 0 as int) toxic").groupBy("key").agg(F.max("toxic").alias("toxic"))
    share = marked.agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0]
    texts = docs.selectExpr("cast(doc_id as long) key", "cast(text as string) text").where("text is not null")
    rows = one_text_each(texts.join(F.broadcast(class_sample(marked, "key", "toxic", per_class)), "key"), "toxic").withColumn("text", window_of(F.col("text"), most_chars)).collect()
    rows = sorted({(r["key"], r["text"], r["toxic"]) for r in rows}, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))
    if len({y for *_, y in rows}) < 2:
        return None
    return train([(t.encode(), int(y > 0)) for _, t, y in rows], share)


def score_toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """Scores of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
        m = shared.value
        for batch in pieces(batches, "text", 2 << 20):
            texts = [words_of(t) for t in raw(batch, "text")]
            if m is None:
                score = np.zeros(len(texts))
            else:
                z, owner = window_logits(m, texts)
                score = sigmoid(m["a"] * np.clip(highest(z, owner, len(texts)), -20, 20) + m["b"]).astype(np.float64)
            yield as_batch(schema, batch.column("doc_id"), batch.column("held_out"), score, (score >= 0.5).astype(np.int32))

    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", "text", held).mapInArrow(run, SCHEMA)


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that the registered query may learn from."""
    return labels.where(fold(F.col("doc_id"), 5) != 0)
