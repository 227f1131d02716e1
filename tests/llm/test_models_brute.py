"""Scores of the learned models against plain versions that follow the definition step by step."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import langid, quality, toxicity

U32 = 1 << 32
TEXTS = ["", "a", "Tor ban kel", "sie OUA iye é 中文 🙂", "word " * 120, " ".join(f"w{k % 37}" for k in range(300)), "x y\nz"]


def language_rows(n=80):
    rng = random.Random(4)
    words = {"aa": ["tor", "ban", "kel", "mur"], "bb": ["sie", "oua", "iye", "uoi"], "cc": ["中", "文", "日", "本"]}
    return [(" ".join(rng.choice(words[k]) for _ in range(12)), k) for _ in range(n) for k in words]


def test_language_scores():
    idf = np.linspace(1, 2, langid.SIZE)
    model = langid.train(language_rows(), idf)
    for text in TEXTS:
        counts = Counter()
        codes = [ord(c) for c in text.lower()]
        for n in langid.ORDERS:
            for at in range(len(codes) - n + 1):
                h = codes[at]
                for c in codes[at + 1 : at + n]:
                    h = h * 0x01000193 % U32 ^ c
                counts[(h * (0x9E3779B1 + 2 * n) % U32) >> (32 - langid.BITS)] += 1
        row = {b: (1 + math.log(k)) * idf[b] for b, k in counts.items()}
        size = math.sqrt(sum(v * v for v in row.values())) or 1.0
        z = [sum(v / size * model["weights"][b][k] for b, v in row.items()) / model["temperature"] for k in range(3)]
        e = [math.exp(x - max(z)) for x in z]
        [name], [score] = langid.predict(model, [text], [True])
        assert score == pytest.approx(max(e) / sum(e)) and model["classes"].index(name) == e.index(max(e))


def test_toxicity_scores():
    rng = random.Random(5)
    rows = [(" ".join(rng.choices(["good", "bad", "dog", "cat", "the"], k=30)) + (" vile" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(90)]
    m = toxicity.train([(t.encode(), y) for t, y in rows], epochs=2)
    p = {k: v.astype(float) for k, v in m["weights"].items()}
    sigma = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        padded = b" " + word + b" "
        tri = [((a * 65599 + b) * 65599 + c) * 0x9E3779B1 % U32 >> (32 - toxicity.CHAR_BITS) for a, b, c in zip(padded, padded[1:], padded[2:])]
        return np.concatenate([p["word"][m["vocabulary"].get(word, 0)], np.mean([p["char"][t] for t in tri], axis=0)])

    def states(vectors, way):
        h, out, n = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for x in vectors if way == "f" else vectors[::-1]:
            gate, u = x @ p[f"W{way}"] + p[f"c{way}"], h @ p[f"U{way}"]
            z, r = sigma(gate[:n] + u[:n]), sigma(gate[n : 2 * n] + u[n : 2 * n])
            h = h + z * (np.tanh(gate[2 * n :] + r * u[2 * n :]) - h)
            out.append(h)
        return out if way == "f" else out[::-1]

    def logit(words):
        vectors = [vector(w) for w in words]
        if not words:  # one window of padding: its states are zero
            return p["bias"][0]
        both = [np.concatenate(s) for s in zip(states(vectors, "f"), states(vectors, "b"))]
        e = np.array([np.tanh(s @ p["A"]) @ p["a"] for s in both])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        return sum(x * s for x, s in zip(a, both)) @ p["o"] + p["bias"][0]

    for text in [*TEXTS, rows[0][0], "vile " * 60]:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        windows = [words[at : at + toxicity.WINDOW] for at in range(0, max(len(words) - (toxicity.WINDOW - toxicity.STRIDE), 1), toxicity.STRIDE)]
        z, owner = toxicity.window_logits(m, [toxicity.words_of(text.encode())])
        assert len(z) == len(windows) and z.max() == pytest.approx(max(map(logit, windows)), abs=1e-3)


def test_quality_scores():
    rng = random.Random(6)
    rows = [((" ".join(rng.choices(["good", "fine", "text"] if k % 2 else ["junk", "spam", "zzz"], k=20))).encode(), k % 2) for k in range(100)]
    m = quality.train(rows, epochs=3)
    for text in TEXTS:
        raw = text.encode()
        z = m["bias"]
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        if words:
            z += float(np.mean([m["words"][zlib.crc32(w) >> (32 - quality.BITS)] for w in words], dtype=float))
        grams = []
        for n in quality.ORDERS:
            for at in range(len(raw) - n + 1):
                h = raw[at]
                for c in raw[at + 1 : at + n]:
                    h = h * 0x01000193 % U32 ^ c
                grams.append(m["chars"][(h * (0x9E3779B1 + 2 * n) % U32) >> (32 - quality.BITS)])
        if grams:
            z += float(np.mean(grams, dtype=float))
        assert quality.judge(m, raw, 0.5)[7] == pytest.approx(1 / (1 + math.exp(-(m["a"] * z + m["b"]))))
