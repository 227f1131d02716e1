"""A group of near copies of one text that differ too much to link: the bitmaps spare comparing each with all others."""

import random

import numpy as np

from quillon.llm import near_copies, simhash


def test_bitmaps_bound_the_intersection(spark):
    rng = np.random.default_rng(5)
    rows, both = [], []
    for n in (1, 5, 300, 5000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for _ in range(2))
        b = np.unique(np.append(b, a[: n // 2 + 1]))
        rows.append((len(a), near_copies.bitmap(a).tolist(), len(b), near_copies.bitmap(b).tolist()))
        both.append(len(np.intersect1d(a, b)))
    pairs = spark.createDataFrame(rows, "n long, bits array<long>, m long, x array<long>")
    bounds = pairs.select(pairs.n - near_copies.only_in("bits", "x"), pairs.m - near_copies.only_in("x", "bits")).collect()
    assert all(min(r) >= k for r, k in zip(bounds, both, strict=True))
    assert all(min(r) < k + 0.3 * n for r, k, (n, *_) in zip(bounds[:3], both, rows, strict=False) if n > 5)


def test_group_just_under_the_similarity(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for i in range(120):
        own = list(base)
        for place in rng.sample(range(0, 200, 10), 3 + i % 4):
            own[place] = f"x{rng.randint(0, 2)}"
        texts.append(" ".join(own))
    sets = [near_copies.shingles(t.encode()) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if near_copies.similarity(sets[a], sets[b]) >= near_copies.SIMILARITY]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    compared, write = [], near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, name: (out := write(df, name), name == "pairs" and compared.append(out.count()))[0])
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(root)
    assert 0 < sum(compared) < 20 * len(texts)
