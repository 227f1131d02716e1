"""The pipeline's near-duplicate stage against all pairs of texts, with planted near copies."""

import random
import re

import corpus_pipeline
import pytest

from quillon.llm import simhash
from quillon.llm.common import table

SF = "/root/testdata/sf0.001"

COLUMNS = "doc_id long, text string, lang string, node long, keys string"


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_kept(rows, least=0.8):
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= least * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted(min((i for i in g if i is not None), default=-1) for g in groups.values())


def planted(seed=5, n=25):
    """Texts and copies of them with one word in some places changed, at similarities from 0.6 to 0.97."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        rows.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) * rng.randint(1, 5) // 200)):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    return rows


def test_planted_copies_go(spark):
    texts = [*planted(), None, "", " \n", "a b", "A  b", "a b c", "x" * 9_000]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (ids[0], texts[0]), (None, texts[1]), (None, "all alone")]
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], COLUMNS)
    sets = [brute_set(t) for t in planted()]
    within = [len(a & b) / len(a | b) for k, a in enumerate(sets) for b in sets[:k]]
    assert sum(0.8 <= x < 0.95 for x in within) > 20 and sum(0.6 <= x < 0.8 for x in within) > 20
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == brute_kept(rows)
    assert simhash.deduplicate(docs.where("false")).count() == 0


def test_crowded_keys(spark):
    """Many copies of one text share their keys; those further than 0.8 from it may still be near one another."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(0, 120, 6), rng.randint(1, 6)):
            copy[at] = rng.choice(["y", "z"])
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], COLUMNS)
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == brute_kept(rows)


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="needs the driver's tables")
def test_stage_on_the_smallest_table(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == brute_kept(rows)
