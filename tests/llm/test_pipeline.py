"""The pipeline and the registered queries on the smallest tables."""

import corpus_pipeline
import pytest

import __spark_entry__
from quillon.llm import langid, quality
from quillon.llm.common import table
from test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "benchmark_decontamination", "sentencepiece"]


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="needs the driver's tables")
def test_pipeline_equals_the_operators_by_hand(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in langid.identify(docs, langid.fit_languages(langid.learnable(docs))).where("score >= 0.5").collect()}
    second = docs.where(docs["doc_id"].isin(list(kept)))
    good = {r["doc_id"] for r in quality.quality_rules(second, quality.fit_quality(second, table(spark, SF, "labels"))).where("kept").collect()}
    import re

    single = set(brute_kept([(i, rows[i]) for i in good]))

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    runs = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r["text"])
        runs |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))}
    sizes = {len(x) for x in runs}
    hit = lambda w: any(tuple(w[i : i + n]) in runs for n in sizes for i in range(len(w) - n + 1))
    want = {i for i in single if not hit(words(rows[i]))}
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert found.keys() == want
    assert all(r["decoded"] == rows[i] and r["n_pieces"] == len(r["ids"]) for i, r in found.items())
