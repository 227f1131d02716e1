"""What the classifiers learn from when ids repeat."""

import pytest

from quillon.llm import quality, toxicity


@pytest.mark.parametrize(("module", "fit", "label"), [(quality, "fit_quality", "quality"), (toxicity, "fit_toxicity", "toxic")])
def test_a_repeated_id_is_one_training_row(spark, monkeypatch, module, fit, label):
    docs = spark.createDataFrame([(1, f"hot {k}") for k in range(3000)] + [(k, f"text {k}") for k in range(2, 22)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 22)], f"doc_id long, {label} int")
    monkeypatch.setattr(module, "train", lambda rows, *_: rows)
    found = [getattr(module, fit)(d, labels, 30) for d in (docs, docs.orderBy("text"))]
    assert found[0] == found[1] and len(found[0]) == 21
    assert {(t, y) for t, y in found[0] if not t.startswith(b"hot")} == {(f"text {k}".encode(), k % 2) for k in range(2, 22)}


def test_long_rows_are_cut_not_dropped(spark):
    from quillon.llm.common import window_of

    texts = ["short", "x" * 10, "".join(map(str, range(100))), None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(window_of(df["t"], 10)).collect()]
    assert got[:2] == texts[:2] and len(got[2]) == 10 and got[2] in texts[2] and got[3] is None


def test_the_labels_of_a_sample(spark):
    """Labels beyond 0 and 1 count as 1, and the same rows are drawn in any order."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3) for k in range(200)] + [(k, None) for k in range(5)], "doc_id long, toxic int")
    found = [toxicity.fit_toxicity(d, l, 60) for d, l in ((docs, labels), (docs.orderBy("text"), labels.orderBy("toxic")))]
    assert (found[0]["weights"]["o"] == found[1]["weights"]["o"]).all() and found[0]["b"] == found[1]["b"]
