"""Languages that have only long documents, and none to learn from."""

from quillon.llm import langid


def test_a_language_of_long_documents_is_a_class(spark):
    rows = [(k, "tor ban kel" if k % 2 else "sie oua iye " * 20, "aa" if k % 2 else "bb") for k in range(40)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_chars=50)
    assert model["classes"] == ["aa", "bb"]


def test_many_values_of_lang(spark):
    """Of more languages than there may be classes the most frequent are learned; ids and texts may repeat."""
    rows = [(k, f"tor ban kel {k}", "aa") for k in range(30)] + [(k, "sie oua iye", "bb") for k in range(30, 50)] * 2 + [(100 + k, "x", f"junk{k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit_languages(docs, most_classes=2)["classes"] == ["aa", "bb"]


def test_without_a_model_documents_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12 .", None), (3, None, None)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(docs, langid.fit_languages(docs))
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]
