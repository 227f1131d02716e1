"""Postings from a stream equal those of the batch index."""

from quillon.operators import index
from quillon.streaming import incremental


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"d{i}", "guide", f"title {i}", f"some text number {i % 3}") for i in range(8)]
    whole = spark.createDataFrame(rows, incremental.DOCUMENT)
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for part in ("doc_pos < 4", "doc_pos >= 4"):
        whole.where(part).write.mode("append").parquet(source)
        incremental.index_stream(spark, source, out, kept).awaitTermination()
    form = lambda df: sorted(tuple(r) for r in df.select("term", "df").collect())
    assert form(incremental.term_counts(spark, out)) == form(index.term_stats(index.postings(whole)))
