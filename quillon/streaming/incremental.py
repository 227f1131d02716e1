"""Keeping postings current from a stream of documents, an extension of the batch index.

Documents arrive as files; each micro-batch appends its postings and statistics to tables partitioned by batch, so a
batch that is run again replaces its own partition and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.index import analysed, postings_of
from quillon.sources.scratch import dropped, written

DOCUMENT = T.StructType([T.StructField("doc_pos", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("id", "kind", "title", "text")]])


def append_batch(docs: DataFrame, batch: int, path: str) -> None:
    read_once = written(analysed(docs), "batch")
    for name, rows in (("postings", postings_of(read_once)), ("measured", read_once.drop("posted"))):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    dropped(read_once)


def index_stream(spark: SparkSession, source: str, path: str, checkpoint: str) -> StreamingQuery:
    """Indexes every Parquet file that appears under source once; stops when no new file is left."""
    docs = spark.readStream.schema(DOCUMENT).parquet(source)
    return docs.writeStream.foreachBatch(lambda df, batch: append_batch(df, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(spark: SparkSession, path: str) -> DataFrame:
    """term and df over all batches so far."""
    return spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
