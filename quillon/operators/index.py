"""Inverted index of a document table: postings, document statistics, corpus statistics.

A document has doc_pos (its key), id, kind, title and text. ``analysed`` reads each text once: a document's postings, length
and ratio are worked out within its row, without a shuffle. A build writes that table and takes all others from it; the
postings are shuffled once, into term order, when the index is saved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import constants as C
from quillon.functions import text as X
from quillon.sources.scratch import dropped, scratch, spread, written

ROW_GROUP_BYTES = 16 << 20  # postings are read by row group

@dataclass(frozen=True)
class Index:
    """The tables of an index; docs holds the documents themselves."""

    docs: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    corpus_stats: DataFrame
    terms: DataFrame

    TABLES = ("docs", "postings", "doc_stats", "corpus_stats", "terms")


def tokenized(docs: DataFrame) -> DataFrame:
    """doc_pos, id, kind and the token arrays of title, id, headings and body."""
    return docs.select(
        "doc_pos", "id", F.coalesce("kind", F.lit("guide")).alias("kind"),
        X.tokens(F.col("title")).alias("title"), X.tokens(F.col("id")).alias("name"),
        X.tokens(F.array_join(X.headings(F.col("text")), "\n")).alias("heading"), X.tokens(F.col("text")).alias("body"),
    )


def analysed(docs: DataFrame) -> DataFrame:
    """doc_pos, id, kind, length (weighted), ratio (distinct share of the body's tokens, 1 for an empty body) and posted
    (term, weight), in one pass. The tokens, as often as they weigh, are sorted; equal neighbours are one posting."""
    times = lambda c, w: F.flatten(F.array_repeat(c, w)) if w > 1 else F.col(c)
    weighed = F.concat(times("title", C.TITLE_WEIGHT), times("name", C.TITLE_WEIGHT), times("heading", C.HEADING_WEIGHT), times("body", C.BODY_WEIGHT))
    ratio = F.when(F.size("body") > 0, F.size(F.array_distinct("body")) / F.size("body")).otherwise(1.0)
    rows = tokenized(spread(docs)).select("doc_pos", "id", "kind", ratio.alias("ratio"), F.sort_array(weighed).alias("sorted"))
    # lambdas read their own arguments only: a column read in one may be worked out again at each of its steps
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), "sorted"), 1, F.size("sorted"))
    pairs = F.arrays_zip(F.col("sorted").alias("term"), before.alias("before"))
    begins = F.filter(F.transform(pairs, lambda p, i: F.when(p["before"].isNull() | (p["term"] != p["before"]), i)), lambda i: i.isNotNull())
    rows = rows.select("*", F.size("sorted").alias("n"), begins.alias("begins"))
    ends = F.slice(F.concat("begins", F.array("n")), 2, F.size("begins"))
    weights = F.zip_with("begins", ends, lambda begin, end: (end - begin).cast("long"))
    posted = F.arrays_zip(F.array_distinct("sorted").alias("term"), weights.alias("weight"))
    return rows.select("doc_pos", "id", "kind", F.col("n").cast("long").alias("length"), "ratio", posted.alias("posted"))


def postings_of(rows: DataFrame) -> DataFrame:
    """doc_pos, term, weight of analysed documents."""
    return rows.select("doc_pos", F.inline("posted"))


def postings(docs: DataFrame) -> DataFrame:
    """doc_pos, term, weight."""
    return postings_of(analysed(docs))


def measured(docs: DataFrame) -> DataFrame:
    """doc_pos, id, kind, length (weighted) and ratio (distinct share of the body's tokens, 1 for an empty body)."""
    return analysed(docs).drop("posted")


def upper_median(rows: DataFrame, key: str, value: str, cells: int = 1000) -> DataFrame:
    """The value at place n // 2 of each key's sorted values.

    Equal values are counted first; counts by cell of the value range find the cell that holds the place, and only that
    cell's values are put in order, so no task sorts a key's values.
    """
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n")).withColumn("cell", F.floor(F.col(value) * cells))
    by_cell = counts.groupBy(key, "cell").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy(key).orderBy("cell")
    place = F.floor(F.sum("n").over(Window.partitionBy(key)) / 2)
    found = by_cell.select(key, "cell", (F.sum("n").over(up_to) - F.col("n")).alias("below"), F.col("n").alias("own"), place.alias("place"))
    found = found.where("below <= place and place < below + own").select(key, "cell", (F.col("place") - F.col("below")).alias("place"))
    inside = counts.join(found, [key, "cell"])
    before = F.sum("n").over(Window.partitionBy(key).orderBy(value)) - F.col("n")
    return inside.withColumn("before", before).where("before <= place and place < before + n").select(key, F.col(value).alias("median"))


def stats_of(rows: DataFrame) -> DataFrame:
    """doc_pos, id, kind, length, norm_length of a written table of analysed documents: the length, longer for bodies more
    repetitive than their kind's median."""
    rows = rows.select("doc_pos", "id", "kind", "length", "ratio")
    joined = rows.join(upper_median(rows, "kind", "ratio"), "kind", "left")
    norm = F.when(F.col("ratio") > 0, F.col("length") * F.pow(F.col("median") / F.col("ratio"), F.lit(C.REPETITION_POWER))).otherwise(F.col("length").cast("double"))
    return joined.select("doc_pos", "id", "kind", "length", norm.alias("norm_length"))


def doc_stats(docs: DataFrame) -> DataFrame:
    """stats_of the documents, whose texts are read once."""
    return stats_of(written(measured(docs), "measured"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """n and avg_length over all documents, empty ones too."""
    return stats.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))


def term_stats(posted: DataFrame) -> DataFrame:
    """term and df."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def build_index(docs: DataFrame) -> Index:
    """The index of docs, its tables in the shared folder: read once, written twice (as it is read, and in term order)."""
    path = scratch(docs.sparkSession, "index")
    write_index(docs, path)
    return load_index(docs.sparkSession, path, docs)


def write_index(docs: DataFrame, path: str) -> None:
    """Builds the tables of an index but the documents themselves. Postings and terms lie in term order, so the least and
    greatest terms of a row group tell whether a lookup needs it."""
    spark = docs.sparkSession
    rows = written(analysed(docs), "analysed")
    postings_of(rows).repartitionByRange("term", "doc_pos").sortWithinPartitions("term", "doc_pos").write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/postings")
    stats_of(rows).write.mode("overwrite").parquet(f"{path}/doc_stats")
    corpus_stats(spark.read.parquet(f"{path}/doc_stats")).write.mode("overwrite").parquet(f"{path}/corpus_stats")
    term_stats(spark.read.parquet(f"{path}/postings")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    dropped(rows)


def save_index(index: Index, path: str) -> None:
    """Writes the tables of an index, whatever they come from, in the order that write_index gives them."""
    for name in ("docs", "doc_stats", "corpus_stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    index.postings.repartitionByRange("term", "doc_pos").sortWithinPartitions("term", "doc_pos").write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/postings")
    index.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")


def load_index(spark: SparkSession, path: str, docs: DataFrame | None = None) -> Index:
    """The index under path, with the documents there or given; fails if a table lacks a column it must have."""
    need = {"docs": {"doc_pos", "id", "title", "text"}, "postings": {"doc_pos", "term", "weight"}, "doc_stats": {"doc_pos", "norm_length", "length"}, "corpus_stats": {"n", "avg_length"}, "terms": {"term", "df"}}
    tables = {t: docs if t == "docs" and docs is not None else spark.read.parquet(f"{path}/{t}") for t in Index.TABLES}
    for name, columns in need.items():
        if missing := columns - set(tables[name].columns):
            raise ValueError(f"{name} lacks {sorted(missing)}")
    return Index(**tables)


def index_problems(index: Index) -> DataFrame:
    """check and violations: what a sound index has none of."""
    posted, stats = index.postings, index.doc_stats
    count = lambda df, name: df.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
    sums = posted.groupBy("doc_pos").agg(F.sum("weight").alias("total"))
    checks = {
        "duplicate_posting": posted.groupBy("doc_pos", "term").count().where("count > 1"),
        "empty_term": posted.where("term is null or term = ''"),
        "weight_below_one": posted.where("weight is null or weight < 1"),
        "orphan_posting": posted.join(stats, "doc_pos", "left_anti"),
        "duplicate_document": stats.groupBy("doc_pos").count().where("count > 1"),
        "length_differs": stats.join(sums, "doc_pos", "left").where("length <> coalesce(total, 0)"),
        "bad_norm": stats.where("norm_length is null or norm_length < 0 or isnan(norm_length)"),
    }
    return reduce(DataFrame.union, [count(df, name) for name, df in checks.items()])
