"""Ranked retrieval over an index, for one query or a table of queries.

Query terms meet postings by equi-join on the term; rare long terms also take spellings that continue them. Where the
queries have at most LITERAL_TERMS distinct terms, terms and postings are filtered by those terms and their continuations
themselves, so that an index in term order is read only where they lie; otherwise both come by join. Both give the same
rows. Texts are read for the winners only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import constants as C
from quillon.functions import markdown as M
from quillon.functions import text as X
from quillon.operators.index import Index


LITERAL_TERMS = 500  # so many distinct terms are put into the filters of a scan


def stripped(text: Column) -> Column:
    """The text without white space of any kind around it."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, asked (stripped, cut to MAX_QUERY, lower case), n_terms and one row per distinct term of queries (query_id,
    query)."""
    asked = F.left(stripped(F.coalesce("query", F.lit(""))), F.lit(C.MAX_QUERY))
    cut = queries.select("query_id", asked.alias("query"))
    cut = cut.select("query_id", F.lower(stripped(F.col("query"))).alias("asked"), F.array_distinct(X.query_tokens(F.col("query"))).alias("all"))
    return cut.select("query_id", "asked", F.size("all").alias("n_terms"), F.explode("all").alias("term"))


def expand_prefix(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """term, lookup: up to MAX_EXPANSIONS indexed terms that continue each distinct rare term of wanted (term).

    Of the continuations only the first MAX_SEEN in alphabetical order count; the most frequent of them, then the
    shortest, then the first, are taken.
    """
    rare = wanted.select("term").distinct().join(terms, "term", "left").where((F.length("term") >= C.MIN_PREFIX) & (F.coalesce("df", F.lit(0)) <= C.MAX_EXPANDED_DF))
    stem = lambda c: F.left(F.col(c), F.lit(C.MIN_PREFIX))
    others = terms.select(F.col("term").alias("lookup"), F.col("df").alias("lookup_df"), stem("term").alias("start")).where(F.length("lookup") > C.MIN_PREFIX)
    pairs = rare.select("term", stem("term").alias("start")).join(others, "start").where("startswith(lookup, term) and lookup <> term")
    seen = pairs.withColumn("seen", F.row_number().over(Window.partitionBy("term").orderBy("lookup"))).where(F.col("seen") <= C.MAX_SEEN)
    best = Window.partitionBy("term").orderBy(F.desc("lookup_df"), F.length("lookup"), "lookup")
    return seen.withColumn("place", F.row_number().over(best)).where(F.col("place") <= C.MAX_EXPANSIONS).select("term", "lookup", "lookup_df", "place")


def pruned(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, postings) of the index that the query terms of asked can touch."""
    wanted = [r["term"] for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    if len(wanted) > LITERAL_TERMS:
        return index.terms, index.postings
    frequent = {r["term"] for r in index.terms.where(F.col("term").isin(wanted)).where(F.col("df") > C.MAX_EXPANDED_DF).collect()}
    rare = [t for t in wanted if len(t) >= C.MIN_PREFIX and t not in frequent]
    near = reduce(Column.__or__, [F.startswith("term", F.lit(t)) for t in rare], F.col("term").isin(wanted))
    terms = index.terms.where(near)
    more = [r["lookup"] for r in expand_prefix(asked, terms).select("lookup").distinct().collect()] if rare else []  # a few a term
    return terms, index.postings.where(F.col("term").isin(wanted + more))


def scored(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_pos, id, kind, title, score, matched (distinct query terms), n_terms and lookups (matching terms)."""
    asked = query_terms(queries)
    terms, postings = pruned(index, asked)
    more = asked.join(expand_prefix(asked, terms), "term").select("query_id", "asked", "n_terms", "term", "lookup", F.lit(C.EXPANSION_WEIGHT).alias("share"))
    lookups = asked.select("query_id", "asked", "n_terms", "term", F.col("term").alias("lookup"), F.lit(1.0).alias("share")).union(more)
    found = lookups.join(terms.withColumnRenamed("term", "lookup"), "lookup").join(postings.withColumnRenamed("term", "lookup"), "lookup")
    rated = found.join(index.doc_stats.select("doc_pos", "norm_length"), "doc_pos").crossJoin(F.broadcast(index.corpus_stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - C.B + C.B * F.when(F.col("avg_length") > 0, F.col("norm_length") / F.col("avg_length")).otherwise(1.0)
    part = F.col("share") * idf * (F.col("weight") * (C.K1 + 1)) / (F.col("weight") + C.K1 * norm)
    per_doc = rated.groupBy("query_id", "asked", "n_terms", "doc_pos").agg(F.sum(part).alias("sum"), F.countDistinct("term").alias("matched"), F.sort_array(F.collect_set("lookup")).alias("lookups"))
    named = per_doc.join(index.docs.select("doc_pos", "id", "kind", "title"), "doc_pos")
    title, name = F.lower(stripped(F.coalesce("title", F.lit("")))), F.lower("id")
    boost = F.when(F.col("asked") == "", 1.0).otherwise(
        F.when(title == F.col("asked"), C.TITLE_EXACT).when(F.contains(title, F.col("asked")), C.TITLE_PART).otherwise(1.0) * F.when(name == F.col("asked"), C.ID_EXACT).otherwise(1.0)
    )
    score = F.col("sum") * (0.5 + 0.5 * F.col("matched") / F.col("n_terms")) * boost
    return named.select("query_id", "doc_pos", "id", "kind", "title", score.alias("score"), "matched", "n_terms", "lookups")


def search_many(index: Index, queries: DataFrame, k: int = C.DEFAULT_K, kind: str = "") -> DataFrame:
    """The k best documents of each query (query_id, query): query_id, place, id, kind, title, score, lookups, doc_pos.

    kind keeps documents whose own kind is that, after ranking; k is clamped. Equal documents must tie although their
    parts may be summed in any order, so the order goes by the score to 9 places, then by id.
    """
    rated = scored(index, queries)
    if kind:
        rated = rated.where(F.col("kind") == kind)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id", "doc_pos")
    ranked = rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= clamp_k(k))
    return ranked.select("query_id", "place", "id", F.coalesce("kind", F.lit("guide")).alias("kind"), "title", "score", "matched", "lookups", "doc_pos")


def clamp_k(k) -> int:
    """k as a number of rows; what is not a number is the default."""
    try:
        return max(C.MIN_K, min(C.MAX_K, int(k)))
    except (TypeError, ValueError, OverflowError):
        return C.DEFAULT_K


def search(spark: SparkSession, index: Index, query: str, k: int = C.DEFAULT_K, kind: str = "") -> DataFrame:
    """id, kind, title, snippet, score (4 places) of the best documents for one query, best first."""
    asked = spark.createDataFrame([(0, query if isinstance(query, str) else "")], "query_id int, query string")
    found = search_many(index, asked, k, kind).join(index.docs.select("doc_pos", F.col("text"), F.col("kind").alias("own_kind")), "doc_pos")
    source = F.when((F.col("own_kind") == "api") & F.startswith("text", F.concat_ws(" ", "id", "title", F.lit(""))), F.expr("substring(text, length(id) + length(title) + 3)")).otherwise(F.col("text"))
    return found.orderBy("place").select("id", "kind", "title", M.snippet(source, F.col("lookups")).alias("snippet"), F.round("score", 4).alias("score"))


def search_docs(spark: SparkSession, index: Index, query: str, k: int = C.DEFAULT_K) -> DataFrame:
    """The public form: id, title, snippet."""
    return search(spark, index, query, k).select("id", "title", "snippet")
