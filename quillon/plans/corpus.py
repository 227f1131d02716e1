"""The driver's tables as the documents of the engine, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import constants as C
from quillon.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_pos, id, kind, title (up to the first full stop), text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc_pos"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), F.col("lang").alias("kind"), F.split_part("text", F.lit("."), F.lit(1)).alias("title"), "text"
    )


DOCS = "docs AS (SELECT doc_id AS doc_pos, 'doc-' || doc_id AS id, lang AS kind, split_part(text, '.', 1) AS title, text FROM documents)"
TOKENIZED = (
    f"tok AS MATERIALIZED (SELECT doc_pos, id, kind, {X.sql_tokens('title')} AS title, {X.sql_tokens('id')} AS name, {X.sql_tokens(X.sql_headings('text'))} AS heading, "
    f"{X.sql_tokens('text')} AS body FROM docs)"
)
POSTED = (
    f"raw_post AS (SELECT doc_pos, unnest(title) AS term, {C.TITLE_WEIGHT} AS w FROM tok UNION ALL SELECT doc_pos, unnest(name), {C.TITLE_WEIGHT} FROM tok "
    f"UNION ALL SELECT doc_pos, unnest(heading), {C.HEADING_WEIGHT} FROM tok UNION ALL SELECT doc_pos, unnest(body), {C.BODY_WEIGHT} FROM tok), "
    "post AS MATERIALIZED (SELECT doc_pos, term, CAST(sum(w) AS BIGINT) AS weight FROM raw_post GROUP BY ALL), terms AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term)"
)
MEASURED = (
    f"meas AS (SELECT doc_pos, id, kind, CAST({C.TITLE_WEIGHT} * (len(title) + len(name)) + len(heading) + len(body) AS BIGINT) AS length, "
    "CASE WHEN len(body) > 0 THEN len(list_distinct(body)) / len(body) ELSE 1.0 END AS ratio FROM tok), "
    "med AS (SELECT kind, ratio AS median FROM (SELECT kind, ratio, row_number() OVER (PARTITION BY kind ORDER BY ratio) - 1 AS rn, count(*) OVER (PARTITION BY kind) AS n FROM meas) WHERE rn = n // 2), "
    f"stats AS MATERIALIZED (SELECT doc_pos, id, kind, length, length * pow(median / ratio, {C.REPETITION_POWER}) AS norm_length FROM meas JOIN med USING (kind)), "
    "corpus AS (SELECT count(*) AS n, avg(length) AS avg_length FROM stats)"
)


def search_sql(queries: str, k: int, kind: str = "", columns: str = "query_id, place, id, kind, round(score, 6) AS score") -> str:
    """The ranked search over the queries of a relation (query_id, query)."""
    only = f"WHERE kind = '{kind}'" if kind else ""
    return f"""WITH {DOCS}, {TOKENIZED}, {POSTED}, {MEASURED}, q AS ({queries}),
    qt AS (SELECT query_id, lower(trim(query)) AS asked, list_distinct({X.sql_query_tokens('query')}) AS ts FROM q),
    asked AS MATERIALIZED (SELECT query_id, asked, len(ts) AS n_terms, unnest(ts) AS term FROM qt),
    {PREFIX_SQL},
    look AS (SELECT query_id, asked, n_terms, term, term AS lookup, 1.0::DOUBLE AS share FROM asked UNION ALL SELECT query_id, asked, n_terms, term, lookup, {C.EXPANSION_WEIGHT}::DOUBLE FROM asked JOIN expanded USING (term)),
    hit AS (SELECT query_id, asked, n_terms, l.term, lookup, doc_pos,
      share * ln(1 + (n - df + 0.5) / (df + 0.5)) * (weight * {C.K1 + 1}::DOUBLE) / (weight + {C.K1}::DOUBLE * ({1 - C.B}::DOUBLE + {C.B}::DOUBLE * norm_length / avg_length)) AS part
      FROM look l JOIN terms t ON t.term = l.lookup JOIN post p ON p.term = l.lookup JOIN stats USING (doc_pos), corpus),
    per_doc AS (SELECT query_id, asked, n_terms, doc_pos, sum(part) AS total, count(DISTINCT term) AS matched, array_to_string(list_sort(list_distinct(list(lookup))), ' ') AS lookups FROM hit GROUP BY ALL),
    rated AS (SELECT query_id, doc_pos, id, kind, title, matched, n_terms, lookups, total * (0.5 + 0.5 * matched / n_terms) * CASE WHEN asked = '' THEN 1.0 ELSE
      (CASE WHEN lower(trim(title)) = asked THEN {C.TITLE_EXACT} WHEN contains(lower(trim(title)), asked) THEN {C.TITLE_PART} ELSE 1.0 END) * (CASE WHEN lower(id) = asked THEN {C.ID_EXACT} ELSE 1.0 END) END AS score
      FROM per_doc JOIN docs USING (doc_pos)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id, doc_pos) AS place FROM rated {only})
    SELECT {columns} FROM ranked WHERE place <= {k}"""


PREFIX_SQL = f"""rare AS (SELECT DISTINCT asked.term FROM asked LEFT JOIN terms USING (term) WHERE length(asked.term) >= {C.MIN_PREFIX} AND coalesce(df, 0) <= {C.MAX_EXPANDED_DF}),
    seen AS (SELECT r.term, t.term AS lookup, t.df AS lookup_df, row_number() OVER (PARTITION BY r.term ORDER BY t.term) AS rn FROM rare r JOIN terms t ON starts_with(t.term, r.term) AND t.term <> r.term),
    expanded AS (SELECT * FROM (SELECT term, lookup, lookup_df, row_number() OVER (PARTITION BY term ORDER BY lookup_df DESC, length(lookup), lookup) AS place FROM seen WHERE rn <= {C.MAX_SEEN}) WHERE place <= {C.MAX_EXPANSIONS})"""
