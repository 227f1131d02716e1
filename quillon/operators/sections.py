"""Section tables of markdown documents, and the same from heading rows with SQL operators only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import constants as C
from quillon.functions import markdown as M


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, title, preamble, sections and toc (JSON) of docs (doc_id, title, text)."""
    return docs.withColumn("page", M.parsed(F.col("text"), F.col("title"))).select("doc_id", "page.*")


def section_rows(parsed: DataFrame) -> DataFrame:
    """One row per section: doc_id, ord, section_id, parent_id, level, title, start_line, end_line, text."""
    return parsed.select("doc_id", F.posexplode("sections").alias("ord", "s")).select("doc_id", "ord", "s.*")


def top_sections(rows: DataFrame, most: int = C.MAX_SECTIONS_LISTED) -> DataFrame:
    """The first sections of the top level of each document: doc_id, ord, section_id, title."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return rows.where("parent_id is null").withColumn("place", place).where(F.col("place") <= most).select("doc_id", "ord", "section_id", "title")


def heading_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, line, level, title of every heading outside code; doc_id, n_lines) of docs (doc_id, text)."""
    scanned = docs.withColumn("scan", M.headings(F.col("text")))
    heads = scanned.select("doc_id", F.inline("scan.headings"))
    return heads, scanned.select("doc_id", F.col("scan.n_lines").alias("n_lines"))


def heading_spans(heads: DataFrame, n_lines: DataFrame) -> DataFrame:
    """doc_id, line, level, title, end_line: a heading's span ends at the next that is no deeper, else at the end.

    heads: doc_id, line, level, title; n_lines: doc_id, n_lines. For each of the six levels a running value holds, from
    the document's end on, the line of the heading of that level seen last; the least of those that are no deeper ends
    the span. Linear in the headings.
    """
    behind = Window.partitionBy("doc_id").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    levels = range(1, 7)
    seen = heads.select("*", *[F.last(F.when(F.col("level") == n, F.col("line")), ignorenulls=True).over(behind).alias(f"next_{n}") for n in levels])
    ends = F.least(*[F.when(F.col("level") >= n, F.col(f"next_{n}")) for n in levels])
    return seen.select("doc_id", "line", "level", "title", ends.alias("end_line")).join(n_lines, "doc_id").select("doc_id", "line", "level", "title", F.coalesce("end_line", "n_lines").alias("end_line"))


def bare_titles(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id and bare: whether only blank lines stand between the first heading and a second no deeper one."""
    order = Window.partitionBy("doc_id").orderBy("line")
    first = heads.withColumn("place", F.row_number().over(order)).withColumn("next_line", F.lead("line").over(order)).withColumn("next_level", F.lead("level").over(order)).where("place = 1")
    between = lines.join(first, "doc_id").where("pos > line and pos < next_line and trim(value) <> ''").groupBy("doc_id").count()
    return first.join(between, "doc_id", "left").select("doc_id", F.coalesce(F.expr("next_level <= level and count is null"), F.lit(False)).alias("bare"))
