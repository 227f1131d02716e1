"""Guide pages from text files: read, cleaned, and the rejects with a reason."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import constants as C
from quillon.functions import markdown as M

MAX_BYTES = 2 << 20


def decoded(content: Column, charset: str = "utf-8") -> Column:
    """The bytes as text; what the charset does not allow becomes U+FFFD, so one bad byte does not fail a crawl."""
    name = codecs.lookup(charset).name  # an unknown charset fails here, not in a task
    if name == "utf-8":
        return F.make_valid_utf8(content.cast("string"))

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode(name, "replace"))

    return run(content)


def read_pages(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, charset: str = "utf-8") -> DataFrame:
    """slug (the file's name), raw text (null if the file is larger than max_bytes) and its size. Larger files are not read."""
    files = spark.read.format("binaryFile").load(path)
    slug = F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)
    named = lambda rows, raw: rows.select(slug.alias("slug"), raw.alias("raw"), F.col("length").alias("bytes"))
    return named(files.where(F.col("length") <= max_bytes), decoded(F.col("content"), charset)).union(named(files.where(F.col("length") > max_bytes), F.lit(None).cast("string")))


def guide_docs(pages: DataFrame, links: DataFrame, variables: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents id, kind, title, url, updated_at, text; rejects slug, reason) of pages (slug, raw) and links."""
    joined = links.join(pages.select("slug", "raw"), "slug", "left").withColumn("page", M.cleaned(F.col("raw"), variables))
    body = F.trim(F.coalesce("page.body", F.lit("")))
    reason = F.when(F.col("raw").isNull(), "missing or too large").when(F.col("page.body").isNull(), "HTML, not markdown").when(body == "", "empty")
    marked = joined.withColumn("reason", reason)
    good = marked.where("reason is null").select(F.col("slug").alias("id"), F.lit("guide").alias("kind"), "title", "url", F.col("page.updated_at").alias("updated_at"), F.col("page.body").alias("text"))
    return good, marked.where("reason is not null").select("slug", "reason")


def live_or_stored(docs: DataFrame, live: DataFrame) -> DataFrame:
    """docs (id, text) with the text of live (id, text and, where a read failed, its reason) where there is one, else the
    stored text and a note that says why."""
    reason = F.coalesce("reason", F.lit("no answer")) if "reason" in live.columns else F.lit("no answer")
    joined = docs.join(live.select("id", F.col("text").alias("fresh"), reason.alias("reason")), "id", "left")
    why = short_reason(F.coalesce("reason", F.lit("no answer")))
    stored = F.concat(F.lit("This is the indexed copy: the page itself could not be read ("), why, F.lit(")."))
    note = F.when(F.col("fresh").isNotNull(), "").when(F.coalesce("text", F.lit("")) != "", stored).otherwise(F.concat(F.lit("The page could not be read: "), why))
    return joined.select(*[c for c in docs.columns if c != "text"], F.coalesce("fresh", "text").alias("text"), note.alias("note"))


def short_reason(message: Column, limit: int = C.MAX_REASON) -> Column:
    """The first line of a message, without white space around it, cut to limit characters."""
    line = F.regexp_extract(message, r"(?U)\A\s*([^\r\n]*[^\r\n\s])", 1)
    return F.when(F.length(line) > limit, F.concat(F.regexp_replace(F.left(line, F.lit(limit - 3)), r"(?U)\s+\z", ""), F.lit("..."))).otherwise(line)
