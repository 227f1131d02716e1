"""Link lists and page addresses: which URLs and slugs are taken, and what a link list holds.

A site is a host and a path prefix; both are parameters. Everything is a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import constants as C

LINK = r"^\s*-\s*\[([^\]]+)\]\(([^)\s]+)\)\s*(?::\s*(.*))?\z"


@dataclass(frozen=True)
class Site:
    host: str = "docs.example.com"
    prefix: str = "/guides/"

    @property
    def base(self) -> str:
        return f"https://{self.host}{self.prefix}"


def is_slug(slug: Column) -> Column:
    """One safe path segment: letters, digits, '.', '_', '-', no '..', at most MAX_ID characters."""
    return F.coalesce(slug.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z") & ~F.contains(slug, F.lit("..")) & (F.length(slug) <= C.MAX_ID), F.lit(False))


def is_page_url(url: Column, site: Site) -> Column:
    """https, exactly the site's host without port or credentials, one segment below its prefix, no query or fragment."""
    tail = url.substr(F.lit(len(site.base) + 1), F.length(url))
    plain = tail.rlike(r"\A[^/?#%\s]+\z") & ~F.contains(tail, F.lit(".."))
    return F.coalesce((F.length(url) <= C.MAX_URL) & F.startswith(url, F.lit(site.base)) & plain, F.lit(False))


def without_md(name: Column) -> Column:
    return F.regexp_replace(name, r"\.md\z", "")


def slug_of(url: Column, site: Site) -> Column:
    """The slug of a page URL, null if it is none."""
    slug = without_md(url.substr(F.lit(len(site.base) + 1), F.length(url)))
    return F.when(is_page_url(url, site) & is_slug(slug), slug)


def page_url(slug: Column, site: Site, markdown: bool = True) -> Column:
    return F.when(is_slug(slug), F.concat(F.lit(site.base), slug, F.lit(".md" if markdown else "")))


def page_id(raw: Column, site: Site) -> Column:
    """A slug, or a page URL (a fragment and one trailing slash are dropped), as a slug; null if it is neither."""
    text = F.regexp_replace(raw, r"(?U)\A\s+|\s+\z", "")
    url = F.regexp_replace(F.regexp_replace(text, r"(?s)#.*\z", ""), r"/\z", "")
    bare = without_md(text)
    slug = F.when(text.rlike(r"\Ahttps?://"), slug_of(url, site)).when(is_slug(bare), bare)
    return F.when(F.length(text).between(1, C.MAX_ID), slug)


def parse_links(lines: DataFrame, site: Site) -> DataFrame:
    """slug, title, url, description of a link list's lines (pos, value), the first of each slug; lists of lists go."""
    part = lambda n: F.regexp_extract("value", LINK, n)
    found = lines.where(F.col("value").rlike(LINK)).select("pos", F.trim(part(1)).alias("title"), part(2).alias("url"), F.trim(part(3)).alias("description"))
    found = found.where(~F.endswith("url", F.lit("llms.txt"))).withColumn("slug", slug_of(F.col("url"), site)).where("slug is not null")
    return first_of(found, "slug", "pos").select("slug", "title", page_url(F.col("slug"), site).alias("url"), "description")


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first: a minimum over whole rows, so it is combined before the shuffle."""
    row = F.struct(order, *[c for c in df.columns if c not in (order, key)])
    return df.groupBy(key).agg(F.min_by(row, order).alias("row")).select(key, "row.*")


def read_links(spark: SparkSession, path: str, site: Site) -> DataFrame:
    """The links of a text file; fails if there are none."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))
    found = parse_links(lines, site)
    if found.isEmpty():
        raise ValueError(f"{path} holds no links")
    return found
