"""The build job: a link list, a folder of pages and a specification in, a published index out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import constants as C
from quillon.operators.index import build_index
from quillon.sources.links import Site, read_links
from quillon.sources.openapi import Dialect, read_spec
from quillon.sources.pages import guide_docs, read_pages
from quillon.sources.publish import guard, publish
from quillon.sources.scratch import written

COLUMNS = {
    "id": "string", "kind": "string", "title": "string", "text": "string", "url": "string", "updated_at": "string", "operation_id": "string",
    "tags": "array<string>", "card": "string", "cli": "string", "cli_aliases": "array<string>",
}


def catalogue(*parts: DataFrame) -> DataFrame:
    """The documents of all parts with the same columns and a doc_pos: unique, and rising with (kind, id) so that a build
    of the same documents numbers them alike. API documents come first and take an alias before guides."""
    rows = None
    for part in parts:
        same = part.select(*[(F.col(c) if c in part.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()])
        rows = same if rows is None else rows.unionByName(same)
    return written(rows.orderBy("kind", "id").withColumn("doc_pos", F.monotonically_increasing_id()), "catalogue")


def build(
    spark: SparkSession, links: str, pages: str, spec: str | None, out: str, built_at: str, site: Site = Site(), dialect: Dialect = Dialect(),
    variables: dict[str, str] | None = None, least_guides: int = C.MIN_GUIDES, least_operations: int = C.MIN_OPERATIONS,
) -> dict:
    """Reads the sources, refuses to go on where either has fewer documents than it must, indexes and publishes.

    Returns generation, guides, operations, api_version and rejects (slug, reason of the pages that were left out)."""
    guides, rejects = guide_docs(read_pages(spark, pages), read_links(spark, links, site), variables)
    guides = written(guides, "guides")
    found = {"guide": guides.count()}
    guard(found, {"guide": least_guides})
    operations, version = read_spec(spark, spec, dialect, least_operations) if spec else (None, None)
    docs = catalogue(guides, *([operations] if operations is not None else []))
    generation = publish(spark, build_index(docs), out, built_at, api_version=version or "")
    total = docs.count()
    return {"generation": generation, "guides": found["guide"], "operations": total - found["guide"], "api_version": version or "", "rejects": rejects}
