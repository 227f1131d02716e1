"""Inventory, age and state of an index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import constants as C
from quillon.sources import publish
from quillon.sources.scratch import file_system


def inventory(docs: DataFrame) -> DataFrame:
    """kind and n of the documents."""
    return docs.groupBy(F.coalesce("kind", F.lit("guide")).alias("kind")).agg(F.count("*").alias("n"))


def age_days(built_at: Column, now: Column) -> Column:
    """Days between two timestamps, as a fraction."""
    return (F.unix_micros(now) - F.unix_micros(built_at)) / F.lit(86_400_000_000)


def staleness(meta: DataFrame, now: Column) -> DataFrame:
    """built_at, age and stale; a built_at that is no time has no age and is not stale."""
    age = age_days(F.try_to_timestamp("built_at"), now)
    return meta.select("built_at", age.alias("age"), F.coalesce(age > C.STALE_DAYS, F.lit(False)).alias("stale"))


REPORT = "path string, state string, generation string, schema int, built_at string, age double, guides long, operations long, terms long, postings long, bytes long, api_version string"


def report(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """One row on what is published under path. state: fresh, stale, unreadable (another schema, or a table is missing or
    lacks columns) or missing."""
    blank = dict.fromkeys(c.split()[0] for c in REPORT.split(", ")) | {"path": path}
    pointer = publish.current(spark, path)
    if pointer is None:
        return spark.createDataFrame([tuple((blank | {"state": "missing"}).values())], REPORT)
    known = blank | pointer.asDict()
    try:
        index = publish.open_published(spark, path)
    except (ValueError, AnalysisException):
        return spark.createDataFrame([tuple((known | {"state": "unreadable"})[k] for k in blank)], REPORT)
    age = staleness(spark.createDataFrame([(pointer["built_at"],)], "built_at string"), now).first()
    kinds = {r["kind"]: r["n"] for r in inventory(index.docs).collect()}
    folder, system = file_system(spark, f"{path}/{pointer['generation']}")
    known |= {
        "state": "stale" if age["stale"] else "fresh", "age": age["age"], "guides": sum(n for k, n in kinds.items() if k != "api"), "operations": kinds.get("api", 0),
        "terms": index.terms.count(), "postings": index.postings.count(), "bytes": system.getContentSummary(folder).getLength(),
    }
    return spark.createDataFrame([tuple(known[k] for k in blank)], REPORT)
