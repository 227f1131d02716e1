"""Finding a document by what someone calls it: aliases, the order in which they are tried, and suggestions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import constants as C
from quillon.sources.links import Site, first_of, page_id

MAX_NEEDLES = 1000


def alias_table(docs: DataFrame, program: str = "cli") -> DataFrame:
    """alias (lower case), id: operation id, command lines with and without the program, and id of API documents.

    The first document in doc_pos order takes an alias; within one document the order is that of the names.
    """
    short = lambda c: F.regexp_replace(F.lower(c), rf"\A{program} ", "")
    commands = F.concat(F.array("cli"), F.coalesce("cli_aliases", F.array().cast("array<string>")))
    both = F.flatten(F.transform(commands, lambda c: F.array(F.lower(c), F.trim(short(c)))))
    names = F.concat(F.array(F.lower("operation_id")), both, F.array(F.lower("id")))
    rows = docs.where("kind = 'api'").select("doc_pos", "id", F.posexplode(names).alias("place", "alias")).where("alias is not null and alias <> ''")
    return first_of(rows.select("alias", "id", F.struct("doc_pos", "place").alias("at")), "alias", "at").select("alias", "id")


def reference_operation(raw: Column, base: str) -> Column:
    """The operation at the end of a reference URL, null for other texts."""
    tail = raw.substr(F.lit(len(base) + 1), F.length(raw))
    name = F.trim(F.regexp_replace(tail, r"(?s)[#?].*\z", ""), F.lit("/"))
    return F.when(F.startswith(F.lower(raw), F.lit(base.lower())) & (name != ""), name)


def resolve(asked: DataFrame, docs: DataFrame, aliases: DataFrame, site: Site = Site(), reference: str = "https://docs.example.com/reference/") -> DataFrame:
    """raw and id (null if unknown) for each row of asked (raw): the first way that leads to a document.

    Ways: the id itself, an alias, a reference URL, METHOD /path in any case and spacing, a slug, the slug in lower case.
    """
    raw = F.regexp_replace("raw", r"(?U)\A\s+|\s+\z", "")
    call = F.when(raw.rlike(r"(?s)\A\S+\s+/"), F.concat(F.upper(F.regexp_extract(raw, r"\A(\S+)", 1)), F.lit(" "), F.regexp_extract(raw, r"(?s)\A\S+\s+(/.*)\z", 1)))
    slug = page_id(raw, site)
    names = [(False, raw), (True, F.lower(raw)), (True, F.lower(reference_operation(raw, reference))), (False, call), (False, slug), (False, F.lower(slug))]
    ways = F.array(*[F.struct(F.lit(i).alias("way"), F.lit(alias).alias("by_alias"), name.alias("name")) for i, (alias, name) in enumerate(names)])
    distinct = asked.select("raw").distinct()
    tried = distinct.select("raw", F.inline(ways)).where("name is not null and name <> ''")
    known = docs.select("id").distinct()
    direct = tried.where("not by_alias").join(known, F.col("name") == F.col("id")).select("raw", "way", "id")
    by_alias = tried.where("by_alias").join(aliases, F.col("name") == F.col("alias")).select("raw", "way", "id")
    best = direct.union(by_alias).groupBy("raw").agg(F.min_by("id", "way").alias("id"))
    return asked.select("raw").join(best, "raw", "left")


def ratio(needle: str, other: str) -> float:
    """Share of matching blocks, 0 where it cannot be over MIN_RATIO."""
    m = difflib.SequenceMatcher(None, needle, other)
    bounds = (m.real_quick_ratio, m.quick_ratio)
    return m.ratio() if all(b() > C.MIN_RATIO for b in bounds) else 0.0


def suggest(asked: list[str], docs: DataFrame, n: int = C.SUGGESTIONS) -> DataFrame:
    """needle, place, id, title, ratio: the n likeliest documents for each unknown name.

    The names, at most MAX_NEEDLES, go to the documents; each task keeps its own n best, so little is shuffled.
    """
    needles = list(dict.fromkeys(x for a in asked if (x := (a or "").strip().lower())))
    if len(needles) > MAX_NEEDLES:
        raise ValueError(f"more than {MAX_NEEDLES} names at once")

    def run(batches):
        for pdf in batches:
            ids, titles = pdf["id"].fillna(""), pdf["title"].fillna("")
            for needle in needles:
                rated = [
                    max(ratio(needle, i.lower()), ratio(needle, t.lower()), C.SUBSTRING_RATIO if needle in i.lower() or needle in t.lower() else 0.0)
                    for i, t in zip(ids, titles, strict=True)
                ]
                own = pd.DataFrame({"needle": needle, "id": ids, "title": titles, "ratio": rated})
                yield own[own["ratio"] > C.MIN_RATIO].sort_values(["ratio", "id"], ascending=[False, True], kind="stable").head(n)

    found = docs.select("id", "title").mapInPandas(run, "needle string, id string, title string, ratio double")
    order = Window.partitionBy("needle").orderBy(F.desc("ratio"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("needle", "place", "id", "title", "ratio")
