"""Connected components by alternating large and small stars; all state lives in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import dropped, written


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component), for all nodes of edges (a, b) but the roots."""
    pairs = edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v")
    stars = written(pairs.distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        mark = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == last or not mark[0]:
            return stars.selectExpr("u node", "v root")
        last = mark
        both = stars.unionByName(stars.selectExpr("v u", "u v"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = written(both.join(least, "u").where("v > u").selectExpr("v u", "m v").distinct(), "large")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").where("v <> m").selectExpr("v u", "m v").unionByName(lower.selectExpr("u", "m v"))
        before, stars = stars, written(small.distinct(), "small")
        dropped(before, least, large, lower)
    raise RuntimeError("the components did not settle")
