"""Connected components of an edge table by alternating large and small stars, with no group gathered anywhere."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import materialize


def _oriented(a: str, b: str) -> tuple:
    return F.greatest(a, b).alias("u"), F.least(a, b).alias("v")


def connected(edges: DataFrame, src: str, dst: str, most: int = 60) -> DataFrame:
    """(node, root) for each node of an edge; root is the least node of its component.

    Every step keeps the components and works by joins and minima on keys, so that a node with very many edges is only
    a skewed join. Nulls and loops are left out; an empty table gives no rows.
    """
    e = materialize(edges.where(F.col(src) != F.col(dst)).select(*_oriented(src, dst)).distinct(), "edges")
    for _ in range(most):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        if _same(now, e):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        e = now
    raise RuntimeError(f"components did not settle in {most} rounds")


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two distinct edge tables are equal, by count and a sum of hashes."""
    of = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return of(a) == of(b)
