"""Places of rows in an order, without any group of them in one task."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..session import cut


def held_before(df: DataFrame, by: list[str], order: list[Column], weight: Column | None = None, name: str = "__before") -> DataFrame:
    """df with name: how much weight (rows, where none is given) lies before the row in order, among rows that share by.

    Rows are dealt by ranges of (by, order), summed up within a range, and moved on by the sums of the ranges before.
    Ranges are drawn from a sample, so what was dealt is kept by a checkpoint.
    """
    dealt = df.withColumn("__w", (F.lit(1) if weight is None else weight).cast("long"))
    dealt = cut(dealt.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    of = {c: f"__of_{i}" for i, c in enumerate(by)}
    sums = dealt.groupBy(*(F.col(c).alias(n) for c, n in of.items()), F.col("__part").alias("__at")).agg(F.sum("__w").alias("__held"))
    earlier = Window.partitionBy(*(of.values() or [F.lit(0)])).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__first", F.coalesce(F.sum("__held").over(earlier), F.lit(0))).drop("__held")
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn(name, F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in of.items()), F.col("__part") == F.col("__at"))
    return placed.join(sums, same).withColumn(name, F.col(name) + F.col("__first")).drop("__w", "__part", "__at", "__first", *of.values())
