"""Accuracy, reports and comparisons of predictions."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """accuracy, a fraction."""
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def tolerance_accuracy(df: DataFrame, actual: Column, predicted: Column, margin: float) -> DataFrame:
    """accuracy_pct, correct, total: right where encoded values differ by at most margin."""
    right = F.abs(predicted - actual) <= margin
    return df.agg(F.avg(right.cast("double") * 100).alias("accuracy_pct"), F.count_if(right).alias("correct"), F.count(F.lit(1)).alias("total"))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support, from one count by (actual, predicted); what has no rows is 0."""
    n = df.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    cells = n.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("hit"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))).alias("c")).select("c.*")
    t = cells.groupBy("class").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t = t.withColumn("precision", ratio(F.col("hit").cast("double"), F.col("said"))).withColumn("recall", ratio(F.col("hit").cast("double"), F.col("support")))
    return t.select("class", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def report_with_averages(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The report with rows for accuracy, macro avg and weighted avg."""
    r = class_report(df, actual, predicted)
    held = r.where("support > 0 OR precision > 0")
    macro = held.agg(F.lit("macro avg").alias("class"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    weigh = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
    weighted = r.agg(F.lit("weighted avg").alias("class"), *(weigh(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    acc = accuracy(df, actual, predicted).crossJoin(r.agg(F.sum("support").alias("support")))
    acc = acc.select(F.lit("accuracy").alias("class"), *(F.col("accuracy").alias(c) for c in ("precision", "recall", "f1")), "support")
    return r.unionByName(acc).unionByName(macro).unionByName(weighted)


def prediction_distribution(df: DataFrame, predicted: str) -> DataFrame:
    n = df.groupBy(predicted).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(0)))).orderBy(F.desc("n"), predicted)


def same_text(a: Column, b: Column) -> Column:
    """Equality of labels as text."""
    return a.cast("string") == b.cast("string")


def mismatches(df: DataFrame, actual: str, predicted: str, order: list, n: int = 3) -> DataFrame:
    """The first wrong rows."""
    return df.where(~same_text(F.col(predicted), F.col(actual))).orderBy(*order).limit(n)


def label_difference(a: DataFrame, b: DataFrame, label: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """side, label: labels that only one side has."""
    x, y = a.select(F.col(label).cast("string").alias("label")).distinct(), b.select(F.col(label).cast("string").alias("label")).distinct()
    only = lambda p, q, n: p.join(q, "label", "left_anti").select(F.lit(n).alias("side"), "label")
    return only(x, y, names[0]).unionByName(only(y, x, names[1]))


def drift(best: float, now: float, threshold: float = 0.05) -> bool:
    """Whether an accuracy differs from the best one by more than the threshold."""
    return abs(best - now) > threshold
