"""Selecting rows: membership, hold-outs, deterministic samples and splits."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .ranks import held_before


def hash_key(row_id: str, seed: int, rnd: int = 0) -> Column:
    """What rows are ordered by where one would draw at random."""
    return F.xxhash64(F.col(row_id), F.lit(seed), F.lit(rnd))


def arithmetic_key(row_id: str, seed: int) -> Column:
    """The same, by arithmetic that any SQL engine has. 7919 and 104729."""
    return (F.col(row_id) * 7919 + seed) % 104729


def selected(df: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in selection."""
    return df.join(selection.select(key), key, "left_semi")


def remaining(df: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't."""
    return df.join(selection.select(key), key, "left_anti")


def append_selection(selection: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return selection.select(key).unionByName(new.select(key)).distinct()


def membership(df: DataFrame, selection: DataFrame, key: str, name: str = "in_training") -> DataFrame:
    """df with a flag for the rows in selection."""
    marked = selection.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def value_holdout(df: DataFrame, train: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Rows of df that stay when each distinct row of train removes the first row equal to it in all columns.

    Duplicates are numbered within their values, so that only the first of them is removed.
    """
    numbered = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*columns).orderBy(*order)))
    gone = train.select(*(F.col(c).alias(f"__{c}") for c in columns)).distinct().withColumn("__first", F.lit(1))
    on = F.col("__rn") == F.col("__first")
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return numbered.join(gone, on, "left_anti").drop("__rn")


def top_by(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows: each task keeps n of its own, these are merged."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int, rnd: int = 0) -> DataFrame:
    """n rows without replacement, the same whatever the partitions."""
    return df.orderBy(hash_key(row_id, seed, rnd), row_id).limit(n)


def sample_per_class(df: DataFrame, label: str, key: Column, row_id: str, n: int) -> DataFrame:
    """Up to n rows of each class."""
    w = Window.partitionBy(label).orderBy(key, row_id)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def weighted_sample(df: DataFrame, by: str, weight: Column, row_id: str, n: int, seed: int, draw: Column | None = None) -> DataFrame:
    """Up to n rows of each class without replacement, with chances by weight: the least of -ln(u) / weight. draw, between
    0 and 1, stands for u; without it u comes from a hash of row_id."""
    u = (F.pmod(hash_key(row_id, seed), F.lit(2**52)).cast("double") + 0.5) / F.lit(float(2**52)) if draw is None else draw
    keyed = df.withColumn("__race", -F.ln(u) / weight)
    w = Window.partitionBy(by).orderBy("__race", row_id)
    return keyed.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn", "__race")


def stratified_split(df: DataFrame, label: str, key: Column, row_id: str, test: float = 0.2) -> DataFrame:
    """df with part: of each class the last round(test * n) rows in key order are test, at least one row in all.

    Classes of one row are all train, unless nothing else would be test. A class may lie in many tasks."""
    sizes = df.groupBy(F.col(label).alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    out = held_before(df, [label], [key, F.col(row_id)])
    out = out.join(sizes, F.col(label).eqNullSafe(F.col("__of"))).drop("__of")
    out = out.withColumn("part", F.when(F.col("__before") >= F.col("__n") - F.round(F.col("__n") * test), "test").otherwise("train"))
    last = df.select(row_id, key.alias("__key")).orderBy(F.desc("__key"), F.desc(row_id)).limit(1).select(F.col(row_id).alias("__last"))
    none = out.agg(F.count_if(F.col("part") == "test").alias("__tests"))
    out = out.crossJoin(F.broadcast(none)).join(F.broadcast(last), F.col(row_id) == F.col("__last"), "left")
    moved = (F.col("__tests") == 0) & F.col("__last").isNotNull()
    return out.withColumn("part", F.when(moved, "test").otherwise(F.col("part"))).drop("__before", "__n", "__tests", "__last")


def misclassified(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    return scored.where(F.col(predicted) != F.col(actual))


def margins(scored: DataFrame) -> DataFrame:
    """Wrong rows with margin: probability of the predicted class less that of the true one. scored has probabilities
    (array), k and predicted."""
    p = lambda c: F.element_at("probabilities", F.col(c))
    return scored.where("predicted != k").withColumn("margin", p("predicted") - p("k"))


def divergent(wrong: DataFrame, label: str, row_id: str, n: int, most: bool = False) -> DataFrame:
    """Up to n wrong rows of each class with the least margins, or the greatest."""
    first = F.round("margin", 9)
    w = Window.partitionBy(label).orderBy(first.desc() if most else first, row_id)
    return wrong.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def extreme_margins(wrong: DataFrame, label: str, row_id: str, n: int) -> DataFrame:
    """The wrong rows of least and of greatest margin of each class, each once."""
    first = F.round("margin", 9)
    low, high = Window.partitionBy(label).orderBy(first, row_id), Window.partitionBy(label).orderBy(first.desc(), row_id)
    out = wrong.withColumn("__lo", F.row_number().over(low)).withColumn("__hi", F.row_number().over(high))
    return out.where((F.col("__lo") <= n) | (F.col("__hi") <= n)).drop("__lo", "__hi")


def divergence(p: Column, q: Column, kind: str = "kl") -> Column:
    """Kullback-Leibler or Jensen-Shannon divergence of two arrays of probabilities."""
    def kl(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), x * F.ln(x / y)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)

    if kind == "kl":
        return kl(p, q)
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (kl(p, m) + kl(q, m)) / 2
