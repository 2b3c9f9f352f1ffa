"""Column statistics, profiles and per-round analytics."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.features import finite, numeric_columns
from ..session import cut
from .ranks import held_before


def _unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """keep, feature, value (DOUBLE); rows are widened in place, not shuffled."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns))
    return df.select(*(keep or []), F.explode(cells).alias("c")).select(*(keep or []), "c.*")


def column_statistics(df: DataFrame) -> DataFrame:
    """column, type, min, max, mean, std (sample), missing, unique_values, most_frequent (the least of equals).

    Numeric columns share one pass; of others the counts of values are grouped before they are shuffled.
    """
    numbers = numeric_columns(df)
    others = [c for c in df.columns if c not in numbers]
    parts = []
    if numbers:
        v = _unpivot(df, numbers)
        parts.append(v.groupBy(F.col("feature").alias("column")).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count_if(F.col("value").isNull()).alias("missing")).select("column", F.lit("numeric").alias("type"), "min", "max", "mean", "std", "missing", F.lit(None).cast("long").alias("unique_values"), F.lit(None).cast("string").alias("most_frequent")))
    if others:
        cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in others))
        counts = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = F.max(F.when(F.col("value").isNotNull(), F.col("n")))
        # the least value of the greatest count, without ordering all values
        top = counts.where("value IS NOT NULL").groupBy("column").agg(F.max("n").alias("top"))
        mode = counts.join(F.broadcast(top), "column").where("n = top AND value IS NOT NULL").groupBy("column").agg(F.min("value").alias("most_frequent"))
        seen = counts.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("unique_values"), best.alias("_n"))
        none = lambda n: F.lit(None).cast("double").alias(n)
        parts.append(seen.join(mode, "column", "left").select("column", F.lit("categorical").alias("type"), none("min"), none("max"), none("mean"), none("std"), "missing", "unique_values", "most_frequent"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_info(df: DataFrame) -> DataFrame:
    """column, kind, nunique, missing."""
    numbers = set(numeric_columns(df))
    aggs = [f.alias(f"{n}{i}") for i, c in enumerate(df.columns) for n, f in (("u", F.count_distinct(F.col(f"`{c}`"))), ("m", F.count_if(F.col(f"`{c}`").isNull())))]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit("numeric" if c in numbers else "categorical").alias("kind"), F.col(f"u{i}").alias("nunique"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """label, n, pct, most frequent first."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(0)))).orderBy(F.desc("n"), label)


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """imbalance_ratio: the largest class over the smallest."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.min("n")).alias("imbalance_ratio"))


def dataset_analysis(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: n_samples, n_features, n_classes, min, max, mean_std, constant_features, sparsity, imbalance_ratio."""
    cols = [F.col(f"`{c}`").cast("double") for c in features]
    aggs = [f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_pop))]
    zero = F.lit(0)
    for c in cols:
        zero = zero + F.when(c == 0, 1).otherwise(0)
    held = df.agg(F.count(F.lit(1)).alias("n_samples"), F.sum(zero).alias("zeros"), *aggs)
    k = len(features)
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_classes"), (F.max("n") / F.min("n")).alias("imbalance_ratio"))
    of = lambda n: F.array(*(f"{n}{i}" for i in range(k)))
    mean = F.aggregate(of("sd"), F.lit(0.0), lambda a, b: a + b) / k
    return held.crossJoin(F.broadcast(classes)).select("n_samples", F.lit(k).alias("n_features"), "n_classes", F.array_min(of("lo")).alias("min"), F.array_max(of("hi")).alias("max"), mean.alias("mean_std"), F.size(F.filter(of("sd"), lambda s: s == 0)).alias("constant_features"), (F.col("zeros") / (F.col("n_samples") * k)).alias("sparsity"), "imbalance_ratio")


def matrix_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """rows, columns, min, max, mean over all cells."""
    return _unpivot(df, features).agg((F.count(F.lit(1)) / len(features)).cast("long").alias("rows"), F.lit(len(features)).alias("columns"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def class_separation(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """score: scatter of the classes' means over scatter within classes; 0 for one class or none within.

    Sums come from counts, means and population variances by class: one pass, one row a class and feature.
    """
    by = _unpivot(df, features, [label]).groupBy(label, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    whole = by.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    sums = by.join(F.broadcast(whole), "feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2))).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count_distinct(label).alias("k"))
    return sums.select(F.when((F.col("k") < 2) | (F.col("within") == 0), 0.0).otherwise(F.try_divide("between", "within")).alias("score"))


def feature_importance(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, variance (population), rank."""
    v = _unpivot(df, features).groupBy("feature").agg(F.var_pop("value").alias("variance"))
    return v.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("variance"), "feature")))


def linear_trend(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def bucket_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bucket 0..bins-1; the last is closed."""
    return F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((x - lo) / ((hi - lo) / bins)))).otherwise(0).cast("int")


def histogram(df: DataFrame, value: str, by: str, bins: int = 20) -> DataFrame:
    """by, bucket, n, density: counts of finite values in equal-width buckets of the whole range, as a density within each group."""
    held = df.select(by, finite(F.col(value)).alias("v"))
    ends = held.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    held = held.where("v IS NOT NULL").crossJoin(F.broadcast(ends))
    n = held.groupBy(by, bucket_of(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bucket"), ((F.col("hi") - F.col("lo")) / bins).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(by, "bucket", "n", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(by)) * F.col("width")).alias("density"))


def group_quantiles(df: DataFrame, by: str, value: str, at: dict[str, float]) -> DataFrame:
    """by, and a column for each named percentile of the group, exact, in proportion between the two nearest values.

    Values of a group are placed by ranges after equal ones are counted; a group's rows never meet in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(held_before(counts, [by], [F.col("v")], F.col("n"), "before"))
    whole = placed.groupBy(F.col(by).alias("__of")).agg(F.sum("n").alias("whole"))
    near = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("v")))
    place = lambda q: (F.col("whole") - 1) * F.lit(float(q))
    parts = [f.alias(f"__{p}{i}") for i, q in enumerate(at.values()) for p, f in (("a", near(F.floor(place(q)))), ("b", near(F.ceil(place(q)))), ("c", F.max(place(q) - F.floor(place(q)))))]
    ends = placed.join(whole, F.col(by).eqNullSafe(F.col("__of"))).groupBy(by).agg(*parts)
    return ends.select(by, *((F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * F.col(f"__c{i}")).alias(name) for i, name in enumerate(at)))


def quantiles(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """Exact percentiles p{100 * at}, in proportion between the two nearest values.

    Equal values are counted first and the counts placed by ranges, so no task holds all values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(held_before(counts, [], [F.col("v")], F.col("n"), "before"))
    whole = placed.agg(F.max(F.col("before") + F.col("n")).alias("whole"))
    near = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("v")))
    place = lambda q: (F.col("whole") - 1) * F.lit(float(q))
    parts = [f.alias(f"{n}{i}") for i, q in enumerate(at) for n, f in (("a", near(F.floor(place(q)))), ("b", near(F.ceil(place(q)))), ("c", F.max(place(q) - F.floor(place(q)))))]
    one = placed.crossJoin(F.broadcast(whole)).agg(*parts)
    return one.select(*((F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"c{i}")).alias(f"p{round(q * 100)}") for i, q in enumerate(at)))


# --- rounds --------------------------------------------------------------------------------------------------------


def round_analytics(rounds: DataFrame, order: str, size: str, accuracy: str, patience_min: float = 0.0) -> DataFrame:
    """For each round: new_samples, best_before, improvement, cumulative (sum of improvements), waited (rounds since the
    last strict improvement), growth_pct over the first round. Rounds are one row each, so one window holds them all."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rounds.withColumn("new_samples", F.col(size) - F.coalesce(F.lag(size).over(w), F.lit(0)))
    out = out.withColumn("best_before", F.coalesce(F.max(accuracy).over(before), F.lit(0.0)))
    out = out.withColumn("improvement", F.col(accuracy) - F.col("best_before"))
    better = F.col("improvement") > patience_min
    out = out.withColumn("cumulative", F.sum("improvement").over(upto)).withColumn("island", F.sum(better.cast("int")).over(upto))
    inside = Window.partitionBy("island").orderBy(order)
    out = out.withColumn("waited", F.when(better, 0).otherwise(F.row_number().over(inside) - F.when(F.col("island") > 0, 1).otherwise(0)))
    first = F.first(size).over(upto)
    return out.withColumn("growth_pct", F.try_divide((F.col(size) - first) * 100.0, first)).drop("island")


def best_round(rounds: DataFrame, order: str, accuracy: str) -> DataFrame:
    """The first round of the best accuracy."""
    return rounds.orderBy(F.desc(accuracy), order).limit(1)


def selection_counts(selection: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """round, label, n, proportion of the rows selected by then."""
    n = selection.join(labels.select(key, label), key).groupBy("round", label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy("round")))


def strategic_rounds(rounds: DataFrame, order: str = "round") -> DataFrame:
    """rounds with strategic: the first, even ones to 10, fives to 50, tens beyond."""
    r = F.col(order)
    return rounds.withColumn("strategic", (r == 1) | ((r <= 10) & (r % 2 == 0)) | ((r > 10) & (r <= 50) & (r % 5 == 0)) | ((r > 50) & (r % 10 == 0)))


def key_rounds(rounds: DataFrame, order: str = "round") -> DataFrame:
    """The first, the middle and the last round; all if there are at most five."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    out = rounds.withColumn("__at", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return out.where("__n <= 5 OR __at IN (0, __n div 2, __n - 1)").drop("__at", "__n")


# --- series --------------------------------------------------------------------------------------------------------


def series_features(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """series, mean, std, min, max, median, p25, p75, mean_diff, std_diff (population).

    Exact percentiles come from counts of equal values placed by ranges, not from a series' values in one task."""
    w = Window.partitionBy(series).orderBy(*order)
    steps = df.withColumn("__d", F.col(value) - F.lag(value).over(w))
    plain = steps.groupBy(series).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg("__d").alias("mean_diff"), F.stddev_pop("__d").alias("std_diff"))
    return _with_quantiles(plain, df, series, value, {"median": 0.5, "p25": 0.25, "p75": 0.75}).select(series, "mean", "std", "min", "max", "median", "p25", "p75", "mean_diff", "std_diff")


def handcrafted_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, mean, std (population), min, max, median, length."""
    plain = df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("length"))
    return _with_quantiles(plain, df, by, value, {"median": 0.5}).select(by, "mean", "std", "min", "max", "median", "length")


def _with_quantiles(plain: DataFrame, df: DataFrame, by: str, value: str, at: dict[str, float]) -> DataFrame:
    found = group_quantiles(df, by, value, at).withColumnRenamed(by, "__by")
    return plain.join(found, plain[by].eqNullSafe(F.col("__by")), "left").drop("__by")


def array_series_features(values: Column) -> dict[str, Column]:
    """The series statistics of an array column, row by row."""
    n = F.size(values)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    mean = lambda a: F.try_divide(total(a), F.size(a).cast("double"))
    std = lambda a: F.sqrt(mean(F.transform(a, lambda x: F.pow(x - mean(a), F.lit(2)))))
    ordered = F.sort_array(values)
    diffs = F.when(n > 1, F.zip_with(F.slice(values, 2, n), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a))

    def at(q: float) -> Column:
        where = (n - 1) * q
        low = F.floor(where).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, n - 1))
        return a + (b - a) * (where - low)

    return {"mean": mean(values), "std": std(values), "min": F.array_min(values), "max": F.array_max(values), "median": at(0.5), "p25": at(0.25), "p75": at(0.75), "mean_diff": mean(diffs), "std_diff": std(diffs), "length": n}
