"""Projection, cleaning and derived features."""

from __future__ import annotations

from itertools import combinations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ..operators.ranks import held_before

#: What stands for missing data, the value put in its place, and names of a target column.
MISSING = ["", "NA", "N/A", "null", "NULL", "None", "NaN", "nan", "ERROR", "error", "MISSING", "missing"]
SENTINEL = -99999.0
TARGET_NAMES = ["target", "class", "label", "y", "output", "result"]

#: What may be cast to a number; Spark alone would also take 1d and Infinity.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType | BooleanType)]


def guess_target(df: DataFrame) -> str:
    """The first of the usual names, else the last column."""
    by_name = {c.lower(): c for c in df.columns}
    return next((by_name[n] for n in TARGET_NAMES if n in by_name), df.columns[-1])


def project(df: DataFrame, features: list[str] | None = None, target: str | None = None) -> DataFrame:
    """Features, all but the target by default, and the target; without one all columns are features."""
    features = features or [c for c in df.columns if c != target]
    wanted = [*features, *([target] if target else [])]
    if gone := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"columns not found: {', '.join(gone)}")
    return df.select(*wanted)


def finite(c: Column) -> Column:
    """A number as DOUBLE; NULL for NaN and the infinities, which bounds and sums must not see."""
    x = c.cast("double")
    return F.when((x > float("-inf")) & (x < float("inf")), x)


def is_missing(c: Column) -> Column:
    return c.isNull() | c.cast("string").isin(MISSING)


def number(c: Column) -> Column:
    """A string as DOUBLE, NULL if it isn't a number."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def to_numeric(df: DataFrame, name: str) -> Column:
    """A column as DOUBLE with the sentinel for what has no number."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, NumericType | BooleanType):
        return F.coalesce(F.nanvl(c.cast("double"), F.lit(SENTINEL)), F.lit(SENTINEL))
    if isinstance(kind, StringType):
        return F.coalesce(F.when(~is_missing(c), number(c)), F.lit(SENTINEL))
    if isinstance(kind, DateType | TimestampType | TimestampNTZType):
        raise ValueError(f"{name}: encode {kind.simpleString()} columns with label_encode()")
    raise ValueError(f"{name}: no number in {kind.simpleString()}")


def codes(df: DataFrame, name: str, fill: str | None = None) -> DataFrame:
    """(value, code): distinct values in sorted order from 0; NULL is left out unless fill stands for it."""
    c = F.col(f"`{name}`").cast("string")
    values = df.select((F.coalesce(c, F.lit(fill)) if fill is not None else c).alias("value")).where("value IS NOT NULL").distinct()
    return held_before(values, [], [F.col("value")], name="code").withColumn("code", F.col("code").cast("int"))


def label_encode(df: DataFrame, name: str, fill: str | None = None) -> DataFrame:
    """df with {name}_code; NULL where the value is NULL and nothing stands for it."""
    c = F.col(f"`{name}`").cast("string")
    book = codes(df, name, fill).select(F.col("value").alias("__value"), F.col("code").alias(f"{name}_code"))
    key = F.coalesce(c, F.lit(fill)) if fill is not None else c
    return df.join(book, key == F.col("__value"), "left").drop("__value")


def encode_mostly_numeric(df: DataFrame, name: str, sentinel_only: bool = False) -> DataFrame:
    """A string column as numbers if at least half of what it holds casts, else as codes."""
    c = F.col(f"`{name}`")
    if not sentinel_only:
        held, cast = df.agg(F.count_if(~is_missing(c)), F.count_if(~is_missing(c) & number(c).isNotNull())).first()
        if held and cast * 2 < held:
            coded = label_encode(df.withColumn(name, F.when(~is_missing(c), c)), name)
            return coded.withColumn(name, F.coalesce(F.col(f"{name}_code").cast("double"), F.lit(SENTINEL))).drop(f"{name}_code")
    return df.withColumn(name, to_numeric(df, name))


def encode_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target, as whole numbers if all of them are numbers that an INT holds, else as codes."""
    c = F.col(f"`{target}`")
    kind = df.schema[target].dataType
    if isinstance(kind, NumericType | BooleanType):
        x = c.cast("double")
        df = df.where(c.isNotNull() & ~F.isnan(x))
    else:
        x = number(c)
        df = df.where(c.isNotNull())
    if df.where(x.isNull() | (F.abs(x) >= 2.0**31)).isEmpty():
        return df.withColumn(target, x.cast("int"))
    return label_encode(df, target).withColumn(target, F.col(f"{target}_code")).drop(f"{target}_code")


def prepare(df: DataFrame, target: str | None = None, features: list[str] | None = None) -> DataFrame:
    """Projection and cleaning for training; without a target the same cleaning for prediction."""
    out = project(df, features, target)
    for name in [c for c in out.columns if c != target]:
        kind = out.schema[name].dataType
        if isinstance(kind, StringType):
            out = encode_mostly_numeric(out, name)
        elif isinstance(kind, NumericType | BooleanType):
            out = out.withColumn(name, to_numeric(out, name))
        else:
            out = label_encode(out, name).withColumn(name, F.coalesce(F.col(f"{name}_code").cast("double"), F.lit(SENTINEL))).drop(f"{name}_code")
    return encode_target(out, target) if target else out


# --- derived features; each takes the columns to use, all numeric ones by default ---------------------------------


def _bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """min and max of the columns' finite values, in one pass; two numbers a column reach the driver."""
    row = df.agg(*(f(finite(F.col(f"`{c}`"))).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(columns)}


def normalize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """norm_{c} in 0..1 for columns that vary."""
    held = _bounds(df, columns or numeric_columns(df))
    return df.withColumns({f"norm_{c}": (F.col(f"`{c}`") - lo) / F.lit(hi - lo) for c, (lo, hi) in held.items() if lo is not None and hi > lo})


def log_transform(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """log_{c}, decimal, for columns of positive values."""
    held = _bounds(df, columns or numeric_columns(df))
    return df.withColumns({f"log_{c}": F.log10(F.col(f"`{c}`")) for c, (lo, _) in held.items() if lo is not None and lo > 0})


def sqrt_transform(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """sqrt_{c} for columns without negative values."""
    held = _bounds(df, columns or numeric_columns(df))
    return df.withColumns({f"sqrt_{c}": F.sqrt(F.col(f"`{c}`")) for c, (lo, _) in held.items() if lo is not None and lo >= 0})


def interactions(df: DataFrame, columns: list[str] | None = None, most: int = 5) -> DataFrame:
    """{a}_x_{b} for the first pairs of columns, as DOUBLE, which whole numbers don't overflow."""
    pairs = list(combinations(columns or numeric_columns(df), 2))[:most]
    return df.withColumns({f"{a}_x_{b}": F.col(f"`{a}`").cast("double") * F.col(f"`{b}`") for a, b in pairs})


def powers(df: DataFrame, columns: list[str] | None = None, most: int = 3) -> DataFrame:
    """{c}_squared and {c}_cubed of the first columns."""
    chosen = (columns or numeric_columns(df))[:most]
    return df.withColumns({f"{c}_{n}": F.pow(F.col(f"`{c}`"), F.lit(k)) for c in chosen for n, k in (("squared", 2), ("cubed", 3))})


def row_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """feature_mean and feature_range over the columns of each row."""
    cols = [F.col(f"`{c}`").cast("double") for c in columns or numeric_columns(df)]
    if len(cols) < 2:
        return df
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return df.withColumn("feature_mean", total / len(cols)).withColumn("feature_range", F.greatest(*cols) - F.least(*cols))


def apply_template(df: DataFrame, suffix: str, template: str, columns: list[str] | None = None) -> DataFrame:
    """{suffix}_{c} from an expression with {col} in it, for columns of positive values."""
    from .expr import derive

    for c, (lo, _) in _bounds(df, columns or numeric_columns(df)).items():
        if lo is not None and lo > 0:
            df = derive(df, f"{suffix}_{c}", template.replace("{col}", c))
    return df


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns whose values don't vary."""
    chosen = columns or numeric_columns(df)
    row = df.agg(*(F.var_pop(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(chosen))).first()
    return [c for i, c in enumerate(chosen) if row[f"v{i}"] == 0]


def matrix_columns(df: DataFrame, array: str, size: int, prefix: str = "feature_") -> DataFrame:
    """The elements of an array column (flattened, if it is nested) as columns of their own."""
    kind = df.schema[array].dataType.elementType.simpleString()
    flat = F.flatten(array) if kind.startswith("array") else F.col(array)
    return df.withColumn("__flat", flat).select(*[c for c in df.columns if c != array], *(F.get("__flat", i).alias(f"{prefix}{i}") for i in range(size)))
