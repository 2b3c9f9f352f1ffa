"""Readers: by suffix, by probing, by discovery, from memory; and configuration files."""

from __future__ import annotations

import json

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import fits

#: Names tried for a dataset, in this order, before any file that matches *.suffix.
CANDIDATES = ["{name}.fits", "{name}.fit", "{name}.csv", "{name}.data", "data.csv", "data.fits", "train.csv", "train.fits"]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, by Spark's own file system."""
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**({"header": True, "inferSchema": True} | options)).csv(path)


def delimited_text(spark: SparkSession, path: str, pattern: str, header: bool = True) -> DataFrame:
    """Lines split at a pattern; all must have as many fields as the first. Columns that cast are numbers. A header is the
    first line that isn't empty of each file, and left out as such; rows that happen to equal it are rows."""

    def fields(lines: DataFrame) -> DataFrame:
        return lines.select(F.split(F.trim("value"), pattern).alias("f")).where("NOT (size(f) = 1 AND f[0] = '')")

    lines = fields(spark.read.text(path))
    first = lines.first()
    if first is None:
        raise ValueError(f"{path} is empty")
    n = len(first.f)
    if n < 2 or not lines.where(F.size("f") != n).isEmpty():
        raise ValueError(f"{path} has no even columns parted by {pattern!r}")
    names = first.f if header else [f"feature_{i}" for i in range(n - 1)] + ["target"]
    # a line is one field of the CSV reader, which leaves out each file's header by its place
    whole = {"header": True, "sep": "\u0001", "quote": "", "escape": "", "comment": "", "maxCharsPerColumn": -1}
    rows = fields(spark.read.schema("value string").options(**whole).csv(path).where("value IS NOT NULL")) if header else lines
    out = rows.select(*(F.col("f")[i].alias(c) for i, c in enumerate(names)))
    from ..functions.features import number

    bad = out.agg(*(F.count_if(number(F.col(f"`{c}`")).isNull() & (F.col(f"`{c}`") != "")).alias(f"n{i}") for i, c in enumerate(names))).first()
    return out.select(*((number(F.col(f"`{c}`")) if not bad[f"n{i}"] else F.col(f"`{c}`")).alias(c) for i, c in enumerate(names)))


def dat(spark: SparkSession, path: str) -> DataFrame:
    """White space, then commas, then tabs."""
    for pattern in (r"\s+", ",", "\t"):
        try:
            return delimited_text(spark, path, pattern)
        except ValueError:
            continue
    raise ValueError(f"{path} isn't delimited text")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """Numbers without a header: feature_0, feature_1, ..., target."""
    for pattern in (r"\s+", r"\s*,\s*"):
        try:
            df = delimited_text(spark, path, pattern, header=False)
        except ValueError:
            continue
        if all(t == "double" for _, t in df.dtypes):
            return df
    raise ValueError(f"{path} isn't a matrix of numbers")


def probe(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated text, then text with white space."""
    df = csv(spark, path)
    return df if len(df.columns) > 1 else delimited_text(spark, path, r"\s+")


def load(spark: SparkSession, path: str) -> DataFrame:
    """By the suffix of the path; others are probed."""
    name = path.rstrip("/").lower()
    if name.endswith((".fits", ".fit")):
        return fits.read(spark, path)
    if name.endswith(".csv"):
        return csv(spark, path)
    if name.endswith(".dat"):
        return dat(spark, path)
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    return probe(spark, path)


def discover(spark: SparkSession, folder: str, name: str) -> str:
    """The path of a dataset: the candidates in order, else the first file of a known suffix."""
    for c in CANDIDATES:
        if exists(spark, p := f"{folder}/{c.format(name=name)}"):
            return p
    fs, p = _fs(spark, f"{folder}/*.{{fits,fit,csv,data,dat}}")
    if found := sorted(str(s.getPath()) for s in fs.globStatus(p) or []):
        return found[0]
    raise FileNotFoundError(f"no data for {name!r} in {folder}")


def dataset_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the data and configuration files of a folder, each once."""
    fs, p = _fs(spark, f"{folder}/*.{{json,conf,csv,fits,fit,data,dat}}")
    return sorted({s.getPath().getName().rsplit(".", 1)[0] for s in fs.globStatus(p) or []})


def config(spark: SparkSession, folder: str, name: str) -> tuple[dict, list[str]]:
    """The configuration of a dataset, .json before .conf, and warnings of files that couldn't be read; {} if none."""
    warnings = []
    for suffix in ("json", "conf"):
        path = f"{folder}/{name}.{suffix}"
        if exists(spark, path):
            try:
                return json.loads(read_text(spark, path)), warnings
            except ValueError as e:
                warnings.append(f"{path}: {e}")
    return {}, warnings


def config_files(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, f"{folder}/*.{{json,conf}}")
    return sorted(str(s.getPath()) for s in fs.globStatus(p) or [])


def arrays(spark: SparkSession, x, y=None, names: list[str] | None = None) -> DataFrame:
    """In-memory features and labels, with row_id."""
    x = [list(map(float, r)) for r in x]
    names = names or [f"f{i}" for i in range(len(x[0]) if x else 0)]
    rows = [(i, *r, *([y[i]] if y is not None else [])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["row_id", *names, *(["label"] if y is not None else [])])
