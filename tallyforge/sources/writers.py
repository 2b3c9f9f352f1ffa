"""Writers: tables with metadata, predictions, models, reports, experiments. Everything goes through Spark's writers or
its file system, so remote folders work."""

from __future__ import annotations

import json
import time
from dataclasses import replace

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..operators.adaptive import AdaptiveResult
from ..operators.pairbayes import ModelConfig, PairModel, initialised
from . import fits
from .readers import _fs, exists, read_text, write_text


def export(df: DataFrame, path: str, dataset: str = "", author: str = "tallyforge") -> None:
    """A CSV folder and a side file with AUTHOR, SOFTWARE, CREATED, DATASET; .fits paths of bounded tables as FITS."""
    meta = {"AUTHOR": author, "SOFTWARE": "tallyforge", "CREATED": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "DATASET": dataset}
    spark = df.sparkSession
    if path.endswith((".fits", ".fit")):
        export_fits(df, path, meta)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)
    write_text(spark, path + ".meta.json", json.dumps(meta))


def export_fits(df: DataFrame, path: str, meta: dict, most_rows: int = 1_000_000) -> None:
    """One file is one machine's work, so tables beyond most_rows are refused."""
    rows = df.limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows don't go into one FITS file")
    fs, p = _fs(df.sparkSession, path)
    out = fs.create(p, True)
    out.write(bytearray(fits.table_bytes({c: rows[c].tolist() for c in rows.columns}, meta)))
    out.close()


def feature_table(df: DataFrame, features: list[str], label: str, path: str) -> None:
    """f0, f1, ..., class; feature_0, ... beyond a thousand columns."""
    prefix = "f" if len(features) <= 1000 else "feature_"
    df.select(*(F.col(f"`{c}`").alias(f"{prefix}{i}") for i, c in enumerate(features)), F.col(f"`{label}`").alias("class")).write.mode("overwrite").option("header", True).csv(path)


def train_test(df: DataFrame, part: str, path: str) -> None:
    """Folders train and test from a column that names the part."""
    for name in ("train", "test"):
        df.where(F.col(part) == name).drop(part).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def with_prediction_columns(df: DataFrame, prediction: str, model_type: str, features: list[str]) -> DataFrame:
    """df with Prediction, Model_Type, Model_Features."""
    return df.withColumn("Prediction", F.col(prediction).cast("string")).withColumn("Model_Type", F.lit(model_type)).withColumn("Model_Features", F.lit(", ".join(features)))


def predictions(df: DataFrame, path: str, prediction: str, model_type: str, features: list[str]) -> None:
    with_prediction_columns(df, prediction, model_type, features).write.mode("overwrite").option("header", True).csv(path)


def save_model(model: PairModel, path: str) -> None:
    """Parquet tables net and wts, or packed with many features, and model.json."""
    spark = model.net.sparkSession
    if model.packed is not None:
        model.packed.write.mode("overwrite").parquet(f"{path}/packed")
    else:
        model.net.write.mode("overwrite").parquet(f"{path}/net")
    if model.weights is not None and model.packed is None:
        model.weights.write.mode("overwrite").parquet(f"{path}/wts")
    write_text(spark, f"{path}/model.json", json.dumps(model.describe() | {"weighted": model.weights is not None, "packed": model.packed is not None, "saved": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}, default=str))


def load_model(spark: SparkSession, path: str) -> PairModel:
    if not exists(spark, f"{path}/model.json"):
        raise FileNotFoundError(f"no model in {path}")
    d = json.loads(read_text(spark, f"{path}/model.json"))
    if not d["features"] or not d["classes"]:
        raise ValueError(f"the model in {path} has no features or classes")
    model = initialised(spark, ModelConfig(**d["config"]), d["features"], d["target"], {k: tuple(v) for k, v in d["bins"].items()}, d["classes"])
    model = replace(model, accuracy=d["accuracy"], history=d["history"])
    if d.get("packed"):
        return model.with_packed(spark.read.parquet(f"{path}/packed"))
    return replace(model, net=spark.read.parquet(f"{path}/net"), weights=spark.read.parquet(f"{path}/wts") if d["weighted"] else None)


def save_config(spark: SparkSession, config: dict, data_file: str) -> str:
    """Beside the data: <base>_adaptive_config.json."""
    path = config_path(data_file)
    write_text(spark, path, json.dumps(config, indent=1))
    return path


def load_config(spark: SparkSession, data_file: str) -> dict:
    path = config_path(data_file)
    return json.loads(read_text(spark, path)) if exists(spark, path) else {}


def config_path(data_file: str) -> str:
    return data_file.rsplit(".", 1)[0] + "_adaptive_config.json"


def report(spark: SparkSession, facts: dict, path: str) -> DataFrame:
    """A line a fact, as text, and the same as a DataFrame (key, value)."""
    df = spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "key string, value string")
    write_text(spark, path, "".join(f"{k}: {v}\n" for k, v in facts.items()))
    return df


def finish_run(result: AdaptiveResult, df: DataFrame, key: str, path: str, config: dict | None = None) -> dict:
    """Writes an adaptive run into one folder and returns its figures over df: model, selection (the keys it was trained
    on), rounds, report and confusion_matrix as CSV, config.json and report.txt."""
    spark = df.sparkSession
    found = result.evaluate(df, key)
    save_model(result.model, f"{path}/model")
    result.selection.select(key).write.mode("overwrite").parquet(f"{path}/selection")
    for name in ("rounds", "report", "confusion_matrix"):
        found[name].write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    write_text(spark, f"{path}/config.json", json.dumps(config or {}, indent=1, default=str))
    report(spark, result.facts | {"accuracy": found["accuracy"]}, f"{path}/report.txt")
    return found


def save_experiment(spark: SparkSession, record: dict, path: str) -> None:
    write_text(spark, path, json.dumps(record, default=str))


def load_experiment(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))
