"""Streams: scoring without state, and counts that grow batch by batch.

A stream's rows are scored by the same code as a table's. Counts of micro-batches add up to the counts of all rows, so
training on a stream is a keyed sum without expiry, kept by the state store; late rows count like others. Labels that come
after their predictions, accuracies by window and sessions are given once each, when the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.pairbayes import CELL, PairModel, binned, class_number, pairs_of


def score_stream(stream: DataFrame, model: PairModel) -> DataFrame:
    """The stream with Prediction and Confidence; rows are scored where they lie, whatever the number of features."""
    return model.transform(stream)


def score_batches(stream: DataFrame, model: PairModel, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer of the stream that hands each scored micro-batch to write, as a table: for models of any size."""
    return stream.writeStream.foreachBatch(lambda batch, number: write(model.transform(batch), number))


def count_stream(stream: DataFrame, model: PairModel) -> DataFrame:
    """Running counts (i, bi, l, bl, k, cnt) of a labelled stream; for output modes update and complete."""
    rows = binned(stream, model.bins, model.config.resol).withColumn("k", class_number(F.col(f"`{model.target}`"), model.classes)).where("k IS NOT NULL")
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"b{i}").alias("bi"), F.lit(j).alias("l"), F.col(f"b{j}").alias("bl")) for i, j in pairs_of(model.n)))
    return rows.select("k", F.explode(cells).alias("c")).groupBy(*(F.col(f"c.{c}").alias(c) for c in CELL), "k").agg(F.count(F.lit(1)).alias("cnt"))


def windowed_counts(stream: DataFrame, ts: str, by: list[str | Column], width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts of rows by event-time window; rows later than delay are left out."""
    at = F.col(ts).cast("timestamp")
    held = stream.withColumn(ts, at).withWatermark(ts, delay)
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return held.groupBy(win, *by).agg(F.count(F.lit(1)).alias("n"))


def labelled_later(predictions: DataFrame, labels: DataFrame, key: str, ts: str, label_ts: str, within: str, delay: str) -> DataFrame:
    """Predictions with the labels that come for them later: each prediction with every label of its key whose time lies between
    the prediction's and that time plus `within`, both included; once none can come any more, a prediction without one has nulls.

    Streams for output mode append. Both sides may be late by `delay`; rows later than that are left out once Spark's
    watermark has passed them, which it does a batch or two after. Rows without key or time are left out.
    What waits in the state store are the rows of `within` and `delay`, not the whole stream. Columns of the two sides but the
    key must differ. Repeated rows stay repeated."""
    clean = lambda df, at: df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    said, known = clean(predictions, ts), clean(labels, label_ts).withColumnRenamed(key, "__key")
    soon = (F.col(label_ts) >= F.col(ts)) & (F.col(label_ts) <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return said.join(known, (F.col(key) == F.col("__key")) & soon, "left").drop("__key")


def accuracy_by_window(joined: DataFrame, ts: str, actual: Column, predicted: Column, margin: float, width: str) -> DataFrame:
    """window, n, labelled, correct: predictions by event-time window, those that have a label, and those within margin of it. A
    window is given once, in append mode, when no prediction of it can come any more; follows labelled_later in one stream."""
    right = F.abs(predicted - actual) <= margin
    return joined.groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), F.count(actual).alias("labelled"), F.count_if(right).alias("correct"))


def sessions(stream: DataFrame, ts: str, by: list[str | Column], gap: str, delay: str) -> DataFrame:
    """window, by, n: runs of a group's rows that follow each other by at most gap; the window ends a gap after the last. A
    session is given once, in append mode, when no row of it can come any more; rows later than delay are left out."""
    held = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return held.groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("session_window", "window")
