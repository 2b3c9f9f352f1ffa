"""Target-distribution importance resampling over hashed n-grams.

A text's words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased) give its features: all runs of 1 to n words,
joined by one space, repeats counted. A feature's bucket is its crc32 modulo `buckets`. Array functions make each text's
bucket array once; it is kept as a table, since counting and scoring both need it. Counting sends partial totals of the
buckets, never features. Scoring explodes nothing: it adds up the entries of one literal array of `buckets` gains.

A bucket's gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), with s of S features of the source in the bucket, t of T of
the target and B buckets. A text's weight is the sum of its features' gains; its score adds Gumbel noise that depends on
the seed and doc_id only, so the texts with the highest scores are a sample without replacement by exp(weight / 1000).

Defined cases: null and empty texts, and texts without words, have no features and weight 0; they are scored, but not
drawn as long as least_words is positive; very long texts are taken whole; a null doc_id has the noise of an empty one
and comes last among equal scores; repeated rows count, are scored and ranked each; equal scores go to the smaller
doc_id, and rows that share both to any of them; an empty target has equal gains for all that the source lacks; an empty
source gives no rows; other columns are ignored by score() and kept by draw().
"""

from __future__ import annotations

import math

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..operators.ranks import held_before
from .common import ascii_lower, fresh, materialize, small

#: What parts words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP), "")


def _following(grams: Column, w: Column, k: int) -> Column:
    """From the runs of k - 1 words those of k."""
    left = F.greatest(F.size(w) - (k - 1), F.lit(0))
    return F.zip_with(F.slice(grams, 1, left), F.slice(w, k, left), lambda a, b: F.concat(a, F.lit(" "), b))


def bucket_array(w: Column, n: int, buckets: int) -> Column:
    """The buckets of all runs of 1 to n words of an array of words."""

    def of(grams: Column) -> Column:
        return F.transform(grams, lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int"))

    def longer(grams: Column, k: int) -> Column:
        here = of(grams)
        return here if k > n else F.concat(here, _bound(_following(grams, w, k), lambda g: longer(g, k + 1)))

    return longer(w, 2)


def bucketed(docs: DataFrame, n: int = 3, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, buckets (an array) for each row of docs."""
    made = _bound(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), bucket_array(w, n, buckets).alias("buckets")))
    return docs.select("doc_id", made.alias("m")).select("doc_id", "m.*")


def totals(made: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has; as many numbers as buckets reach the driver."""
    out = np.zeros(buckets, np.int64)
    for r in made.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Integer log ratio of target to source, of each bucket, smoothed by one feature a bucket."""
    more, less = float(source.sum() + len(source)), float(target.sum() + len(target))
    return [math.floor(1000 * math.log((t + 1) * more / ((s + 1) * less))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandfold Gumbel noise of a document, from the first 32 bits of a hash."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def score(docs: DataFrame, target: DataFrame, n: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_features, weight, score; target needs a column text."""
    made = materialize(bucketed(docs, n, buckets), "buckets")
    aims = bucketed(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets)
    gain = F.lit(np.array(gains(totals(made, buckets), totals(aims, buckets)), np.int64))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b + 1))
    made = made.select("doc_id", F.col("n_words").cast("long"), F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return made.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, **options) -> DataFrame:
    """score()'s rows with rank: 1, 2, 3, ... by falling score for the drawn ones, null for the others.

    Drawn are percent of a hundred of the rows with at least least_words words, rounded down. Rows are placed by ranges of
    the order, so no task holds them all."""
    scored = materialize(score(docs, target, **options), "scores")
    most = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    out = F.col("n_words") < least_words
    placed = held_before(scored, [], [out, F.col("score").desc(), F.col("doc_id").asc_nulls_last()], name="before")
    return placed.withColumn("rank", F.when(~out & (F.col("before") < most), F.col("before") + 1)).drop("before")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, with all their columns; rows that share a doc_id are drawn together."""
    (key,) = fresh(docs.columns, "drawn_id")
    drawn = materialize(ranked(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias(key)).distinct(), "drawn")
    return docs.join(small(drawn), docs["doc_id"].eqNullSafe(F.col(key)), "left_semi")
