"""Features of raw items: series, texts and given vectors, by built-in expressions; and the pipeline over them."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .pairbayes import PairModel, class_number, config_for, confusion, fit
from .selection import arithmetic_key, stratified_split
from .stats import array_series_features, dataset_analysis


def text_statistics(text: Column) -> dict[str, Column]:
    """n_chars, n_words, n_lines, n_digits, n_upper, avg_word_length of a text."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    letters = F.length(F.regexp_replace(text, r"\s", ""))
    return {
        "n_chars": F.length(text), "n_words": words, "n_lines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1,
        "n_digits": F.regexp_count(text, F.lit("[0-9]")), "n_upper": F.regexp_count(text, F.lit("[A-Z]")),
        "avg_word_length": F.try_divide(letters.cast("double"), words),
    }


def hashed_terms(text: Column, size: int = 64) -> Column:
    """Shares of the hashed words of a text, as an array: stands in for embeddings that would need a model."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_divide(F.size(F.filter(at, lambda a: a == i)).cast("double"), F.size(words)))


def _series(item: Column) -> Column:
    f = array_series_features(item)
    return F.array(*(f[n] for n in ("mean", "std", "min", "max", "median", "p25", "p75", "mean_diff", "std_diff")))


def _audio(item: Column) -> Column:
    f = array_series_features(item)
    return F.array(*(f[n].cast("double") for n in ("mean", "std", "min", "max", "median", "length")))


def _text(item: Column) -> Column:
    return F.concat(F.array(*(c.cast("double") for c in text_statistics(item).values())), hashed_terms(item))


EXTRACTORS = {"time_series": _series, "audio": _audio, "text": _text, "vector": lambda c: F.transform(c, lambda x: x.cast("double"))}


def extract(df: DataFrame, item: str, kind: str) -> DataFrame:
    """df with features (array) and problem: items that are missing give NULL and say so, never made-up values."""
    if kind not in EXTRACTORS:
        raise ValueError(f"no features of {kind!r} items; there are {', '.join(EXTRACTORS)}")
    c = F.col(item)
    empty = c.isNull() if kind == "text" else c.isNull() | (F.size(c) == 0)
    return df.withColumn("features", F.when(~empty, EXTRACTORS[kind](c))).withColumn("problem", F.when(empty, "no item"))


def run_pipeline(df: DataFrame, key: str, item: str, label: str, kind: str, size: int, **override) -> dict:
    """Features, analysis, split, fit and confusion of items; size: how many features to take."""
    made = extract(df, item, kind).where("features IS NOT NULL")
    names = [f"f{i}" for i in range(size)]
    table = made.select(key, label, *(F.coalesce(F.get("features", i), F.lit(0.0)).alias(n) for i, n in enumerate(names)))
    parts = stratified_split(table, label, arithmetic_key(key, 42), key)
    config = config_for({"vector": "high_dimensional"}.get(kind, kind), **override)
    model: PairModel = fit(parts.where("part = 'train'"), names, label, config)
    scored = model.score(parts.where("part = 'test'").withColumn("k", class_number(F.col(label), model.classes)))
    return {"analysis": dataset_analysis(table, names, label), "model": model, "test": confusion(scored, "k", "predicted", list(range(1, len(model.classes) + 1)))}
