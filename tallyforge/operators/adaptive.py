"""The adaptive loop: train, score everything, take informative wrong rows, repeat."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, replace
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..session import cut, tasks_for
from .clusters import diverse_per_class
from .metrics import report_with_averages
from .pairbayes import ModelConfig, PairModel, class_number, confidence, confusion, fit, initialise
from .selection import append_selection, hash_key, remaining, sample_per_class, sample_rows, selected


@dataclass(frozen=True)
class AdaptiveConfig:
    """The loop's defaults. min_improvement is in percent points."""

    initial_samples_per_class: int = 10
    max_margin_samples_per_class: int = 3
    max_adaptive_rounds: int = 10
    patience: int = 3
    min_improvement: float = 1e-7
    min_training_accuracy: float = 0.95
    enable_acid_test: bool = True
    max_samples_per_class_fallback: int = 2
    diverse_start: bool = True
    seed: int = 42


def adaptive_config(config: dict) -> AdaptiveConfig:
    """Defaults, then the sections adaptive and adaptive_learning, then keys at the top."""
    known = {f.name for f in fields(AdaptiveConfig)}
    merged: dict = {}
    for section in ("adaptive", "adaptive_learning"):
        for k, v in (config.get(section) or {}).items():
            if k in known:
                merged[k] = v
            else:
                warnings.warn(f"unknown key {section}.{k}", stacklevel=2)
    merged |= {k: v for k, v in config.items() if k in known}
    return AdaptiveConfig(**merged)


@dataclass
class AdaptiveResult:
    model: PairModel
    selection: DataFrame
    rounds: DataFrame
    best_round: int
    best_accuracy: float
    selections: DataFrame
    facts: dict = field(default_factory=dict)

    def evaluate(self, df: DataFrame, key: str) -> dict:
        """accuracy, confusion and report over df, and what the loop did."""
        m = self.model
        scored = m.score(df.withColumn("k", class_number(F.col(f"`{m.target}`"), m.classes)))
        return {
            "accuracy": scored.agg(F.avg((F.col("k") == F.col("predicted")).cast("double"))).first()[0],
            "confusion_matrix": confusion(scored, "k", "predicted", list(range(1, len(m.classes) + 1))),
            "report": report_with_averages(scored, "k", "predicted"),
            "rounds": self.rounds, "samples_added": self.facts["samples_added"],
        }


#: Selections of up to so many rows are broadcast; they have a few rows for each class and round.
SELECTED_ROWS = 300_000
ROUNDS = "round int, training_size long, train_accuracy double, test_accuracy double, new_samples long, improvement double, accuracy_type string, mean_confidence double"


def initial_selection(df: DataFrame, key: str, target: str, features: list[str], config: AdaptiveConfig) -> DataFrame:
    if config.diverse_start:
        rows = df.select(key, target, F.array(*(F.col(f"`{c}`").cast("double") for c in features)).alias("__v"))
        return diverse_per_class(rows, target, key, "__v", config.initial_samples_per_class, config.seed).select(key)
    return sample_per_class(df, target, hash_key(key, config.seed), key, config.initial_samples_per_class).select(key)


def learn(df: DataFrame, key: str, features: list[str], target: str, model_config: ModelConfig | None = None, config: AdaptiveConfig | None = None, on_round: Callable[[dict], None] | None = None) -> AdaptiveResult:
    """Runs the loop on df, whose rows key names. State is a table of selected keys; what each round adds is a sample of
    the wrong rows that aren't selected. The model of the best round is the result, with the rows it was trained on.
    on_round gets each round's row of the log."""
    config, model_config = config or AdaptiveConfig(), model_config or ModelConfig()
    spark = df.sparkSession
    df = _spread(df.select(key, *features, target).where(F.col(target).isNotNull()), key).persist()
    try:
        frame = initialise(df, features, target, model_config)
        rows = df.withColumn("k", class_number(F.col(f"`{target}`"), frame.classes))
        selection = cut(initial_selection(df, key, target, features, config).distinct())
        keys, log, parts, best, waited = selection.count(), [], [], None, 0
        for rnd in range(1, config.max_adaptive_rounds + 1):
            parts.append(selection.withColumn("round", F.lit(rnd)))
            known = _light(selection, keys)
            model = fit(selected(df, known, key), features, target, frame=frame)
            with _judged(model, rows, key) as scored:  # read for figures and for the pool
                judged = scored.join(known.withColumn("__in", F.lit(True)), key, "left")
                right = (F.col("k") == F.col("predicted")).cast("double")
                outside = F.col("__in").isNull()
                size, on_all, on_rest, wrong, sure = judged.agg(F.count_if(~outside), F.avg(right), F.avg(F.when(outside, right)), F.count_if(outside & (F.col("k") != F.col("predicted"))), F.avg("confidence")).first()
                accuracy = on_all if config.enable_acid_test or on_rest is None else on_rest
                improvement = accuracy - (best["accuracy"] if best else 0.0)
                if best is None or improvement > 0:
                    best, waited = {"round": rnd, "accuracy": accuracy, "model": model, "selection": selection}, 0
                else:
                    waited += 1
                stop = accuracy >= 0.9999 or wrong == 0 or waited >= config.patience or rnd == config.max_adaptive_rounds
                added = 0
                if not stop:
                    pool = remaining(scored.where("predicted != k"), known, key)
                    new = sample_rows(pool, key, config.max_margin_samples_per_class * len(frame.classes), config.seed, rnd).select(key)
                    selection = cut(append_selection(selection, new, key))
                    keys = selection.count()
                    added = keys - size
            _note(log, on_round, rnd, size, model.accuracy, accuracy, added, improvement, "acid_test" if config.enable_acid_test else "remaining", sure)
            if stop:
                break
    finally:
        df.unpersist()
    return _result(spark, replace(best["model"], accuracy=best["accuracy"]), best["selection"], log, best["round"], best["accuracy"], parts)


@contextmanager
def _judged(model: PairModel, rows: DataFrame, key: str) -> Iterator[DataFrame]:
    """key, k, predicted, confidence (the predicted class's probability), kept while a round reads it."""
    scored = model.score(rows).select(key, "k", "predicted", confidence(F.col("scores")).alias("confidence")).persist()
    try:
        yield scored
    finally:
        scored.unpersist()


def _spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt by key: scoring costs far more than reading, and a small file is read in few tasks."""
    return df.repartition(tasks_for(df.sparkSession, df.count(), 8 * len(df.columns)), key)


def _light(selection: DataFrame, size: int) -> DataFrame:
    """selection, broadcast up to SELECTED_ROWS, so that the rows that meet it stay where they lie."""
    return F.broadcast(selection) if size <= SELECTED_ROWS else selection


def _note(log: list[tuple], on_round: Callable[[dict], None] | None, *row) -> None:
    log.append(row)
    if on_round:
        on_round(dict(zip((f.split()[0] for f in ROUNDS.split(", ")), row, strict=True)))


def _result(spark, model: PairModel, selection: DataFrame, log: list[tuple], best: int, accuracy: float, parts: list[DataFrame]) -> AdaptiveResult:
    facts = {"best_round": best, "best_accuracy": accuracy, "rounds": len(log), "training_size": log[best - 1][1], "samples_added": sum(r[4] for r in log)}
    return AdaptiveResult(model, selection, spark.createDataFrame(log, ROUNDS), best, accuracy, reduce(DataFrame.unionByName, parts), facts)


def learn_from_all_wrong(df: DataFrame, key: str, features: list[str], target: str, model_config: ModelConfig | None = None, config: AdaptiveConfig | None = None, on_round: Callable[[dict], None] | None = None) -> AdaptiveResult:
    """The plainer loop. A round is judged by the model's accuracy on the rows it was trained on, and ends the loop once
    that reaches min_training_accuracy. Else a sample of all wrong rows, selected ones too, joins the selection, where
    rows that are in it already count once; rounds without a gain of more than min_improvement percent points use up patience. The last round's
    model and selection are the result."""
    config, model_config = config or AdaptiveConfig(), model_config or ModelConfig()
    df = _spread(df.select(key, *features, target).where(F.col(target).isNotNull()), key).persist()
    try:
        frame = initialise(df, features, target, model_config)
        rows = df.withColumn("k", class_number(F.col(f"`{target}`"), frame.classes))
        chosen = cut(initial_selection(df, key, target, features, config).distinct())
        keys, log, parts, top, waited = chosen.count(), [], [], 0.0, 0
        for rnd in range(1, config.max_adaptive_rounds + 1):
            parts.append(chosen.withColumn("round", F.lit(rnd)))
            near = _light(chosen, keys)
            known = selected(rows, near, key)
            model = fit(known.drop("k"), features, target, frame=frame)
            right = (F.col("k") == F.col("predicted")).cast("double")
            with _judged(model, rows, key) as scored:
                size, accuracy = selected(scored, near, key).agg(F.count(F.lit(1)), F.avg(right)).first()
                on_all, wrong, sure = scored.agg(F.avg(right), F.count_if(F.col("k") != F.col("predicted")), F.avg("confidence")).first()
                gain, added = accuracy - top, 0
                done = accuracy >= config.min_training_accuracy
                if not done:
                    if wrong:
                        take = config.max_samples_per_class_fallback * len(frame.classes)
                        new = sample_rows(scored.where("predicted != k"), key, take, config.seed, rnd).select(key)
                        grown = cut(append_selection(chosen, new, key))
                        keys = grown.count()
                        added = keys - size
                    better = wrong and 100 * gain > config.min_improvement
                    top, waited = (accuracy, 0) if better else (top, waited + 1)
                    done = waited >= config.patience or rnd == config.max_adaptive_rounds
            _note(log, on_round, rnd, size, accuracy, on_all, added, gain, "training", sure)
            if done:
                break
            chosen = grown if wrong else chosen
    finally:
        df.unpersist()
    return _result(df.sparkSession, replace(model, accuracy=accuracy), chosen, log, len(log), accuracy, parts)
