"""The pairwise model against a counter in plain Python, and its invariants."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyspark.sql.functions as F
import pytest

from tallyforge import session
from tallyforge.operators import adaptive, metrics, pairbayes, ranks, selection, stats
from tallyforge.sources import writers

FEATURES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        c = rng.choice("abc")
        rows.append((i, rng.gauss("abc".index(c), 0.7), rng.random() * 4, float(rng.randrange(3)), c))
    return rows, spark.createDataFrame(rows, "id int, x double, y double, z double, label string").cache()


def plain(rows, resol):
    lo, hi = [min(r[i] for r in rows) for i in (1, 2, 3)], [max(r[i] for r in rows) for i in (1, 2, 3)]
    bins = {r[0]: [int(min(resol, max(0, math.floor((r[i + 1] - lo[i]) / (hi[i] - lo[i]) * resol + 0.5)))) for i in range(3)] for r in rows}
    net = Counter((i, bins[r[0]][i], j, bins[r[0]][j], "abc".index(r[4]) + 1) for r in rows for i, j in combinations(range(3), 2))
    scores = {}
    for r in rows:
        scores[r[0]] = []
        for k in (1, 2, 3):
            s = 0.0
            for i, j in combinations(range(3), 2):
                cell = (i, bins[r[0]][i], j, bins[r[0]][j])
                s += math.log((net[*cell, k] + 1) / (sum(net[*cell, q] for q in (1, 2, 3)) + 3))
            scores[r[0]].append(s)
    return net, scores


def test_counts_and_scores(data):
    rows, df = data
    net, scores = plain(rows, 8)
    model = pairbayes.fit(df, FEATURES, "label", pairbayes.ModelConfig(resol=8, max_epochs=0))
    assert {tuple(r)[:5]: r.cnt for r in model.net.collect()} == dict(net)
    got = {r.id: r.scores for r in model.score(df).collect()}
    assert all(got[i] == pytest.approx(s) for i, s in scores.items())
    joined = pairbayes.add_scores(pairbayes.binned(df, model.bins, 8), 3, pairbayes.cell_scores(model.net, 3), 3)
    assert {r.id: r.scores for r in joined.collect()}[5] == pytest.approx(scores[5])


@pytest.mark.parametrize("most", [0, pairbayes.BROADCAST_BYTES])
def test_scores_do_not_depend_on_broadcasts(data, monkeypatch, most):
    _, df = data
    model = pairbayes.fit(df, FEATURES, "label", pairbayes.ModelConfig(resol=8, max_epochs=0))
    want = {r.id: r.scores for r in model.score(df).collect()}
    monkeypatch.setattr(pairbayes, "BROADCAST_BYTES", most)
    assert {r.id: pytest.approx(r.scores) for r in model.score(df).collect()} == want


def test_counts_add_up(data):
    _, df = data
    model = pairbayes.fit(df, FEATURES, "label", pairbayes.ModelConfig(resol=5, max_epochs=0))
    assert [r[0] for r in model.net.groupBy("i", "l").agg(F.sum("cnt")).select("sum(cnt)").collect()] == [60] * 3
    halves = [pairbayes.pair_counts(pairbayes.binned(df.where(f"id % 2 = {k}").withColumn("k", pairbayes.class_number(F.col("label"), model.classes)), model.bins, 5), 3, F.col("k")) for k in (0, 1)]
    assert sorted(map(tuple, pairbayes.merge_counts(*halves).collect())) == sorted(map(tuple, model.net.collect()))


@pytest.mark.parametrize("parts", [1, 5])
def test_boosting_keeps_the_best(data, parts):
    _, df = data
    plain_model = pairbayes.fit(df, FEATURES, "label", pairbayes.ModelConfig(resol=6, max_epochs=0))
    model = pairbayes.fit(df.repartition(parts), FEATURES, "label", pairbayes.ModelConfig(resol=6, max_epochs=4, patience=2))
    assert model.accuracy >= plain_model.accuracy and model.accuracy == max(h["accuracy"] for h in model.history)
    p = model.score(df).select(pairbayes.posteriors(F.col("scores")).alias("p")).collect()
    assert all(sum(r.p) == pytest.approx(1) for r in p)


def test_unseen_rows_and_missing_columns(spark, data):
    _, df = data
    model = pairbayes.fit(df, FEATURES, "label", pairbayes.ModelConfig(resol=6, max_epochs=0))
    far = spark.createDataFrame([(9.0, 99.0, -50.0, 1)], "z double, y double, x double, id int")
    assert model.transform(far).select("Prediction").first()[0] in "abc"
    with pytest.raises(ValueError, match="features not found: z"):
        model.transform(far.drop("z"))


def test_ties_and_constant_features(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, "b"), (2, 1.0, 1.0, "a")], "id int, x double, y double, label string")
    model = pairbayes.fit(df, ["x", "y"], "label", pairbayes.ModelConfig(resol=4, max_epochs=0))
    assert [r.predicted for r in model.score(df).collect()] == [1, 1]
    one = pairbayes.fit(df.where("id = 1"), ["x", "y"], "label", pairbayes.ModelConfig(resol=4))
    assert one.accuracy == 1
    assert pairbayes.fit(df.where("false"), ["x", "y"], "label", pairbayes.ModelConfig(resol=4)).classes == []


def test_round_trip(spark, data, tmp_path):
    _, df = data
    model = pairbayes.fit(df, FEATURES, "label", pairbayes.ModelConfig(resol=6, max_epochs=2))
    writers.save_model(model, str(tmp_path / "m"))
    again = writers.load_model(spark, str(tmp_path / "m"))
    pick = lambda m: sorted(tuple(r) for r in m.transform(df).select("id", "Prediction", F.round("Confidence", 9)).collect())
    assert pick(again) == pick(model) and again.bins == model.bins
    with pytest.raises(FileNotFoundError):
        writers.load_model(spark, str(tmp_path / "none"))


def test_adaptive_loop(data):
    _, df = data
    found = adaptive.learn(df, "id", FEATURES, "label", pairbayes.ModelConfig(resol=6, max_epochs=1), adaptive.AdaptiveConfig(initial_samples_per_class=2, max_adaptive_rounds=3))
    rounds = found.rounds.orderBy("round").collect()
    sizes = [r.training_size for r in rounds]
    assert sizes[0] == 6 and sizes == sorted(sizes)
    assert found.best_accuracy == max(r.test_accuracy for r in rounds)
    assert selection.selected(df, found.selection, "id").count() + selection.remaining(df, found.selection, "id").count() == 60
    done = found.evaluate(df, "id")
    total = {(r.actual, r.predicted): r.n for r in done["confusion_matrix"].collect()}
    assert sum(total.values()) == 60 and done["accuracy"] == pytest.approx(sum(total[k, k] for k in (1, 2, 3)) / 60)
    assert len(total) == 9
    assert all(1 / 3 <= r.mean_confidence <= 1 for r in rounds)


@pytest.mark.parametrize("loop", [adaptive.learn, adaptive.learn_from_all_wrong])
def test_loops_score_in_all_tasks(spark, data, monkeypatch, loop):
    """A small file is read in one part; its rows are scored in as many tasks as there are cores, and rounds read no more parts."""
    _, df = data
    parts, score = [], pairbayes.PairModel.score
    held = lambda m, d: parts.append((d.count(), d.select(F.spark_partition_id()).distinct().count())) or score(m, d)
    monkeypatch.setattr(pairbayes.PairModel, "score", held)
    monkeypatch.setattr(session, "TASK_ROWS", 5, raising=False)
    config = adaptive.AdaptiveConfig(initial_samples_per_class=2, max_adaptive_rounds=2)
    log = lambda d: loop(d, "id", FEATURES, "label", pairbayes.ModelConfig(resol=6, max_epochs=1), config).rounds.orderBy("round").collect()
    one = log(df.coalesce(1))
    assert {p for n, p in parts if n == 60} == {spark.sparkContext.defaultParallelism}
    for a, b in zip(one, log(df.repartition(9)), strict=True):
        assert all(x == (pytest.approx(y) if isinstance(y, float) else y) for x, y in zip(a, b, strict=True))
    monkeypatch.setattr(adaptive, "SELECTED_ROWS", 0)
    assert [r[:7] for r in log(df)] == [r[:7] for r in one]


def test_best_class_and_probabilities(spark):
    rows = [[-2.0, -1.0, -1.0 + 4e-10], [-1.0, -1.0 + 3e-9, -4.0], [-7.0] * 4, [-1e12, -1e12 + 1], [-3.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s array<double>")
    s = F.col("s")
    for r in df.select("i", pairbayes.best_class(s).alias("k"), pairbayes.posteriors(s).alias("p"), pairbayes.confidence(s).alias("c")).collect():
        e = np.exp(np.array(rows[r.i]) - max(rows[r.i]))
        assert r.k == [2, 2, 1, 2, 1][r.i] and r.p == pytest.approx((e / e.sum()).tolist()) and r.c == max(r.p)
    assert spark.range(1).select(pairbayes.best_class(F.array().cast("array<double>"))).first()[0] is None


def test_finished_run(spark, data, tmp_path):
    _, df = data
    found = adaptive.learn(df, "id", FEATURES, "label", pairbayes.ModelConfig(resol=6, max_epochs=1), adaptive.AdaptiveConfig(initial_samples_per_class=2, max_adaptive_rounds=2))
    path = str(tmp_path / "run")
    figures = writers.finish_run(found, df, "id", path, {"a": 1})
    assert writers.load_model(spark, f"{path}/model").classes == found.model.classes
    assert {r.id for r in spark.read.parquet(f"{path}/selection").collect()} == {r.id for r in found.selection.collect()}
    assert spark.read.option("header", True).csv(f"{path}/rounds").count() == found.facts["rounds"]
    assert spark.read.option("header", True).csv(f"{path}/report").where("class = 'macro avg'").count() == 1
    assert f"accuracy: {figures['accuracy']}" in "".join(r.value + "\n" for r in spark.read.text(f"{path}/report.txt").collect())
    assert writers.load_experiment(spark, f"{path}/config.json") == {"a": 1}


def test_places_in_order(spark):
    rows = [(None if i % 5 == 0 else i % 3, i * 37 % 11, i) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, x int, id int")
    got = {r.id: (r.before, r.held) for r in ranks.held_before(ranks.held_before(df, ["g"], [F.col("x"), F.col("id")], name="before"), [], [F.col("x"), F.col("id")], F.col("id"), "held").collect()}
    for g, x, i in rows:
        assert got[i] == (sum(h == g and (y, j) < (x, i) for h, y, j in rows), sum(j for _, y, j in rows if (y, j) < (x, i)))
    assert ranks.held_before(df.where("false"), ["g"], [F.col("x")]).count() == 0


def test_exact_percentiles(spark):
    values = [3.0] * 40 + [float(i * i % 17) for i in range(35)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert list(stats.quantiles(df, "v", at).first()) == pytest.approx(np.quantile(values, at).tolist())
    assert list(stats.quantiles(df.where("v IS NULL"), "v", [0.5]).first()) == [None]


def test_loop_over_all_wrong_rows(data):
    _, df = data
    model = pairbayes.ModelConfig(resol=6, max_epochs=1)
    run = lambda **c: adaptive.learn_from_all_wrong(df, "id", FEATURES, "label", model, adaptive.AdaptiveConfig(initial_samples_per_class=2, max_adaptive_rounds=4, **c), told.append)
    told: list = []
    found = run(min_training_accuracy=1.1)
    rounds = found.rounds.orderBy("round").collect()
    assert [r.asDict() for r in rounds] == told and len(rounds) == 4 and found.best_round == 4
    sizes = [r.training_size for r in rounds]
    assert sizes[0] == 6 and all(b == a + r.new_samples for a, b, r in zip(sizes, sizes[1:], rounds, strict=False)) and all(0 <= r.new_samples <= 6 for r in rounds)
    last = {r.id for r in found.selections.where("round = 4").collect()}
    assert {r.id for r in found.selection.collect()} == last and len(last) == sizes[-1] == found.facts["training_size"]
    scored = selection.selected(found.model.transform(df), found.selection, "id").collect()
    assert found.best_accuracy == pytest.approx(sum(r.Prediction == r.label for r in scored) / len(scored)) == rounds[-1].train_accuracy
    early = run(min_training_accuracy=0.0)
    assert early.rounds.count() == early.best_round == 1 and early.selections.count() == early.selection.count() == 6


def test_adaptive_config():
    c = {"adaptive": {"patience": 3, "seed": 1}, "adaptive_learning": {"seed": 2}, "max_adaptive_rounds": 7}
    got = adaptive.adaptive_config(c)
    assert (got.patience, got.seed, got.max_adaptive_rounds) == (3, 2, 7)
    with pytest.warns(UserWarning, match="unknown key"):
        adaptive.adaptive_config({"adaptive": {"no_such": 1}})


def test_modality_defaults():
    assert pairbayes.config_for("text").resol == 60 and pairbayes.config_for("unheard").resol == 40
    assert pairbayes.config_for("audio", resol=9).resol == 9


def test_report_without_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "c")], "y string, p string")
    got = {r["class"]: (r.precision, r.recall, r.support) for r in metrics.class_report(df, "y", "p").collect()}
    assert got == {"a": (0.5, 1.0, 1), "b": (0.0, 0.0, 2), "c": (0.0, 0.0, 0)}
    assert metrics.report_with_averages(df, "y", "p").count() == 6
    assert metrics.drift(0.9, 0.8) and not metrics.drift(0.9, 0.88)
