"""Values that used to end jobs, poison bounds or lose rows: NaN, infinities, large whole numbers, rows like the header."""

import math

import pyspark.sql.functions as F
import pytest

from tallyforge.functions import expr, features
from tallyforge.operators import adaptive, pairbayes, stats
from tallyforge.sources import readers

from .conftest import rows_of

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(0, 1.0, "a"), (1, 3.0, "b"), (2, NAN, "a"), (3, None, "b"), (4, INF, "a"), (5, -INF, "b"), (6, 2.0, "a")]
    return spark.createDataFrame(rows, "id int, x double, y string")


def test_bounds_are_of_finite_values(gaps):
    assert pairbayes.feature_bins(gaps, ["x"], 4) == {"x": (1.0, 3.0)}
    assert pairbayes.feature_bins(gaps.where("id = 2"), ["x"], 4, {"x": (0.0, 5.0)}) == {"x": (0.0, 5.0)}
    got = {r.id: r.b0 for r in pairbayes.binned(gaps, {"x": (1.0, 3.0)}, 4).collect()}
    assert got == {0: 0, 1: 4, 2: 0, 3: 0, 4: 4, 5: 0, 6: 2}
    assert {c: "norm_x" in features.normalize(gaps, [c]).columns for c in ("x",)} == {"x": True}
    none = gaps.where("id IN (2, 3)")
    assert pairbayes.feature_bins(none, ["x"], 4) == {"x": (None, None)} and {r.b0 for r in pairbayes.binned(none, {"x": (None, None)}, 4).collect()} == {0}


def test_histogram_leaves_out_what_is_not_finite(gaps):
    got = rows_of(stats.histogram(gaps, "x", "y", 2).select("y", "bucket", "n"))
    assert got == sorted([(0, 1, "a"), (1, 1, "a"), (1, 1, "b")])


def test_whole_numbers_do_not_overflow(spark):
    df = spark.createDataFrame([(100_000, 2**31 - 1), (-5, 7)], "a int, b int")
    assert [r[0] for r in features.interactions(df, ["a", "b"]).select("a_x_b").collect()] == [100_000.0 * (2**31 - 1), -35.0]
    assert [r.z for r in expr.derive(df, "z", "a * b * b + b - -a").collect()] == [100_000.0 * (2**31 - 1) ** 2 + 2**31 - 1 + 100_000, -5 * 49 + 7 - 5]
    assert expr.derive(df, "z", "b + b").select("z").first()[0] == 2.0**32 - 2


@pytest.mark.parametrize(
    ("kind", "labels", "want"),
    [
        ("long", [2**31, 5, None, 2**40], [1, 2, 0]), ("long", [2**31 - 1, -(2**31) + 1, 0], [2**31 - 1, -(2**31) + 1, 0]),
        ("double", [1.0, NAN, 2.0], [1, 2]), ("double", [1.0, INF], [0, 1]), ("string", ["3000000000", "1", None], [1, 0]), ("string", ["7", "1.0"], [7, 1]), ("boolean", [True, False], [1, 0]),
    ],
)
def test_labels_of_any_size(spark, kind, labels, want):
    df = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], f"id int, y {kind}")
    assert [r.y for r in features.encode_target(df, "y").orderBy("id").collect()] == want


def test_rows_like_the_header_stay(spark, tmp_path):
    for name, lines in (("one", ["", "a b", "1 2", "a b", "3 4", "", "a b"]), ("two", ["a b", "a b", '"5 6'])):
        (tmp_path / "d.dat").mkdir(exist_ok=True)
        (tmp_path / "d.dat" / f"{name}.dat").write_text("\n".join(lines) + "\n")
    got = readers.load(spark, str(tmp_path / "d.dat"))
    assert got.columns == ["a", "b"]
    assert sorted(map(tuple, got.collect())) == sorted([("1", "2"), ("a", "b"), ("3", "4"), ("a", "b"), ("a", "b"), ('"5', "6")])


def test_matrices_hold_numbers(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2 x\n3 4 y\n")
    with pytest.raises(ValueError, match="isn't a matrix of numbers"):
        readers.matrix(spark, str(tmp_path / "m.txt"))
    (tmp_path / "n.txt").write_text("1,2,3\n3,4,5\n")
    assert rows_of(readers.matrix(spark, str(tmp_path / "n.txt"))) == [(1.0, 2.0, 3.0), (3.0, 4.0, 5.0)]


def test_defaults_of_the_loop():
    c = adaptive.AdaptiveConfig()
    assert (c.initial_samples_per_class, c.max_adaptive_rounds, c.patience, c.min_improvement, c.max_margin_samples_per_class) == (10, 10, 3, 1e-7, 3)
    assert (c.min_training_accuracy, c.max_samples_per_class_fallback, c.enable_acid_test) == (0.95, 2, True)


def test_gains_are_percent_points(spark):
    df = spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z"), (F.col("id") % 2).alias("y"))
    run = lambda least: adaptive.learn_from_all_wrong(df, "id", ["x", "z"], "y", pairbayes.ModelConfig(resol=3, max_epochs=0), adaptive.AdaptiveConfig(initial_samples_per_class=3, max_adaptive_rounds=6, patience=2, min_improvement=least, min_training_accuracy=1.1)).rounds.count()
    # no gain is 101 percent points, so patience ends the loop after two rounds
    assert run(101.0) == 2 < run(1.0)


def test_exact_percentiles_of_groups(spark):
    import numpy as np

    values = [("a", float(i * i % 17)) for i in range(35)] + [("b", 2.0)] * 9 + [("b", -1.0), ("b", None), ("c", None), (None, 4.0), (None, 5.0)]
    got = {r.g: r for r in stats.group_quantiles(spark.createDataFrame(values, "g string, v double").repartition(3), "g", "v", {"lo": 0.1, "mid": 0.5}).collect()}
    for g in ("a", "b", None):
        held = [v for h, v in values if h == g and v is not None]
        assert (got[g].lo, got[g].mid) == pytest.approx(tuple(np.quantile(held, [0.1, 0.5])))
    assert set(got) == {"a", "b", None} and not math.isnan(got["a"].lo)
