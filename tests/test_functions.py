"""Expressions and cleaning on small frames."""

import pytest

from tallyforge.functions import features
from tallyforge.functions.expr import ExpressionError, derive, derive_all


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1, 3.0, 4.0), (2, 0.0, -2.0), (3, None, 5.0)], "id int, a double, b double")


def values(df, name):
    return [r[0] for r in df.orderBy("id").select(name).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("sqrt(a^2 + b**2)", [5.0, 2.0, None]),
        ("a > mean(a)", [True, False, None]),
        ("max(a, b) - min(a, b)", [1.0, 2.0, None]),
        ("log10(a)", [pytest.approx(0.47712125), None, None]),
        ("b / a", [pytest.approx(4 / 3), None, None]),
        ("7 / 2 + b % 3", [4.5, 1.5, 5.5]),
        ("(a > 1) & (b > 1)", [True, False, None]),
        ("-a + abs(b)", [1.0, 2.0, None]),
        ("std(b)", [pytest.approx(3.0912062)] * 3),
        ("1 < a < 4", [True, False, None]),
    ],
)
def test_expressions(numbers, text, want):
    assert values(derive(numbers, "x", text), "x") == want


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "[a]", "no_such + 1", "mean(mean(a))", "lambda: 1", "sqrt(a, b)", "a +", "'x'", "f'{a}'"])
def test_rejected_expressions(numbers, text):
    with pytest.raises(ExpressionError):
        derive(numbers, "x", text)


def test_steps_in_order(numbers):
    df, skipped = derive_all(numbers, [("x", "a + 1"), ("y", "x * 2"), ("z", "gone + 1"), ("w", "y - x")])
    assert values(df, "w") == [4.0, 1.0, None] and len(skipped) == 1 and skipped[0].startswith("z")
    with pytest.raises(ExpressionError):
        derive(numbers, "a", "b", replace=False)


def test_coercion(spark):
    raw = ["1.5", " 2 ", "abc", "", "NaN", "1d", "0x10", None, "N/A", "MISSING", "1e3", "-.5"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, raw string")
    s = features.SENTINEL
    out = df.select("id", features.to_numeric(df, "raw").alias("n"), features.is_missing(df.raw).alias("m"))
    assert values(out, "n") == [1.5, 2.0, s, s, s, s, s, s, s, s, 1000.0, -0.5]
    assert values(out, "m") == [False, False, False, True, True, False, False, True, True, True, False, False]


def test_numbers_with_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 2.0)], "id int, x double")
    assert values(df.select("id", features.to_numeric(df, "x").alias("n")), "n") == [features.SENTINEL, features.SENTINEL, 2.0]


def test_codes_and_targets(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, y string")
    assert values(features.label_encode(df, "y"), "y_code") == [1, 0, None, 1]
    assert values(features.label_encode(df, "y", fill="MISSING"), "y_code") == [2, 1, 0, 2]
    assert [tuple(r) for r in features.encode_target(df, "y").orderBy("id").collect()] == [(1, 1), (2, 0), (4, 1)]
    numbers = spark.createDataFrame([(1, "3"), (2, "4.0")], "id int, y string")
    assert values(features.encode_target(numbers, "y"), "y") == [3, 4]


def test_mostly_numeric_strings(spark):
    df = spark.createDataFrame([(1, "1"), (2, "2"), (3, "x")], "id int, v string")
    assert values(features.encode_mostly_numeric(df, "v"), "v") == [1.0, 2.0, features.SENTINEL]
    words = spark.createDataFrame([(1, "y"), (2, "x"), (3, "1")], "id int, v string")
    assert values(features.encode_mostly_numeric(words, "v"), "v") == [2.0, 1.0, 0.0]
    assert values(features.encode_mostly_numeric(words, "v", sentinel_only=True), "v") == [features.SENTINEL, features.SENTINEL, 1.0]


def test_derived(spark, numbers):
    assert "norm_id" in features.normalize(numbers).columns
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, c double")
    assert "norm_c" not in features.normalize(same, ["c"]).columns and features.constant_columns(same) == ["c"]
    assert "log_b" not in features.log_transform(numbers, ["b"]).columns and "sqrt_a" in features.sqrt_transform(numbers, ["a"]).columns
    assert values(features.row_statistics(numbers, ["id", "b"]), "feature_mean") == [2.5, 0.0, 4.0]
    assert "t_id" in features.apply_template(numbers, "t", "{col} * 2", ["id"]).columns


def test_projection(numbers):
    assert features.project(numbers, target="b").columns == ["id", "a", "b"]
    with pytest.raises(ValueError, match="gone"):
        features.project(numbers, ["gone"])
    assert features.guess_target(numbers) == "b" and features.guess_target(numbers.withColumnRenamed("a", "Label")) == "Label"
    assert features.numeric_columns(numbers) == ["id", "a", "b"]


def test_empty_frames(spark, numbers):
    none = numbers.where("false")
    assert features.normalize(none).count() == 0 and features.prepare(none, "b").count() == 0
    assert features.constant_columns(none) == []
