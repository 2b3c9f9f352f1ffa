"""Registered queries and their SQL. Every query reads its whole tables."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions import expr, features
from ..operators import adaptive, clusters, graph, metrics, modality, pairbayes, selection, stats
from ..session import cut, shared_path
from ..sources import readers, writers
from ..streaming import increments
from .core_sql import with_core

LINE_FEATURES, LINE_LABEL, RESOL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag", 10
LINE_CONFIG = pairbayes.ModelConfig(resol=RESOL, max_epochs=0)
PART_FEATURES, PART_LABEL = ["p_size", "p_retailprice"], "p_type"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run has."""
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def line_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pairbayes.PairModel]:
    """lineitem with class numbers, and the model of its counts without boosting."""
    rows = table(spark, sf_dir, "lineitem").select(*LINE_FEATURES, LINE_LABEL)
    model = pairbayes.initialise(rows, LINE_FEATURES, LINE_LABEL, LINE_CONFIG)
    rows = rows.withColumn("k", pairbayes.class_number(F.col(LINE_LABEL), model.classes))
    model.net = cut(pairbayes.pair_counts(pairbayes.binned(rows, model.bins, RESOL), len(LINE_FEATURES), F.col("k")))
    return rows, model


LINE_CORE = with_core("lineitem", LINE_FEATURES, LINE_LABEL, RESOL)

# --- the model -------------------------------------------------------------------------------------------------------


@query(f"WITH {LINE_CORE} SELECT i, bi, l, bl, k, cnt FROM net")
def pair_counts(spark, sf_dir):
    return line_model(spark, sf_dir)[1].net


@query(f"WITH {LINE_CORE} SELECT a.name AS actual, b.name AS predicted, count(*) AS n FROM pred JOIN classes a ON a.k = y JOIN classes b ON b.k = p GROUP BY ALL")
def pair_score_confusion(spark, sf_dir):
    rows, model = line_model(spark, sf_dir)
    found = pairbayes.confusion(model.score(rows), LINE_LABEL, "predicted")
    name = F.element_at(F.array(*map(F.lit, model.classes)), F.col("predicted"))
    return found.select("actual", name.alias("predicted"), "n")


_GAPS = "g AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice, l_discount, l_returnflag FROM lineitem)"


@query(f"WITH {_GAPS}, {with_core('g', LINE_FEATURES[:3], LINE_LABEL, RESOL)} SELECT i, bi, l, bl, k, cnt FROM net")
def pair_counts_with_gaps(spark, sf_dir):
    """lineitem with NaN and NULL in two features: bounds come from the other values, gaps lie in bin 0."""
    gap = lambda c, n, v: F.when(F.col("l_orderkey") % n == 0, F.lit(v).cast("double")).otherwise(F.col(c).cast("double")).alias(c)
    rows = table(spark, sf_dir, "lineitem").select(gap("l_quantity", 7, float("nan")), gap("l_extendedprice", 5, None), "l_discount", LINE_LABEL)
    return pairbayes.fit(rows, LINE_FEATURES[:3], LINE_LABEL, LINE_CONFIG).net


@query(f"WITH o AS (SELECT o_orderkey, o_totalprice, month(o_orderdate) AS o_month, day(o_orderdate) AS o_day, o_orderstatus FROM orders), {with_core('o', ['o_totalprice', 'o_month', 'o_day'], 'o_orderstatus', 10, 'o_orderkey')} SELECT row_id, k, round(p, 10) AS p FROM post")
def class_posteriors(spark, sf_dir):
    names, label = ["o_totalprice", "o_month", "o_day"], "o_orderstatus"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice", F.month("o_orderdate").alias("o_month"), F.day("o_orderdate").alias("o_day"), label)
    model = pairbayes.fit(rows, names, label, pairbayes.ModelConfig(resol=10, max_epochs=0))
    return pairbayes.long_scores(model.score(rows), ["row_id"], pairbayes.posteriors(F.col("scores"))).select("row_id", "k", F.round("value", 10).alias("p"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in LINE_FEATURES))
def feature_bins(spark, sf_dir):
    bins = pairbayes.feature_bins(table(spark, sf_dir, "lineitem"), LINE_FEATURES, RESOL)
    return spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in bins.items()], "feature string, min double, max double")


PART_GAIN = 2.0


WIDE = [f"x{i}" for i in range(64)]
WIDE_CONFIG = pairbayes.ModelConfig(resol=10, max_epochs=0)
WIDE_CORE = f"e AS (SELECT vec_id, label, {', '.join(f'embedding[{i + 1}] AS {c}' for i, c in enumerate(WIDE))} FROM embeddings), {with_core('e', WIDE, 'label', 10, 'vec_id')}"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with a column for each of their 64 dimensions."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.get("embedding", i).alias(c) for i, c in enumerate(WIDE)))


@query(f"WITH {WIDE_CORE} SELECT i, l, count(*) AS cells, CAST(sum(cnt) AS BIGINT) AS n, max(cnt) AS most, CAST(sum(bi * 1000000 + bl * 1000 + k * cnt) AS BIGINT) AS check_sum FROM net GROUP BY i, l")
def wide_pair_counts(spark, sf_dir):
    """Counts of all pairs of 64 features, each pair summed up."""
    net = pairbayes.fit(_wide(spark, sf_dir), WIDE, "label", WIDE_CONFIG).net
    said = F.sum(F.col("bi") * 1000000 + F.col("bl") * 1000 + F.col("k") * F.col("cnt")).cast("long")
    return net.groupBy("i", "l").agg(F.count(F.lit(1)).alias("cells"), F.sum("cnt").alias("n"), F.max("cnt").alias("most"), said.alias("check_sum"))


@query(f"WITH {WIDE_CORE} SELECT row_id AS vec_id, p AS predicted, round(top, 8) AS confidence FROM pred JOIN (SELECT row_id, max(p) AS top FROM post GROUP BY row_id) USING (row_id)")
def wide_predictions(spark, sf_dir):
    """The class of each row by all 2,016 pairs of features."""
    rows = _wide(spark, sf_dir)
    model = pairbayes.fit(rows, WIDE, "label", WIDE_CONFIG)
    return model.score(rows).select("vec_id", "predicted", F.round(F.array_max(pairbayes.posteriors(F.col("scores"))), 8).alias("confidence"))


@query(f"""WITH {with_core('part', [*PART_FEATURES, 'p_partkey'], PART_LABEL, 10, 'p_partkey')},
wrong AS (SELECT d.row_id, d.y, {PART_GAIN} * (1 - exp(st.s - sp.s)) AS d FROM pred d JOIN score st ON st.row_id = d.row_id AND st.k = d.y JOIN score sp ON sp.row_id = d.row_id AND sp.k = d.p WHERE d.p <> d.y)
SELECT q.i, q.bi, q.l, q.bl, q.y AS k, round(1 + avg(w.d), 6) AS w FROM pairs q JOIN wrong w USING (row_id) GROUP BY q.i, q.bi, q.l, q.bl, q.y""")
def boost_epoch_weights(spark, sf_dir):
    names = [*PART_FEATURES, "p_partkey"]
    rows = table(spark, sf_dir, "part").select(*names, PART_LABEL)
    model = pairbayes.fit(rows, names, PART_LABEL, pairbayes.ModelConfig(resol=10, gain=PART_GAIN, max_epochs=0))
    scored = model.score(rows.withColumn("k", pairbayes.class_number(F.col(PART_LABEL), model.classes)))
    return pairbayes.boost(scored, len(names), None, PART_GAIN).select("i", "bi", "l", "bl", "k", *r6("w"))


@query(f"WITH {LINE_CORE} SELECT round(avg(CASE WHEN abs(p - y) <= 0.2 THEN 100.0 ELSE 0 END), 6) AS accuracy_pct, count(*) FILTER (abs(p - y) <= 0.2) AS correct, count(*) AS total FROM pred")
def tolerance_accuracy(spark, sf_dir):
    rows, model = line_model(spark, sf_dir)
    scored = model.score(rows)
    return metrics.tolerance_accuracy(scored, F.col("k").cast("double"), F.col("predicted").cast("double"), 0.2).select(*r6("accuracy_pct"), "correct", "total")


@query(f"""WITH {LINE_CORE}, t AS (SELECT c.name AS class, count(*) FILTER (y = c.k AND p = c.k) AS hit, count(*) FILTER (y = c.k) AS support, count(*) FILTER (p = c.k) AS said FROM classes c CROSS JOIN pred GROUP BY c.name)
SELECT class, round(coalesce(hit / nullif(said, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall,
       round(coalesce(2.0 * hit / nullif(said + support, 0), 0), 6) AS f1, support FROM t""")
def accuracy_report(spark, sf_dir):
    rows, model = line_model(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, model.classes)), F.col("predicted"))
    r = metrics.class_report(model.score(rows).withColumn("said", name), LINE_LABEL, "said")
    return r.select("class", *r6("precision", "recall", "f1"), "support")


@query(f"WITH {LINE_CORE} SELECT a.name AS actual, b.name AS predicted, count(*) AS n FROM pred JOIN classes a ON a.k = y JOIN classes b ON b.k = p GROUP BY ALL")
def model_roundtrip(spark, sf_dir):
    """The flagship's answer from a model that was written and read again."""
    rows, model = line_model(spark, sf_dir)
    path = own_path(spark, "model-roundtrip")
    writers.save_model(model, path)
    model = writers.load_model(spark, path)
    name = F.element_at(F.array(*map(F.lit, model.classes)), F.col("predicted"))
    return pairbayes.confusion(model.score(rows), LINE_LABEL, "predicted").select("actual", name.alias("predicted"), "n")


@query(f"""WITH {LINE_CORE} SELECT Prediction, Model_Type, Model_Features, count(*) AS n, round(sum(q), 2) AS quantity FROM (
  SELECT b.name AS Prediction, 'pairwise' AS Model_Type, '{', '.join(LINE_FEATURES)}' AS Model_Features, r.x0 AS q FROM pred JOIN r USING (row_id) JOIN classes b ON b.k = p) GROUP BY ALL""")
def predictions_sink(spark, sf_dir):
    """Predictions with their columns as written to and read from CSV, counted."""
    rows, model = line_model(spark, sf_dir)
    path = own_path(spark, "predictions-sink")
    writers.predictions(model.transform(rows), path, "Prediction", "pairwise", LINE_FEATURES)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return back.groupBy("Prediction", "Model_Type", "Model_Features").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *LINE_FEATURES, "l_shipdate", "l_returnflag", "l_linestatus"]
ORDER_FEATURES = ["o_totalprice", "o_month", "o_day"]
ORDER_ROWS = "o AS (SELECT o_orderkey, o_totalprice, month(o_orderdate) AS o_month, day(o_orderdate) AS o_day, o_orderstatus FROM orders)"
ORDER_CORE = f"{ORDER_ROWS}, {with_core('o', ORDER_FEATURES, 'o_orderstatus', 10, 'o_orderkey')}"
ORDER_MARGINS = f"{ORDER_CORE}, m AS (SELECT d.row_id, d.y AS label, d.p AS pred, round(a.p - b.p, 9) AS margin FROM pred d JOIN post a ON a.row_id = d.row_id AND a.k = d.p JOIN post b ON b.row_id = d.row_id AND b.k = d.y WHERE d.p <> d.y)"


def _order_scored(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice", F.month("o_orderdate").alias("o_month"), F.day("o_orderdate").alias("o_day"), "o_orderstatus")
    model = pairbayes.fit(rows, ORDER_FEATURES, "o_orderstatus", pairbayes.ModelConfig(resol=10, max_epochs=0))
    scored = model.score(rows.withColumn("k", pairbayes.class_number(F.col("o_orderstatus"), model.classes)))
    return scored.withColumn("probabilities", pairbayes.posteriors(F.col("scores")))


@query(f"WITH {ORDER_CORE} SELECT row_id, y AS label, p AS pred FROM pred WHERE p <> y ORDER BY (row_id * 7919 + 42) % 104729, row_id LIMIT 50")
def misclassified_sample(spark, sf_dir):
    wrong = selection.misclassified(_order_scored(spark, sf_dir), "k", "predicted")
    top = selection.top_by(wrong, [selection.arithmetic_key("row_id", 42), "row_id"], 50)
    return top.select("row_id", F.col("k").alias("label"), F.col("predicted").alias("pred"))


@query(f"WITH {ORDER_MARGINS} SELECT label, row_id, round(margin, 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY margin, row_id) AS rn FROM m) WHERE rn <= 3")
def divergent_samples(spark, sf_dir):
    wrong = selection.margins(_order_scored(spark, sf_dir))
    return selection.divergent(wrong, "k", "row_id", 3).select(F.col("k").alias("label"), "row_id", *r6("margin"))


@query(f"""WITH {ORDER_MARGINS} SELECT label, row_id, round(margin, 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY margin, row_id) AS lo,
row_number() OVER (PARTITION BY label ORDER BY margin DESC, row_id) AS hi FROM m) WHERE lo <= 2 OR hi <= 2""")
def minmax_margin_samples(spark, sf_dir):
    wrong = selection.margins(_order_scored(spark, sf_dir))
    return selection.extreme_margins(wrong, "k", "row_id", 2).select(F.col("k").alias("label"), "row_id", *r6("margin"))


@query(f"WITH {ORDER_CORE} SELECT row_id, p AS pred, y AS actual FROM pred WHERE p <> y ORDER BY row_id LIMIT 3")
def mismatch_examples(spark, sf_dir):
    return metrics.mismatches(_order_scored(spark, sf_dir), "k", "predicted", ["row_id"], 3).select("row_id", F.col("predicted").alias("pred"), F.col("k").alias("actual"))


@query(f"WITH {ORDER_CORE} SELECT p AS predicted, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS pct FROM pred GROUP BY p")
def prediction_distribution(spark, sf_dir):
    return metrics.prediction_distribution(_order_scored(spark, sf_dir), "predicted").select("predicted", "n", *r6("pct"))


@query()
def adaptive_rounds_log(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.length("p_name").alias("name_length"), PART_LABEL)
    found = adaptive.learn(rows, "p_partkey", ["p_size", "p_retailprice", "name_length"], PART_LABEL, pairbayes.ModelConfig(resol=20, max_epochs=2, patience=1), adaptive.AdaptiveConfig(max_adaptive_rounds=3, patience=2))
    return found.rounds


# --- statistics --------------------------------------------------------------------------------------------------------


def _number_sql(t: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", 'numeric' AS type, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, count(*) FILTER ({c} IS NULL) AS missing, CAST(NULL AS DOUBLE) AS unique_values, CAST(NULL AS VARCHAR) AS most_frequent FROM {t}"


def _text_sql(t: str, c: str) -> str:
    return f"SELECT '{c}', 'categorical', NULL, NULL, NULL, NULL, (SELECT count(*) FILTER ({c} IS NULL) FROM {t}), (SELECT CAST(count(DISTINCT {c}) AS DOUBLE) FROM {t}), (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(" UNION ALL ".join([*(_number_sql("customer", c) for c in ("c_custkey", "c_nationkey", "c_acctbal")), *(_text_sql("customer", c) for c in ("c_name", "c_mktsegment"))]))
def column_statistics(spark, sf_dir):
    return stats.column_statistics(table(spark, sf_dir, "customer")).select("column", "type", *r6("min", "max", "mean", "std"), "missing", F.col("unique_values").cast("double").alias("unique_values"), "most_frequent")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(DISTINCT {c}) AS nunique, count(*) FILTER ({c} IS NULL) AS missing FROM part" for c, k in (("p_partkey", "numeric"), ("p_name", "categorical"), ("p_brand", "categorical"), ("p_type", "categorical"), ("p_size", "numeric"), ("p_retailprice", "numeric"))))
def table_info(spark, sf_dir):
    return stats.table_info(table(spark, sf_dir, "part"))


@query(f"""SELECT count(*) AS n_samples, 4 AS n_features, count(DISTINCT l_returnflag) AS n_classes, least({', '.join(f'min({c})' for c in LINE_FEATURES)}) AS min, greatest({', '.join(f'max({c})' for c in LINE_FEATURES)}) AS max,
round(({' + '.join(f'stddev_pop({c})' for c in LINE_FEATURES)}) / 4, 6) AS mean_std, {' + '.join(f'CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE 0 END' for c in LINE_FEATURES)} AS constant_features,
round(({' + '.join(f'count(*) FILTER ({c} = 0)' for c in LINE_FEATURES)}) / (count(*) * 4), 6) AS sparsity, (SELECT round(max(n) / min(n), 6) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)) AS imbalance_ratio FROM lineitem""")
def dataset_analysis(spark, sf_dir):
    d = stats.dataset_analysis(table(spark, sf_dir, "lineitem"), LINE_FEATURES, LINE_LABEL)
    return d.select("n_samples", "n_features", "n_classes", "min", "max", *r6("mean_std"), "constant_features", *r6("sparsity", "imbalance_ratio"))


@query(f"SELECT count(*) AS rows, 4 AS columns, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean FROM (SELECT unnest([{', '.join(LINE_FEATURES)}]) AS v FROM lineitem)".replace("count(*) AS rows", "count(*) // 4 AS rows"))
def matrix_summary(spark, sf_dir):
    return stats.matrix_summary(table(spark, sf_dir, "lineitem"), LINE_FEATURES).select("rows", "columns", *r6("min", "max", "mean"))


@query("SELECT c_mktsegment AS label, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS pct FROM customer GROUP BY c_mktsegment")
def class_distribution(spark, sf_dir):
    return stats.class_distribution(table(spark, sf_dir, "customer"), "c_mktsegment").select(F.col("c_mktsegment").alias("label"), "n", *r6("pct"))


@query(f"""WITH u AS (SELECT l_returnflag AS y, unnest([{', '.join(f"'{c}'" for c in LINE_FEATURES)}]) AS f, unnest([{', '.join(LINE_FEATURES)}]) AS v FROM lineitem),
m AS (SELECT *, avg(v) OVER (PARTITION BY f) AS g, avg(v) OVER (PARTITION BY f, y) AS c FROM u)
SELECT round(sum((c - g) * (c - g)) / nullif(sum((v - c) * (v - c)), 0), 6) AS score FROM m""")
def class_separation(spark, sf_dir):
    return stats.class_separation(table(spark, sf_dir, "lineitem"), LINE_FEATURES, LINE_LABEL).select(*r6("score"))


@query(f"SELECT feature, round(variance, 4) AS variance, row_number() OVER (ORDER BY variance DESC, feature) AS rank FROM ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, var_pop({c}) AS variance FROM lineitem''' for c in LINE_FEATURES)})")
def feature_importance(spark, sf_dir):
    return stats.feature_importance(table(spark, sf_dir, "lineitem"), LINE_FEATURES).select("feature", F.round("variance", 4).alias("variance"), "rank")


@query("WITH d AS (SELECT datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, avg(value) AS v FROM events GROUP BY ALL) SELECT round(regr_slope(v, day), 6) AS slope, round(regr_intercept(v, day), 4) AS intercept FROM d")
def linear_trend(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("day")).agg(F.avg("value").alias("v"))
    return stats.linear_trend(days, "v", "day").select(*r6("slope"), F.round("intercept", 4).alias("intercept"))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT event_type, CASE WHEN hi > lo THEN CAST(least(19, floor((value - lo) / ((hi - lo) / 20))) AS INT) ELSE 0 END AS bucket, (hi - lo) / 20 AS width FROM events, e WHERE value IS NOT NULL)
SELECT event_type, bucket, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY event_type) * any_value(width)), 6) AS density FROM b GROUP BY event_type, bucket""")
def feature_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), "value", "event_type").select("event_type", "bucket", "n", *r6("density"))


@query("SELECT round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50 FROM events")
def percentile_thresholds(spark, sf_dir):
    return stats.quantiles(table(spark, sf_dir, "events"), "value", [0.25, 0.5]).select(*r6("p25", "p50"))


# --- features ----------------------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b, min(c_nationkey) AS c, max(c_nationkey) AS d FROM customer) SELECT c_custkey, round((c_acctbal - a) / (b - a), 6) AS norm_c_acctbal, round((c_nationkey - c) / (d - c), 6) AS norm_c_nationkey FROM customer, e")
def normalize_features(spark, sf_dir):
    return features.normalize(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"]).select("c_custkey", *r6("norm_c_acctbal", "norm_c_nationkey"))


@query("SELECT p_partkey, round(log10(p_size), 6) AS log_p_size, round(log10(p_retailprice), 6) AS log_p_retailprice, round(sqrt(p_size), 6) AS sqrt_p_size, round(sqrt(p_retailprice), 6) AS sqrt_p_retailprice FROM part")
def log_sqrt_features(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    out = features.sqrt_transform(features.log_transform(df, PART_FEATURES), PART_FEATURES)
    return out.select("p_partkey", *r6("log_p_size", "log_p_retailprice", "sqrt_p_size", "sqrt_p_retailprice"))


@query("""SELECT p_partkey, round(p_size * p_retailprice, 6) AS p_size_x_p_retailprice, CAST(p_size AS DOUBLE) ** 2 AS p_size_squared, CAST(p_size AS DOUBLE) ** 3 AS p_size_cubed,
round((p_size + p_retailprice) / 2, 6) AS feature_mean, round(greatest(p_size, p_retailprice) - least(p_size, p_retailprice), 6) AS feature_range FROM part""")
def interaction_poly_features(spark, sf_dir):
    df = features.interactions(table(spark, sf_dir, "part"), PART_FEATURES)
    df = features.row_statistics(features.powers(df, ["p_size"]), PART_FEATURES)
    return df.select("p_partkey", *r6("p_size_x_p_retailprice"), "p_size_squared", "p_size_cubed", *r6("feature_mean", "feature_range"))


@query("""WITH e AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)
SELECT c_custkey, round(sqrt(CAST(c_nationkey AS DOUBLE) ** 2 + 1), 6) AS root, c_acctbal > m AS above, round((c_acctbal - m) / s, 6) AS z, round(greatest(c_acctbal, c_nationkey) - least(c_acctbal, c_nationkey), 6) AS span,
CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS lg FROM customer, e""")
def expression_columns(spark, sf_dir):
    steps = [("root", "sqrt(c_nationkey^2 + 1)"), ("above", "c_acctbal > mean(c_acctbal)"), ("z", "(c_acctbal - mean(c_acctbal)) / std(c_acctbal)"), ("bad", "__import__('os')"), ("span", "max(c_acctbal, c_nationkey) - min(c_acctbal, c_nationkey)"), ("lg", "log10(c_acctbal)"), ("gone", "no_such + 1")]
    df, _ = expr.derive_all(table(spark, sf_dir, "customer"), steps)
    return df.select("c_custkey", *r6("root"), "above", *r6("z", "span", "lg"))


@query("""WITH v AS (SELECT event_id, nullif(CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k') ELSE event_type END, 'error') AS raw FROM events)
SELECT event_id, raw IS NULL OR raw IN ('', 'NA', 'N/A', 'null', 'NULL', 'None', 'NaN', 'nan', 'ERROR', 'error', 'MISSING', 'missing') AS missing, coalesce(CASE WHEN regexp_full_match(raw, '[0-9.]+') THEN TRY_CAST(raw AS DOUBLE) END, -99999.0) AS num FROM v""")
def numeric_coercion(spark, sf_dir):
    raw = F.nullif(F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k")).otherwise(F.col("event_type")), F.lit("error"))
    df = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return df.select("event_id", features.is_missing(F.col("raw")).alias("missing"), features.to_numeric(df, "raw").alias("num"))


@query("WITH c AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, code, CASE WHEN code > 3 THEN 'Class_' || code ELSE v END AS decoded FROM customer JOIN c ON c_mktsegment = v")
def label_encode(spark, sf_dir):
    """Codes, and names looked up in a book that lacks the codes above 3."""
    df = features.label_encode(table(spark, sf_dir, "customer"), "c_mktsegment").withColumnRenamed("c_mktsegment_code", "code")
    book = df.where("code <= 3").select("code", F.col("c_mktsegment").alias("name")).distinct()
    return pairbayes.decode(df, "code", book).select("c_custkey", "code", "decoded")


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def target_filter(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return features.encode_target(df, "quality")


@query("""WITH o AS (SELECT o_orderkey, 2147483648 + o_custkey % 4 * 100000000000 AS y FROM orders WHERE o_custkey IS NOT NULL),
c AS (SELECT y, row_number() OVER (ORDER BY CAST(y AS VARCHAR)) - 1 AS code FROM (SELECT DISTINCT y FROM o)) SELECT o_orderkey, code AS y FROM o JOIN c USING (y)""")
def large_labels(spark, sf_dir):
    """Whole labels that no INT holds become codes."""
    y = F.lit(2147483648) + F.col("o_custkey").cast("long") % 4 * F.lit(100000000000)
    return features.encode_target(table(spark, sf_dir, "orders").select("o_orderkey", y.alias("y")), "y").select("o_orderkey", "y")


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey + 100000 AS DOUBLE) * (l_suppkey + 100000) AS a_x_b, CAST(l_partkey + 100000 AS DOUBLE) * (l_partkey + 100000) - 1 AS sq FROM lineitem")
def large_products(spark, sf_dir):
    """Products of whole numbers beyond the largest INT."""
    whole = lambda c: (F.col(c) + 100000).cast("int")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", whole("l_partkey").alias("a"), whole("l_suppkey").alias("b"))
    return expr.derive(features.interactions(df, ["a", "b"]), "sq", "a * a - 1").select("l_orderkey", "l_linenumber", "a_x_b", "sq")


# --- selection ---------------------------------------------------------------------------------------------------------


def _picked(df: DataFrame, key: str) -> DataFrame:
    return df.where(selection.arithmetic_key(key, 42) < 30000).select(key)


@query("SELECT o_orderkey AS row_id, o_orderstatus FROM orders WHERE (o_orderkey * 7919 + 42) % 104729 < 30000")
def semi_select(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return selection.selected(df, _picked(df, "o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")


@query("SELECT o_orderkey AS row_id, o_orderstatus FROM orders WHERE (o_orderkey * 7919 + 42) % 104729 >= 30000")
def anti_remaining(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return selection.remaining(df, _picked(df, "o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")


@query("""WITH n AS (SELECT l_quantity, l_discount, l_tax, l_returnflag, row_number() OVER (PARTITION BY l_quantity, l_discount, l_tax, l_returnflag) AS rn FROM lineitem),
t AS (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem WHERE l_linenumber = 1)
SELECT l_quantity, l_discount, l_tax, l_returnflag, count(*) AS n FROM n WHERE NOT (rn = 1 AND EXISTS (SELECT 1 FROM t WHERE t.l_quantity = n.l_quantity AND t.l_discount = n.l_discount AND t.l_tax = n.l_tax AND t.l_returnflag = n.l_returnflag)) GROUP BY ALL""")
def value_first_match_holdout(spark, sf_dir):
    """lineitem has no key, so the rows that stay are counted by value."""
    cols = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
    df = table(spark, sf_dir, "lineitem")
    return selection.value_holdout(df.select(*cols), df.where("l_linenumber = 1").select(*cols), cols, cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919 + 42) % 104729, c_custkey) AS rn FROM customer)
SELECT c_custkey, CASE WHEN rn > n - round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM n""")
def stratified_split(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return selection.stratified_split(df, "c_mktsegment", selection.arithmetic_key("c_custkey", 42), "c_custkey").select("c_custkey", "part")


@query("SELECT c_custkey, c_mktsegment AS label FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919 + 42) % 104729, c_custkey) AS rn FROM customer) WHERE rn <= 5")
def initial_per_class(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return selection.sample_per_class(df, "c_mktsegment", selection.arithmetic_key("c_custkey", 42), "c_custkey", 5).select("c_custkey", F.col("c_mktsegment").alias("label"))


@query("SELECT 'documents' AS side, lang AS label FROM (SELECT DISTINCT lang FROM documents WHERE lang NOT IN (SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang <> 'en')) UNION ALL SELECT 'toxic', lang FROM (SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang <> 'en' AND lang NOT IN (SELECT lang FROM documents))")
def label_set_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    toxic = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").where("lang <> 'en'")
    return metrics.label_difference(docs, toxic, "lang", ("documents", "toxic"))


# --- rounds ------------------------------------------------------------------------------------------------------------

_DAYS = "d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS acc FROM events GROUP BY ALL)"


@query(f"""WITH {_DAYS}, a AS (SELECT *, n - coalesce(lag(n) OVER (ORDER BY day), 0) AS new_samples, coalesce(max(acc) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before, first(n) OVER (ORDER BY day) AS n0 FROM d),
b AS (SELECT *, acc - best_before AS improvement, sum(CASE WHEN acc - best_before > 0 THEN 1 ELSE 0 END) OVER (ORDER BY day) AS island FROM a)
SELECT CAST(day AS VARCHAR) AS day, n, new_samples, round(best_before, 6) AS best_before, round(improvement, 6) AS improvement, round(sum(improvement) OVER (ORDER BY day), 5) AS cumulative,
CASE WHEN improvement > 0 THEN 0 ELSE row_number() OVER (PARTITION BY island ORDER BY day) - CASE WHEN island > 0 THEN 1 ELSE 0 END END AS waited, round((n - n0) * 100.0 / n0, 6) AS growth_pct FROM b""")
def round_analytics(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("acc"))
    out = stats.round_analytics(days, "day", "n", "acc")
    return out.select(F.col("day").cast("string").alias("day"), "n", "new_samples", *r6("best_before", "improvement"), F.round("cumulative", 5).alias("cumulative"), "waited", *r6("growth_pct"))


_ROUNDS = "t AS (SELECT DISTINCT CAST(1 + datediff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INT) AS r FROM events)"


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round for each day of events, counted from the first."""
    day = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    return day.crossJoin(F.broadcast(day.agg(F.min("day").alias("first")))).select((F.datediff("day", "first") + 1).alias("round"))


@query(f"WITH {_ROUNDS} SELECT r AS round, r = 1 OR (r <= 10 AND r % 2 = 0) OR (r > 10 AND r <= 50 AND r % 5 = 0) OR (r > 50 AND r % 10 = 0) AS strategic FROM t")
def strategic_rounds(spark, sf_dir):
    return stats.strategic_rounds(_rounds(spark, sf_dir))


@query(f"WITH {_ROUNDS}, p AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS place, count(*) OVER () AS n FROM t) SELECT r AS round FROM p WHERE n <= 5 OR place IN (0, n // 2, n - 1)")
def key_rounds(spark, sf_dir):
    return stats.key_rounds(_rounds(spark, sf_dir))


@query(f"WITH {_DAYS} SELECT CAST(day AS VARCHAR) AS day, n, acc FROM d ORDER BY acc DESC, day LIMIT 1")
def best_round(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("acc"))
    return stats.best_round(days, "day", "acc").select(F.col("day").cast("string").alias("day"), "n", "acc")


# --- series, texts, vectors ----------------------------------------------------------------------------------------------

_SERIES = "round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS median"


@query(f"WITH e AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id, {_SERIES}, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(avg(d), 6) AS mean_diff, round(stddev_pop(d), 6) AS std_diff FROM e GROUP BY user_id")
def timeseries_features(spark, sf_dir):
    f = stats.series_features(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return f.select("user_id", *r6("mean", "std", "min", "max", "median", "p25", "p75", "mean_diff", "std_diff"))


@query(f"SELECT event_type, {_SERIES}, count(value) AS length FROM events GROUP BY event_type")
def handcrafted_summary(spark, sf_dir):
    return stats.handcrafted_summary(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", *r6("mean", "std", "min", "max", "median"), "length")


@query("""SELECT d.doc_id, quality, length(text) AS n_chars, len(regexp_extract_all(text, '\\S+')) AS n_words, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, len(regexp_extract_all(text, '[0-9]')) AS n_digits,
len(regexp_extract_all(text, '[A-Z]')) AS n_upper FROM documents d JOIN labels USING (doc_id)""")
def text_stat_features(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    f = modality.text_statistics(F.col("text"))
    return df.select("doc_id", "quality", *(f[n].alias(n) for n in ("n_chars", "n_words", "n_lines", "n_digits", "n_upper")))


@query("SELECT vec_id, CAST(embedding[1] AS FLOAT) AS feature_0, CAST(embedding[2] AS FLOAT) AS feature_1, CAST(embedding[3] AS FLOAT) AS feature_2 FROM embeddings")
def array_features(spark, sf_dir):
    return features.matrix_columns(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 3)


_PAIRS = "p AS (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"


@query(f"WITH {_PAIRS} SELECT label, src, dst, round(dist, 6) AS dist FROM p WHERE dist <= (SELECT quantile_cont(dist, 0.25) FROM p)")
def euclidean_pairs_threshold(spark, sf_dir):
    return graph.proximity(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.25).select("label", "src", "dst", *r6("dist"))


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, src, dst) AS place FROM p WHERE dist <= (SELECT quantile_cont(dist, 0.5) FROM p)),
both_ways AS (SELECT label, src AS a, dst AS b, place FROM e UNION ALL SELECT label, dst, src, place FROM e),
reach AS (SELECT label, place, src AS node FROM e UNION SELECT r.label, r.place, w.b FROM reach r JOIN both_ways w ON w.label = r.label AND w.a = r.node AND w.place < r.place)
SELECT e.label, e.src, e.dst, round(e.dist, 6) AS dist FROM e LEFT JOIN reach r ON r.label = e.label AND r.place = e.place AND r.node = e.dst WHERE r.node IS NULL""")
def class_mst(spark, sf_dir):
    """An edge is in the forest if lesser edges don't connect its ends, as the SQL says."""
    return graph.class_forest(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.5).select("label", "src", "dst", *r6("dist"))


@query("""WITH n AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM n) SELECT a AS vec_id, round(avg(d), 6) AS avg_dist FROM r WHERE rn <= 10 GROUP BY a""")
def knn_density(spark, sf_dir):
    return graph.neighbour_density(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10, "label").select("vec_id", *r6("avg_dist"))


@query("""WITH n AS (SELECT a.vec_id AS a, a.label, b.vec_id AS b, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM n), s AS (SELECT a AS vec_id, label, avg(d) + 1e-8 AS weight FROM r WHERE rn <= 10 GROUP BY a, label),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY -ln(((vec_id * 7919 + 42) % 104729 + 0.5) / 104729) / weight, vec_id) AS rn FROM s)
SELECT vec_id, label FROM t WHERE rn <= 20""")
def weighted_sample(spark, sf_dir):
    """Points in thin places are likelier; draws come from the arithmetic key, which SQL has too."""
    df = table(spark, sf_dir, "embeddings")
    near = graph.neighbour_density(df, "vec_id", "embedding", 10, "label")
    draw = (selection.arithmetic_key("vec_id", 42) + 0.5) / 104729
    return selection.weighted_sample(df.select("vec_id", "label").join(near, "vec_id"), "label", 1 / F.col("density"), "vec_id", 20, 42, draw).select("vec_id", "label")


@query()
def pca_variance(spark, sf_dir):
    _, shares = graph.pca(table(spark, sf_dir, "embeddings"), "embedding", 3)
    return spark.createDataFrame([(i, round(s, 6)) for i, s in enumerate(shares, 1)], "k int, ratio double")


@query()
def kmeans_diverse(spark, sf_dir):
    return clusters.diverse_per_class(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 5)


def _round_sql(i: int) -> str:
    """CTEs of a round of k-means: a{i}, every row with its nearest centre of c{i}; c{i + 1}, the means."""
    return f"""a{i} AS (SELECT * FROM (SELECT v.*, j, list_distance(x, m) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(x, m), j) AS rn FROM v JOIN c{i} USING (label)) WHERE rn = 1),
m{i} AS (SELECT label, j, list(s ORDER BY p) AS m FROM (SELECT label, j, p, avg(x[p]) AS s FROM a{i}, range(1, 65) t(p) GROUP BY ALL) GROUP BY label, j),
c{i + 1} AS (SELECT c.label, c.j, coalesce(n.m, c.m) AS m FROM c{i} c LEFT JOIN m{i} n USING (label, j))"""


@query(f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
c0 AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919 + 42) % 104729, vec_id) AS j, x AS m FROM v QUALIFY j <= 5),
{_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)}
SELECT DISTINCT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label, j ORDER BY d, vec_id) AS nth FROM a2) WHERE nth = 1""")
def kmeans_two_rounds(spark, sf_dir):
    """Rows nearest to the centres of two rounds of k-means, all classes in one plan, begun from rows by an arithmetic key."""
    begin = lambda df: selection.sample_per_class(df, "label", selection.arithmetic_key("vec_id", 42), "vec_id", 5)
    return clusters.diverse_per_class(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 5, rounds=2, start=begin)


@query("""WITH s AS (SELECT 1 AS round, c_custkey FROM customer WHERE (c_custkey * 7919 + 42) % 104729 < 10000 UNION ALL SELECT 2, c_custkey FROM customer WHERE (c_custkey * 7919 + 42) % 104729 < 30000)
SELECT round, c_mktsegment AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY round), 6) AS proportion FROM s JOIN customer USING (c_custkey) GROUP BY round, c_mktsegment""")
def selection_counts(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    key = selection.arithmetic_key("c_custkey", 42)
    sel = df.where(key < 10000).select(F.lit(1).alias("round"), "c_custkey").unionByName(df.where(key < 30000).select(F.lit(2).alias("round"), "c_custkey"))
    return stats.selection_counts(sel, df, "c_custkey", "c_mktsegment").select("round", F.col("c_mktsegment").alias("label"), "n", *r6("proportion"))


@query("SELECT c_custkey, (c_custkey * 7919 + 42) % 104729 < 30000 AS in_training FROM customer")
def training_membership(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey")
    return selection.membership(df, _picked(df, "c_custkey"), "c_custkey")


# --- files and streams: written and read again -----------------------------------------------------------------------------


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def fits_table_scan(spark, sf_dir):
    path = own_path(spark, "fits-table") + ".fits"
    writers.export(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path, "supplier")
    return readers.load(spark, path).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, p_brand FROM part")
def dat_scan(spark, sf_dir):
    """Columns parted by commas in a .dat file, which the first of the tried separators doesn't fit."""
    path = own_path(spark, "dat") + ".dat"
    table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand").write.option("header", True).csv(path)
    return readers.load(spark, path)


@query("SELECT CAST(o_orderkey AS DOUBLE) AS feature_0, o_totalprice AS feature_1, CAST(month(o_orderdate) AS DOUBLE) AS target FROM orders")
def matrix_scan(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").alias("m"))
    path = own_path(spark, "matrix")
    df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.text(path)
    return readers.matrix(spark, path)


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def discovered_scan(spark, sf_dir):
    """A folder in which the dataset's CSV is found by name, ahead of a file of another name."""
    cols, folder = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"], own_path(spark, "discovered")
    table(spark, sf_dir, "nation").write.option("header", True).csv(f"{folder}/a.csv")
    table(spark, sf_dir, "customer").select(*cols).write.option("header", True).csv(f"{folder}/customer.csv")
    return readers.load(spark, readers.discover(spark, folder, "customer"))


@query("SELECT lower(c_mktsegment) AS name, count(*) AS resol FROM customer GROUP BY ALL")
def config_scan(spark, sf_dir):
    """A configuration file for each market segment, with its number of customers, found by name and read again."""
    folder, out = own_path(spark, "configs"), []
    for i, r in enumerate(table(spark, sf_dir, "customer").groupBy(F.lower("c_mktsegment").alias("name")).count().collect()):
        readers.write_text(spark, f"{folder}/{r['name']}.{'json' if i % 2 else 'conf'}", f'{{"resol": {r["count"]}}}')
    for name in readers.dataset_names(spark, folder):
        out.append((name, readers.config(spark, folder, name)[0]["resol"]))
    return spark.createDataFrame(out, "name string, resol long")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part
UNION ALL SELECT 'p_partkey', 'p_size' FROM part WHERE p_size % 10 = 0""")
def dat_rows_like_the_header(spark, sf_dir):
    """Files with headers, in which rows stand that equal the header: only the headers go."""
    path = own_path(spark, "doubled") + ".dat"
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))
    doubled = part.unionByName(part.where("p_size % 10 = 0").select(F.lit("p_partkey").alias("p_partkey"), F.lit("p_size").alias("p_size")))
    doubled.repartition(3).write.option("header", True).option("sep", " ").csv(path)
    return readers.load(spark, path)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a stream takes a single file only where a pattern names it
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream has given once its input is read: all rows of an appending one, the last state of a complete one."""
    spark = stream.sparkSession
    path, state = own_path(spark, name), own_path(spark, f"{name}-state")
    out = stream.writeStream.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", path)
    else:
        out = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    out.start().awaitTermination()
    return spark.read.parquet(path)


@query(f"WITH {LINE_CORE} SELECT i, bi, l, bl, k, cnt FROM net")
def stream_pair_counts(spark, sf_dir):
    """The counts of lineitem, gathered by a stream."""
    rows = table(spark, sf_dir, "lineitem").select(*LINE_FEATURES, LINE_LABEL)
    model = pairbayes.initialise(rows, LINE_FEATURES, LINE_LABEL, LINE_CONFIG)
    return _drained(increments.count_stream(_stream(spark, sf_dir, "lineitem").select(*LINE_FEATURES, LINE_LABEL), model), "stream-counts", "complete")


@query(f"WITH {LINE_CORE} SELECT b.name AS predicted, count(*) AS n FROM pred JOIN classes b ON b.k = p GROUP BY b.name")
def stream_scores(spark, sf_dir):
    """lineitem scored as a stream, counted by prediction."""
    model = line_model(spark, sf_dir)[1]
    scored = _drained(increments.score_stream(_stream(spark, sf_dir, "lineitem").select(*LINE_FEATURES), model).select("Prediction"), "stream-scores", "append")
    return scored.groupBy(F.col("Prediction").cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    """Events by day and type, gathered by a stream with a watermark."""
    events = _stream(spark, sf_dir, "events").select("ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    n = _drained(increments.windowed_counts(events, "ts", ["event_type"], "1 day", "2 days"), "stream-windows", "complete")
    return n.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


# events as predictions, and labels of most of them that come up to six hours later; two days before the last event every
# wait is over, so what the streams have given up to then is all they ever give
_OVER = "(SELECT date_trunc('day', max(ts)) - INTERVAL 2 DAY FROM events)"
_LABELS = "SELECT event_id, ts + (event_id % 7) * INTERVAL 1 HOUR AS label_ts, floor(value) + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS label FROM events WHERE event_id % 5 <> 0"
_LATE = f"""SELECT p.event_id, p.ts, p.value, l.label FROM events p LEFT JOIN ({_LABELS}) l
ON p.event_id = l.event_id AND l.label_ts BETWEEN p.ts AND p.ts + INTERVAL 4 HOUR WHERE p.ts < {_OVER}"""


def _over(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "events").agg(F.date_trunc("day", F.max(F.col("ts").cast("timestamp"))) - F.expr("INTERVAL 2 DAY")).first()[0]


def _late_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    later = F.col("ts") + F.make_dt_interval(hours=F.pmod("event_id", F.lit(7)).cast("int"))
    label = F.floor("value").cast("double") + F.when(F.col("event_id") % 3 == 0, 2.0).otherwise(0.0)
    labels = _stream(spark, sf_dir, "events").where("event_id % 5 <> 0").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", later.alias("label_ts"), label.alias("label"))
    return increments.labelled_later(events, labels, "event_id", "ts", "label_ts", "4 HOUR", "6 hours")


@query(f"SELECT event_id, label FROM ({_LATE})")
def stream_late_labels(spark, sf_dir):
    """Every event of all but the last days with its label, or with none where none came in time: a join of two streams."""
    joined = _drained(_late_labels(spark, sf_dir), "stream-labels", "append")
    return joined.where(F.col("ts") < F.lit(_over(spark, sf_dir))).select("event_id", "label")


@query(f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(label) AS labelled, count(*) FILTER (abs(value - label) <= 1) AS correct FROM ({_LATE}) GROUP BY ALL")
def stream_late_accuracy(spark, sf_dir):
    """Accuracy by day of predictions whose labels come later: a join of two streams and windows after it, in one stream."""
    days = increments.accuracy_by_window(_late_labels(spark, sf_dir), "ts", F.col("label"), F.col("value"), 1.0, "1 day")
    days = _drained(days, "stream-accuracy", "append").where(F.col("window.start") < F.lit(_over(spark, sf_dir)))
    return days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "labelled", "correct")


@query(f"""WITH s AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS n FROM n GROUP BY user_id, k HAVING max(ts) < {_OVER}""")
def stream_sessions(spark, sf_dir):
    """Sessions of users with pauses of up to three hours, of all but the last days, each given once."""
    events = _stream(spark, sf_dir, "events").select("ts", "user_id")
    held = _drained(increments.sessions(events, "ts", ["user_id"], "3 hours", "6 hours"), "stream-sessions", "append")
    last = F.col("window.end") - F.expr("INTERVAL 3 HOUR")
    return held.where(last < F.lit(_over(spark, sf_dir))).select("user_id", F.unix_micros("window.start").alias("first_us"), F.unix_micros(last).alias("last_us"), "n")
