"""The pairwise count model: bins, counts of pairs of bins by class, scores, boosted weights.

Counts are a sparse table (i, bi, l, bl, k, cnt); cells that aren't there stand for the prior of one row per class.
Scoring looks cells up pair by pair: the table of one pair of features has at most (resol + 1)^2 rows, whatever the
input, so these are broadcast, if they are counted to be small, and a row is scored where it lies. A plan of a join a pair
suits few features; with more, features are counted and looked up in blocks (feature_blocks.py), with the same results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from itertools import combinations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from ..functions.features import finite
from ..session import cut
from . import feature_blocks

CELL = ["i", "bi", "l", "bl"]
#: Features whose pairs a plan joins one by one; more are dealt into blocks.
JOINED_FEATURES = 12
#: Cells are broadcast up to so many bytes in all; larger ones are joined as Spark sees fit.
BROADCAST_BYTES = 128 << 20


@dataclass(frozen=True)
class ModelConfig:
    """The model's defaults."""

    resol: int = 100
    gain: float = 2.0
    margin: float = 0.2
    patience: int = 10
    max_epochs: int = 100
    min_improvement: float = 1e-7


#: Defaults by kind of data (resol, gain, margin, patience, epochs, min_improvement).
MODALITY = {
    "image": (80, 15.0, 0.15, 15, 200, 0.05),
    "text": (60, 12.0, 0.10, 20, 150, 0.03),
    "audio": (70, 18.0, 0.20, 12, 180, 0.08),
    "time_series": (50, 20.0, 0.25, 10, 100, 0.10),
    "high_dimensional": (40, 8.0, 0.08, 25, 250, 0.02),
}


def config_for(kind: str, **override) -> ModelConfig:
    """Defaults for a kind of data, those of high_dimensional for unknown kinds."""
    r, g, m, p, e, i = MODALITY.get(kind, MODALITY["high_dimensional"])
    return replace(ModelConfig(r, g, m, p, e, i), **override)


# --- bins ----------------------------------------------------------------------------------------------------------


def feature_bins(df: DataFrame, features: list[str], resol: int, known: dict[str, tuple] | None = None) -> dict[str, tuple]:
    """feature -> (min, max) of its finite values, one pass, two numbers a feature; known bounds are only ever widened."""
    if len(features) <= JOINED_FEATURES:
        row = df.agg(*(f(finite(F.col(f"`{c}`"))).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max)))).first()
        out = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(features)}
    else:  # hundreds of aggregates make a plan that takes longer than the data
        long = df.select(F.posexplode(F.array(*(F.col(f"`{c}`").cast("double") for c in features))).alias("i", "x")).select("i", finite(F.col("x")).alias("x"))
        held = {r.i: (r.lo, r.hi) for r in long.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        out = {c: held.get(i, (None, None)) for i, c in enumerate(features)}
    for c, (lo, hi) in (known or {}).items():
        if c in out:
            held = [x for x in (lo, out[c][0]) if x is not None], [x for x in (hi, out[c][1]) if x is not None]
            out[c] = (min(held[0], default=None), max(held[1], default=None))
    return out


def bin_of(x: Column, lo: float | None, hi: float | None, resol: int) -> Column:
    """Bin 0..resol; values out of bounds go to the outer bins, NULL, NaN and constant features to 0."""
    if lo is None or hi is None or not hi > lo:
        return F.lit(0)
    at = F.floor((F.nanvl(x.cast("double"), F.lit(float("-inf"))) - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) * resol + 0.5)
    return F.least(F.lit(resol), F.greatest(F.lit(0), at)).cast("int")


def binned(df: DataFrame, bins: dict[str, tuple], resol: int) -> DataFrame:
    """df with b0, b1, ... for the features in order."""
    return df.withColumns({f"b{i}": bin_of(F.col(f"`{c}`"), lo, hi, resol) for i, (c, (lo, hi)) in enumerate(bins.items())})


def classes_of(df: DataFrame, label: str) -> list:
    """The labels in sorted order; class k is the k-th, from 1. As many values as classes reach the driver."""
    return [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def class_number(label: Column, classes: list) -> Column:
    out = F.lit(None).cast("int")
    for k, c in enumerate(classes, 1):
        out = F.when(label == F.lit(c), F.lit(k)).otherwise(out)
    return out


# --- counts --------------------------------------------------------------------------------------------------------


def pairs_of(n: int) -> list[tuple[int, int]]:
    return list(combinations(range(n), 2))


def _exploded(df: DataFrame, n: int, *keep: Column | str) -> DataFrame:
    """keep and i, bi, l, bl for every pair of features of every row."""
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"b{i}").alias("bi"), F.lit(j).alias("l"), F.col(f"b{j}").alias("bl")) for i, j in pairs_of(n)))
    return df.select(*keep, F.explode(cells).alias("c")).select(*[k if isinstance(k, str) else "k" for k in keep], "c.*")


def pair_counts(df: DataFrame, n: int, k: Column) -> DataFrame:
    """i, bi, l, bl, k, cnt of binned rows; partial counts are made before the shuffle, of at most that many cells."""
    return _exploded(df, n, k.alias("k")).groupBy(*CELL, "k").agg(F.count(F.lit(1)).alias("cnt"))


def merge_counts(*nets: DataFrame) -> DataFrame:
    """Sum of count tables: counts of parts add up to those of the whole."""
    out = nets[0]
    for net in nets[1:]:
        out = out.unionByName(net)
    return out.groupBy(*CELL, "k").agg(F.sum("cnt").alias("cnt"))


def cell_scores(net: DataFrame, n_classes: int, weights: DataFrame | None = None) -> DataFrame:
    """i, bi, l, bl, s: log scores of each class in each cell, in an array."""
    rows = net.select(*CELL, "k", F.col("cnt"), F.lit(1.0).alias("w"))
    if weights is not None:
        rows = net.join(weights, [*CELL, "k"], "left").select(*CELL, "k", "cnt", F.coalesce("w", F.lit(1.0)).alias("w"))
    cols = [F.sum(F.when(F.col("k") == k, F.col("cnt")).otherwise(0)).alias(f"c{k}") for k in range(1, n_classes + 1)]
    cols += [F.coalesce(F.max(F.when(F.col("k") == k, F.col("w"))), F.lit(1.0)).alias(f"w{k}") for k in range(1, n_classes + 1)]
    cells = rows.groupBy(*CELL).agg(*cols, F.sum("cnt").alias("n"))
    score = [F.ln(F.col(f"w{k}") * (F.col(f"c{k}") + 1) / (F.col("n") + n_classes)) for k in range(1, n_classes + 1)]
    return cells.select(*CELL, F.array(*score).alias("s"))


def add_scores(df: DataFrame, n: int, cells: DataFrame, n_classes: int, resol: int | None = None) -> DataFrame:
    """df with scores, an array of one log score a class, by a join for each pair of features; rows stay where they are as
    long as the cells are small enough to broadcast. They are counted where the whole grid of resol isn't that small."""
    blank = F.array(*[F.lit(0.0) - F.ln(F.lit(float(n_classes)))] * n_classes)
    cells = cut(cells)
    fit = BROADCAST_BYTES // ((n_classes + len(CELL)) * 8)
    fits = (resol is not None and len(pairs_of(n)) * (resol + 1) ** 2 <= fit) or cells.count() <= fit
    out, names = df, []
    for p, (i, j) in enumerate(pairs_of(n)):
        part = cells.where((F.col("i") == i) & (F.col("l") == j)).select(F.col("bi").alias(f"b{i}"), F.col("bl").alias(f"b{j}"), F.col("s").alias(f"__s{p}"))
        out = out.join(F.broadcast(part) if fits else part, [f"b{i}", f"b{j}"], "left")
        names.append(f"__s{p}")
    total = [F.lit(0.0) for _ in range(n_classes)]
    for s in names:
        held = F.coalesce(s, blank)
        total = [t + held[k] for k, t in enumerate(total)]
    return out.withColumn("scores", F.array(*total)).drop(*names)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row; inside a lambda it would be computed again for every element."""
    return F.transform(F.array(value), use)[0]


def best_class(scores: Column) -> Column:
    """Class of the highest score rounded to 9 places, the first of equal ones. Only scores near the highest, but not
    equal to it, are rounded."""
    is_top = lambda top: lambda s: (s == top) | ((s >= top - 1e-8) & (F.round(s, 9) == F.round(top, 9)))
    return F.nullif(_once(F.array_max(scores), lambda top: F.array_position(F.transform(scores, is_top(top)), True)), F.lit(0)).cast("int")


def posteriors(scores: Column) -> Column:
    """Class probabilities, in an array."""
    e = _once(F.array_max(scores), lambda top: F.transform(scores, lambda s: F.exp(s - top)))
    return _once(e, lambda e: _once(_total(e), lambda t: F.transform(e, lambda x: x / t)))


def confidence(scores: Column) -> Column:
    """Probability of the likeliest class."""
    return _once(F.array_max(scores), lambda top: 1 / F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


# --- boosting ------------------------------------------------------------------------------------------------------


def lagging(gain: float) -> Column:
    """What a wrong row adds to the weights of its true class: gain * (1 - p_true / p_predicted)."""
    return gain * (1 - F.exp(F.element_at("scores", F.col("k")) - F.element_at("scores", F.col("predicted"))))


def boost(scored: DataFrame, n: int, weights: DataFrame | None, gain: float) -> DataFrame:
    """Weights after one batch epoch: each cell of the true class that wrong rows touch grows by the mean of
    gain * (1 - p_true / p_predicted) over those rows. scored has bins, scores, k and predicted."""
    wrong = scored.where("predicted != k")
    touched = _exploded(wrong.withColumn("__d", lagging(gain)), n, "k", "__d").groupBy(*CELL, "k").agg(F.avg("__d").alias("d"))
    if weights is None:
        return touched.select(*CELL, "k", (F.lit(1.0) + F.col("d")).alias("w"))
    both = weights.join(touched, [*CELL, "k"], "full")
    return both.select(*CELL, "k", (F.coalesce("w", F.lit(1.0)) + F.coalesce("d", F.lit(0.0))).alias("w"))


# --- the model -----------------------------------------------------------------------------------------------------


@dataclass
class PairModel:
    """A fitted model. Tables are DataFrames, bounded by the grid and not by the input; nothing changes in place."""

    config: ModelConfig
    features: list[str]
    target: str
    bins: dict[str, tuple]
    classes: list
    net: DataFrame
    weights: DataFrame | None = None
    accuracy: float | None = None
    history: list[dict] = field(default_factory=list)
    #: With many features the counts and weights are here, and net and weights are read from it.
    packed: DataFrame | None = None

    @property
    def n(self) -> int:
        return len(self.features)

    def check(self, df: DataFrame) -> DataFrame:
        """df, if it has the features that the model was fitted on, in any order."""
        if gone := [c for c in self.features if c not in df.columns]:
            raise ValueError(f"features not found: {', '.join(gone)}")
        return df

    @property
    def grid(self) -> feature_blocks.Grid:
        return feature_blocks.Grid(self.n, self.config.resol, len(self.classes))

    def with_packed(self, packed: DataFrame) -> PairModel:
        """The model with these packed counts and weights."""
        rows = feature_blocks.cells(packed, self.grid)
        return replace(self, packed=packed, net=rows.drop("w"), weights=rows.where("w != 1").select(*CELL, "k", "w"))

    def score(self, df: DataFrame) -> DataFrame:
        """df with scores and predicted (class number), and with few features their bins."""
        self.check(df)
        if self.packed is None:
            out = add_scores(binned(df, self.bins, self.config.resol), self.n, cell_scores(self.net, len(self.classes), self.weights), len(self.classes), self.config.resol)
        elif feature_blocks.size_of(self.packed) <= BROADCAST_BYTES:
            out = feature_blocks.score_in_place(df, self.bins, self.packed, self.grid)
        elif df.isStreaming:
            raise ValueError("the model is too large to score a stream's rows where they lie; use increments.score_batches")
        else:
            rows = cut(df.withColumn("__row", F.monotonically_increasing_id()))
            blocks = cut(feature_blocks.deal(rows, self.bins, self.grid, "__row"))
            found = feature_blocks.score(blocks, self.packed, self.grid).select(F.col("row").alias("__row"), "scores")
            out = rows.join(found, "__row").drop("__row")
        return out.withColumn("predicted", best_class(F.col("scores")))

    def transform(self, df: DataFrame) -> DataFrame:
        """df with Prediction (the class's name) and Confidence (its probability)."""
        out = self.score(df)
        name = F.element_at(F.array(*(F.lit(str(c)) for c in self.classes)), F.col("predicted"))
        return out.withColumn("Prediction", name).withColumn("Confidence", confidence(F.col("scores"))).drop("scores", "predicted", *(f"b{i}" for i in range(self.n)))

    def without_weights(self) -> PairModel:
        if self.packed is not None:
            return self.with_packed(self.packed.withColumn("weights", F.lit(None).cast("binary")))
        return replace(self, weights=None)

    def describe(self) -> dict:
        return {"config": asdict(self.config), "features": self.features, "target": self.target, "bins": {k: list(v) for k, v in self.bins.items()}, "classes": self.classes, "accuracy": self.accuracy, "history": self.history}


def initialise(df: DataFrame, features: list[str], target: str, config: ModelConfig, known: dict[str, tuple] | None = None) -> PairModel:
    """Bounds and classes from the full data, with no counts yet: every class is as likely everywhere."""
    return initialised(df.sparkSession, config, features, target, feature_bins(df, features, config.resol, known), classes_of(df, target))


def initialised(spark: SparkSession, config: ModelConfig, features: list[str], target: str, bins: dict[str, tuple], classes: list) -> PairModel:
    return PairModel(config, features, target, bins, classes, spark.createDataFrame([], "i int, bi int, l int, bl int, k int, cnt long"))


def fit(df: DataFrame, features: list[str], target: str, config: ModelConfig | None = None, frame: PairModel | None = None) -> PairModel:
    """Counts df and boosts epoch by epoch, until all rows are right, patience ends without a better epoch, or
    max_epochs. The best epoch's weights are kept. frame: bounds and classes to keep from another fit."""
    frame = frame or initialise(df, features, target, config or ModelConfig())
    config = config or frame.config
    rows = df.withColumn("k", class_number(F.col(f"`{target}`"), frame.classes)).where("k IS NOT NULL").select(*features, "k")
    frame = replace(frame, config=config, weights=None, packed=None, accuracy=None, history=[])
    if len(features) > JOINED_FEATURES:
        # rows are dealt into blocks once; epochs only read these
        rows = cut(feature_blocks.deal(cut(rows.withColumn("__row", F.monotonically_increasing_id())), frame.bins, frame.grid, "__row", F.col("k")))
        model = frame.with_packed(feature_blocks.count(rows, frame.grid))
        score = lambda m: cut(feature_blocks.score(rows, m.packed, m.grid).withColumn("predicted", best_class(F.col("scores"))))
        better = lambda m, scored: m.with_packed(cut(feature_blocks.boost(rows, m.packed, scored.where("predicted != k").select("shard", "at", lagging(config.gain).alias("delta")), m.grid)))
    else:
        rows = rows.persist()  # read by counts and by every epoch
        model = replace(frame, net=cut(pair_counts(binned(rows, frame.bins, config.resol), len(features), F.col("k"))))
        score = lambda m: m.score(rows)
        better = lambda m, scored: replace(m, weights=cut(boost(scored, m.n, m.weights, config.gain)))
    best, waited = None, 0
    try:
        for epoch in range(config.max_epochs + 1):
            scored = score(model)
            accuracy = scored.agg(F.avg((F.col("predicted") == F.col("k")).cast("double"))).first()[0]
            if accuracy is None:
                break
            model.history.append({"epoch": epoch, "accuracy": accuracy})
            if best is None or accuracy > best.accuracy:
                best, waited = replace(model, accuracy=accuracy), 0
            else:
                waited += 1
            if accuracy >= 1 or waited >= config.patience or epoch == config.max_epochs:
                break
            model = better(model, scored)
    finally:
        rows.unpersist()
    return best or model


# --- unpivoted forms -----------------------------------------------------------------------------------------------


def long_scores(scored: DataFrame, keys: list[str], values: Column) -> DataFrame:
    """keys, k, value: an array column a class a row."""
    return scored.select(*keys, F.posexplode(values).alias("k", "value")).withColumn("k", F.col("k") + 1)


def decode(df: DataFrame, code: str, book: DataFrame, name: str = "decoded") -> DataFrame:
    """df with the name of a code from book (code, name), Class_{code} where it has none."""
    book = book.select(F.col("code").alias("__code"), F.col("name").alias("__name"))
    return df.join(book, F.col(code) == F.col("__code"), "left").withColumn(name, F.coalesce("__name", F.concat(F.lit("Class_"), F.col(code).cast("string")))).drop("__code", "__name")


def confusion(df: DataFrame, actual: str, predicted: str, classes: list | None = None) -> DataFrame:
    """actual, predicted, n; with classes all their pairs."""
    n = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        return n
    one = df.sparkSession.createDataFrame([(c,) for c in classes], n.select("actual").schema)
    grid = one.crossJoin(F.broadcast(one.withColumnRenamed("actual", "predicted")))
    return grid.join(n, ["actual", "predicted"], "left").fillna(0, ["n"])


def ranked(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
