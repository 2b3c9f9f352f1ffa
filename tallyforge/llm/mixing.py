"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions alone.

A budget of tokens is passed down a tree (by default domain, language, source). A parent's budget is split among its
children by weight; a child can't take more than its tokens times max_epochs, and what it lacks goes to its siblings, so
that only a parent whose children are all full passes a shortage on to its own siblings. A leaf takes whole epochs and
then the prefix of one more epoch, in an order seeded by (seed, epoch, doc_id), that still fits its budget.

Only leaves are ever gathered. The prefix of a leaf is found from sums over slices of the order and a running sum in the
one slice where it ends, so a leaf with any share of the rows is no task's burden; documents are then judged by a
comparison with their leaf's cut.

Defined cases: null texts have no tokens; documents without tokens fit into any prefix, but not beyond max_epochs; null tree columns are the name ''; a null doc_id is ordered as the empty text;
documents of equal (order, doc_id) enter together or not at all; nodes of weight 0 get nothing; an empty table gives no
rows; extra columns are kept by select() whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .common import fresh, materialize, small

#: Hexadecimal digits of the order that name a slice of a leaf.
SLICE_DIGITS = 3


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass
class Plan:
    """levels: name and column of each level, root first. weights: by level, name to whole number; 1 where absent."""

    levels: dict[str, Column]
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget_percent: int = 60
    max_epochs: int = 2
    seed: int = 7
    tokens: Column | None = None

    def weight(self, level: str) -> Column:
        known = self.weights.get(level, {})
        out = F.lit(1).cast("long")
        for name, w in known.items():
            out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
        return out


def fill(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Adds `given` to children (parent columns, node, weight, most, budget of the parent): its share by weight, at most
    `most`, with the rest shared by the others in the same way. Shares are rounded down."""
    live = children.where("weight > 0")
    by = Window.partitionBy(*parent, F.lit(0)).orderBy(F.col("most") / F.col("weight"), node)
    group = Window.partitionBy(*parent, F.lit(0))
    live = live.withColumn("before", F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    live = live.withColumn("from_here", F.sum("weight").over(group) - F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight"))
    live = live.withColumn("full", F.expr("most * from_here <= weight * (budget - before)"))
    live = live.withColumn("taken", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(group))
    live = live.withColumn("shared", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(group))
    given = F.expr("CASE WHEN full THEN most ELSE ((budget - taken) * weight) div shared END")
    live = live.withColumn("given", given).drop("before", "from_here", "full", "taken", "shared")
    return live.unionByName(children.where("weight <= 0").withColumn("given", F.lit(0).cast("long")))


def leaf_budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves: the level columns and supply. Adds given (tokens), epochs (whole ones) and left (tokens of one more)."""
    names = list(plan.levels)
    leaves = leaves.withColumn("budget", F.expr(f"sum(supply) OVER () * {plan.budget_percent} div 100"))
    level = None
    for i, name in enumerate(names):
        at = leaves.groupBy(*names[: i + 1]).agg((F.sum("supply") * plan.max_epochs).cast("long").alias("most"), F.first("budget").alias("budget")).withColumn("weight", plan.weight(name))
        if level is not None:
            at = at.drop("budget").join(level.select(*names[:i], F.col("given").alias("budget")), names[:i])
        level = fill(at, names[:i], name)
    out = leaves.drop("budget").join(level.select(*names, "given"), names)
    return out.withColumn("epochs", F.expr("CASE WHEN supply > 0 THEN given div supply ELSE 0 END")).withColumn("left", F.expr("given - epochs * supply"))


def order_key(seed: int, epochs: Column, doc_id: Column) -> Column:
    """Hexadecimal digest that orders the documents of a leaf in an epoch."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epochs.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def cuts(docs: DataFrame, plan: Plan) -> DataFrame:
    """A row per leaf: level columns, epochs, cut_slice and cut_key: documents of lesser slices are in the prefix of the
    last epoch, and those of that slice up to the key."""
    names = list(plan.levels)
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    tokens = plan.tokens if plan.tokens is not None else count_words(F.col("text"))
    slim = docs.select(*(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in plan.levels.items()), "doc_id", tokens.alias("n_tokens"))
    slim = materialize(slim, "mix-tokens")
    leaves = slim.groupBy(*names).agg(F.sum("n_tokens").alias("supply"))
    leaves = materialize(leaf_budgets(leaves, plan), "mix-leaves")
    rows = slim.join(small(leaves.select(*names, "epochs", "left")), names)
    rows = rows.withColumn("key", F.concat(order_key(plan.seed, F.col("epochs"), F.col("doc_id")), F.lit("/"), id_text)).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = rows.groupBy(*names, "slice").agg(F.sum("n_tokens").alias("held"), F.first("left").alias("left"))
    upto = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("upto", F.sum("held").over(upto))
    # the slice in which the prefix ends: the first that doesn't fit whole
    split = materialize(slices.where("upto > left").groupBy(*names).agg(F.min(F.struct("slice", (F.col("left") - F.col("upto") + F.col("held")).alias("room"))).alias("s")).select(*names, F.col("s.slice").alias("cut_slice"), F.col("s.room").alias("room")), "mix-splits")
    inside = rows.join(small(split), names).where(F.col("slice") == F.col("cut_slice"))
    upto = Window.partitionBy(*names).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.sum("n_tokens").over(upto)).where("upto <= room").groupBy(*names).agg(F.max("key").alias("cut_key"))
    # a leaf without a split fits whole; one without a key takes nothing of its slice
    out = leaves.select(*names, "supply", "given", "epochs").join(split.drop("room"), names, "left").join(last, names, "left")
    return materialize(out.withColumn("cut_slice", F.coalesce("cut_slice", F.lit("~"))).withColumn("cut_key", F.coalesce("cut_key", F.lit(""))), "mix-cuts")


def _judged(docs: DataFrame, plan: Plan) -> tuple[DataFrame, list[str], str]:
    """docs with their leaf's columns under fresh names, and the name of the number of copies."""
    names = list(plan.levels)
    held = cuts(docs, plan)
    new = fresh(docs.columns, *[f"leaf_{c}" for c in held.columns], "copies")
    leaf = dict(zip(held.columns, new[:-1], strict=True))
    held = held.select(*(F.col(c).alias(n) for c, n in leaf.items()))
    on = None
    for n, c in plan.levels.items():
        same = F.coalesce(c.cast("string"), F.lit("")) == F.col(leaf[n])
        on = same if on is None else on & same
    out = docs.join(small(held), on)
    key = F.concat(order_key(plan.seed, F.col(leaf["epochs"]), F.col("doc_id")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    piece = F.substring(key, 1, SLICE_DIGITS)
    within = (piece < F.col(leaf["cut_slice"])) | ((piece == F.col(leaf["cut_slice"])) & (key <= F.col(leaf["cut_key"])))
    return out.withColumn(new[-1], F.least(F.col(leaf["epochs"]) + within.cast("long"), F.lit(plan.max_epochs).cast("long"))), [leaf[n] for n in names], new[-1]


def copies(docs: DataFrame, plan: Plan) -> DataFrame:
    """A row per row of docs: doc_id, the level columns, copies (how often the mix takes it, 0 for not at all)."""
    out, leaf, times = _judged(docs, plan)
    return out.select("doc_id", *(F.col(c).alias(n) for c, n in zip(leaf, plan.levels, strict=True)), F.col(times).alias("copies"))


def select(docs: DataFrame, plan: Plan) -> DataFrame:
    """The rows of docs that the mix takes, all columns, each as often as it takes them."""
    out, _, times = _judged(docs, plan)
    if plan.max_epochs == 1:
        return out.where(F.col(times) > 0).select(*docs.columns)
    return out.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
