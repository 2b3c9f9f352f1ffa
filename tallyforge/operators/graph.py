"""Distances, neighbours, spanning trees and projections of vectors."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame

from ..session import cut
from . import distances, neighbours


#: Edges of a class that a task may hold; the forest of more is found by joins, round by round.
FOREST_EDGES = 2_000_000


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def class_pairs(df: DataFrame, label: str, row_id: str, vector: str) -> DataFrame:
    """label, src, dst, dist for every two points of a class, src < dst. As many rows as the classes have pairs: callers
    hand in the points to compare, not a whole corpus."""
    a = df.select(label, F.col(row_id).alias("src"), F.col(vector).alias("u"))
    b = df.select(label, F.col(row_id).alias("dst"), F.col(vector).alias("v"))
    return a.join(b, label).where("src < dst").select(label, "src", "dst", distance(F.col("u"), F.col("v")).alias("dist"))


def proximity(df: DataFrame, label: str, row_id: str, vector: str, at: float) -> DataFrame:
    """The class pairs at most as far apart as that percentile of all of them; only these pairs are ever rows."""
    blocks = distances.point_blocks(df, label, row_id, vector)
    limit = distances.distance_quantile(blocks, label, at)
    return distances.close_pairs(blocks, label, -1.0 if limit is None else limit)


def class_forest(df: DataFrame, label: str, row_id: str, vector: str, at: float) -> DataFrame:
    """The minimum spanning forest of proximity(), from the few of its edges that can be in it."""
    blocks = distances.point_blocks(df, label, row_id, vector)
    limit = distances.distance_quantile(blocks, label, at)
    edges = cut(distances.light_edges(blocks, label, -1.0 if limit is None else limit))
    sizes = cut(edges.groupBy(F.col(label).alias("__of")).agg((F.count(F.lit(1)) <= FOREST_EDGES).alias("__few")))
    dealt = edges.join(F.broadcast(sizes), F.col(label) == F.col("__of"))
    few, many = (dealt.where(w).select(label, "src", "dst", "dist") for w in ("__few", "not __few"))
    found = distances.forest_of(few, label)
    return found if sizes.where("not __few").isEmpty() else found.unionByName(spanning_forest(cut(many), label))


def spanning_forest(edges: DataFrame, label: str, most_rounds: int = 40) -> DataFrame:
    """label, src, dst, dist of the minimum spanning forest of each class, by Boruvka's rounds.

    Each round every tree takes its least edge to another, by (dist, src, dst); trees then take the least point of those
    they join. Rounds are as many as the logarithm of the number of points.
    """
    points = edges.select(label, F.col("src").alias("id")).unionByName(edges.select(label, F.col("dst").alias("id"))).distinct()
    tree = cut(points.withColumn("root", F.col("id")))
    taken = edges.select(label, "src", "dst", "dist").where(F.lit(False))
    for _ in range(most_rounds):
        of = lambda side: tree.select(label, F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
        open_ = edges.join(of("src"), [label, "src"]).join(of("dst"), [label, "dst"]).where("root_src != root_dst")
        ends = open_.select(label, "src", "dst", "dist", "root_src", "root_dst", F.explode(F.array("root_src", "root_dst")).alias("root"))
        least = ends.groupBy(label, "root").agg(F.min(F.struct("dist", "src", "dst", "root_src", "root_dst")).alias("e")).select(label, "root", "e.*")
        least = cut(least)
        if least.isEmpty():
            return taken
        taken = cut(taken.unionByName(least.select(label, "src", "dst", "dist").distinct()))
        links = least.select(label, F.col("root_src").alias("a"), F.col("root_dst").alias("b"))
        tree = cut(_relabel(tree, links, label))
    raise RuntimeError("the spanning forest did not settle")


def _relabel(tree: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """tree with the roots that links join replaced by the least of them."""
    names = tree.select(label, F.col("root").alias("node")).distinct().withColumn("to", F.col("node"))
    both = links.unionByName(links.select(label, F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        near = both.join(names.select(label, F.col("node").alias("b"), F.col("to").alias("near")), [label, "b"]).groupBy(label, F.col("a").alias("node")).agg(F.min("near").alias("near"))
        new = cut(names.join(near, [label, "node"], "left").select(label, "node", F.least("to", F.coalesce("near", "to")).alias("new"), "to"))
        changed = not new.where("new != to").isEmpty()
        names = new.select(label, "node", F.col("new").alias("to"))
        if not changed:
            return tree.join(names, (tree["root"] == names["node"]) & tree[label].eqNullSafe(names[label])).select(tree[label], "id", F.col("to").alias("root"))


def neighbour_density(df: DataFrame, row_id: str, vector: str, k: int = 10, by: str | None = None) -> DataFrame:
    """row_id, avg_dist (to the k nearest points of the group, itself included), density."""
    near = neighbours.nearest(df, row_id, vector, k, by)
    mean = F.aggregate("dists", F.lit(0.0), lambda s, d: s + d) / F.size("dists")
    return near.select(row_id, mean.alias("avg_dist")).withColumn("density", 1 / (F.col("avg_dist") + 1e-8))


def pca(df: DataFrame, vector: str, k: int = 3) -> tuple[DataFrame, list[float]]:
    """df with components (array) of centred vectors, and the shares of variance they explain."""
    size = F.size(vector)
    means = df.select(F.posexplode(vector).alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m"))
    centre = means.agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("c"))  # one number a dimension
    centred = df.crossJoin(F.broadcast(centre)).withColumn("__v", array_to_vector(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(vector, i).cast("double") - F.get("c", i)["m"]))).drop("c")
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(centred)
    from pyspark.ml.functions import vector_to_array

    return model.transform(centred).withColumn("components", vector_to_array("__p")).drop("__v", "__p"), [float(x) for x in model.explainedVariance]
