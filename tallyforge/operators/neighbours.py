"""The nearest points of a group, exactly, without comparing all pairs.

A few reference points are chosen, and every point knows its distance to each of them. Points of a group are put in order by
their nearest reference point and its distance, and cut into blocks of about equal size, so that a block holds points that
lie near each other and, for each reference point, the range of their distances. A point's k nearest inside its block bound how
far its k nearest can be at all. Another block is read only where the triangle inequality leaves room: if some point of
the block may be nearer to a reference point, or further from it, by less than that bound. Blocks that meet are dealt into tiles of
some blocks by some others, so that a block is copied once for each tile and not for each block that it meets; what is found
in different tiles is merged by rank, at most k distances from each.

Where all points lie about equally far from each other nothing can be left out; then all pairs of blocks of a group meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..session import cut, ship
from .distances import STRIPE, TILES, distances_at, matrix, squares
from .ranks import held_before

#: Reference points, the rows they are chosen from, points of a block, and blocks that are compared in one slice.
PIVOTS, CHOICE, BLOCK, SLICE = 32, 1024, 512, 1024
#: Share of the largest distance by which rounding may move a difference of distances.
SLACK = 1e-9

DOUBLES = ArrayType(DoubleType())


def reference_points(points: DataFrame, n: int = PIVOTS, choice: int = CHOICE) -> np.ndarray:
    """Up to n rows of points, each the furthest from those before it, out of `choice` rows drawn by a hash of their id.

    Any points are right; far ones leave out more blocks."""
    rows = points.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(choice).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.v for r in rows])
    chosen = [0]
    far = matrix(x, x[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, matrix(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), pa.float64()))


def point_blocks(points: DataFrame, pivots: np.ndarray, k: int, block: int = BLOCK) -> DataFrame:
    """g, block, ids, points, refs (distances to the pivots), tops (each point's k least distances inside the block), kth (their
    greatest; infinite where the block has fewer), lo, hi (ranges of refs), reach (the greatest kth)."""
    spark, block = points.sparkSession, max(block, 2 * k)
    ship(spark)
    schema = StructType(list(points.schema.fields)).add("refs", DOUBLES).add("cell", "integer").add("near", "double")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                to = matrix(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), pivots)
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(to), pa.array(to.argmin(1), pa.int32()), pa.array(to.min(1))], names=[*b.schema.names, "refs", "cell", "near"])

    known = points.mapInArrow(measured, schema)
    placed = cut(held_before(known, ["g", "cell"], [F.col("near"), F.col("id")], name="place"))
    # points whose nearest reference point has few others share the blocks of their group's rest
    sizes = placed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("parcel", F.when(F.col("n") * 2 >= block, F.col("cell")).otherwise(-1))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    cells = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier("g", "parcel", "cell")), F.lit(0)))
    parcels = sizes.groupBy("g", "parcel").agg(F.sum("n").alias("whole")).withColumn("blocks", F.ceil(F.col("whole") / block))
    parcels = parcels.withColumn("first", F.coalesce(F.sum("blocks").over(earlier("g", "parcel")), F.lit(0)))
    dealt = placed.join(cells.join(parcels, ["g", "parcel"]), ["g", "cell"])
    dealt = dealt.withColumn("block", (F.col("first") + F.floor((F.col("place") + F.col("before")) * F.col("blocks") / F.col("whole"))).cast("int"))
    held = dealt.groupBy("g", "block").agg(F.collect_list(F.struct("id", "v", "refs")).alias("p"))
    held = held.select("g", "block", F.col("p.id").alias("ids"), F.flatten("p.v").alias("points"), F.flatten("p.refs").alias("refs"))
    out = StructType(list(held.schema.fields)).add("tops", ArrayType(DOUBLES)).add("kth", DOUBLES).add("lo", DOUBLES).add("hi", DOUBLES).add("reach", "double")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                n = len(one.column("ids")[0])
                x, refs = (one.column(c)[0].values.to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("points", "refs"))
                top = np.sort(matrix(x, x), axis=1)[:, :k]
                kth = top[:, -1] if n >= k else np.full(n, np.inf)
                tops = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), _lists(top))
                more = [tops, *(_lists(v[None, :]) for v in (kth, refs.min(0), refs.max(0))), pa.array([kth.max()])]
                yield pa.RecordBatch.from_arrays([*one.columns, *more], names=out.names)

    return cut(held.mapInArrow(inside, out))


def _gap(lo: str, hi: str, other_lo: str, other_hi: str) -> Column:
    """How far apart points of two blocks are at least."""
    over, under = F.zip_with(lo, other_hi, lambda a, b: a - b), F.zip_with(other_lo, hi, lambda a, b: a - b)
    return F.array_max(F.zip_with(over, under, lambda a, b: F.greatest(a, b))) - SLACK * F.greatest(F.array_max(F.col(hi)), F.array_max(F.col(other_hi)))


def meetings(blocks: DataFrame) -> DataFrame:
    """g, block, b: the blocks b in which points of a block may have nearer neighbours. Only ranges are compared, in slices of a
    group, so that no task holds a whole group's."""
    last = blocks.agg(F.max("block")).first()[0] or 0
    a = blocks.where("reach > 0").select("g", "block", "lo", "hi", "reach", F.floor(F.col("block") / SLICE).alias("slice"))
    b = blocks.select(F.col("g").alias("of"), F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(F.sequence(F.lit(0), F.lit(last // SLICE))).alias("in"))
    met = a.join(b, (F.col("g") == F.col("of")) & (F.col("slice") == F.col("in")) & (F.col("block") != F.col("b")) & (_gap("lo", "hi", "lo_b", "hi_b") < F.col("reach")))
    return cut(met.select("g", "block", "b"))


def nearest(df: DataFrame, row_id: str, vector: str, k: int, by: str | None = None, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """row_id, dists: the k least distances of each point to points of its group, itself included, in order; fewer where the
    group has fewer. Rows without group, id or vector have no neighbours and are left out; vectors are equally long. Of copies
    every row counts as a point; rows that share an id have one result, of all of them."""
    group = F.col(by) if by else F.lit(0)
    points = df.select(group.alias("g"), F.col(row_id).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("g IS NOT NULL AND id IS NOT NULL AND v IS NOT NULL")
    held = point_blocks(points, reference_points(points, pivots), k, block)
    met = meetings(held)
    tasks = TILES * held.sparkSession.sparkContext.defaultParallelism
    width = min(STRIPE, max(1, math.ceil(math.sqrt(met.count() / tasks))))
    tiles = met.select("g", "block", "b", F.floor(F.col("block") / width).alias("s"), F.floor(F.col("b") / width).alias("t"))
    asking = tiles.groupBy("g", "s", "t", "block").agg(F.collect_list("b").alias("asks")).join(held.select("g", "block", "ids", "points", "refs", "kth"), ["g", "block"])
    asked = tiles.select("g", "s", "t", F.col("b").alias("block")).distinct().join(held.select("g", "block", "points", "lo", "hi"), ["g", "block"])
    sides = asking.unionByName(asked, allowMissingColumns=True).repartition(tasks, "g", "s", "t")
    id_type = held.schema["ids"].dataType.elementType
    ids_arrow = to_arrow_type(id_type)
    floats = lambda v: v.values.to_numpy(zero_copy_only=False)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        those, others = [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                at = {c: batch.column(c)[i] for c in batch.schema.names}
                if at["ids"].is_valid:
                    those.append(at)
                else:
                    others[at["block"].as_py()] = floats(at["points"]), floats(at["lo"]), floats(at["hi"])
        for at in those:
            kth, refs = floats(at["kth"]), floats(at["refs"]).reshape(len(at["ids"]), -1)
            x = floats(at["points"]).reshape(len(kth), -1)
            of_x, slack = np.einsum("ij,ij->i", x, x), (8 * x.shape[1] + 32) * np.finfo(float).eps
            best, room = np.full((len(x), k), np.inf), kth
            for number in at["asks"].as_py():
                y, lo, hi = others[number]
                y = y.reshape(-1, x.shape[1])
                gap = np.maximum(refs - hi, lo - refs).max(1) - SLACK * max(refs.max(), hi.max())
                open_ = np.flatnonzero(gap < room)
                if not len(open_):
                    continue
                of_y = np.einsum("ij,ij->i", y, y)
                # products may be off by a rounding: what may be near enough is computed again
                near = squares(x[open_], y, of_x[open_], of_y) <= (room[open_] ** 2 + slack * max(of_x.max(), of_y.max()))[:, None]
                i, _, d = distances_at(x[open_], y, near)
                order = np.lexsort((d, i))
                i, d = i[order], d[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                found = np.full((len(open_), k), np.inf)
                found[i[place < k], place[place < k]] = d[place < k]
                best[open_] = np.sort(np.concatenate([best[open_], found], 1), axis=1)[:, :k]
                room = np.minimum(kth, best[:, -1])
            nearer = best < kth[:, None]
            n = nearer.sum(1)
            dists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[n > 0])], pa.int32()), pa.array(best[nearer], pa.float64()))
            yield pa.RecordBatch.from_arrays([at["ids"].values.take(pa.array(np.flatnonzero(n))).cast(ids_arrow), dists], names=["id", "dists"])

    found = sides.groupBy("g", "s", "t").applyInArrow(across, StructType().add("id", id_type).add("dists", DOUBLES))
    own = held.select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("tops").alias("dists"))).alias("p")).select("p.id", F.col("p.dists").alias("dists"))
    each = own.unionByName(found).select("id", F.explode("dists").alias("d"))
    best = each.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("d"))).where(F.col("rn") <= k)
    return best.groupBy(F.col("id").alias(row_id)).agg(F.sort_array(F.collect_list("d")).alias("dists"))
