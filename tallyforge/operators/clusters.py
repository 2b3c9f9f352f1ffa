"""Clusters inside classes, all classes in one plan a round.

Rows are packed once into blocks of points of a class and dealt over all tasks by their ids. A round reads the blocks once,
whatever the number of classes: tasks hold every class's centres, meet each block with those of its class, and give one partial sum for each (class, centre), which are added up. What reaches the driver are centres, that is
classes times clusters vectors; tables of classes whose centres take more than CENTRE_BYTES are clustered slice by slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructType

from ..session import cut, ship, tasks_for
from .distances import matrix

CENTRE_BYTES = 64 << 20
#: What the usual k-means stops at.
ROUNDS, SHIFT = 20, 1e-4


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class in a batch of k, id, x: k, ids, x (one vector after the other)."""
    for batch in batches:
        if batch.num_rows:
            k = batch.column("k").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(k), -1)
            order = np.argsort(k, kind="stable")
            kinds, first = np.unique(k[order], return_index=True)
            ends = np.append(first, len(k))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), batch.column("id").take(pa.array(order)))
            flat = pa.ListArray.from_arrays(pa.array(ends * x.shape[1], pa.int32()), pa.array(x[order].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), ids, flat], names=["k", "ids", "x"])


def packed(df: DataFrame, tasks: int) -> DataFrame:
    """k, ids, x: blocks of points of a class, out of k, id, x. Rows are dealt by id first, so that tasks have about as many
    points each, however few the classes are or the parts that df is read in; what the rounds read is kept by a checkpoint."""
    schema = StructType().add("k", "integer").add("ids", ArrayType(df.schema["id"].dataType)).add("x", ArrayType(DoubleType()))
    return cut(df.repartition(tasks, "id").mapInArrow(_packed, schema))


def _blocks(batches: Iterator[pa.RecordBatch], centres: list[np.ndarray]) -> Iterator[tuple]:
    """Batch, row in the batch, class, ids, vectors, and distances to the class's centres."""
    for batch in batches:
        k, ids, points = batch.column("k").to_numpy(), batch.column("ids"), batch.column("x")
        for i, c in enumerate(k.tolist()):
            x = points[i].values.to_numpy(zero_copy_only=False).reshape(len(ids[i]), -1)
            yield batch, i, c, ids[i].values, x, matrix(x, centres[c]) if len(centres[c]) else np.zeros((len(x), 0))


def _one_each(rows: DataFrame, centres: list[np.ndarray], race: Callable[[Column], Column]) -> list:
    """k, x of one row of each class that lies apart from its centres, drawn with chances by its squared distance to them."""

    def least(batches):
        for batch, i, c, ids, x, d in _blocks(batches, centres):
            u = batch.column("u")[i].values.to_numpy()
            # before there is a centre all rows have the same chance
            far = (d.min(1) ** 2) if d.shape[1] else np.ones(len(x))
            apart = np.flatnonzero(far > 0)
            if len(apart):
                key = -np.log(u[apart]) / far[apart]
                first = apart[key == key.min()]  # equal draws are told apart by id
                of = [pa.array([c] * len(first), pa.int32()), ids.take(pa.array(first)), pa.array(list(x[first])), pa.array([float(key.min())] * len(first))]
                yield pa.RecordBatch.from_arrays(of, names=["k", "id", "x", "race"])

    schema = StructType().add("k", "integer").add("id", _id_type(rows)).add("x", ArrayType(DoubleType())).add("race", "double")
    drawn = rows.withColumn("u", F.transform("ids", race))
    held = drawn.mapInArrow(least, schema).groupBy("k").agg(F.min(F.struct("race", "id", "x")).alias("m"))
    return held.select("k", "m.x").collect()


def _id_type(rows: DataFrame) -> DataType:
    return rows.schema["ids"].dataType.elementType


def _uniform(row_id: Column, seed: int, t: int) -> Column:
    """Between 0 and 1, by a hash."""
    return (F.pmod(F.xxhash64(row_id, F.lit(seed), F.lit(t)), F.lit(2**52)).cast("double") + 0.5) / F.lit(float(2**52))


def seeds(rows: DataFrame, classes: int, n: int, seed: int) -> list[np.ndarray]:
    """Up to n centres of each class, drawn one after the other, all classes at once; fewer where a class has fewer points."""
    centres = [np.zeros((0, 0))] * classes
    for t in range(n):
        for r in _one_each(rows, centres, lambda i: _uniform(i, seed, t)):  # noqa: B023
            one = np.array(r.x)[None, :]
            centres[r.k] = np.vstack([centres[r.k], one]) if len(centres[r.k]) else one
    return centres


def moved(rows: DataFrame, centres: list[np.ndarray]) -> list[np.ndarray]:
    """The centres after one round: each the mean of the rows nearest to it; one without rows stays."""

    def sums(batches):
        total, count = [np.zeros_like(c) for c in centres], [np.zeros(len(c), np.int64) for c in centres]
        for _, _, c, _, x, d in _blocks(batches, centres):
            to, n = d.argmin(1), len(centres[c])
            count[c] += np.bincount(to, minlength=n)
            for j, column in enumerate(x.T):
                total[c][:, j] += np.bincount(to, column, n)
        for c, n in enumerate(count):
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at]), pa.array(total[c][at].tolist())], names=["k", "c", "n", "s"])

    # partial sums of a task are added up by lanes of tasks, then by centre
    held = rows.mapInArrow(sums, "k int, c int, n long, s array<double>").groupBy("k", "c", F.pmod(F.spark_partition_id(), F.lit(64)).alias("lane"))
    zero = F.transform(F.get(F.collect_list("s"), 0), lambda x: F.lit(0.0))
    part = held.agg(F.sum("n").alias("n"), F.aggregate(F.collect_list("s"), zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("s"))
    out = [c.copy() for c in centres]
    totals: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for r in part.toLocalIterator():
        n, s = totals.get((r.k, r.c), (0, 0.0))
        totals[r.k, r.c] = n + r.n, s + np.array(r.s)
    for (k, c), (n, s) in totals.items():
        out[k][c] = s / n
    return out


def nearest_rows(rows: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """k, c, id: the row of each cluster that lies nearest to its centre, the least id of equal ones."""

    def least(batches):
        for _, _, c, ids, _, d in _blocks(batches, centres):
            to, dist = d.argmin(1), d.min(1)
            nearest = np.full(d.shape[1], np.inf)
            np.minimum.at(nearest, to, dist)
            at = np.flatnonzero(dist == nearest[to])
            of = [pa.array([c] * len(at), pa.int32()), ids.take(pa.array(at)), pa.array(to[at], pa.int32()), pa.array(dist[at])]
            yield pa.RecordBatch.from_arrays(of, names=["k", "id", "c", "d"])

    schema = StructType().add("k", "integer").add("id", _id_type(rows)).add("c", "integer").add("d", "double")
    return rows.mapInArrow(least, schema).groupBy("k", "c").agg(F.min(F.struct("d", "id")).alias("m")).select("k", "c", "m.id")


def clustered(rows: DataFrame, start: list[np.ndarray], rounds: int = ROUNDS, shift: float = SHIFT) -> list[np.ndarray]:
    """Centres after so many rounds, or once none moves further than shift."""
    centres = start
    for _ in range(rounds):
        new = moved(rows, centres)
        far = max((float(np.sqrt(((a - b) ** 2).sum(1)).max()) for a, b in zip(new, centres, strict=True) if len(a)), default=0.0)
        centres = new
        if far <= shift:
            break
    return centres


def diverse_per_class(df: DataFrame, label: str, row_id: str, vector: str, n: int, seed: int = 42, rounds: int = ROUNDS, start: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """label, row_id: of each class the rows nearest to the centres of n clusters, each once; whole classes of up to n rows.

    start picks the rows that clusters begin from, at most n of a class, out of (label, row_id, ...); without it they are drawn
    apart from each other by a seed. Rows without vector are left out; a null label is a class. Results don't depend on partitions
    but for the last digits of sums."""
    ship(df.sparkSession)
    df = df.where(F.col(vector).isNotNull() & F.col(row_id).isNotNull())
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("dims")).orderBy(label).collect()
    small = df.join(_numbered(df, label, [r for r in sizes if r.n <= n]), F.col(label).eqNullSafe(F.col("__of"))).select(label, row_id)
    large = [r for r in sizes if r.n > n]
    step = max(1, CENTRE_BYTES // max(1, 8 * n * max((r.dims for r in large), default=1)))
    for i in range(0, len(large), step):
        some = large[i : i + step]
        names = _numbered(df, label, some)
        numbered = df.join(names, F.col(label).eqNullSafe(F.col("__of")))
        vectors = lambda rows: rows.select(F.col("__k").alias("k"), F.col(row_id).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
        rows = packed(vectors(numbered), tasks_for(df.sparkSession, sum(r.n for r in some), 8 * (1 + max(r.dims for r in some))))
        if start is None:
            begin = seeds(rows, len(some), n, seed)
        else:
            first = vectors(start(df).join(names, F.col(label).eqNullSafe(F.col("__of")))).orderBy("k", "id").collect()
            begin = [np.array([r.x for r in first if r.k == k]) for k in range(len(some))]
        near = nearest_rows(rows, clustered(rows, begin, rounds)).select("k", "id").distinct()
        small = small.unionByName(near.join(names, F.col("k") == F.col("__k")).select(F.col("__of").alias(label), F.col("id").alias(row_id)))
    return small


def _numbered(df: DataFrame, label: str, classes: list) -> DataFrame:
    """__of, __k: classes by number."""
    kind = df.schema[label].dataType
    schema = StructType().add("__of", kind).add("__k", "integer", False)
    # the classes are on the driver already; joined by a shuffle, rows would lie in as many tasks as there are classes
    return F.broadcast(df.sparkSession.createDataFrame([(r[label], k) for k, r in enumerate(classes)], schema))
