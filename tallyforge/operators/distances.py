"""Distances inside classes, block of points against block of points, without a table of all pairs.

Points of a class are dealt into blocks by a hash of their id, and a block is one row that holds its points as arrays. Blocks of
a class lie in stripes, and a task holds two stripes, whose blocks meet there two at a time; so a block is copied once for each
stripe of its class, of which there are about as many as keep all tasks busy, and more only where a stripe would be too large.
A matrix of distances is never stored: it is counted into buckets, or filtered. An exact percentile of all distances comes from
counts alone: buckets are refined around its place until few values are left, which are then read.

Counts and filters look at squares that come from one matrix product and may be off by a rounding, whose bound is known. What
lies within that bound of a limit is computed again, dimension by dimension, and so is every distance that is returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut, ship

#: Points of a block, buckets of a refinement, and values that are read once so few are left.
BLOCK, BUCKETS, FEW = 512, 4096, 20_000
#: Blocks of a stripe at most, which bounds what a task holds, and tiles (two stripes) for each core.
STRIPE, TILES = 64, 8


def point_blocks(df: DataFrame, label: str, row_id: str, vector: str, block: int = BLOCK) -> DataFrame:
    """label, block, ids, points (one array after the other): about `block` points of a class in each row."""
    sizes = df.groupBy(F.col(label).alias("__of")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__blocks"))
    points = df.select(label, F.col(row_id).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    dealt = points.join(sizes, F.col(label).eqNullSafe(F.col("__of"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int"))
    held = dealt.groupBy(label, "block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("p"))
    return cut(held.select(label, "block", F.col("p.id").alias("ids"), F.flatten("p.v").alias("points")))


class Scale(NamedTuple):
    """What all passes over some blocks share: blocks of a stripe, tasks, and how far a square may be off or can be at most."""

    width: int
    tasks: int
    slack: float
    most: float


def _scale(blocks: DataFrame, label: str) -> Scale:
    n = TILES * blocks.sparkSession.sparkContext.defaultParallelism
    sizes = blocks.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    met = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _blocks(batch):
                held = b.squares[np.isfinite(b.squares)]
                yield pa.record_batch([pa.array([b.x.shape[1]], pa.int32()), pa.array([held.max() if len(held) else 0.0])], names=["dims", "far"])

    ship(blocks.sparkSession)
    dims, far = blocks.mapInArrow(longest, "dims int, far double").agg(F.max("dims"), F.max("far")).first()
    width = min(STRIPE, max(1, math.ceil(math.sqrt(met / (2 * n)))))
    far = far or 0.0
    return Scale(width, n, (8 * (dims or 0) + 32) * np.finfo(float).eps * far, 4 * far)


class Block(NamedTuple):
    name: object
    number: int
    own_ids: pa.Array
    ids: np.ndarray
    x: np.ndarray
    squares: np.ndarray


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    label = batch.schema.names[0]
    for i in range(batch.num_rows):
        held = at["ids"][i].values
        ids = held.to_numpy(zero_copy_only=False) if pa.types.is_integer(held.type) else np.array(held.to_pylist())
        x = at["points"][i].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        yield Block(at[label][i].as_py(), at["block"][i].as_py(), held, ids, x, np.einsum("ij,ij->i", x, x))


def matrix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of every point of x to every point of y, summed dimension by dimension."""
    total = np.zeros((len(x), len(y)))
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    step = max(1, 32_768 // max(1, len(y)))  # so many rows stay in a core's cache
    for r in range(0, len(x), step):
        held = total[r : r + step]
        apart = np.empty_like(held)
        for d in range(x.shape[1]):
            np.subtract(xt[d, r : r + step, None], yt[d][None, :], out=apart)
            np.multiply(apart, apart, out=apart)
            held += apart
    return np.sqrt(total, out=total)


def squares(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray) -> np.ndarray:
    """About the squares of the distances; of_x and of_y are the squares of the points themselves."""
    out = x @ y.T
    out *= -2
    out += of_x[:, None]
    out += of_y[None, :]
    return out


def distances_at(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of mask in both sides, and their distances, the same as in matrix()."""
    i, j = np.nonzero(mask)
    if 8 * len(i) > mask.size:
        return i, j, matrix(x, y)[i, j]
    total = np.zeros(len(i))
    for d in range(x.shape[1]):
        apart = x[i, d] - y[j, d]
        total += apart * apart
    return i, j, np.sqrt(total)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Block, np.ndarray, np.ndarray | None]]:
    """Two blocks of a tile, their squares, and where both are one block which are pairs of their own (src < dst, each once)."""
    sides: dict[int, list[Block]] = {}
    for batch in batches:
        at = [batch.schema.names.index(n) for n in ("stripe", "s", "t")]
        for i, b in enumerate(_blocks(batch)):
            stripe, s, t = (batch.column(k)[i].as_py() for k in at)
            sides.setdefault(stripe, []).append(b)
    for a in sides.get(s, []):
        for b in sides.get(t, []):
            if s != t or a.number <= b.number:
                yield a, b, squares(a.x, b.x, a.squares, b.squares), a.ids[:, None] < b.ids[None, :] if a.number == b.number else None


def _mapped(blocks: DataFrame, label: str, scale: Scale, each: Callable, schema: str) -> DataFrame:
    """What each(pairs) yields for every two stripes of a class, a stripe with itself too."""
    ship(blocks.sparkSession)
    sizes = blocks.groupBy(F.col(label).alias("__of")).agg((F.floor(F.max("block") / scale.width)).cast("int").alias("__last"))
    dealt = blocks.join(sizes, F.col(label) == F.col("__of")).withColumn("stripe", F.floor(F.col("block") / scale.width).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), "__last")))
    tiles = dealt.select(label, "block", "ids", "points", "stripe", F.least("stripe", "__other").alias("s"), F.greatest("stripe", "__other").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(_pairs(batches))

    return tiles.repartition(scale.tasks, label, "s", "t").groupBy(label, "s", "t").applyInArrow(run, schema)


def _table(name, of: pa.DataType, ids: pa.DataType, src: np.ndarray, dst: np.ndarray, dist: np.ndarray, label: str) -> pa.RecordBatch:
    array = lambda v: pa.array(v, ids) if v.dtype.kind in "iu" else pa.array(v.tolist(), ids)
    return pa.record_batch([pa.array([name], of).take(pa.array(np.zeros(len(src), np.int64))), array(src), array(dst), pa.array(dist)], names=[label, "src", "dst", "dist"])


def _edges(blocks: DataFrame, label: str) -> tuple[pa.DataType, pa.DataType, str]:
    """Arrow types of class and id, and the schema of a table of pairs."""
    name_type, id_type = (blocks.schema[c].dataType for c in (label, "ids"))
    id_kind = id_type.elementType.simpleString()
    return to_arrow_type(name_type), to_arrow_type(id_type.elementType), f"`{label}` {name_type.simpleString()}, src {id_kind}, dst {id_kind}, dist double"


def close_pairs(blocks: DataFrame, label: str, limit: float) -> DataFrame:
    """label, src, dst, dist of the pairs of a class at most so far apart, src < dst."""
    of, ids, schema = _edges(blocks, label)
    scale = _scale(blocks, label)
    top = limit * limit + scale.slack if limit >= 0 else -math.inf

    def each(pairs) -> Iterator[pa.RecordBatch]:
        for a, b, square, own in pairs:
            near = square <= top
            i, j, d = distances_at(a.x, b.x, near if own is None else near & own)
            i, j, d = (v[d <= limit] for v in (i, j, d))
            if len(d):
                u, v = a.ids[i], b.ids[j]
                swap = v < u
                yield _table(a.name, of, ids, np.where(swap, v, u), np.where(swap, u, v), d, label)

    return _mapped(blocks, label, scale, each, schema)


def _forest(n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which edges are in the minimum spanning forest of points 0..n-1, by (d, least end, other end), and each point's tree."""
    order = np.lexsort((np.maximum(u, v), np.minimum(u, v), d))
    u, v = u[order], v[order]
    tree, live, kept = np.arange(n), np.arange(len(u)), []
    while True:
        a, b = tree[u[live]], tree[v[live]]
        live, a, b = live[a != b], a[a != b], b[a != b]
        if not len(live):
            return order[np.concatenate(kept)] if kept else order[:0], tree
        least = np.full(n, len(u))
        np.minimum.at(least, a, live)
        np.minimum.at(least, b, live)
        roots = np.flatnonzero(least < len(u))
        e = least[roots]
        kept.append(np.unique(e))
        a, b = tree[u[e]], tree[v[e]]
        to = np.where(a == roots, b, a)
        parent = np.arange(n)
        parent[roots] = to
        parent[roots[(parent[to] == roots) & (roots < to)]] = roots[(parent[to] == roots) & (roots < to)]
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        tree = parent[tree]


def light_edges(blocks: DataFrame, label: str, limit: float) -> DataFrame:
    """label, src, dst, dist of the edges of at most limit that are in the minimum spanning forest of some two stripes. The forest
    of the class has no others; of two stripes they are fewer than their points, so pairs are never rows.

    A task keeps a forest of what it has seen. Points that lighter edges connect already need no heavier one, so distances
    beyond nearly all of the forest's are only looked at between points that it doesn't connect so far down."""
    of, ids, schema = _edges(blocks, label)
    scale = _scale(blocks, label)
    top = limit * limit + scale.slack if limit >= 0 else -math.inf

    def each(pairs) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        names: list[np.ndarray] = []
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        more: list[tuple] = []
        count, near, tree, name = 0, math.inf, np.zeros(0, np.int64), None

        def numbers(b: Block) -> np.ndarray:
            if b.number not in known:
                known[b.number] = np.arange(count, count + len(b.ids))
                names.append(b.ids)
            return known[b.number]

        def settle() -> None:
            nonlocal held, more, near, tree
            at = np.concatenate(names)
            _, rank = np.unique(at, return_inverse=True)  # ends in order of ids; rows that share an id are one point
            u, v, d = (np.concatenate([h, *(m[k] for m in more)]) for k, h in enumerate(held))
            kept, _ = _forest(len(at), rank[u], rank[v], d)
            held, more = [u[kept], v[kept], d[kept]], []
            near = np.partition(held[2], k := int(0.98 * len(kept)))[k] if len(kept) else math.inf
            low = held[2] <= near
            tree = _forest(len(at), rank[held[0][low]], rank[held[1][low]], held[2][low])[1][rank]

        for a, b, square, own in pairs:
            name = a.name
            i = numbers(a)
            count = sum(map(len, names))
            j = numbers(b)
            count = sum(map(len, names))
            if len(tree) < count:
                tree = np.r_[tree, np.arange(len(tree), count) + (tree.max() + 1 if len(tree) else 0)]
            want = square <= top
            if near < math.inf:
                want &= (square <= near * near + scale.slack) | (tree[i][:, None] != tree[j][None, :])
            k, m, d = distances_at(a.x, b.x, want if own is None else want & own)
            k, m, d = (x[d <= limit] for x in (k, m, d))
            more.append((i[k], j[m], d))
            if sum(len(x[2]) for x in more) > max(500_000, 4 * count):
                settle()
        if names and sum(len(x[2]) for x in more):
            settle()
        if len(held[2]):
            at = np.concatenate(names)
            u, v = at[held[0]], at[held[1]]
            swap = v < u
            yield _table(name, of, ids, np.where(swap, v, u), np.where(swap, u, v), held[2], label)

    return _mapped(blocks, label, scale, each, schema)


def forest_of(edges: DataFrame, label: str) -> DataFrame:
    """The minimum spanning forest of each class's edges (label, src, dst, dist), a class in a task: for few edges a class."""

    def each(t: pa.Table) -> pa.Table:
        src, dst, d = (t.column(c).to_numpy() for c in ("src", "dst", "dist"))
        _, rank = np.unique(np.concatenate([src, dst]), return_inverse=True)
        kept, _ = _forest(len(rank), rank[: len(src)], rank[len(src) :], d)
        return t.take(pa.array(kept))

    ship(edges.sparkSession)
    return edges.groupBy(label).applyInArrow(each, edges.schema)


def _counted(blocks: DataFrame, label: str, scale: Scale, low: float, high: float) -> tuple[int, np.ndarray]:
    """How many squares lie below low, and in each of BUCKETS parts of low..high, high included; all within the slack."""
    buckets = BUCKETS

    def each(pairs) -> Iterator[pa.RecordBatch]:
        n, below = np.zeros(buckets, np.int64), 0
        for _, _, square, own in pairs:
            v = square.ravel() if own is None else square[own]
            inside = v[(v >= low) & (v <= high)]
            below += int((v < low).sum())
            inside -= low
            inside *= buckets / (high - low)
            n += np.bincount(np.minimum(inside.astype(np.int64), buckets - 1), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[below, n[at]], pa.int64())], names=["bucket", "n"])

    out, below = np.zeros(buckets, np.int64), 0
    for r in _mapped(blocks, label, scale, each, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            below = r.n
        else:
            out[r.bucket] = r.n
    return below, out


def _at(blocks: DataFrame, label: str, scale: Scale, places: list[int], low: float, high: float) -> list[float]:
    """The distances at places of all of them in order, from 0, if their squares lie in low..high; reads distinct values with counts."""

    def each(pairs) -> Iterator[pa.RecordBatch]:
        found, below = [np.zeros(0)], 0
        for a, b, square, own in pairs:
            own = True if own is None else own
            below += int(((square < low - scale.slack) & own).sum())
            found.append(np.asarray(distances_at(a.x, b.x, (square >= low - scale.slack) & (square <= high + scale.slack) & own)[2]))
            if sum(map(len, found)) > 1_000_000:
                yield counted(found)
                found = [np.zeros(0)]
        yield counted(found)
        yield pa.record_batch([pa.array([-1.0]), pa.array([below], pa.int64())], names=["d", "n"])

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        v, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.record_batch([pa.array(v), pa.array(n, pa.int64())], names=["d", "n"])

    held = sorted(_mapped(blocks, label, scale, each, "d double, n long").groupBy("d").agg(F.sum("n").alias("n")).collect())
    ends = np.cumsum([r.n for r in held])
    return [held[int(np.searchsorted(ends, place, "right"))].d for place in places]


def _placed(blocks: DataFrame, label: str, scale: Scale, places: list[int], low: float, high: float, below: int, n: np.ndarray) -> list[float]:
    """The distances at one place or two next to each other: the range of their squares shrinks to their buckets until few are
    left, or only numbers that differ by a rounding, however often they are there."""
    while True:
        k = np.minimum(np.searchsorted(below + np.cumsum(n), places, "right"), len(n) - 1)
        width, held = (high - low) / len(n), int(n[k[0] : k[-1] + 1].sum())
        before = high - low
        # the order of true squares is that of the counted ones but for the slack
        low, high = low + k[0] * width - width * 1e-9 - scale.slack, low + (k[-1] + 1) * width + width * 1e-9 + scale.slack
        if held <= FEW or high - low <= max(8 * scale.slack, 8 * np.spacing(high)):
            return _at(blocks, label, scale, places, low, high)
        if len(places) > 1 and high - low > before / 2:  # far from each other
            return [x for p in places for x in _placed(blocks, label, scale, [p], low, high, *_counted(blocks, label, scale, low, high))]
        if high - low > 0.9 * before:
            return _at(blocks, label, scale, places, low, high)
        below, n = _counted(blocks, label, scale, low, high)


def distance_quantile(blocks: DataFrame, label: str, at: float) -> float | None:
    """The percentile of the distances of all pairs inside classes, in proportion between the two nearest; None without pairs."""
    scale = _scale(blocks, label)
    low, high = -scale.slack - 1e-300, scale.most + 2 * scale.slack + 1e-300
    below, held = _counted(blocks, label, scale, low, high)
    n = int(held.sum())
    if not n:
        return None
    place = (n - 1) * at
    found = _placed(blocks, label, scale, sorted({math.floor(place), math.ceil(place)}), low, high, below, held)
    a, b = found[0], found[-1]
    return a + (b - a) * (place - math.floor(place))
