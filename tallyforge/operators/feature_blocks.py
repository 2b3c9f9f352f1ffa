"""The pairwise count model for hundreds of features: blocks of features against blocks, in arrays.

With n features there are n (n - 1) / 2 tables of cells, far too many for a join or a struct each. Features are dealt into
blocks, and rows into shards that hold their bins as arrays, a row of the table for each shard and block. A task takes a
shard and a lane, which is a share of the pairs of blocks; it counts a pair of blocks with one bincount, and scores its rows by
looking their cells up in one array for each pair of blocks. So rows are repeated for lanes, as many as keep the cluster busy,
and not for pairs of features.

The counts of a pair of blocks are one packed row: a, b, keys (cell and class, rising), counts and weights. A cell of
features f of block a and g of block b, with bins x and y, has the number (f * bins + x) * side + g * bins + y, where side is
block width times bins; its key is that number times the number of classes, plus class - 1. Counts of shards are merged a few
at a time, so that no task holds more than a few tables of one pair of blocks. The width of blocks bounds such a table.

A packed model is broadcast where its counted bytes allow; rows are then scored where they lie, which streams need. Otherwise
its tables travel to the lanes that use them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..session import cut, ship

#: Entries (cells times classes) of the table of two blocks.
TABLE = 1 << 20
#: Rows of a shard, and tables that are merged at once.
SHARD, FAN = 1 << 14, 8

PACKED = "a int, b int, keys binary, counts binary, weights binary"
CELLS = "i int, bi int, l int, bl int, k int, cnt long, w double"


class Grid:
    """How features lie in blocks and cells in tables."""

    def __init__(self, n: int, resol: int, n_classes: int):
        self.n, self.bins, self.classes = n, resol + 1, max(1, n_classes)
        self.width = max(1, min(n, int(math.sqrt(TABLE / self.classes)) // self.bins))
        self.blocks = -(-n // self.width)
        self.side = self.width * self.bins
        self.kind = np.uint8 if self.bins <= 256 else np.uint16
        self.pairs = [(a, b) for a in range(self.blocks) for b in range(a, self.blocks)]

    def cells(self, a: int, b: int, x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
        """The cell of each row (bins x of block a, y of block b), a feature of a at a time, for its partners in b."""
        left = self.bins * np.arange(x.shape[1]) + x
        right = self.bins * np.arange(y.shape[1]) + y
        for f in range(x.shape[1]):
            held = right[:, f + 1 :] if a == b else right
            if held.shape[1]:
                yield left[:, f, None] * self.side + held

    def log_scores(self, keys: bytes, counts: bytes, weights: bytes | None) -> np.ndarray:
        """Log score of each class in each cell; cells without rows give every class the same."""
        at = np.frombuffer(keys, np.uint32)
        cell = at // self.classes
        new = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
        seen, of, k = cell[new], np.cumsum(new) - 1, at % self.classes
        part = np.ones((len(seen), self.classes))
        part[of, k] += loose(keys, counts)
        part /= part.sum(axis=1, keepdims=True)
        if weights is not None:
            part[of, k] *= np.frombuffer(weights, np.float64)
        out = np.full((self.side * self.side, self.classes), -math.log(self.classes))
        out[seen] = np.log(part)
        return out

    def add_scores(self, into: np.ndarray, a: int, b: int, x: np.ndarray, y: np.ndarray, scores: np.ndarray) -> None:
        for cells in self.cells(a, b, x, y):
            into += scores[cells].sum(axis=1)


def binned(bounds: dict[str, tuple], grid: Grid) -> Callable[[np.ndarray], np.ndarray]:
    """The bins of rows of values: bin_of() of pairbayes.py, for all features at once."""
    lo, hi = (np.array([v[i] if v[0] is not None and v[1] is not None and v[1] > v[0] else i for v in bounds.values()], float) for i in (0, 1))
    varies = np.array([v[0] is not None and v[1] is not None and v[1] > v[0] for v in bounds.values()])
    top = grid.bins - 1

    def run(x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            at = np.floor((np.where(np.isnan(x), -np.inf, x) - lo) / (hi - lo) * top + 0.5)
        return np.where(varies, np.clip(at, 0, top), 0).astype(grid.kind)

    return run


def _values(bounds: dict[str, tuple]) -> Column:
    """The features of a row in an array, NULL as NaN."""
    return F.array(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in bounds))


def tight(n: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes()


def loose(keys: bytes, counts: bytes) -> np.ndarray:
    """The counts of tight(); their width follows from the number of keys."""
    return np.frombuffer(counts, np.dtype(f"u{4 * len(counts) // len(keys)}") if keys else np.uint8).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _batch(schema: list[tuple], columns: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_DEALT = [("shard", pa.int64()), ("block", pa.int32()), ("rows", pa.binary()), ("ks", pa.binary()), ("bins", pa.binary())]


def deal(df: DataFrame, bounds: dict[str, tuple], grid: Grid, row: str, k: Column | None = None) -> DataFrame:
    """shard, block, rows, ks, bins: up to SHARD rows of df each; a shard is named by its first row."""

    bins_of, most = binned(bounds, grid), SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def full() -> Iterator[pa.RecordBatch]:
            rows, ks = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            x = np.concatenate([h[2] for h in held])
            for block in range(grid.blocks):
                part = np.ascontiguousarray(x[:, block * grid.width : (block + 1) * grid.width])
                yield _batch(_DEALT, [[int(rows[0])], [block], [rows.tobytes()], [ks.tobytes()], [part.tobytes()]])

        for batch in batches:
            n = batch.num_rows
            x = bins_of(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, grid.n))
            rows, ks = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            for at in range(0, n, most):
                held.append((rows[at : at + most], ks[at : at + most], x[at : at + most]))
                size += len(held[-1][0])
                if size >= most:
                    yield from full()
                    held, size = [], 0
        if held:
            yield from full()

    ship(df.sparkSession)
    given = df.select(F.col(row).cast("long").alias("__row"), F.coalesce(k if k is not None else F.lit(0), F.lit(0)).cast("int").alias("__k"), _values(bounds).alias("__values"))
    return given.mapInArrow(run, "shard long, block int, rows binary, ks binary, bins binary")


def _lanes(blocks: DataFrame, grid: Grid) -> int:
    """As many shares of the pairs of blocks as keep all tasks busy."""
    shards = blocks.where("block = 0").count()
    return max(1, min(len(grid.pairs), -(-2 * blocks.sparkSession.sparkContext.defaultParallelism // max(1, shards))))


def _in_lanes(blocks: DataFrame, lanes: int, more: DataFrame | None = None) -> DataFrame:
    """The blocks of each shard for each lane, in order, followed by the rows of more for this shard and lane."""
    fields = blocks.columns
    out = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    if more is not None:
        out = out.unionByName(more, allowMissingColumns=True)
    n = blocks.sparkSession.sparkContext.defaultParallelism
    out = out.repartition(max(n, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard", "lane")
    return out.sortWithinPartitions("shard", "lane", F.col("block").asc_nulls_last(), *(["a", "b"] if more is not None else [])).select("lane", *fields, *[c for c in out.columns if c not in ("lane", *fields)])


class _Shard:
    """The blocks of a shard as they arrive, as arrays."""

    def __init__(self, grid: Grid, first: dict):
        self.grid, self.shard, self.lane = grid, first["shard"], first["lane"]
        self.rows, self.ks = np.frombuffer(first["rows"], np.int64), np.frombuffer(first["ks"], np.int32)
        self.block: dict[int, np.ndarray] = {}

    def add(self, r: dict) -> None:
        self.block[r["block"]] = np.frombuffer(r["bins"], self.grid.kind).reshape(len(self.rows), -1)


def _per_shard(batches: Iterator[pa.RecordBatch], grid: Grid, done: Callable, on_table: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Calls on_table(shard, row) for rows without a block, and yields what done(shard, row) gives at a shard's end."""
    held, last = None, None
    for r in _rows(batches):
        if held is None or (held.shard, held.lane) != (r["shard"], r["lane"]):
            if held is not None:
                yield from done(held, last)
            held = _Shard(grid, r)
        if r["block"] is not None:
            held.add(r)
            last = r
        else:
            on_table(held, r)
    if held is not None:
        yield from done(held, last)


_PART = [("a", pa.int32()), ("b", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary())]
PART = "a int, b int, shard long, keys binary, counts binary, sums binary"


def _tallied(grid: Grid, keys: list[np.ndarray], weights: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each is there, and the sum of its weights."""
    k = np.concatenate([x.ravel() for x in keys]) if keys else np.zeros(0, np.int64)
    size = grid.side * grid.side * grid.classes
    n = np.bincount(k, minlength=size)
    at = np.flatnonzero(n)
    sums = np.bincount(k, np.concatenate([x.ravel() for x in weights]) if weights else None, minlength=size)[at] if weights is not None else np.zeros(0)
    return at.astype(np.uint32), n[at], sums.astype(np.float64)


def _tallies(blocks: DataFrame, grid: Grid, touched: DataFrame | None = None) -> DataFrame:
    """PART rows of all shards: counts of keys; with touched (shard, at, deltas: places of rows and their deltas) only of these
    rows, with the sums of their deltas."""
    lanes, some = _lanes(blocks, grid), touched is not None

    def done(s: _Shard, r: dict) -> Iterator[pa.RecordBatch]:
        at = np.array(r["at"], np.int64) if some else np.arange(len(s.rows))
        delta = np.array(r["deltas"], np.float64) if some else None
        at, delta = (at[s.ks[at] > 0], delta[s.ks[at] > 0] if delta is not None else None)
        if not len(at):
            return
        k = s.ks[at, None] - 1
        block = {i: x[at] for i, x in s.block.items()}
        for a, b in grid.pairs[s.lane :: lanes]:
            keys = [c * grid.classes + k for c in grid.cells(a, b, block[a], block[b])]
            weights = [np.broadcast_to(delta[:, None], c.shape) for c in keys] if delta is not None else None
            found, n, sums = _tallied(grid, keys, weights)
            yield _batch(_PART, [[a], [b], [s.shard], [found.tobytes()], [tight(n)], [sums.tobytes()]])

    given = blocks if touched is None else blocks.join(touched, "shard")
    return _merged(_in_lanes(given, lanes).mapInArrow(lambda batches: _per_shard(batches, grid, done), PART), blocks.where("block = 0").count())


def _merged(parts: DataFrame, most: int) -> DataFrame:
    """One PART row for each pair of blocks, of which there are at most so many; FAN rows or so are added up at a time."""
    parts = cut(parts)

    def added(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows])
        found, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate([loose(r["keys"], r["counts"]) for r in rows]))
        sums = np.concatenate([np.frombuffer(r["sums"], np.float64) for r in rows])
        sums = np.bincount(at, sums, minlength=len(found)) if len(sums) else sums
        return pa.Table.from_batches([_batch(_PART, [[rows[0]["a"]], [rows[0]["b"]], [rows[0]["shard"]], [found.tobytes()], [tight(total)], [sums.tobytes()]])])

    while most > 1:
        most = -(-most // FAN)
        parts = cut(parts.groupBy("a", "b", F.pmod(F.xxhash64("shard"), F.lit(most)).alias("g")).applyInArrow(added, PART))
    return parts


def count(blocks: DataFrame, grid: Grid) -> DataFrame:
    """The packed counts of dealt rows that have a class."""
    return _tallies(blocks, grid).select("a", "b", "keys", "counts", F.lit(None).cast("binary").alias("weights"))


def merge(*packed: DataFrame) -> DataFrame:
    """Packed counts of parts added up; weights don't add up and are left out."""
    parts = [p.select("a", "b", F.lit(i).cast("long").alias("shard"), "keys", "counts", F.unhex(F.lit("")).alias("sums")) for i, p in enumerate(packed)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _merged(out, len(packed)).select("a", "b", "keys", "counts", F.lit(None).cast("binary").alias("weights"))


def size_of(packed: DataFrame) -> int:
    """Bytes of a packed model."""
    return packed.agg(F.sum(F.octet_length("keys") + F.octet_length("counts") + F.coalesce(F.octet_length("weights"), F.lit(0)))).first()[0] or 0


_SCORED = [("shard", pa.int64()), ("at", pa.int32()), ("row", pa.int64()), ("k", pa.int32()), ("s", pa.list_(pa.float64()))]


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def score(blocks: DataFrame, packed: DataFrame, grid: Grid) -> DataFrame:
    """shard, at, row, k, scores for every dealt row; tables of the model go to each shard once, to the lane that uses them."""
    lanes = _lanes(blocks, grid)

    def on_table(s: _Shard, r: dict) -> None:
        if not hasattr(s, "total"):
            s.total = np.zeros((len(s.rows), grid.classes))
        grid.add_scores(s.total, r["a"], r["b"], s.block[r["a"]], s.block[r["b"]], grid.log_scores(r["keys"], r["counts"], r["weights"]))

    def done(s: _Shard, _: dict) -> Iterator[pa.RecordBatch]:
        total = getattr(s, "total", np.zeros((len(s.rows), grid.classes)))
        for i in range(0, len(total), 4096):
            part = total[i : i + 4096]
            cols = [pa.array(np.full(len(part), s.shard)), pa.array(np.arange(i, i + len(part)), pa.int32()), pa.array(s.rows[i : i + 4096]), pa.array(s.ks[i : i + 4096]), _lists(part)]
            yield pa.record_batch(cols, names=[n for n, _ in _SCORED])

    place = F.col("a") * grid.blocks - F.expr("a * (a - 1) div 2") + F.col("b") - F.col("a")
    work = blocks.where("block = 0").select("shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    tables = packed.withColumn("lane", F.pmod(place, F.lit(lanes)).cast("int")).join(work, "lane")
    out = _in_lanes(blocks, lanes, tables).mapInArrow(lambda batches: _per_shard(batches, grid, done, on_table), "shard long, at int, row long, k int, s array<double>")
    total = out.groupBy("shard", "at", "row", "k").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(grid.classes)))
    return total.select("shard", "at", "row", "k", F.array(*(f"s{i}" for i in range(grid.classes))).alias("scores"))


def score_in_place(df: DataFrame, bounds: dict[str, tuple], packed: DataFrame, grid: Grid) -> DataFrame:
    """df with scores; each task has the whole model, whose size the caller has checked."""
    tables = df.sparkSession.sparkContext.broadcast([(r.a, r.b, bytes(r["keys"]), bytes(r["counts"]), bytes(r["weights"]) if r["weights"] is not None else None) for r in packed.collect()])

    bins_of = binned(bounds, grid)

    @F.pandas_udf("array<double>")
    def scores(held):
        out = np.zeros((len(held), grid.classes))
        if len(held):
            x = bins_of(np.stack(held.to_numpy()))
            part = [x[:, i * grid.width : (i + 1) * grid.width] for i in range(grid.blocks)]
            for a, b, keys, counts, weights in tables.value:
                grid.add_scores(out, a, b, part[a], part[b], grid.log_scores(keys, counts, weights))
        import pandas as pd

        return pd.Series(list(out))

    ship(df.sparkSession)
    return df.withColumn("scores", scores(_values(bounds)))


def boost(blocks: DataFrame, packed: DataFrame, wrong: DataFrame, grid: Grid) -> DataFrame:
    """packed with the weights after one batch epoch: each cell of the true class that wrong rows (shard, at, delta) touch
    grows by their mean delta."""
    touched = wrong.groupBy("shard").agg(F.collect_list(F.struct("at", "delta")).alias("w")).select("shard", F.col("w.at").alias("at"), F.col("w.delta").alias("deltas"))
    found = _tallies(blocks, grid, touched).select("a", "b", F.col("keys").alias("hit"), F.col("counts").alias("n"), "sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            keys = np.frombuffer(r["keys"], np.uint32)
            w = np.frombuffer(r["weights"], np.float64).copy() if r["weights"] is not None else np.ones(len(keys))
            if r["hit"] is not None:
                w[np.searchsorted(keys, np.frombuffer(r["hit"], np.uint32))] += np.frombuffer(r["sums"], np.float64) / loose(r["hit"], r["n"])
            yield _batch([("a", pa.int32()), ("b", pa.int32()), *((n, pa.binary()) for n in ("keys", "counts", "weights"))], [[r["a"]], [r["b"]], [r["keys"]], [r["counts"]], [w.tobytes()]])

    return packed.join(found, ["a", "b"], "left").mapInArrow(run, PACKED)


def cells(packed: DataFrame, grid: Grid) -> DataFrame:
    """i, bi, l, bl, k, cnt, w: the packed counts as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            keys = np.frombuffer(r["keys"], np.uint32).astype(np.int64)
            n = loose(r["keys"], r["counts"])
            w = np.frombuffer(r["weights"], np.float64) if r["weights"] is not None else np.ones(len(keys))
            cell, k = keys // grid.classes, keys % grid.classes + 1
            x, y = cell // grid.side, cell % grid.side
            cols = [r["a"] * grid.width + x // grid.bins, x % grid.bins, r["b"] * grid.width + y // grid.bins, y % grid.bins, k]
            for i in range(0, len(keys), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.record_batch([*(pa.array(c[part], pa.int32()) for c in cols), pa.array(n[part]), pa.array(w[part])], names=["i", "bi", "l", "bl", "k", "cnt", "w"])

    return packed.mapInArrow(run, CELLS)
