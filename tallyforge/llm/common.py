"""What the text operators share: the shared scratch folder, size-checked broadcasts, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

#: Largest number of rows that a broadcast side may have; beyond it joins shuffle.
BROADCAST_ROWS = 300_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_made: list[tuple[SparkSession, str]] = []
#: Path of a table -> weak reference of the JVM to the files that plans read it from.
_read: dict[str, object] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset a folder of the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends, or by remove()."""
    path = f"{shared_root(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system, so remote folders work too."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before; a path that can't be removed keeps no other
            continue


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage at a table in the shared folder: survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _read[path] = df.sparkSession.sparkContext._jvm.java.lang.ref.WeakReference(files)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of plans that nothing refers to any more, before its own driver comes to it, and
    removes the tables of materialize() that no plan reads any more."""
    gc.collect()
    for _ in range(2):  # the first lets go of what Python's objects held in the JVM
        spark.sparkContext._jvm.System.gc()
    for at, path in [m for m in _made if m[0] is spark and m[1] in _read]:
        if _read[path].get() is None:
            remove(spark, path)
            _made.remove((at, path))
            del _read[path]


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if it has at most limit rows, else leaves the join to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ascii_lower(c: Column) -> Column:
    """A-Z only, so that no other script changes."""
    return F.translate(c, UPPER, LOWER)


def crc_fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null ids fold as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that clash with none of taken."""
    low = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = f"_{n}"
        out.append(n)
        low.add(n.lower())
    return out


#: Bytes that the memos of one Python worker may take together, by estimate.
MEMO_BYTES = 56 << 20


def held_bytes(x) -> int:
    """Bytes of a string, or of tuples of strings with what they hold."""
    return 56 + 8 * len(x) + sum(map(held_bytes, x)) if isinstance(x, tuple) else sys.getsizeof(x)


class TwoGenerations(dict):
    """A memo of bounded size in bytes: when half of them are taken, entries of the generation before are dropped.

    Entries of more than `largest` bytes are never kept. shared: a value that many entries have, which takes no room.
    """

    def __init__(self, make, limit: int = MEMO_BYTES, largest: int = 1000, shared=None):
        super().__init__()
        self.make, self.limit, self.largest, self.shared, self.old, self.taken = make, limit // 2, largest, shared, {}, 0

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        # an entry's place in the table takes some 75 bytes
        size = 75 + held_bytes(key) + (0 if v is self.shared else held_bytes(v))
        if size > self.largest:
            return v
        if self.taken + size > self.limit:
            self.old = dict(self)
            self.clear()
            self.taken = 0
        self.taken += size
        self[key] = v
        return v


_worker: dict = {}


def worker_wide(key, make):
    """What make() gives, kept for later tasks of this Python worker; what another key left there goes first."""
    if key not in _worker:
        if _worker:
            _worker.clear()
            gc.collect()
            give_back()
        _worker[key] = make()
    return _worker[key]


def give_back() -> None:
    """Returns freed memory to the system, which allocators otherwise keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_rows(batch, *names: str) -> Iterator[tuple]:
    """Rows of an Arrow batch as tuples of the named columns, made a part at a time."""
    at = [batch.schema.get_field_index(n) for n in names]
    for i in range(0, batch.num_rows, 1024):
        yield from zip(*(batch.column(k).slice(i, 1024).to_pylist() for k in at), strict=True)
