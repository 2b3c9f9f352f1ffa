"""Session defaults."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of a batch that goes to a Python worker, which bounds what it holds of long texts at once.
ARROW_BYTES = 8 << 20

#: A task of work that costs more than reading gets at most so many bytes, and at least so many rows where cores are left over.
TASK_BYTES, TASK_ROWS = 64 << 20, 10_000

#: Settings that suit any size; memory and partition counts are the cluster's to set.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tallyforge", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder under spark.checkpoint.dir, or under the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{name}"


def cut(df, name: str = "cut"):
    """df with its lineage cut by a checkpoint in the shared folder, which lost executors don't take along."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))
    return df.checkpoint()


def tasks_for(spark: SparkSession, rows: int, row_bytes: int) -> int:
    """Parts to deal rows into: one for each core, fewer of a small table, more of one that would make them too large."""
    most = min(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return max(1, most, -(-rows * row_bytes // TASK_BYTES))


def ship(spark: SparkSession, arrow_bytes: int = ARROW_BYTES) -> SparkSession:
    """Sends the package's code to the executors, once for each application, so that Python workers can import it, and
    bounds the batches that they get, unless the session has a bound of its own."""
    sc = spark.sparkContext
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if held is None or held == getattr(spark, "_tallyforge_arrow_bytes", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(arrow_bytes))
        spark._tallyforge_arrow_bytes = str(arrow_bytes)
    if getattr(sc, "_tallyforge_shipped", False):
        return spark
    here = Path(__file__).resolve().parent
    # executors fetch it from the driver as they start, so it stays until the driver ends
    folder = tempfile.mkdtemp(prefix="tallyforge-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{here.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    kept = sys.path[:]
    sc.addPyFile(str(path))
    sys.path[:] = kept  # the driver imports from where it did before
    sc._tallyforge_shipped = True
    return spark
