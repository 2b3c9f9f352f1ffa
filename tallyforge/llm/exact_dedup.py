"""Exact deduplication by a stream with keyed state on disk.

Intake: one scan turns every row into (row, doc_id, digest), written to the shared folder. A Structured Streaming
query with the RocksDB state store reads that table in micro-batches. Its state is keyed by digest, never expires (no
watermark), and retains per digest the stable identifier of the row that stays, its locator (the intake row) and the
size of the group. Hits, which are rows whose digest was seen with another row, have their full bytes compared with
those of the row that stays. Texts that share a digest and differ in bytes are told apart by grouping on their bytes.

With a state_path the state is kept there and the next call goes on from it: its rows are judged against all before
them. Verdicts of earlier calls aren't given again; a caller who keeps them learns from keep_id what has been replaced.

Defined cases: a null text counts as empty, so null and empty texts are one group; a null doc_id is less than any
other; rows repeated whole keep one row, that with the largest intake row; a very long text is digested and compared
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import ascii_lower, fresh, materialize, scratch, small

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Session settings of the stream while it runs: state on disk, in bounded memory.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    # a store's memory goes when its task ends, and not when an executor finds that others have it
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # many small stores: no disk set aside before it is needed
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normal(text: Column) -> Column:
    """The text that is compared: null as empty, A-Z lower-cased."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed_state(intake: DataFrame, path: str, at: str, bytes_per_trigger: int) -> DataFrame:
    """Streams what is new in the intake table at path through the keyed state at at; returns the state: digest,
    group_size, keep_id, keep_row."""
    spark = intake.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        seen = (
            spark.readStream.schema(intake.schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)
            .groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        )
        query = (
            seen.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", at).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(at)
    keep, n = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
    return state.select(F.col("key.digest").alias("digest"), F.col(n).alias("group_size"), F.col(f"{keep}.doc_id").alias("keep_id"), F.col(f"{keep}.row").alias("keep_row"))


def verdicts(docs: DataFrame, digest=sha256, bytes_per_trigger: int = 8 << 30, state_path: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept.

    digest: from a normalised text column to its digest column; any function gives right results, since hits are
    compared byte by byte. state_path: a shared folder whose state is continued; earlier: the rows (doc_id, text) of the
    calls before, of which those that stay are compared with hits.
    """
    spark = docs.sparkSession
    path = f"{state_path.rstrip('/')}/intake" if state_path else scratch(spark, "dedup-intake")
    before = _batches(spark, path) if state_path else 0
    # rows of a later call have larger numbers than those of all before it
    number = F.monotonically_increasing_id() if not before else F.expr(f"monotonically_increasing_id() + {before} * 4503599627370496L")
    rows = docs.select("doc_id", digest(normal(F.col("text"))).alias("digest"), number.alias("row"), F.lit(before).alias("batch"))
    rows.write.mode("append").parquet(path)
    intake = spark.read.schema(rows.schema).parquet(path)
    own = intake.where(F.col("batch") == before).drop("batch")
    if own.isEmpty():
        return own.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    at = f"{state_path.rstrip('/')}/state" if state_path else scratch(spark, "dedup-state")
    state = materialize(keyed_state(intake, path, at, bytes_per_trigger), "dedup-keys")
    found = own.join(state, "digest")
    texts = docs.select("doc_id", "text", F.lit(True).alias("new"))
    if earlier is not None:
        texts = texts.unionByName(earlier.select("doc_id", "text", F.lit(False).alias("new")))
    differ = _differing(docs, earlier, found.where("group_size > 1"), digest)
    kept = F.col("row") == F.col("keep_row")
    if differ is None:
        return found.select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))
    clear = found.join(differ.select("digest").distinct(), "digest", "left_anti")
    return clear.select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept")).unionByName(_by_bytes(texts, differ.select("digest").distinct(), digest))


def _batches(spark, path: str) -> int:
    """How many calls the intake table at path has rows of."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return 0
    last = spark.read.schema("batch int").parquet(path).agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1


def _differing(docs: DataFrame, earlier: DataFrame | None, hits: DataFrame, digest) -> DataFrame | None:
    """Rows of hits' digests whose full text isn't that of the row that stays; None if there are none."""
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "keep_id")
    ids = small(hits.unionByName(hits.select(F.col("keep_id").alias("hit_id"), "hit_digest", "keep_id")).distinct())
    text = normal(F.col("text")).alias("text")
    # rows of this call are known by their doc_id, so that only theirs are digested again
    full = docs.select("doc_id", text).join(ids, F.col("doc_id").eqNullSafe(F.col("hit_id"))).where(digest(F.col("text")) == F.col("hit_digest")).drop("hit_id")
    if earlier is not None:
        full = full.unionByName(earlier.select("doc_id", text).join(small(hits.drop("hit_id").distinct()), digest(F.col("text")) == F.col("hit_digest")))
    full = full.withColumnRenamed("hit_digest", "digest")
    kept = full.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("kept_text"))
    differ = materialize(full.join(kept, "digest").where(F.col("text") != F.col("kept_text")).select("doc_id", "digest"), "dedup-differ")
    return None if differ.isEmpty() else differ


def _by_bytes(docs: DataFrame, digests: DataFrame, digest) -> DataFrame:
    """Verdicts of the new rows with these digests, grouped on the text itself."""
    rows = docs.select("doc_id", "new", normal(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    rows = materialize(rows.join(digests, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "dedup-bytes")
    groups = rows.groupBy("text").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return rows.where("new").join(groups, "text").select("doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"))


def deduplicate(docs: DataFrame, digest=sha256, bytes_per_trigger: int = 8 << 30) -> DataFrame:
    """The rows of docs that stay, all columns. Of rows repeated whole in doc_id and text one stays."""
    found = materialize(verdicts(docs, digest, bytes_per_trigger), "dedup-verdicts")
    key, mark, rank = fresh(docs.columns, "hit_id", "hit_digest", "hit_rank")
    # rows to drop, known by (doc_id, digest); where the same pair also stays, copies of one row remain and one is taken
    per = found.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    per = materialize(per.select(F.col("doc_id").alias(key), F.col("digest").alias(mark), F.col("kept").alias(rank)), "dedup-drop")
    if per.isEmpty():
        return docs
    here = digest(normal(docs["text"]))
    on = docs["doc_id"].eqNullSafe(F.col(key)) & (here == F.col(mark))
    stay = docs.join(small(per), on, "left_anti")
    twice = per.where(rank)
    if twice.isEmpty():
        return stay
    again = docs.join(small(twice), on, "inner").dropDuplicates([key, mark]).select(*docs.columns)
    return stay.unionByName(again)
