"""The corpus pipeline: toxicity, exact dedup, near-duplicate dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result to the shared folder and reads it again as the next one's docs. Before a stage begins, scratch
tables and shuffle files that no plan refers to any more are removed.

Defined cases, in every stage: rows with a null doc_id and repeated rows are rows like others; null and empty texts are
equal to each other, clean, and packed as their end token alone; very long texts are read whole; columns beside those of
documents pass through; an empty table gives an empty result. Ties go to the largest doc_id among equal texts, and to the
least among near copies.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import common, exact_dedup, minhash_join, mixing, packing, toxicity
from tallyforge.llm.common import crc_fold, materialize, release
from tallyforge.llm.queries import mix_plan, table, word_tokenizer
from tallyforge.session import ARROW_BYTES, ship

#: An executor runs all stages in one go, and memory that one of them took outside the heap is rarely given back; so
#: a Python worker remembers half of what it does in a query of one stage, and batches are a quarter.
MEMO_BYTES, BATCH_BYTES = common.MEMO_BYTES // 2, ARROW_BYTES // 4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; labels of one fold in three are never learnt from."""
    labels = table(ship(spark, BATCH_BYTES), sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_fold(F.col("doc_id"), 3) != 1), memo_bytes=MEMO_BYTES)
    return toxicity.drop_toxic(docs, model, threshold=0.7, memo_bytes=MEMO_BYTES)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    release(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    release(ship(spark, BATCH_BYTES))
    return minhash_join.keep_one(docs, threshold=0.8, n=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by weights; no document twice."""
    release(spark)
    return mixing.select(docs, mix_plan(docs, budget_percent=90, max_epochs=1, seed=7))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    release(ship(spark, BATCH_BYTES))
    pieces = packing.pack(docs, word_tokenizer(), memo_bytes=MEMO_BYTES)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Models, tokenizers and MinHash have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
