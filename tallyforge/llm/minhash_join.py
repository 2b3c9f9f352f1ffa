"""N-gram Jaccard self-join by MinHash banding.

Shingles are n words in a row (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); a text of fewer words is one shingle, one
without words has none. Bands and rows are chosen for a target recall at the threshold. Rows of equal text are one
node; nodes are shuffled on (band, hash) and each is linked to the least node of its bucket, which keeps buckets linear.
Components of those links are the only places where a pair can match. A component is compared as a whole, block against
block, or, where that copies fewer texts, as a component that chance candidates hold together does, bucket by bucket: a
pair is then looked at in the first bucket that it shares only. No task holds more than two blocks, and links are counted
where they are found instead of being emitted as rows. MinHash works on 64-bit hashes in which the order of the words
counts; what is compared is sets of the words' own n-grams, without any hash. Components of the verified links are the
classes.

Result, a row per row of docs: class_id (least doc_id of the class) and n_links (different texts, copies not counted,
whose similarity to this row's text is at least the threshold).

Defined cases: null texts are empty; texts without words only match copies; very long texts are shingled whole, and blocks
that hold them hold fewer texts; null doc_ids never give a class its id
unless all are null; repeated rows are copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import MEMO_BYTES, TwoGenerations, arrow_rows, fresh, give_back, materialize, small, worker_wide
from .components import connected

#: An odd 64-bit multiplier.
MIX = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false candidates, that reach the recall within so many hashes."""
    for rows in range(most_hashes, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 1e-12 else most_hashes + 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no banding reaches this recall within so many hashes")


def _finish(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Shingler:
    """64-bit hashes of the word shingles of a text, in order.

    Each word's hash is added to what the words before it gave, after that was mixed, so words at different places don't
    swap. Only candidates come from these hashes."""

    def __init__(self, n: int):
        import xxhash

        self.n = n
        self.word = TwoGenerations(xxhash.xxh3_64_intdigest, MEMO_BYTES // 2)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(w))
        h = w[: len(w) - n + 1].copy()
        for k in range(1, n):
            h ^= h >> np.uint64(32)
            h *= MIX
            h += w[k : len(w) - n + 1 + k]
        if n < self.n:  # short texts differ from parts of longer ones
            h += np.uint64(n)
        return _finish(h)


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The set of word n-grams of each text, as sorted numbers: within these texts, equal numbers are equal n-grams."""
    vocabulary: dict[bytes, int] = {}
    number = itertools.count()
    coded = []
    for t in texts:
        words = (t or "").encode().lower().split()
        coded.append(np.fromiter(map(vocabulary.setdefault, words, number), np.int64, len(words)))
    w = np.concatenate(coded) if coded else np.zeros(0, np.int64)
    del vocabulary
    total = next(number) + 1  # more than any number so far

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * total + b, return_inverse=True)[1]

    runs, size = {1: w}, 1
    while 2 * size <= min(n, len(w)):
        runs[2 * size] = pairs(runs[size][:-size], runs[size][size:])
        size *= 2
    grams = runs[size]
    for more in sorted(runs, reverse=True):
        if more <= min(n, len(w)) - size:
            grams = pairs(grams[:-more], runs[more][size:])
            size += more
    short: dict[bytes, int] = {}
    out, at = [], 0
    for t, c in zip(texts, coded, strict=True):
        if len(c) >= n:
            out.append(np.unique(grams[at : at + len(c) - n + 1]))
        else:  # fewer words: one shingle, whose number is below all others
            whole = b" ".join((t or "").encode().lower().split())
            out.append(np.array([-1 - short.setdefault(whole, len(short))] if len(c) else [], np.int64))
        at += len(c)
    return out


class Signer:
    """Band hashes of a set of shingles."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**32, k, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, k, np.uint32)[:, None]
        self.factor = rng.integers(0, 2**63, rows, np.uint64) | np.uint64(1)

    def __call__(self, shingles: np.ndarray, step: int = 2048) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), step):
            h = x[None, i : i + step] * self.a
            h += self.b
            np.minimum(least, h.min(axis=1), out=least)
        h = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.factor).sum(axis=1, dtype=np.uint64)
        return _finish(h).view(np.int64)


def _sketcher(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what an earlier stage left in this worker goes
        shingler, signer = worker_wide(("shingler", n), lambda: Shingler(n)), Signer(bands, rows)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            made, size = [], []
            for t in text:
                s = shingler(t.as_py())
                size.append(len(s))
                made.append(signer(s) if len(s) else None)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "digest")]
            yield pa.record_batch([*cols, pa.array(made, pa.list_(pa.int64())), pa.array(size, pa.int64())], names=["doc_id", "digest", "bands", "size"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets of distinct 64-bit values.

    Values of few sets are counted pair by pair, those of many by products of 0/1 matrices, a slice of values at a time.
    """
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    held = np.diff(np.r_[first, len(values)])
    few = 24
    for k in range(2, few + 1):
        at = first[held == k]
        if len(at):
            rows = owner[at[:, None] + np.arange(k)]
            a, b = np.triu_indices(k, 1)
            out += np.bincount((rows[:, a] * m + rows[:, b]).ravel(), minlength=m * m).reshape(m, m).astype(np.int32)
    at, size = first[held > few], held[held > few]
    for i in range(0, len(at), 2048):
        x = np.zeros((m, len(at[i : i + 2048])), np.float32)
        for j, (p, s) in enumerate(zip(at[i : i + 2048], size[i : i + 2048], strict=True)):
            x[owner[p : p + s], j] = 1
        out += np.triu(x @ x.T, 1).astype(np.int32)
    return out + out.T


def link_matrix(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two sets reach the threshold; none with itself, and empty sets with none."""
    size = np.array([len(s) for s in sets])
    both = overlaps(sets)
    union = size[:, None] + size[None, :] - both
    hit = (both >= threshold * union - 1e-9) & (both > 0)
    np.fill_diagonal(hit, False)
    return hit


def least_linked(hit: np.ndarray) -> np.ndarray:
    """For each row the least row of its component."""
    root = np.arange(len(hit))
    while True:
        near = np.where(hit, root[None, :], len(hit)).min(axis=1, initial=len(hit))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def met_before(bands: list[list[int]], band: int) -> np.ndarray:
    """Which two share a bucket of an earlier band."""
    b = np.array(bands, np.int64)[:, :band]
    out = np.zeros((len(b), len(b)), bool)
    for k in range(band):
        out |= b[:, k, None] == b[None, :, k]
    return out


def _verifier(n: int, threshold: float):
    def group(rows: list[tuple]) -> list[tuple]:
        _, band, _, bi, bj = rows[0][0]
        hit = link_matrix(ngram_sets([r[2] for r in rows], n), threshold)
        if bi != bj:  # two blocks: pairs inside one are seen elsewhere
            side = np.array([r[1] for r in rows])
            hit &= side[:, None] != side[None, :]
        if band >= 0:
            hit &= ~met_before([r[4] for r in rows], band)
        root, count = least_linked(hit), hit.sum(axis=1)
        return [(rows[i][3], int(count[i]), rows[root[i]][3]) for i in range(len(rows)) if count[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def ready() -> pa.RecordBatch:
            made = pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["node", "links", "peer"])
            out.clear()
            return made

        for batch in batches:
            for *key, block, text, node, bands in arrow_rows(batch, "cluster", "band", "hash", "bi", "bj", "block", "text", "node", "bands"):
                if held and held[0][0] != key:
                    out += group(held)
                    held = []
                held.append((key, block, text, node, bands))
            if out:
                yield ready()
        if held:
            out += group(held)
            held = []
        if out:
            yield ready()
        give_back()

    return run


def join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, most_hashes: int = 128, block: int = 512) -> DataFrame:
    """doc_id, text_digest, class_id, class_node (a number of the class), n_links for each row of docs."""
    bands, rows = banding(threshold, recall, most_hashes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = source.mapInArrow(_sketcher(n, bands, rows), f"doc_id {kind}, digest binary, bands array<long>, size long")
    sketch = materialize(sketch.withColumn("row", F.monotonically_increasing_id()), "sketch")
    # one node per text; null doc_ids come last
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = materialize(sketch.groupBy("digest").agg(lead.alias("lead"), F.first("bands").alias("bands"), F.first("size").alias("size")).select("digest", F.col("lead.row").alias("node"), F.col("lead.doc_id").alias("lead_id"), "bands", "size"), "nodes")
    edges = _bucket_edges(nodes)
    clusters = connected(edges, "node", "pivot")
    links = materialize(_verified(source, nodes, clusters, threshold, n, block), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = connected(links, "node", "peer")
    known = nodes.select("digest", "node", "lead_id").join(counts, "node", "left").join(classes, "node", "left")
    known = materialize(known.select("digest", "lead_id", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "known")
    ids = known.groupBy("root").agg(F.min("lead_id").alias("class_id"))
    # classes of one node keep the id at hand; only the others are looked up
    return sketch.select("doc_id", F.col("digest").alias("text_digest")).join(known.join(ids, "root").select(F.col("digest").alias("text_digest"), "class_id", F.col("root").alias("class_node"), "n_links"), "text_digest").select("doc_id", "text_digest", "class_id", "class_node", "n_links")


def _bucket_edges(nodes: DataFrame) -> DataFrame:
    """Each node and the least node of each of its buckets; (band, hash) is the shuffle key, minima are pre-aggregated."""
    in_bucket = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    least = in_bucket.groupBy("band", "hash").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("held")).where("held > 1")
    return in_bucket.join(least, ["band", "hash"]).where("node != pivot").select("node", "pivot").distinct()


def _groups(nodes: DataFrame, clusters: DataFrame, block: int, most_shingles: int) -> DataFrame:
    """cluster, band, hash, node, blocks: whom to compare with whom. Band -1 is a component as a whole; components of more
    than one block are compared by buckets where these copy fewer texts."""
    # neither too many texts in a block nor too many shingles
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / most_shingles)).cast("int")
    sized = clusters.join(nodes.select("node", "size"), "node")
    held = materialize(sized.groupBy("root").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n")), "components")
    whole = clusters.join(small(held), "root").select(F.col("root").alias("cluster"), F.lit(-1).alias("band"), F.lit(0).cast("long").alias("hash"), "node", "blocks")
    large = held.where("blocks > 1")
    if large.isEmpty():
        return whole
    inside = clusters.join(small(large.select("root", F.col("blocks").alias("parts"), "n")), "root").join(nodes.select("node", "size", "bands"), "node")
    inside = materialize(inside.select("root", "node", "size", F.posexplode("bands").alias("band", "hash")), "inside")
    buckets = inside.groupBy("root", "band", "hash").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = materialize(buckets, "buckets")
    cost = buckets.groupBy("root").agg(F.sum(F.col("m") * F.col("blocks")).alias("copied")).join(large, "root").where(F.col("copied") < F.col("n") * F.col("blocks")).select("root")
    cost = materialize(cost, "by-bucket")
    if cost.isEmpty():
        return whole
    parts = inside.join(buckets.drop("m").join(small(cost), "root", "left_semi"), ["root", "band", "hash"]).select(F.col("root").alias("cluster"), "band", "hash", "node", "blocks")
    return whole.join(small(cost), F.col("cluster") == F.col("root"), "left_anti").unionByName(parts)


def _verified(source: DataFrame, nodes: DataFrame, clusters: DataFrame, threshold: float, n: int, block: int, most_shingles: int = 1 << 20) -> DataFrame:
    """(node, links, peer): verified links counted per node, each with a node of the same class, from each two blocks."""
    member = _groups(nodes, clusters, block, most_shingles).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    mine = F.collect_list(F.struct("cluster", "band", "hash", "blocks", "block")).alias("groups")
    member = member.groupBy("node").agg(mine).join(nodes.select("node", "digest", "bands"), "node")
    by_bucket = F.exists("groups", lambda g: g["band"] >= 0)
    member = materialize(member.select("digest", "node", "groups", F.when(by_bucket, F.col("bands")).alias("bands")), "members")
    texts = source.join(small(member), "digest").dropDuplicates(["node"])
    spread = texts.select("node", "text", "bands", F.explode("groups").alias("g")).select("node", "text", "bands", "g.*")
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("cluster", "band", "hash", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "text", "bands")
    key = ["cluster", "band", "hash", "bi", "bj"]
    spread = spread.repartition(*key).sortWithinPartitions(*key, "node")
    return spread.mapInArrow(_verifier(n, threshold), "node long, links long, peer long")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with one document of each class: the least doc_id; all columns."""
    found = materialize(join(docs, **options), "near-classes")
    key, digest = fresh(docs.columns, "near_id", "near_digest")
    lead = found.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_digest")).alias("lead"))
    stays = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_digest") == F.col("lead.text_digest"))
    judged = found.join(lead, "class_node").groupBy("doc_id", "text_digest").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("held"))
    drop = judged.where("not stays or held > 1").select(F.col("doc_id").alias(key), F.col("text_digest").alias(digest), "stays")
    drop = materialize(drop, "near-drop")
    if drop.isEmpty():
        return docs
    here = F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256))
    on = docs["doc_id"].eqNullSafe(F.col(key)) & (here == F.col(digest))
    stay = docs.join(small(drop.drop("stays")), on, "left_anti")
    twice = drop.where("stays").drop("stays")
    if twice.isEmpty():
        return stay
    return stay.unionByName(docs.join(small(twice), on).dropDuplicates([key, digest]).select(*docs.columns))
