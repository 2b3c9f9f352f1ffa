"""Language-model scores by a weighted backoff automaton.

A text is its words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) parted by a space and closed by an end, as UTF-8 bytes.
The model is a smoothed n-gram model of those bytes: states are contexts of up to order - 1 bytes, arcs are bytes seen
after them with the log probability of the interpolated (Witten-Bell) estimate, and a failure arc with a backoff weight
leads to the next shorter context. One traversal from left to right carries the state and adds up weights. So unseen
words have probabilities of their own, and all texts together have probability one.

Counts cover every training text and grow with the corpus, so no task and not the driver ever holds the whole model.
Texts are dealt into blocks of about block_bytes; a block lists the words and n-grams that occur in it. N-grams travel
packed, a row for each block and shard, a shard being the n-grams whose contexts share a hash, so that a context's arcs
meet in one. Shards add up the blocks' counts into the model, then tell each block the counts of its own n-grams and
contexts: the part of the automaton that the block needs comes back to it, ahead of its texts.

Defined cases: null and empty texts are the end alone; without training texts every byte is equally likely and nothing
is known; rows with a null doc_id fold as the empty text would; repeated rows are scored each; a very long text is
counted window by window and walked piece by piece, with the same result; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice, repeat

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import arrow_rows, materialize, release

END = 10
#: The length of an n-gram stands in the top byte of its key, its bytes below.
LENGTH_AT = 56


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# --- counting ----------------------------------------------------------------------------------------------------


def grams_of(texts: list[bytes], order: int, window: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Keys, in order, and counts of the n-grams, 1 to order, of texts that each end with END; END also stands before
    each."""
    s = np.frombuffer(bytes([END]) + b"".join(texts), np.uint8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(1, len(s), window):
        lead = min(at, order)
        found.append(_grams_in(s[at - lead : at + window], lead, order))
        if len(found) > 8:
            found = [merge_all(found)]
    return merge_all(found)


def _grams_in(s: np.ndarray, lead: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Those that end behind the first lead bytes of s."""
    j = np.arange(len(s))
    # bytes since the last END before each position, itself included; far where it isn't in sight
    since = j - np.maximum.accumulate(np.where(np.r_[False, s[:-1] == END], np.r_[0, j[:-1]], -order))
    code = np.zeros(len(s), np.uint64)
    for i in range(min(order, len(s))):
        code[i:] |= s[: len(s) - i].astype(np.uint64) << np.uint64(8 * i)
    code, since = code[lead:], since[lead:]
    keys, counts = [], []
    full = since >= order - 1
    now, n = np.unique(code[full], return_counts=True)
    short, reach = code[~full], since[~full]
    for k in range(order, 0, -1):
        keys.append(now | (np.uint64(k) << np.uint64(LENGTH_AT)))
        counts.append(n)
        if k > 1:  # shorter n-grams end where longer ones do, or too near to a beginning for those
            mask = np.uint64((1 << (8 * (k - 1))) - 1)
            near = reach == k - 2
            now, n = merge(np.concatenate([now & mask, short[near] & mask]), np.concatenate([n, np.ones(np.count_nonzero(near), np.int64)]))
    return np.concatenate(keys[::-1]), np.concatenate(counts[::-1])


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def merge_all(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return merge(*map(np.concatenate, zip(*parts, strict=True))) if len(parts) > 1 else parts[0]


def context_of(keys: np.ndarray) -> np.ndarray:
    """Keys of the n-grams without their last bytes; 0 for single bytes. In order if keys are."""
    code = keys & np.uint64((1 << LENGTH_AT) - 1)
    return (code >> np.uint64(8)) | (((keys >> np.uint64(LENGTH_AT)) - np.uint64(1)) << np.uint64(LENGTH_AT))


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte: first bytes first, which compresses well where numbers are in order or small."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


LISTED = "block int, shard int, word binary, n long, grams binary, counts binary"


def _counter(order: int, shards: int, chunk_bytes: int = 2 << 20):
    """Of each block: rows of words with their counts in training texts, and of n-grams by shard."""

    def flush(block: int, words: Counter, keys: np.ndarray, counts: np.ndarray, texts: int) -> Iterator[pa.RecordBatch]:
        words[b"\n"] = texts
        items = iter(words.items())
        while part := list(islice(items, 20_000)):
            yield _batch([(block, None, w, n, None, None) for w, n in part], LISTED)
        words.clear()
        shard = ((context_of(keys) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)
        by = np.argsort(shard, kind="stable")
        first = np.searchsorted(shard[by], np.arange(shards + 1))
        for i in range(shards):
            at = by[first[i] : first[i + 1]]
            if len(at):
                yield _batch([(block, i, None, None, packed(keys[at]), packed(counts[at]))], LISTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, texts = None, Counter(), 0
        chunk: dict[bool, list[bytes]] = {True: [], False: []}
        size = 0
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> None:
            nonlocal size, found
            for train, said in chunk.items():
                if said:
                    keys, counts = grams_of(said, order)
                    found.append((keys, counts if train else np.zeros_like(counts)))
                    said.clear()
            size = 0
            if len(found) > 4:
                found = [merge_all(found)]

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal found
            close()
            keys, counts = merge_all(found)
            found = []
            yield from flush(block, words, keys, counts, texts)

        for batch in batches:
            for b, train, text in arrow_rows(batch, "block", "train", "text"):
                if b != block:
                    if block is not None:
                        yield from done()
                    block, texts = b, 0
                own = words_of(text)
                if train:
                    words.update(own)
                    texts += 1
                else:
                    for w in own:
                        words.setdefault(w, 0)
                said = b" ".join(own) + b"\n"
                chunk[bool(train)].append(said)
                size += len(said)
                if size >= chunk_bytes:
                    close()
        if block is not None:
            yield from done()

    return run


SUMS = "shard int, salt int, grams binary, counts binary"
MODEL = "shard int, grams binary, counts binary, contexts binary, kinds binary, nexts binary, bytes_n long, bytes_kinds long"


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], *names: str) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of each key, one after the other; rows of a key stand together."""
    rows = (r for batch in batches for r in arrow_rows(batch, *keys, *names))
    for key, own in groupby(rows, key=lambda r: r[: len(keys)]):
        yield key, (r[len(keys) :] for r in own)


def _summed(rows: Iterator[tuple], most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and sums of counts; about most numbers are held besides the distinct ones."""
    total, found, held = merge_all([]), [], 0
    for grams, counts in rows:
        found.append((unpacked(grams), unpacked(counts).view(np.int64)))
        held += len(found[-1][0])
        if held > max(most, len(total[0])):
            total, found, held = merge_all([total, *found]), [], 0
    return merge_all([total, *found])


def _partly_summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (shard, salt), rows in _groups(batches, ("shard", "salt"), "grams", "counts"):
        keys, counts = _summed(rows)
        yield _batch([(shard, salt, packed(keys), packed(counts))], SUMS)


def _modelled(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The model's n-grams of each shard, and their contexts with kinds and counts of next bytes, in rows of most."""
    for (shard,), rows in _groups(batches, ("shard",), "grams", "counts"):
        keys, counts = _summed(rows)
        keys, counts = keys[counts > 0], counts[counts > 0]
        if not len(keys):
            continue
        context = context_of(keys)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        kinds, nexts = np.diff(np.r_[first, len(keys)]), np.add.reduceat(counts, first)
        contexts = context[first]
        root = np.flatnonzero(contexts == 0)
        whole = (int(nexts[root[0]]), int(kinds[root[0]])) if len(root) else (None, None)
        for i in range(0, len(keys), most):
            part = slice(i, i + most)
            yield _batch([(shard, *map(packed, (keys[part], counts[part], contexts[part], kinds[part], nexts[part])), *whole)], MODEL)


NEEDED = "block int, grams binary, counts binary, contexts binary, kinds binary, nexts binary"


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's n-grams those that the model knows, and their contexts; a shard's model stands before its blocks."""
    for _, rows in _groups(batches, ("shard", "salt"), "block", "grams", "counts", "contexts", "kinds", "nexts"):
        parts: list[tuple] = []
        model: list[np.ndarray] = []
        for block, grams, *rest in rows:
            if block is None:
                parts.append(tuple(map(unpacked, (grams, *rest))))
                continue
            if not parts and not model:
                continue  # nothing of this shard was learnt
            if not model:
                model, parts = [np.concatenate(x) for x in zip(*parts, strict=True)], []
            keys = unpacked(grams)
            found = []
            for wanted, known, *facts in ((keys, model[0], model[1]), (np.unique(context_of(keys)), *model[2:])):
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = known[at] == wanted
                found += [wanted[hit], *(f[at[hit]] for f in facts)]
            yield _batch([(block, *map(packed, found))], NEEDED)


# --- the automaton -----------------------------------------------------------------------------------------------


class Table:
    """From 64-bit keys to positions, by open addressing; all look-ups are made at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.key = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.at = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several for one slot the last stays
            won = self.at[slot] == left
            self.key[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where a key isn't held."""
        slot = self._slot(keys)
        out = np.where(self.key[slot] == keys, self.at[slot], -1)
        left = np.flatnonzero((out < 0) & (self.at[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            s = slot[left]
            hit = self.key[s] == keys[left]
            out[left[hit]] = self.at[s[hit]]
            left = left[~hit & (self.at[s] >= 0)]
        return out


class Automaton:
    """States, arcs and failure arcs from n-grams with their counts, and contexts with kinds and counts of next bytes.

    whole: count and kinds of single bytes in the corpus, where the n-grams are a part of it.
    """

    def __init__(self, keys: np.ndarray, count: np.ndarray, contexts: np.ndarray, context_kinds: np.ndarray, context_nexts: np.ndarray, order: int, whole: tuple[int, int] | None = None):
        order_by = np.argsort(keys)
        keys, count = keys[order_by], count[order_by]
        del order_by
        length = (keys >> np.uint64(LENGTH_AT)).astype(np.int8)
        code = keys & np.uint64((1 << LENGTH_AT) - 1)

        def place(wanted: np.ndarray) -> np.ndarray:
            at = np.searchsorted(keys, wanted).astype(np.int32)
            at[at == len(keys)] = 0
            return np.where(keys[at] == wanted, at, np.int32(-1)) if len(keys) else np.full(len(wanted), -1, np.int32)

        kinds, nexts = np.zeros(len(keys), np.int16), np.zeros(len(keys))
        at = place(contexts)
        kinds[at[at >= 0]], nexts[at[at >= 0]] = context_kinds[at >= 0], context_nexts[at >= 0]
        is_state = (kinds > 0) & (length < order)
        held = np.flatnonzero(is_state).astype(np.int32)
        state = np.zeros(len(keys) + 1, np.int32)  # the last entry is for the root
        state[held] = np.arange(1, len(held) + 1)
        p = np.zeros(len(keys))
        one = length == 1
        total, types = whole or (count[one].sum(), np.count_nonzero(count[one]))
        base = np.full(256, 1 / 256)
        if total:
            seen = np.zeros(256)
            seen[code[one].astype(np.int64)] = count[one]
            base = (seen + types / 256) / (total + types)
        p[one] = base[code[one].astype(np.int64)]
        prefix, suffix = np.full(len(keys), -1, np.int32), np.full(len(keys), -1, np.int32)
        for k in range(2, order + 1):
            at = np.flatnonzero(length == k)
            tag = np.uint64(k - 1) << np.uint64(LENGTH_AT)
            prefix[at] = place((code[at] >> np.uint64(8)) | tag)
            suffix[at] = place((code[at] & np.uint64((1 << (8 * (k - 1))) - 1)) | tag)
            h = prefix[at]
            p[at] = (count[at] + kinds[h] * p[suffix[at]]) / (nexts[h] + kinds[h])
        # the longest suffix that is a state: of states themselves for failure arcs, of n-grams for arcs
        longest = np.where(is_state, np.arange(len(keys), dtype=np.int32), np.int32(-1))
        for k in range(2, order + 1):
            at = np.flatnonzero((length == k) & (longest < 0))
            longest[at] = longest[suffix[at]]
        self.fail = np.zeros(len(held) + 1, np.int32)
        deep = length[held] > 1
        self.fail[1:][deep] = state[longest[suffix[held[deep]]]]
        self.backoff = np.zeros(len(held) + 1)
        self.backoff[1:] = np.log10(kinds[held] / (nexts[held] + kinds[held]))
        arcs = np.flatnonzero((length > 1) & (count > 0))
        self.table = Table((state[prefix[arcs]].astype(np.uint64) << np.uint64(8)) | (code[arcs] & np.uint64(255)))
        self.weight = np.log10(np.maximum(p[arcs], 1e-300))
        self.next = state[longest[arcs]].astype(np.int32)
        self.root_weight = np.log10(base)
        self.root_next = np.zeros(256, np.int32)
        self.root_next[code[one].astype(np.int64)] = state[longest[one]]
        self.start = int(self.root_next[END])

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after, log10 weights) of one byte from each state, failure arcs included."""
        after, weight = np.empty(len(state), np.int32), np.zeros(len(state))
        at = self.table.find((state.astype(np.uint64) << np.uint64(8)) | byte)
        hit = at >= 0
        if hit.all():
            return self.next[at], self.weight[at]
        after[hit], weight[hit] = self.next[at[hit]], self.weight[at[hit]]
        left = np.flatnonzero(~hit)
        s = state[left]
        while len(left):
            weight[left] += self.backoff[s]
            root = s == 0
            r = left[root]
            weight[r] += self.root_weight[byte[r]]
            after[r] = self.root_next[byte[r]]
            left, s = left[~root], self.fail[s[~root]]
            if len(left):
                at = self.table.find((s.astype(np.uint64) << np.uint64(8)) | byte[left])
                hit = at >= 0
                after[left[hit]] = self.next[at[hit]]
                weight[left[hit]] += self.weight[at[hit]]
                left, s = left[~hit], s[~hit]
        return after, weight

    def score(self, texts: list[bytes], order: int, width: int = 512) -> np.ndarray:
        """log10 probabilities of texts that end with END.

        Long texts are walked in pieces side by side: a state only depends on the last order - 1 bytes, so a piece
        first walks those to find its state, and adds up weights from there on.
        """
        out = np.zeros(len(texts))
        ahead = order - 1
        size = np.array([len(t) for t in texts], np.int64)
        pieces = np.maximum(1, -(-size // width))
        owner = np.repeat(np.arange(len(texts)), pieces)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        base = np.repeat(np.cumsum(size) - size, pieces)
        begin = base + part * width
        end = np.minimum(begin + width, base + size[owner])
        data = np.frombuffer(b"".join(texts), np.uint8)
        by = np.argsort(begin - end, kind="stable")  # longest first
        begin, end, owner, part = begin[by], end[by], owner[by], part[by]
        state = np.where(part == 0, self.start, 0).astype(np.int32)
        later = np.flatnonzero(part > 0)
        for k in range(ahead, 0, -1):
            if len(later):
                state[later] = self.step(state[later], data[begin[later] - k])[0]
        total = np.zeros(len(owner))
        for k in range(int((end - begin).max(initial=0))):
            n = np.searchsorted(begin - end, -k, side="left")  # pieces longer than k
            state[:n], w = self.step(state[:n], data[begin[:n] + k])
            total[:n] += w
        np.add.at(out, owner, total)
        return out


def _scorer(order: int, tokens: int, kinds: int, whole: tuple[int, int]):
    floor = np.log10(tokens + 0.1 * (kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, rows, machine = None, {}, [], None
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            blocks, kind = cols["block"].to_numpy(), cols["kind"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
                part = {n: c.slice(a, b - a) for n, c in cols.items()}
                if blocks[a] != block:
                    block, known, rows, machine = blocks[a], {}, [], None
                if kind[a] == 0:
                    rows += zip(*([unpacked(x) for x in part[n].to_pylist()] for n in ("grams", "counts", "contexts", "kinds", "nexts")), strict=True)
                elif kind[a] == 1:
                    known.update(zip(part["word"].to_pylist(), part["c"].to_pylist(), strict=True))
                else:
                    if machine is None:
                        g = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.uint64)] * 5
                        rows = []
                        machine = Automaton(g[0], g[1].view(np.int64), *g[2:], order, whole)
                        del g
                    ends = known.get(b"\n", 0)
                    n, seen, base, score = [], [], [], []
                    for i in range(0, b - a, 512):
                        said = []
                        for t in part["text"].slice(i, 512).to_pylist():
                            own = words_of(t)
                            c = np.fromiter(map(known.get, own, repeat(0)), np.int64, len(own))
                            n.append(len(own) + 1)
                            seen.append(int(np.count_nonzero(c)) + (ends > 0))
                            base.append(float(np.log10(c + 0.1).sum() + np.log10(ends + 0.1) - n[-1] * floor))
                            said.append(b" ".join(own) + b"\n")
                        score += machine.score(said, order).tolist()
                    yield pa.record_batch([part["doc_id"], part["train"], pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(score)], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, train: Column, order: int = 6, block_bytes: int = 16 << 20, most_shards: int = 4096, most_tasks: int = 20_000, most_blocks: int = 2048) -> DataFrame:
    """A row per row of docs: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    train: a boolean column of docs, whether a row is learnt from. order: bytes of the longest n-grams, 7 at most.
    most_shards: parts of the model; a task holds one. most_tasks: tasks that blocks are dealt to, each taking its blocks
    one after the other. most_blocks: blocks whose rows of one shard go through one task; beyond it they are added up
    and looked up in several.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", train.alias("train"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    shards, tasks, salts = min(blocks, most_shards), min(blocks, most_tasks), -(-blocks // most_blocks)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    in_tasks = lambda df, *by: df.repartitionById(tasks, F.col("block") % tasks).sortWithinPartitions(*by)
    listed = materialize(in_tasks(dealt, "block").mapInArrow(_counter(order, shards), LISTED), "lm-listed")
    release(docs.sparkSession)

    words = listed.where(F.col("word").isNotNull()).select("block", "word", "n")
    counts = materialize(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "lm-words")
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()

    salted = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt")
    grams = listed.where(F.col("shard").isNotNull()).select("block", "shard", salted, "grams", "counts")
    sums = grams.select("shard", "salt", "grams", "counts")
    if salts > 1:
        sums = sums.repartition("shard", "salt").sortWithinPartitions("shard", "salt").mapInArrow(_partly_summed, SUMS)
    model = materialize(sums.drop("salt").repartition("shard").sortWithinPartitions("shard").mapInArrow(_modelled, MODEL), "lm-model")
    whole = model.agg(F.coalesce(F.max("bytes_n"), F.lit(0)), F.coalesce(F.max("bytes_kinds"), F.lit(0))).first()
    release(docs.sparkSession)

    facts = ("contexts", "kinds", "nexts")
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    asked = grams.select("shard", "salt", "block", "grams", none("binary", "counts"), *(none("binary", f) for f in facts))
    told = model.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), none("int", "block"), "grams", "counts", *facts)
    needed = told.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("block").asc_nulls_first()).mapInArrow(_looked_up, NEEDED)

    parts = needed.withColumn("kind", F.lit(0))
    for more in (words.join(counts, "word").select("block", F.lit(1).alias("kind"), "word", "c"), dealt.withColumn("kind", F.lit(2))):
        parts = parts.unionByName(more, allowMissingColumns=True)
    scored = in_tasks(parts, "block", "kind").mapInArrow(_scorer(order, tokens, kinds, (whole[0], whole[1])), f"doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
