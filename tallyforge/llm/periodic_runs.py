"""Periodic runs of words: stretches that repeat a block of words, wherever it begins and however long it is.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
max(least_words, times * q) words that no neighbouring word extends keeping period q.

Harmonic grid: a run with period p and four periods or more covers a multiple of p, and the next three, within its first
four periods. So for each period only every p-th place is looked at, n/p of them, and n log n (period, place) pairs see
every run of a text of n words. Pairs whose next grid words differ begin no run. For all that remain, of many texts at
once, the longest common extensions of the place and the place one period on, forwards and backwards, are found by
simultaneous binary searches over prefix hashes. A stretch with several periods keeps the smallest. Then the words
themselves are compared; a stretch that only hashes took for a run is extended again word by word.

Defined cases: words are `[^\\x20\\x09-\\x0D]+`; null and empty texts have no words and no runs; very long texts are taken
whole, with their pairs looked at in parts of bounded size; of runs of equal length the one that begins first, and then
the one with the smaller period, is the longest; runs may overlap; repeated rows and null doc_ids are rows like others;
other columns are ignored by find() and kept by collapse(); an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import arrow_rows, fresh

#: A prime below 2^31, so that products of two remainders fit 64 bits.
PRIME = np.uint64(2**31 - 1)
#: Periods a stretch must hold; the grid's filter relies on four.
TIMES = 4
#: (period, place) pairs looked at together, and words of texts taken together.
PAIRS, WORDS = 1 << 18, 1 << 16


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo PRIME, by doubling."""
    out = np.ones(1, np.uint64)
    step = base % int(PRIME)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % PRIME])
        step = step * step % int(PRIME)
    return out[:n]


class Hashes:
    """Prefix hashes of a sequence of word numbers."""

    def __init__(self, w: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        values = rng.integers(1, int(PRIME), int(w.max(initial=0)) + 1, np.uint64)
        self.power = powers(int(rng.integers(1 << 20, 1 << 30)), len(w) + 1)
        terms = values[w] * self.power[:-1] % PRIME
        # below 2^31 each, so that sums of fewer than 2^33 fit
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % PRIME])

    def alike(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of a length at places and one period later have equal hashes."""
        here = (self.prefix[at + length] + PRIME - self.prefix[at]) % PRIME
        there = (self.prefix[at + period + length] + PRIME - self.prefix[at + period]) % PRIME
        return here * self.power[period] % PRIME == there

    def extend(self, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from (or, back, before) at equal those one period on, up to most of them."""
        low, high = np.zeros_like(most), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            mid = (low + high + 1) // 2
            good = self.alike(at - mid if back else at, period, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low


def grid(lengths: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place in it) of all pairs of texts of these lengths, in parts of about PAIRS."""
    text = np.flatnonzero(lengths >= max(least, TIMES))
    period = 1
    held, size = [], 0
    while len(text):
        count = (lengths[text] - 1 - (TIMES - 1) * period) // period + 1  # places with three more grid words behind them
        for i in range(0, len(text), PAIRS):
            held.append((text[i : i + PAIRS], period, count[i : i + PAIRS]))
            size += int(count[i : i + PAIRS].sum())
            if size >= PAIRS:
                yield from _spread(held)
                held, size = [], 0
        period += 1
        text = text[lengths[text] >= TIMES * period]
    yield from _spread(held)


def _spread(held: list[tuple[np.ndarray, int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places of (texts, period, counts), in parts of at most PAIRS."""
    if not held:
        return
    text = np.concatenate([t for t, _, _ in held])
    period = np.repeat([p for _, p, _ in held], [len(t) for t, _, _ in held])
    upto = np.cumsum(np.concatenate([c for _, _, c in held]))
    for begin in range(0, int(upto[-1]), PAIRS):
        k = np.arange(begin, min(begin + PAIRS, int(upto[-1])))
        of = np.searchsorted(upto, k, "right")
        before = np.where(of > 0, upto[of - 1], 0)
        yield text[of], period[of], (k - before) * period[of]


def find_runs(texts: list[list[bytes]], least: int = 6, hashes=Hashes) -> list[list[tuple[int, int, int]]]:
    """For each text, as a list of words, its runs (start, length, period), by start and period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    w = np.fromiter(map({}.setdefault, itertools.chain.from_iterable(texts), itertools.count()), np.int64, int(begin[-1]))
    h = None
    runs: dict[tuple[int, int], int] = {}
    # a run that was found over each word: its end and period
    until, of = np.zeros(len(w), np.int64), np.ones(len(w), np.int64)
    for text, period, place in grid(lengths, least):
        at = begin[text] + place
        hit = np.flatnonzero((w[at] == w[at + period]) & (w[at + period] == w[at + 2 * period]))
        at, period, text = at[hit], period[hit], text[hit]
        # inside a run whose period divides this one, only that run would be found again
        new = (w[at + 2 * period] == w[at + 3 * period]) & ((at + 3 * period >= until[at]) | (period % of[at] != 0))
        at, period, text = at[new], period[new], text[new]
        if not len(at):
            continue
        h = h or hashes(w)
        ahead = h.extend(at, period, begin[text + 1] - at - period, back=False)
        behind = h.extend(at, period, at - begin[text], back=True)
        start, end = at - behind, at + period + ahead
        long = end - start >= np.maximum(least, TIMES * period)
        # periods only grow from part to part, and in order here, so a stretch keeps its smallest
        for p, t, lo, hi in np.unique(np.stack([period, text, start, end], axis=1)[long], axis=0).tolist():
            for a, b in _verified(w, lo, hi, p, int(begin[t]), int(begin[t + 1])):
                if b - a >= max(least, TIMES * p) and runs.setdefault((a, b), p) == p:
                    wider = until[a:b] < b
                    until[a:b][wider], of[a:b][wider] = b, p
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, end), period in sorted(runs.items(), key=lambda r: (r[0][0], r[1])):
        text = int(np.searchsorted(begin, start, "right")) - 1
        out[text].append((start - int(begin[text]), end - start, period))
    return out


def _verified(w: np.ndarray, start: int, end: int, p: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """The maximal stretches of words with the period inside a stretch: itself, unless only hashes took it for one."""

    def closed(a: int, b: int) -> bool:
        return (a == lo or w[a - 1] != w[a - 1 + p]) and (b == hi or w[b] != w[b - p])

    same = np.concatenate([[False], w[start : end - p] == w[start + p : end], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    stretches = [(start + int(a), start + int(b) + p) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return [s for s in stretches if closed(*s)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats: of each run the first period stays, unless another run drops it."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(itertools.compress(words, np.cumsum(edge[:-1]) == 0))


RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find(docs: DataFrame, least_words: int = 6) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed (the text without repeats) for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            held: list[list[bytes]] = []
            size = first = 0
            for i, (text,) in enumerate(arrow_rows(batch, "text")):
                held.append((text or "").encode().split())
                size += len(held[-1])
                if size >= WORDS or i == batch.num_rows - 1:
                    found = find_runs(held, least_words)
                    made = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
                    short = [collapsed(t, runs).decode() for t, runs in zip(held, found, strict=True)]
                    cols = [ids.slice(first, len(held)), pa.array(map(len, held), pa.int64()), pa.array(made, _RUN), pa.array(short, pa.string())]
                    yield pa.record_batch(cols, names=["doc_id", "n_words", "runs", "collapsed"])
                    first, held, size = i + 1, [], 0

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def collapse(docs: DataFrame, least_words: int = 6) -> DataFrame:
    """docs with the texts that hold runs replaced by their words without repeats; others stay as they are."""
    (found,) = fresh(docs.columns, "found")

    @F.udf("string", useArrow=True)
    def short(text):
        words = text.encode().split() if text else []
        runs = find_runs([words], least_words)[0]
        return collapsed(words, runs).decode() if runs else text

    return docs.withColumn(found, short(F.col("text").cast("string"))).withColumn("text", F.col(found)).drop(found)
