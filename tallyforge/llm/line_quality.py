"""Quality by line sequence labelling.

A linear-chain conditional random field marks each line as content or boilerplate; a document is kept if enough of its
words stand in content lines and it passes two plain rules. Lines carry no labels of their own, only documents do, so
the field is fitted in rounds: lines of good documents are content, lines of poor ones begin with the label of a line
classifier and are then decoded again, under the field fitted so far.

Defined cases: null and empty texts have no words and fail the rules; lines without words are content and weigh
nothing; rows with a null doc_id are judged like others; labels that are null or lack a document are left out; without
any poor labelled document every line is content; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import arrow_rows
from .crf import Crf, fit

FEATURES = ("words", "long", "upper", "symbols", "shouts", "bars", "digits", "repeated", "again", "ended", "chars", "first", "last")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACE = b" \t\n\x0b\x0c\r"

_KIND = {name: np.zeros(256, bool) for name in ("space", "tail", "upper", "lower", "symbol", "shout", "bar", "digit")}
for _name, _set in (("space", SPACE), ("tail", bytes(range(0x80, 0xC0))), ("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123)) + bytes(range(0xC0, 256))), ("symbol", b"#*$%&|<>"), ("shout", b"!"), ("bar", b"|"), ("digit", b"0123456789")):
    _KIND[_name][list(_set)] = True


def repeated_words(words: list[bytes]) -> np.ndarray:
    """Which words stand in a window of three words that the text holds twice or more."""
    n = len(words)
    covered = np.zeros(n, bool)
    if n < 4:
        return covered
    w = np.fromiter(map({}.setdefault, words, itertools.count()), np.int64, n)
    pair = w[:-1] * n + w[1:]
    if n > 2_000_000:  # the product of three would overflow
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * n + w[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if same.any():
        hit = np.zeros(n - 2, bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        for k in range(3):
            covered[k : n - 2 + k] |= hit
    return covered


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts per text, features per line, words per line, first line of each text and the end)."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    is_space = _KIND["space"][data]
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    word_start = ~is_space & np.r_[True, is_space[:-1]]

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask, dtype=np.int64)]
        return total[ends] - total[starts]

    count = {k: per_line(_KIND[k][data]) for k in ("upper", "lower", "symbol", "shout", "bar", "digit")}
    words = per_line(word_start)
    chars = per_line(~is_space & ~_KIND["tail"][data])
    lines = np.array([r.count(b"\n") + 1 for r in raw])
    begin = np.r_[0, np.cumsum(lines)]
    again = np.zeros(len(ends), bool)
    repeated = np.zeros(int(words.sum()), bool)
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    at = 0
    for i, r in enumerate(raw):
        a, b = begin[i], begin[i + 1]
        if b - a > 1:
            seen: set[bytes] = set()
            for k, line in enumerate(r.split(b"\n"), a):
                if words[k]:
                    if line in seen:
                        again[k] = True
                    else:
                        seen.add(line)
        found = repeated_words(r.split())
        repeated[at : at + len(found)] = found
        out[i] = len(found), chars[a:b].sum(), count["symbol"][a:b].sum(), again[a:b].sum(), found.sum()
        at += len(found)
    of_word = np.r_[0, np.cumsum(repeated, dtype=np.int64)]
    last_word = np.cumsum(words)
    in_line = of_word[last_word] - of_word[last_word - words]
    letters, n, c = np.maximum(1, count["upper"] + count["lower"]), np.maximum(1, words), np.maximum(1, chars)
    tail = data[np.maximum(ends - 1, 0)]
    edge = np.zeros((2, len(ends)))
    edge[0, begin[:-1]] = 1
    edge[1, begin[1:] - 1] = 1
    x = np.stack([
        np.log1p(words), np.log1p(chars / n), count["upper"] / letters, np.minimum(3, count["symbol"] / n), np.minimum(3, count["shout"] / n),
        np.minimum(2, count["bar"] / n), count["digit"] / c, in_line / n, again, np.isin(tail, list(b".!?:;")), np.log1p(chars), *edge,
    ], axis=1)
    return out, x, words, begin


def _line_classifier(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200) -> np.ndarray:
    """Probability of label 1 from a weighted logistic regression."""
    z = np.hstack([(x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    rate = 4 / max(1e-9, np.linalg.norm((z * weight[:, None]).T @ z / weight.sum(), 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        w += rate * ((z * weight[:, None]).T @ (y - p) / weight.sum() - 1e-3 * w)
    return 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))


def train(texts: list[str | None], quality: list[int], rounds: int = 3) -> Crf | None:
    """Fits the field to documents labelled 1 (good) or 0 (poor); None without poor ones."""
    poor = np.array([q == 0 for q in quality], bool)
    if not poor.any() or poor.all():
        return None
    _, x, words, begin = measure(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(begin))
    bad, used = poor[of], words > 0
    # documents weigh alike, and so do both kinds
    weight = used / np.maximum(1, np.bincount(of, used, len(texts)))[of]
    weight[bad] *= weight[~bad].sum() / max(1e-9, weight[bad].sum())
    y = (bad & used & (_line_classifier(x, bad.astype(float), weight) > 0.5)).astype(int)
    for _ in range(rounds):
        model = fit(x, y, begin)
        y = (bad & used & (model.decode(x, begin) == 1)).astype(int)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, most: int, label: str = "quality") -> tuple[list, list]:
    """Texts and labels of at most so many labelled documents, chosen by a hash of doc_id."""
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("label_id", F.lit(17)), "label_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or "", r.y))
    return [r.text for r in rows], [r.y for r in rows]


def judge(docs: DataFrame, model: Crf | None, least_words: int = 50, most_repeated: int = 50, least_share: float = 0.5) -> DataFrame:
    """A row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_share, content (the text's content lines)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [t for (t,) in arrow_rows(part, "text")]
                counts, x, words, begin = measure(texts)
                boiler = (model.decode(x, begin) if model else np.zeros(len(x), int)) * (words > 0)
                total = np.r_[0, np.cumsum(words)]
                held = np.r_[0, np.cumsum(words * (1 - boiler))]
                share = (held[begin[1:]] - held[begin[:-1]]) / np.maximum(1, total[begin[1:]] - total[begin[:-1]])
                failed = (counts[:, 0] < least_words) | (100 * counts[:, 4] > most_repeated * counts[:, 0])
                content = [None if t is None else t if not boiler[begin[k] : begin[k + 1]].any() else "\n".join(line for line, b in zip(t.split("\n"), boiler[begin[k] : begin[k + 1]], strict=True) if not b) for k, t in enumerate(texts)]
                cols = [part.column(part.schema.get_field_index("doc_id")), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(~failed & (share >= least_share)), pa.array(share), pa.array(content, pa.string())]
                yield pa.record_batch(cols, names=["doc_id", *COUNTS, "base_failed", "kept", "content_share", "content"])

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, content_share double, content string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
