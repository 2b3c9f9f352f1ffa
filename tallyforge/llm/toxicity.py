"""Toxicity of deobfuscated text.

Every word is seen through a noisy channel that may replace letters by look-alike signs, put signs or spaces between
letters, or repeat letters. Its readings form a lattice of characters, which Viterbi decodes under a character trigram
model counted over all documents. Words without any such sign have one reading and are taken as they stand. Spaces are
undone in rows of three or more words of at most two letters; a word cut into longer parts isn't put together. The
restored text is scored by a logistic regression on the evidence of words and word beginnings that labelled toxic
documents hold significantly more often.

Only the text is an input of a score. Labels are read from the rows that the caller hands in, at most `most_labelled`
of them, chosen by a hash; character counts cover every document.

Defined cases: null and empty texts get the score of a text without any evidence; labels that are null are left out;
without both kinds of labels every score is the share of toxic labels (0.5 without labels); repeated rows are scored
each; very long texts are scored whole, and very long words are decoded but not remembered; equally good readings (ties)
go to the first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import MEMO_BYTES, TwoGenerations, arrow_rows, fresh, materialize, worker_wide

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
#: Class 0 is a boundary, the last class any other letter.
SIZE = len(LETTERS) + 2
OTHER = SIZE - 1
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.zeros(0x250, np.int32)
for _c in range(0x250):
    if chr(_c).isalpha():
        _TABLE[_c] = CLASS.get(chr(_c), OTHER)

#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¥": "y"}
#: Log probabilities of the channel: a sign for a letter inside a word or at its edge, a sign that is only a boundary,
#: a sign or space to leave out between letters, letters that were repeated.
AS_LETTER, AS_LETTER_EDGE, AS_BOUNDARY, AS_BOUNDARY_EDGE, LEFT_OUT, SIGN_LEFT_OUT, SQUEEZED, KEPT_DOUBLE = -0.7, -4.0, -4.0, -0.1, -1.5, -8.0, -4.0, -0.1
#: A space beside a fragment of two letters, as it stands or left out: the model decides.
SPACE, SPACE_LEFT_OUT = -0.1, -0.1
#: Signs that end sentences or stand behind words for show; others behind a word are rather letters.
TRAILING = "!$+(*#%&"
#: The boundary that such a sign is before a word, where it hardly ever stands for show; brackets do.
AS_BOUNDARY_BEFORE = {c: -6.0 for c in "!$+"}

_EDGE = ".,;:!?\"'()[]{}«»„“”‘’…-"
_DOUBLE = re.compile(r"(.)\1")
_TRIPLE = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1*", re.S)
#: Kinds of words in a row that may be a spaced word: see Restorer.kind.
_SPACED, _LONE = re.compile("[bsf][sf]+[sfe]"), re.compile("s{3,}")


# --- character model ---------------------------------------------------------------------------------------------


def classes(text: str) -> np.ndarray:
    """Character classes of the lower-cased text, one boundary between words and at both ends."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    c = _TABLE[np.minimum(code, 0x24F)]
    far = code > 0x24F
    if far.any():
        c[far] = [OTHER if chr(x).isalpha() else 0 for x in code[far]]
    c = np.concatenate(([0], c, [0]))
    return c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character classes in threes, over all texts; at most SIZE ** 3 numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            texts = [t for (t,) in arrow_rows(batch, "text") if t]
            for i in range(0, len(texts), 256):
                c = classes("\n".join(texts[i : i + 256])).astype(np.int64)
                c = np.concatenate(([0], c))
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = docs.select(F.col("text").cast("string")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE**3)
    for r in cells:
        out[r.cell] = r.n
    return out.reshape(SIZE, SIZE, SIZE)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a class after two others: Witten-Bell, down to uniform."""

    def step(c: np.ndarray, below: np.ndarray) -> np.ndarray:
        kinds = np.maximum(1, (c > 0).sum(axis=-1, keepdims=True))
        return (c + kinds * below) / (c.sum(axis=-1, keepdims=True) + kinds)

    p = step(counts.sum(axis=(0, 1)), np.full(SIZE, 1 / SIZE))
    p = step(counts.sum(axis=0), p[None])
    return np.log(step(counts, p[None])).astype(np.float32)


# --- lattice ---------------------------------------------------------------------------------------------------


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Readings of each run of equal characters of a lower-cased word, with their log probabilities.

    A blank in a reading is a boundary. Spaces in word are those between letters that stand alone, which are rather left
    out, or beside fragments.
    """
    runs = [m.group(0) for m in _RUN.finditer(word)]
    alone = [len(p.strip(_EDGE)) <= 1 for p in word.split(" ")]
    gaps = (x and y for x, y in zip(alone, alone[1:], strict=False))
    inner = [i for i, r in enumerate(runs) if r[0].isalpha()]
    a, b = (inner[0], inner[-1]) if inner else (0, -1)
    out: list[list[tuple[str, float]]] = []
    for i, r in enumerate(runs):
        c, n, inside = r[0], len(r), a < i < b
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c, SQUEEZED if n == 2 else -0.5), (c * 2, KEPT_DOUBLE if n == 2 else -1.0)])
            continue
        letters = SIGNS.get(c, "")
        shown = i > b and (not letters or c in TRAILING or n > 1)
        before = AS_LETTER if n > 1 else AS_BOUNDARY_BEFORE.get(c, AS_BOUNDARY)
        read = [(" ", AS_BOUNDARY_EDGE if shown else before if i < a else AS_BOUNDARY)]
        if c == " ":
            read = [(" ", -4.0), ("", -0.1)] if next(gaps) else [(" ", SPACE), ("", SPACE_LEFT_OUT)]
        elif inside:
            read.append(("", SIGN_LEFT_OUT if letters else LEFT_OUT))
        for letter in letters:
            p = AS_LETTER_EDGE if shown else AS_LETTER
            read.append((letter, p))
            if n == 2:
                read.append((letter * 2, p))
        out.append(read)
    return out


def decode(readings: list[list[tuple[str, float]]], model: list[float]) -> str:
    """The best reading under the model, by Viterbi over (two classes before, boundary or not); ties go to the first."""
    best = {(0, 0): (0.0, None)}
    for options in readings:
        then: dict = {}
        for (x, y), (score, path) in best.items():
            for said, p in options:
                s, u, v = score + p, x, y
                for c in said:
                    k = 0 if c == " " else CLASS.get(c, OTHER)
                    if k == 0 and v == 0:
                        continue
                    s += model[(u * SIZE + v) * SIZE + k]
                    u, v = v, k
                old = then.get((u, v))
                if old is None or s > old[0]:
                    then[u, v] = (s, (path, said))
        best = then
    top, chosen = -np.inf, None
    for (x, y), (score, path) in best.items():
        s = score + (model[(x * SIZE + y) * SIZE] if y else 0.0)
        if s > top:
            top, chosen = s, path
    said = []
    while chosen:
        said.append(chosen[1])
        chosen = chosen[0]
    return "".join(reversed(said))


class Restorer:
    """Restored words of whitespace-separated words, from a memo of bounded size."""

    def __init__(self, model: np.ndarray, memo_bytes: int = MEMO_BYTES):
        self.model = model.ravel().tolist()
        self.memo = TwoGenerations(lambda w: (self.read(w), self.kind(w)), memo_bytes)

    @staticmethod
    def kind(word: str) -> str:
        """What a word may be of a spaced word: s, a lone character, with or without punctuation; f, a fragment of two;
        b and e, a fragment with punctuation before or behind it, which can only begin or end one; x, nothing."""
        bare = word.strip(_EDGE)
        if len(word) == 1 or len(bare) == 1:
            return "s"
        if len(bare) != 2:
            return "x"
        return "f" if len(word) == 2 else "e" if word.startswith(bare) else "b" if word.endswith(bare) else "x"

    def read(self, word: str) -> tuple[str, ...]:
        bare = word.strip(_EDGE).lower()
        if bare.isalpha() and not _TRIPLE.search(bare) and not any(c in SIGNS for c in word):
            return (_DOUBLE.sub(self._double, bare),) if _DOUBLE.search(bare) else (bare,)
        low = word.lower()
        if not any(c.isalpha() for c in low):
            return ()
        said = decode(lattice(low), self.model)
        return tuple("".join(c if c.isalpha() else " " for c in said).split())

    def _double(self, m: re.Match) -> str:
        """The better reading of a doubled letter where doubled letters are all that is open in a word.

        What stands before and after it is the same for both readings, so they differ in the trigrams over the letter
        alone, each double letter is decided by itself, and the result is the lattice's best path.
        """
        a, b = m.span()
        at = lambda c: CLASS.get(c, OTHER)
        x, c, y = (at(m.string[a - 1]) if a else 0), at(m[1]), (at(m.string[b]) if b < len(m.string) else 0)
        twice = KEPT_DOUBLE + self.model[(x * SIZE + c) * SIZE + c] + self.model[(c * SIZE + c) * SIZE + y]
        return m[0] if twice > SQUEEZED + self.model[(x * SIZE + c) * SIZE + y] else m[1]

    def words(self, text: str | None) -> list[tuple[str, ...]]:
        """Restored words for each word of the text. Three or more lone characters in a row are read as one, and so are
        lone characters and fragments; where short words around may belong to a spaced word or not, both are given."""
        words = (text or "").split()
        known = list(map(self.memo.__getitem__, words))
        out = [said for said, _ in known]
        kinds = "".join([kind for _, kind in known])
        for m in _SPACED.finditer(kinds):
            a, b = m.span()
            for lone in _LONE.finditer(kinds, a, b):
                c, d = lone.span()
                out[c:d] = [self.memo[" ".join(words[c:d])][0], *[()] * (d - c - 1)]
            plain = {w for said in out[a:b] for w in said}
            out[a] += tuple(w for w in self.memo[" ".join(words[a:b])][0] if w not in plain)
        return out

    def text(self, text: str | None) -> str:
        return " ".join(w for ws in self.words(text) for w in ws)


def shared_restorer(model: np.ndarray, memo_bytes: int = MEMO_BYTES) -> Restorer:
    """One restorer with its memo for all tasks of a Python worker, that of the model at hand."""
    return worker_wide(("restorer", hashlib.sha256(model.tobytes()).digest(), memo_bytes), lambda: Restorer(model, memo_bytes))


# --- scores ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """weights: log odds of toxicity of the rows that hold a feature. A score is a logistic function of the strongest
    evidence and of the sum of the rest; a text without evidence has that of a lone feature of log odds `least`."""

    characters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    least: float = 0.0
    bias: float = 0.0
    strongest: float = 1.0
    others: float = 0.0

    @property
    def lengths(self) -> list[int]:
        return sorted({len(f) - 1 for f in self.weights if f.endswith("*")})

    def inputs(self, found: list[str]) -> tuple[float, float]:
        """Strongest log odds, and the logarithm of one more than the sum of the other positive ones. Beginnings of one
        word are one piece of evidence: of features that begin with each other the strongest counts."""
        held: dict[str, float] = {}
        for f in sorted(found):
            stem = f[:4]
            held[stem] = max(held.get(stem, -np.inf), self.weights[f])
        w = sorted(held.values(), reverse=True)
        return (max(w[0], self.least), float(np.log1p(sum(x for x in w[1:] if x > 0)))) if w else (self.least, 0.0)

    def score(self, found: list[str]) -> float:
        top, rest = self.inputs(found)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.strongest * top + self.others * rest, -50, 50))))


def evidence(words: tuple[str, ...], weights: dict[str, float], lengths: list[int]) -> tuple[str, ...]:
    """Features of the restored words that have a weight: whole words, and beginnings marked by a star."""
    out = []
    for w in words:
        if w in weights:
            out.append(w)
        for n in lengths:
            if len(w) >= n and (f := f"{w[:n]}*") in weights:
                out.append(f)
    return tuple(out)


#: What most words have: no evidence, and no part in a spaced word.
NOTHING: tuple = ((), "x")


class Finder:
    """Evidence of texts, from a memo of that of each word: what Restorer.words gives, but only where it counts."""

    def __init__(self, model: Model, memo_bytes: int = MEMO_BYTES):
        self.weights, self.lengths, self.restorer = model.weights, model.lengths, Restorer(model.characters, memo_bytes // 16)
        self.memo = TwoGenerations(self._own, memo_bytes * 15 // 16, shared=NOTHING)

    def _own(self, word: str) -> tuple[tuple[str, ...], str]:
        found, kind = evidence(self.restorer.read(word), self.weights, self.lengths), Restorer.kind(word)
        return (found, kind) if found or kind != "x" else NOTHING

    def __call__(self, text: str | None) -> list[str]:
        """The distinct features of the text, in order."""
        words = (text or "").split()
        known = list(map(self.memo.__getitem__, words))
        kinds = "".join([kind for _, kind in known])
        hits: set[str] = set()
        spaced = list(_SPACED.finditer(kinds))
        if spaced:
            known = [found for found, _ in known]
            for a, b in (m.span() for m in spaced):
                for c, d in (m.span() for m in _LONE.finditer(kinds, a, b)):
                    known[c:d] = [self.memo[" ".join(words[c:d])][0], *[()] * (d - c - 1)]
                hits.update(self.memo[" ".join(words[a:b])][0])
            hits.update(*known)
        else:
            hits.update(*{found for found, _ in known})
        return sorted(hits)


def shared_finder(model: Model, memo_bytes: int = MEMO_BYTES) -> Finder:
    """One finder with its memo for all tasks of a Python worker, that of the model at hand."""
    said = hashlib.sha256(model.characters.tobytes() + repr(sorted(model.weights.items())).encode()).digest()
    return worker_wide(("finder", said, memo_bytes), lambda: Finder(model, memo_bytes))


def _restored(docs: DataFrame, characters: np.ndarray, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """y and the distinct restored words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = shared_restorer(characters, memo_bytes)
        for batch in batches:
            said = [sorted({w for ws in restorer.words(t) for w in ws}) for (t,) in arrow_rows(batch, "text")]
            yield pa.record_batch([batch.column(batch.schema.get_field_index("y")), pa.array(said, pa.list_(pa.string()))], names=["y", "words"])

    return docs.select("y", "text").mapInArrow(run, "y int, words array<string>")


def _evidence_rows(restored: DataFrame, known: dict[str, int], lengths: list[int]) -> DataFrame:
    """y and the features found in each row: all that the driver needs of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({f for w in words or () for f in evidence((w,), known, lengths)}) for (words,) in arrow_rows(batch, "words")]
            yield pa.record_batch([batch.column(batch.schema.get_field_index("y")), pa.array(found, pa.list_(pa.string()))], names=["y", "found"])

    return restored.mapInArrow(run, "y int, found array<string>")


def select_features(restored: DataFrame, least: int = 4, z: float = 4.5, beginnings: tuple[int, ...] = (4, 5, 6, 7, 8)) -> dict[str, float]:
    """Words and beginnings held by significantly more toxic rows than others, with the log odds of the rows that hold
    them."""
    n1, n0 = restored.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    if not n1 or not n0:
        return {}
    def begun(n: int):
        return F.transform(F.filter("words", lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    seen = restored.select("y", F.explode(F.array_distinct(F.concat("words", *map(begun, beginnings)))).alias("feature"))
    seen = seen.groupBy("feature").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("t") >= least)
    p1, p0, p = F.col("t") / n1, (F.col("n") - F.col("t")) / n0, F.col("n") / (n1 + n0)
    spread = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    odds = F.ln((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 2))
    return {r.feature: r.odds for r in seen.where((p1 - p0) / spread > z).select("feature", odds.alias("odds")).orderBy("feature").collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_labelled: int = 12_000, memo_bytes: int = MEMO_BYTES) -> Model:
    """The character model from docs, weights from labels (doc_id and the label column).

    memo_bytes, here and in drop_toxic(): what each Python worker may remember of words; it changes the time taken and
    no result.
    """
    characters = log_model(trigram_counts(docs))
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("label_id", F.lit(29)), "label_id", "y").limit(most_labelled)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    restored = materialize(_restored(rows, characters, memo_bytes), "restored")
    share = restored.agg(F.avg("y")).first()[0]
    p = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
    prior = float(np.log(p / (1 - p)))
    weights = select_features(restored)
    if not weights:
        return Model(characters, {}, prior)
    model = Model(characters, weights, prior)
    rows = _evidence_rows(restored, weights, model.lengths).collect()
    x = np.array([(1.0, *model.inputs(r.found)) for r in rows])
    model.bias, model.strongest, model.others = logistic(x, np.array([r.y for r in rows], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float, float]:
    """Coefficients of a logistic regression by Newton's method; those of evidence aren't negative."""
    w = np.array([0.0, 1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(3) * [1e-6, 1, 1] + 1e-9 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * len(y) * (w - [0, 1, 0]) * [0, 1, 1])
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, with_text: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, score, predicted, evidence (features found), and restored (text) if asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shared_finder(model)
        for batch in batches:
            scores, held, said = [], [], []
            for (t,) in arrow_rows(batch, "text"):
                held.append(finder(t))
                scores.append(model.score(held[-1]))
                if with_text:
                    said.append(finder.restorer.text(t))
            cols = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(held, pa.list_(pa.string()))]
            yield pa.record_batch(cols + [pa.array(said, pa.string())] * with_text, names=["doc_id", "score", "predicted", "evidence", "restored"][: 4 + with_text])

    schema = f"doc_id {kind}, score double, predicted int, evidence array<string>" + ", restored string" * with_text
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """The rows of docs that aren't predicted toxic, all columns, in one pass over the texts."""
    said = docs.schema["text"].dataType.simpleString() == "string"
    mark = "text" if said else fresh(docs.columns, "judged_text")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shared_finder(model, memo_bytes)
        for batch in batches:
            keep = [model.score(finder(t)) < threshold for (t,) in arrow_rows(batch, mark)]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield kept if said else kept.select([c for c in kept.schema.names if c != mark])

    # texts of another type travel as strings beside it
    return (docs if said else docs.withColumn(mark, F.col("text").cast("string"))).mapInArrow(run, docs.schema)
