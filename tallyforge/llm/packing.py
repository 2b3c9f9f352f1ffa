"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

Each task tokenises its own rows and packs them window by window, so nothing is shuffled: a window is closed once it
holds window_tokens ids, and its sequences are as few as hold them. The cost of a piece of n tokens is estimated as
linear * n + quadratic * n * n (attention). Documents longer than a sequence are first cut into whole sequences; the
rest go in descending order of length to the lowest-cost sequence with capacity for them. What fits in no sequence is
cut over the sequences with the most capacity left, so that a window pads less than one sequence in all.

Sequences are padded to max_tokens, but one whose fill is a power of two is left as it is.

Defined cases: doc_id may be of any type and null; a null text is empty and gives the end id alone; a very long text is cut
over as many sequences as it fills; equal lengths are taken in order of arrival; an empty
table gives no rows; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame

from .common import MEMO_BYTES, TwoGenerations, arrow_rows, worker_wide

assert array("I").itemsize == 4 and sys.byteorder == "little"  # ids are little-endian unsigned 32-bit

#: Columns after doc_id, which keeps its type.
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of a task begin at its partition's number times this.
PER_TASK = 1 << 33


class ChunkTokenizer:
    """Ids of whole texts from a memo of the ids of their chunks between ASCII white space, and of the chunks' pieces.

    The tokenizer's normaliser and its pre-tokenizer never join what white space parts, so ids of a text are those of
    its chunks in order. It lower-cases, so chunks are looked up with A-Z lower-cased, but not in texts with one of
    its added tokens, which it matches as they stand. Chunks without them go through its stages one by one: normaliser,
    pre-tokenizer, model. For printable composed Latin (below U+0250) the first two are lower-casing, the
    pre-tokenizer's pattern and its letters for bytes. All this holds for tokenizers with that normaliser and that
    pre-tokenizer; texts of others are encoded whole.
    """

    #: The normaliser and pre-tokenizer of word_bpe_49k.json.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        steps = [json.loads(x.__getstate__()) if x else {} for x in (self.tok.normalizer, self.tok.pre_tokenizer)]
        split = steps[1].get("pretokenizers", [])
        self.known = steps[0] == self.NORMALIZER and [s["type"] for s in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": self.PATTERN}
        if not self.known:
            return
        self.model, self.normalize, self.split = self.tok.model, self.tok.normalizer.normalize_str, self.tok.pre_tokenizer.pre_tokenize_str
        self.memo = TwoGenerations(self._encode, memo_bytes)
        self.marked = True  # whether the text has an added token, so that its chunks may
        # printable bytes stand for themselves, the others in order for the characters from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = dict(zip([b for b in range(256) if b not in plain], range(256, 512)))
        self.added = [t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()]

    def _model(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _encode(self, chunk: bytes) -> bytes:
        said = chunk.decode()
        if self.marked and any(a in chunk.lower() for a in self.added):
            return np.array(self.tok.encode(said, add_special_tokens=False).ids, "<u4").tobytes()
        if said.isprintable() and max(said) < "\u0250" and is_normalized("NFC", said) and max(low := said.lower()) < "\u0250":
            pieces = self.PIECES.findall(low)
            if len(pieces) > 1:  # a piece is a chunk with itself as its only piece
                return b"".join([self.memo[p.encode()] for p in pieces])
            if not low.isascii():
                pieces = [p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        else:
            pieces = [p for p, _ in self.split(self.normalize(said))]
        return b"".join(map(self._model, pieces))

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        if not text:
            return b""
        if not self.known:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        raw = text.encode()
        low = raw.lower()
        self.marked = any(a in low for a in self.added)
        if self.marked:
            low = raw
        return b"".join(map(self.memo.__getitem__, low.split()))


def shared_tokenizer(path: str, memo_bytes: int = MEMO_BYTES) -> ChunkTokenizer:
    """One tokenizer with its memo for all tasks of a Python worker."""
    return worker_wide(("tokenizer", path, memo_bytes), lambda: ChunkTokenizer(path, memo_bytes))


def balance(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length); every token of each item lies in exactly one piece."""
    whole: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(lengths):
        full = n // capacity
        whole += [[(i, k * capacity, capacity)] for k in range(full)]
        if n % capacity:
            rest.append((n % capacity, i, full * capacity))
    total = sum(n for n, _, _ in rest)
    if not total:
        return whole
    count = -(-total // capacity)
    rest.sort(key=lambda x: -x[0])
    cost, room = np.zeros(count), np.full(count, capacity)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]

    def put(s: int, i: int, start: int, n: int) -> None:
        out[s].append((i, start, n))
        cost[s] += linear * n + quadratic * n * n
        room[s] -= n

    for n, i, start in rest:
        fits = np.where(room >= n, cost, np.inf)
        s = int(fits.argmin())
        if fits[s] < np.inf:
            put(s, i, start, n)
            continue
        while n:
            s = int(room.argmax())
            take = min(n, int(room[s]))
            put(s, i, start, take)
            start, n = start + take, n - take
    return whole + [s for s in out if s]


def _packer(path: str, memo_bytes: int, end_id: int, max_tokens: int, window_tokens: int, linear: float, quadratic: float):
    end = np.array([end_id], "<u4").tobytes()

    def flush(window: list[tuple], first: int, doc_type: pa.DataType) -> tuple[pa.RecordBatch, int]:
        sequences = balance([len(ids) // 4 for _, ids in window], max_tokens, linear, quadratic)
        cols: list[list] = [[] for _ in range(7)]
        for s, pieces in enumerate(sequences):
            at = 0
            for i, start, n in pieces:
                doc, ids = window[i]
                for c, v in zip(cols, (doc, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, first + s, at), strict=True):
                    c.append(v)
                at += n
        kinds = [doc_type] + [pa.int64()] * 2 + [pa.binary()] + [pa.int64()] * 3
        names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names), first + len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = shared_tokenizer(path, memo_bytes)
        sequence = TaskContext.get().partitionId() * PER_TASK
        window: list[tuple] = []
        held = 0
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for doc, text in arrow_rows(batch, "doc_id", "text"):
                ids = tok(text) + end
                window.append((doc, ids))
                held += len(ids) // 4
                if held >= window_tokens:
                    made, sequence = flush(window, sequence, doc_type)
                    window, held = [], 0
                    yield made
        if window:
            yield flush(window, sequence, doc_type)[0]

    return run


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 1, window_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 2048, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    memo_bytes: what each Python worker may hold of chunks' ids; it changes the time taken and no result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(_packer(tokenizer, memo_bytes, end_id, max_tokens, window_tokens, linear, quadratic), f"doc_id {kind}, {SCHEMA}")
