"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole as `<|turn|>role<|text|>text<|end|>` per turn, encoded once with offsets, and the spans
of the trained turns are intersected with those of the tokens by binary search. The three control strings are added to
the tokenizer as tokens of their own, so no token ever reaches over the edge of a turn. Inside roles and texts control
strings can't occur: `<` and `|` that meet, or that only backslashes part, get one more backslash between, which parse()
takes away again.

Defined cases: null roles and texts are empty; turns are ordered by turn, role, text, null turns first, and repeated
rows are turns each; a null conv_id is a conversation of its own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import arrow_rows

TURN, TEXT, STOP = "<|turn|>", "<|text|>", "<|end|>"
_TO_ESCAPE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation, and (begin, end) of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, STOP]
        at = spans[-1][1] + len(STOP)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(formatted)]


def align(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the spans; both are sorted, and spans don't overlap."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 1] <= spans[np.maximum(at, 0), 1]) & (offsets[:, 1] > offsets[:, 0])


def masked_texts(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """Unescaped text under the mask, one for each run of tokens without a gap; shared characters are taken once."""
    begin, end = offsets[mask, 0], offsets[mask, 1]
    if not len(begin):
        return []
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    last = np.r_[first[1:] - 1, len(begin) - 1]
    return [unescape(formatted[a:b]) for a, b in zip(begin[first].tolist(), reach[last].tolist(), strict=True)]


@dataclass
class Formatter:
    """tokenizer: path of a byte-level tokenizer file. trained: the roles that the loss is taken on."""

    tokenizer: str
    trained: tuple[str, ...] = ("assistant",)
    _tok: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"tokenizer": self.tokenizer, "trained": self.trained, "_tok": None}

    def encoder(self):
        if self._tok is None:
            from tokenizers import AddedToken, Tokenizer, pre_tokenizers

            tok = Tokenizer.from_file(self.tokenizer)
            # offsets cover blanks too
            tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
            tok.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in (TURN, TEXT, STOP)])
            self._tok = tok
        return self._tok

    def __call__(self, turns: list[tuple[str, str]]) -> tuple[str, list[int], np.ndarray, np.ndarray]:
        """(formatted, ids, offsets, loss mask) of one conversation."""
        formatted, spans = render(turns)
        found = self.encoder().encode(formatted, add_special_tokens=False)
        offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
        trained = np.array([r in self.trained for r, _ in turns], bool)
        return formatted, found.ids, offsets, align(offsets, spans[trained])


def render_conversations(turns: DataFrame, formatter: Formatter) -> DataFrame:
    """conv_id, formatted, ids, begins, ends, mask of each conversation; turns has conv_id, turn, role, text."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "formatted", "ids", "begins", "ends", "mask"]

        def flush(out: list) -> pa.RecordBatch:
            kinds = [conv_kind, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

        now, held, out, conv_kind, any_yet = None, [], [], None, False
        for batch in batches:
            conv_kind = batch.schema.field("conv_id").type
            for conv, role, text in arrow_rows(batch, "conv_id", "role", "text"):
                if any_yet and conv != now:
                    formatted, ids, offsets, mask = formatter(held)
                    out.append((now, formatted, ids, offsets[:, 0], offsets[:, 1], mask))
                    held = []
                now, any_yet = conv, True
                held.append((role or "", text or ""))
                if len(out) >= 256:
                    yield flush(out)
                    out = []
        if held:
            formatted, ids, offsets, mask = formatter(held)
            out.append((now, formatted, ids, offsets[:, 0], offsets[:, 1], mask))
        if out:
            yield flush(out)

    rows = turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, f"conv_id {kind}, formatted string, ids array<int>, begins array<int>, ends array<int>, mask array<boolean>")


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from rendered conversations alone."""
    import hashlib

    kind = rendered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for formatted, begins, ends, mask in arrow_rows(batch, "formatted", "begins", "ends", "mask"):
                turns = parse(formatted)
                said = "".join(masked_texts(formatted, np.array([begins, ends], np.int64).T.reshape(-1, 2), np.array(mask, bool)))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                for c, v in zip(cols, (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted)), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([batch.column(batch.schema.get_field_index("conv_id")), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rendered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
