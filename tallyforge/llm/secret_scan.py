"""Secrets in texts: plain patterns, and strings whose characters look drawn at random.

Plain patterns, leftmost and non-overlapping each: assignments to names such as password or token, access keys, and
lower-case hexadecimal strings. Besides, every candidate string (a maximal stretch of characters of a class, at least as
long as the class's window) is read by a window that slides over it. The window keeps the counts of its characters, and
with them the sum of c log2 c, which one step changes by two characters; the Shannon entropy follows from that sum.
Stretches covered by windows of enough entropy, and with enough characters of each sort that the class asks for, are
spans of their own (the whole candidate, if they are half of it or more), unless the allow-list names what they are: identifiers that are public by form, checksums,
placeholders, alphabets. A span that overlaps a plain one, or one of a class before, isn't added.

Spans are (kind, start, end, entropy) in code points, end exclusive, by start and then kind; plain spans carry no entropy
and the allow-list never touches them.

Defined cases: null and empty texts have no spans; very long texts are read whole, in time linear in their length, and
windows hold no more than their own characters; a null doc_id and repeated rows are scanned like others; spans of
different kinds may start at the same place, and come in the order of KINDS; other columns are ignored by scan() and
kept by redact(); an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import arrow_rows, fresh

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")


@dataclass(frozen=True)
class CharacterClass:
    """What a window over a class's characters must show: entropy in bits, and so many digits, capitals, small letters
    and letters of either case."""

    kind: str
    characters: str
    window: int
    entropy: float
    digits: int = 0
    upper: int = 0
    lower: int = 0
    letters: int = 0


#: Narrow classes first. A window of random characters reaches these limits nearly always, words and numbers don't.
CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", 24, 3.0, digits=4, letters=2),
    CharacterClass("entropy_alnum", "0-9A-Za-z", 20, 3.6, digits=2, letters=4),
    CharacterClass("entropy_base64", "0-9A-Za-z+/_-", 32, 4.0, digits=2, upper=4, lower=4),
)
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, *(c.kind for c in CLASSES))

#: Strings of these forms, as a whole, are public: UUIDs, and placeholders.
ALLOWED = (
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"(?i:.*(?:example|sample|placeholder|dummy|changeme|xxxx|your[_-]).*)",
)
#: What says, right before a string, that it is a checksum.
CHECKSUM = re.compile(r"(?i:sha-?(?:1|224|256|384|512)|md5|crc32|checksum|integrity|etag)[\"']?\x20*[:=-]\x20*[\"']?$", re.ASCII)
TOKEN = "0-9A-Za-z+/_-"
SORT = {c: k for k, sort in enumerate((string.digits, string.ascii_uppercase, string.ascii_lowercase)) for c in sort}


def base_spans(text: str) -> list[tuple]:
    """(kind, start, end) of the plain patterns; a match that is too short is dropped, with all that it covers."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def is_alphabet(s: str, run: int = 10) -> bool:
    """Whether s holds so many characters in a row that each follow the one before in the code."""
    held = 1
    for a, b in zip(s, s[1:], strict=False):
        held = held + 1 if ord(b) == ord(a) + 1 else 1
        if held >= run:
            return True
    return False


class Scanner:
    """Finds spans in a text. allowed: patterns of whole strings that aren't secrets, beside those of the library."""

    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ()):
        self.classes = [(c, re.compile(f"[{c.characters}]{{{c.window},}}"), [k * math.log2(k) if k else 0.0 for k in range(c.window + 1)]) for c in classes]
        self.order = {k: i for i, k in enumerate((*BASE_KINDS, *(c.kind for c in classes)))}
        self.allowed = [re.compile(a) for a in (*ALLOWED, *allowed)]
        # without a stretch of this many token characters no class has a candidate
        self.any = re.compile(f"[{TOKEN}]{{{min((c.window for c in classes), default=1)},}}")

    def windows(self, s: str, c: CharacterClass, log: list[float]) -> list[tuple[int, int, float]]:
        """(start, end, most entropy) of the stretches of s that windows with enough of everything cover."""
        w, count, total, sorts = c.window, {}, 0.0, [0, 0, 0, 0]
        out: list[tuple[int, int, float]] = []
        most = (math.log2(w) - c.entropy) * w + 1e-9
        for i, ch in enumerate(s):
            k = count.get(ch, 0)
            total += log[k + 1] - log[k]
            count[ch] = k + 1
            sorts[SORT.get(ch, 3)] += 1
            if i < w - 1:
                continue
            at, (digits, upper, lower, _) = i - w + 1, sorts
            if total <= most and digits >= c.digits and upper >= c.upper and lower >= c.lower and upper + lower >= c.letters:
                h = math.log2(w) - total / w
                if out and at <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1, max(h, out[-1][2]))
                else:
                    out.append((at, i + 1, h))
            ch = s[at]
            k = count[ch]
            total += log[k - 1] - log[k]
            count[ch] = k - 1
            sorts[SORT.get(ch, 3)] -= 1
        return out

    def stretches(self, s: str, c: CharacterClass, log: list[float]) -> list[tuple[int, int, float]]:
        """What windows cover, or all of s where that is half of it or more."""
        found = self.windows(s, c, log)
        if 2 * sum(b - a for a, b, _ in found) >= len(s):
            return [(0, len(s), max(h for _, _, h in found))]
        return found

    def is_allowed(self, text: str, start: int, end: int, whole: tuple[int, int]) -> bool:
        """whole: the stretch of token characters around the span."""
        said = text[start:end], text[whole[0] : whole[1]]
        return any(a.fullmatch(s) for a in self.allowed for s in said) or is_alphabet(said[0]) or bool(CHECKSUM.search(text[max(0, whole[0] - 24) : whole[0]]) or CHECKSUM.search(text[max(0, start - 24) : start]))

    def __call__(self, text: str | None) -> list[tuple[str, int, int, float | None]]:
        if not text:
            return []
        found = [(*s, None) for s in base_spans(text)]
        for m in self.any.finditer(text):
            lo, hi = m.span()
            taken = [(a, b) for _, a, b, _ in found if a < hi and lo < b]
            for c, pattern, log in self.classes:
                for run in pattern.finditer(text, lo, hi):
                    for a, b, h in self.stretches(run[0], c, log):
                        a, b = run.start() + a, run.start() + b
                        if any(a < y and x < b for x, y in taken) or self.is_allowed(text, a, b, (lo, hi)):
                            continue
                        taken.append((a, b))
                        found.append((c.kind, a, b, h))
        return sorted(found, key=lambda s: (s[1], self.order[s[0]], s[2]))


SPANS = "array<struct<kind:string,start:long,end:long,entropy:double>>"


def scan(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, spans for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed)
        of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entropy", pa.float64())]))
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "entropy"), s, strict=True)) for s in scanner(t)] for (t,) in arrow_rows(batch, "text")]
            yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), pa.array(spans, of)], names=["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def redact(docs: DataFrame, mask: str = "[SECRET]", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ()) -> DataFrame:
    """docs with each stretch of spans that touch or overlap replaced by mask; texts without spans stay as they are."""
    (found,) = fresh(docs.columns, "found")

    @F.udf("string", useArrow=True)
    def masked(text):
        out, upto, held = [], 0, worker_scanner(classes, allowed)(text)
        for _, a, b, _ in held:
            if a > upto or not out:
                out += [text[upto:a], mask]
            upto = max(upto, b)
        return "".join([*out, text[upto:]]) if held else text

    return docs.withColumn(found, masked(F.col("text").cast("string"))).withColumn("text", F.col(found)).drop(found)


def worker_scanner(classes: tuple[CharacterClass, ...], allowed: tuple[str, ...], _held: dict = {}) -> Scanner:  # noqa: B006
    """One scanner for all rows of a worker."""
    key = classes, allowed
    if key not in _held:
        _held.clear()
        _held[key] = Scanner(classes, allowed)
    return _held[key]


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
