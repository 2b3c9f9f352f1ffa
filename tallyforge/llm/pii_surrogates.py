"""Keyed surrogates for personal data.

Detected entities (e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment card and account numbers, US
social security numbers, secret tokens, names after a title) are replaced by others of the same type and format. What a type may vary is written as a number of mixed radix,
and a keyed permutation of those numbers gives the surrogate: digits stay digits, letters stay letters of their script,
vowels vowels, case stays, a card's check digit stays as right or wrong as it was, an account number's stays right, public addresses stay public, and
a name keeps its title and its last letter, which carry gender. Spellings of one entity (case of an e-mail address,
punctuation of a number) share a canonical form and so one surrogate, in every document: coreference.

A permutation keeps entities distinct. What it can't rule out is checked over all distinct entities: a surrogate that is
itself an entity of the corpus, or an entity's own value. Those are drawn again with the next key, and what is drawn
again must differ from all others, until nothing collides. Entities that have no free surrogate of their format left
after `most_draws` get letters or digits added.

Names are found after a title. Each of their words is an entity of its own, and wherever it stands capitalised in the
same text, with a title or without, it gets the same surrogate. Telephone numbers are those with a country code, those
that begin with 0, ten-digit ones, and ones of nine digits in groups; their canonical form leaves out country code and
leading 0, which surrogates keep.

Defined cases: null texts stay null, empty ones empty; texts without entities stay as they are; of entities that overlap
the earlier type in PATTERNS counts (a tie), then the one that begins first; equal entities in repeated rows get equal
surrogates; texts and entities of any length are searched and replaced whole, in time that grows with their length; an
empty table gives no rows; a null doc_id is carried along; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import TwoGenerations, arrow_rows, materialize

#: Letters by script, vowels first; a letter's group is the string it stands in.
GROUPS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñß", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "0123456789")
_GROUP = {c: g for g in GROUPS for c in g}
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|M|Mme|Mlle|Sr|Sra|Srta|Don|Doña|Господин|Госпожа|Κύριος|Κυρία"
#: Country codes of one and two digits; others have three.
COUNTRY = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
_SEP = "(?:[ .-]| ?/ ?)?"
_PHONES = (
    r"(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}",
    rf"(?:\+ ?|00)[1-9]\d{{0,2}}{_SEP}(?:\(\d{{1,5}}\){_SEP})?\d(?:{_SEP}\d){{5,12}}",
    r"1?[2-9]\d{2}[2-9]\d{6}",
    rf"\(0[1-9]\d{{0,4}}\)(?:{_SEP}\d){{5,9}}",
    # a date isn't one, with what stands behind it
    rf"(?!\d\d([ ./-])\d\d\1(?:19|20)\d\d(?!\d))0[1-9](?:{_SEP}\d){{7,10}}",
    r"[6-9]\d{2}([ .-])\d{3}\2(?!000)\d{3}",
    r"[6-9]\d{2}([ .-])\d{2}\3\d{2}\3\d{2}",
    r"9\d([ .-])\d{3}\4\d{2}\4\d{2}",
)

PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])[_.+%-]*+(?P<said>[^\W_][\w.+%-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}\b)"),
    "token": re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ipv6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?:(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9A-Fa-f]{1,4})(?![\w:]|\.\d)"),
    "ssn": re.compile(r"(?<![\w.+-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.+])(?!00[1-9](?:[ -]?\d){10,12}(?![ -]?\d))\d(?:[ -]?\d){12,18}(?![\w])"),
    "ip": re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\w|\.\d)"),
    "phone": re.compile(rf"(?<![\w.])(?:{'|'.join(_PHONES)})(?!\w)"),
    "name": re.compile(rf"\b(?:(?:{TITLES})\.? )+(?!(?:{TITLES})\b)((?:[A-ZÀ-ÞΑ-ΩА-Я][a-zà-ÿά-ώа-я]{{2,}})(?: [A-ZÀ-ÞΑ-ΩА-Я][a-zà-ÿά-ώа-я]{{2,}})?)"),
}
#: Characters of a long value that are permuted together.
PIECE = 128
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]{3,}")


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, type, canonical form) of the entities, in order and apart from each other; earlier types go first.

    The words of a name are entities of their own, and so are their other mentions in the text.
    """
    kinds = []
    if "@" in text:
        kinds.append("email")
    if _DIGIT.search(text):
        kinds += ["token", "iban", *(["ipv6"] if ":" in text else []), "card", "ssn", "ip", "phone"]
    out: list[tuple[int, int, str, str]] = []
    for kind in kinds:
        taken, k, more = sorted(out), 0, []
        for m in PATTERNS[kind].finditer(text):
            a, b = m.span("said") if kind == "email" else m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if (k == len(taken) or b <= taken[k][0]) and _holds(kind, said := text[a:b]):
                more.append((a, b, kind, canonical(kind, said)))
        out += more
    out.sort()
    parts = {canonical("name", w) for m in PATTERNS["name"].finditer(text) for w in m[1].split(" ")}
    if not parts:
        return out
    named, k = [], 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        if text[a].isupper() and (value := canonical("name", m[0])) in parts:
            while k < len(out) and out[k][1] <= a:
                k += 1
            if k == len(out) or b <= out[k][0]:
                named.append((a, b, "name", value))
    return sorted(out + named)


def _holds(kind: str, said: str) -> bool:
    """Whether what looks like an entity is one: account numbers have their check digits, IPv6 addresses can be read."""
    if kind == "iban":
        return _mod97(said.replace(" ", "")) == 1
    if kind == "ipv6":
        if said.count(":") < 3 or not _DIGIT.search(said):
            return False  # rather names of a programming language, or a time
        try:
            return bool(ipaddress.IPv6Address(said))
        except ValueError:
            return False
    return True


def _mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def canonical(kind: str, said: str) -> str:
    if kind == "iban":
        return said.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(said).exploded
    if kind == "ssn":
        return said.replace("-", "")
    if kind in ("phone", "card"):
        digits = "".join(c for c in said if c.isdigit())
        return _national(digits, said.startswith("+")) if kind == "phone" else digits
    if kind == "ip":
        return ".".join(str(int(x)) for x in said.split("."))
    return said.lower()


def _national(digits: str, plus: bool) -> str:
    """A telephone number without country code and leading 0, as calls from within a country and from abroad share it."""
    if plus or digits.startswith("00"):
        digits = digits if plus else digits[2:]
        digits = digits[next((n for n in (1, 2) if digits[:n] in COUNTRY), 3) :]
    elif len(digits) == 11 and digits[0] == "1":
        return digits[1:]
    return digits[1:] if digits.startswith("0") else digits


def permute(n: int, size: int, key: bytes) -> int:
    """A keyed permutation of range(size): a Feistel network over the next square, walked until it is in range."""
    if size < 2:
        return n
    side = isqrt(size - 1) + 1
    while True:
        a, b = divmod(n, side)
        for r in range(8):
            mixed = hmac.digest(key, b"%d/%d/%d" % (r, side, b), "sha256")
            a, b = b, (a + int.from_bytes(mixed[:16], "big")) % side
        n = a * side + b
        if n < size:
            return n


def _by_groups(said: str, key: bytes, fixed: frozenset[int] = frozenset()) -> str:
    """Permutes the letters and digits of said within their groups, at all but the fixed places."""
    if len(said) > PIECE:
        return _in_pieces(said, key, lambda part, own, i: _by_groups(part, own, frozenset(f - i for f in fixed)))
    at = [i for i, c in enumerate(said) if c in _GROUP and i not in fixed]
    n, size = 0, 1
    for i in at:
        g = _GROUP[said[i]]
        n, size = n * len(g) + g.index(said[i]), size * len(g)
    # the key holds what stays, so that formats have permutations of their own
    shape = "".join(_GROUP[c][0] if i in at else c for i, c in enumerate(said))
    n = permute(n, size, key + shape.encode())
    out = list(said)
    for i in reversed(at):
        g = _GROUP[said[i]]
        n, k = divmod(n, len(g))
        out[i] = g[k]
    return "".join(out)


def _in_pieces(said: str, key: bytes, permuted) -> str:
    """permuted(piece, key, place) of each piece; a piece's key holds the pieces before it, so that long values are
    permuted as a whole, in time that grows with their length."""
    out = []
    for i in range(0, len(said), PIECE):
        part = said[i : i + PIECE]
        out.append(permuted(part, key, i))
        key = hmac.digest(key, part.encode(), "sha256")
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit that digits call for."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _is_public(n: int) -> bool:
    a, b = n >> 24, (n >> 16) & 255
    return a not in (0, 10, 127) and a < 224 and not (a == 172 and 16 <= b < 32) and (a, b) not in ((192, 168), (169, 254))


def surrogate(kind: str, value: str, secret: bytes, draw: int = 0) -> str:
    """The surrogate of a canonical form; draw: how often it was drawn again."""
    key = hmac.digest(secret, f"{kind}/{draw}/".encode(), "sha256")
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        host, _, top = domain.rpartition(".")
        return f"{_by_groups(local, key)}@{_by_groups(host, hmac.digest(secret, b'domain/', 'sha256'))}.{top}"
    if kind == "card":
        head = _by_groups(value[:-1], key)
        return head + str((_luhn(head) + int(value[-1]) - _luhn(value[:-1])) % 10)
    if kind == "ip":
        n = 0
        for x in value.split("."):
            n = n * 256 + int(x)
        if _is_public(n):
            n = permute(n, 1 << 32, key)
            while not _is_public(n):
                n = permute(n, 1 << 32, key)
        else:
            n = (n >> 16 << 16) | permute(n & 0xFFFF, 1 << 16, key)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "token":
        return _in_pieces(value, key, lambda part, own, _: f"{permute(int(part, 16), 16 ** len(part), own):0{len(part)}x}")
    if kind == "iban":
        letters = "".join(c if c.isdigit() else c.lower() for c in value[4:])
        body = _by_groups(letters, key + value[:2].encode()).upper()
        return f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02d}{body}"
    if kind == "ipv6":
        n, low = int(ipaddress.IPv6Address(value)), (1 << 112) - 1
        return ipaddress.IPv6Address((n & ~low) | permute(n & low, low + 1, key)).exploded
    if kind == "ssn":
        while True:
            value = _by_groups(value, key)
            if PATTERNS["ssn"].fullmatch(f"{value[:3]}-{value[3:5]}-{value[5:]}"):
                return value
    if kind == "name":
        last = [i for i, c in enumerate(value) if i + 1 == len(value) or value[i + 1] == " "]
        return _by_groups(value, key, frozenset(last))
    said = _by_groups(value, key)
    # a 0 in front would read as one to leave out
    while said.startswith("0") != value.startswith("0"):
        said = _by_groups(said, key)
    return said


def spell(said: str, kind: str, value: str) -> str:
    """A canonical value in the format of said: its case and its punctuation."""
    if kind == "ipv6":
        short = ipaddress.IPv6Address(value).compressed if "::" in said else value
        return short.upper() if said.upper() == said else short
    if kind in ("phone", "card", "iban", "ssn"):
        places = [i for i, c in enumerate(said) if c.isalnum()] if kind == "iban" else [i for i, c in enumerate(said) if c.isdigit()]
        out = list(said)
        extra = value[len(places) :] if len(value) > len(places) else ""
        for i, c in zip(places[len(places) - min(len(value), len(places)) :], value, strict=False):
            out[i] = c
        return "".join(out) + extra
    if kind == "ip":
        return value
    if said.isupper() and said.lower() != said:
        return value.upper()
    return "".join(v.upper() if i < len(said) and said[i].isupper() else v for i, v in enumerate(value))


@dataclass
class Surrogates:
    """Replaces entities in texts; again: how often (type, canonical form) was drawn again."""

    secret: bytes
    again: dict[tuple[str, str], int] = field(default_factory=dict)
    most_draws: int = 16

    def value(self, kind: str, value: str, draw: int) -> str:
        if draw < self.most_draws:
            return surrogate(kind, value, self.secret, draw)
        # no free surrogate of this format: longer by what the number of the draw says
        tail = hashlib.sha256(f"{draw}/{value}".encode()).hexdigest()[:8]
        tail = str(int(tail, 16)) if kind in ("phone", "card", "iban", "ssn") else tail
        return f"{tail}{value}" if kind == "email" else f"{value}{tail}"

    def replace(self, text: str, memo: dict) -> tuple[str, list[str]]:
        found = find(text)
        if not found:
            return text, []
        out, at = [], 0
        for a, b, kind, value in found:
            out += [text[at:a], spell(text[a:b], kind, memo[kind, value])]
            at = b
        return "".join([*out, text[at:]]), [k for _, _, k, _ in found]


def entities(docs: DataFrame) -> DataFrame:
    """The distinct entities of docs: kind, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = sorted({(k, v) for (t,) in arrow_rows(batch, "text") if t for _, _, k, v in find(t)})
            yield pa.record_batch([pa.array([x[i] for x in seen], pa.string()) for i in range(2)], names=["kind", "value"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, value string").distinct()


def collisions(found: DataFrame, secret: bytes, most_draws: int = 16, rounds: int = 64) -> DataFrame:
    """kind, value, draw of the entities whose first surrogate collides: with an entity, or with another surrogate."""
    maker = Surrogates(secret, most_draws=most_draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [maker.value(k, v, d) for k, v, d in arrow_rows(batch, "kind", "value", "draw")]
            yield pa.record_batch([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, "said"])

    # few bytes and much work, so dealt to as many tasks as a shuffle has
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = lambda df: df.repartition(tasks).mapInArrow(run, "kind string, value string, draw int, said string")
    held = materialize(drawn(found.select("kind", "value", F.lit(0).alias("draw"))), "pii-drawn")
    taken = found.select("kind", F.col("value").alias("said"), F.lit(True).alias("real"))
    for _ in range(rounds):
        marked = held.join(taken, ["kind", "said"], "left")
        # of equal surrogates the one drawn first stays, then the least value
        first = held.groupBy("kind", "said").agg(F.min(F.struct("draw", "value")).alias("first"))
        marked = marked.join(first, ["kind", "said"])
        bad = materialize(marked.where(F.col("real").isNotNull() | (F.col("value") != F.col("first.value"))).select("kind", "value", "draw"), "pii-again")
        if bad.isEmpty():
            return held.where("draw > 0").select("kind", "value", "draw")
        rest = held.join(bad, ["kind", "value"], "left_anti")
        held = materialize(rest.unionByName(drawn(bad.withColumn("draw", F.col("draw") + 1))), "pii-drawn")
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def replace(docs: DataFrame, secret: bytes, most_draws: int = 16, most_held: int = 100_000) -> DataFrame:
    """A row per row of docs: doc_id, text (with surrogates), n_entities, kinds (sorted, distinct).

    Entities that had to be drawn again are few; up to most_held of them travel with the code, more are joined.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    again = materialize(collisions(materialize(entities(docs), "pii-entities"), secret, most_draws), "pii-draws")
    few = again.limit(most_held + 1).count() <= most_held
    known = {(r.kind, r.value): r.draw for r in again.collect()} if few else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(secret, known, most_draws)
        memo = TwoGenerations(lambda kv: maker.value(*kv, known.get(kv, 0)))
        for batch in batches:
            out = []
            for text, draws in arrow_rows(batch, "text", "draws"):
                if text is None:
                    out.append((None, []))
                elif draws:
                    own = {(d["kind"], d["value"]): d["draw"] for d in draws}
                    out.append(maker.replace(text, TwoGenerations(lambda kv, own=own: maker.value(*kv, own.get(kv, known.get(kv, 0))))))
                else:
                    out.append(maker.replace(text, memo))
            cols = [batch.column(batch.schema.get_field_index("doc_id")), pa.array([t for t, _ in out], pa.string()), pa.array([len(k) for _, k in out], pa.int64()), pa.array([sorted(set(k)) for _, k in out], pa.list_(pa.string()))]
            yield pa.record_batch(cols, names=["doc_id", "text", "n_entities", "kinds"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    struct = "array<struct<kind:string,value:string,draw:int>>"
    if few:
        rows = rows.withColumn("draws", F.lit(None).cast(struct))
    else:
        rows = _with_draws(rows, again)
    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_entities long, kinds array<string>")


def _with_draws(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows with the draws of their entities, by joins on the text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = sorted({(d, k, v) for d, t in arrow_rows(batch, "digest", "text") if t for _, _, k, v in find(t)})
            yield pa.record_batch([pa.array([x[i] for x in seen], pa.string()) for i in range(3)], names=["digest", "kind", "value"])

    rows = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    held = rows.select("digest", "text").mapInArrow(run, "digest string, kind string, value string").distinct().join(again, ["kind", "value"])
    held = held.groupBy("digest").agg(F.collect_list(F.struct("kind", "value", F.col("draw").cast("int").alias("draw"))).alias("draws"))
    return rows.join(held, "digest", "left").select("doc_id", "text", "draws")
