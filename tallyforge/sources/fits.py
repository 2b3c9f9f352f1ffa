"""Tables, images and headers of FITS files, read from bytes (published standard 4.0) and written as one table."""

from __future__ import annotations

import io
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

BLOCK, CARD = 2880, 80
#: Codes of column and image types, big-endian as stored.
TABLE_TYPES = {"L": "i1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16", "A": "S"}
IMAGE_TYPES = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: Header keywords shown for a file.
KEYWORDS = ["TELESCOP", "INSTRUME", "OBJECT", "RA", "DEC", "EXPTIME"]


def _value(text: str):
    text = text.strip()
    if m := re.match(r"'((?:[^']|'')*)'", text):  # a quote inside is doubled
        return m[1].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, float):
        try:
            return kind(text.replace("D", "E") if kind is float else text)
        except ValueError:
            continue
    return text or None


def scan(f) -> Iterator[tuple[dict, int, int]]:
    """(header, place of its data, their length) of the header-data units of an open file, of which only headers are read."""
    at, end = 0, f.seek(0, 2)
    while at + BLOCK <= end:
        header: dict = {}
        ended = False
        while not ended:
            f.seek(at)
            block = f.read(BLOCK)
            if len(block) < BLOCK:
                raise ValueError("FITS header without an end")
            at += BLOCK
            for i in range(0, BLOCK, CARD):
                card = block[i : i + CARD].decode("ascii", "replace")
                name = card[:8].strip()
                if name == "END":
                    ended = True
                    break
                if card[8:10] == "= ":
                    header[name] = _value(card[10:])
        shape = [int(header.get(f"NAXIS{i}", 0)) for i in range(1, int(header.get("NAXIS", 0)) + 1)]
        size = math.prod(shape) * abs(int(header.get("BITPIX", 8))) // 8 * int(header.get("GCOUNT", 1)) if shape else 0
        size += int(header.get("PCOUNT", 0)) if header.get("XTENSION") == "BINTABLE" else 0
        yield header, at, size
        at += -(-size // BLOCK) * BLOCK


def units(data: bytes) -> list[tuple[dict, bytes]]:
    """(header, data) of the header-data units of a file."""
    return [(header, data[at : at + size]) for header, at, size in scan(io.BytesIO(data))]


def ascii_table(header: dict, data: bytes) -> dict[str, list]:
    """Columns of an ASCII table; blank and TNULL fields of numbers are None."""
    width, rows, out = int(header["NAXIS1"]), int(header["NAXIS2"]), {}
    lines = [data[i * width : (i + 1) * width].decode("latin-1") for i in range(rows)]
    for i in range(1, int(header["TFIELDS"]) + 1):
        code, size, _, places = re.match(r"([AIFED])(\d+)(\.(\d+))?", str(header[f"TFORM{i}"]).strip()).groups()
        at, null = int(header[f"TBCOL{i}"]) - 1, str(header.get(f"TNULL{i}", "")).strip()
        said = [x[at : at + int(size)] for x in lines]
        if code != "A":
            scale, zero = header.get(f"TSCAL{i}", 1), header.get(f"TZERO{i}", 0)
            said = [_number(x.strip(), code, int(places or 0), scale, zero) if x.strip() not in ("", null) else None for x in said]
        out[str(header.get(f"TTYPE{i}", f"col{i}"))] = [x.rstrip() for x in said] if code == "A" else said
    return out


def _number(said: str, code: str, places: int, scale, zero):
    if code == "I":
        n = int(said)
    else:
        n = float(said.upper().replace("D", "E"))
        if "." not in said and "E" not in said.upper().replace("D", "E"):
            n /= 10**places  # the point is left out
    return n if (scale, zero) == (1, 0) else n * scale + zero


def _scaled(values: np.ndarray, header: dict, number: int | None = None) -> np.ndarray:
    scale, zero = (header.get(f"TSCAL{number}", 1), header.get(f"TZERO{number}", 0)) if number else (header.get("BSCALE", 1), header.get("BZERO", 0))
    return values if (scale, zero) == (1, 0) else values * scale + zero


def field_of(header: dict, i: int) -> tuple[str, int, str, str]:
    """Name, repeats, code and, for arrays of any length, the code of their elements, of a binary table's column."""
    m = re.match(r"\s*(\d*)([A-Z])([A-Z]?)", str(header[f"TFORM{i}"]))
    n, code = int(m[1] or 1), m[2]
    if code not in TABLE_TYPES and code not in "XPQ" or code in "PQ" and m[3] not in {*TABLE_TYPES, "X"}:
        raise ValueError(f"FITS column type {header[f'TFORM{i}']} isn't known")
    return str(header.get(f"TTYPE{i}", f"col{i}")), n, code, m[3]


def _stored(n: int, code: str):
    """How a field lies in a row, as numpy says it."""
    if code == "A":
        return f"S{n}"
    if code == "X":
        return "u1", (-(-n // 8),)
    if code in "PQ":
        return {"P": ">i4", "Q": ">i8"}[code], (2 * n,)
    return (TABLE_TYPES[code], (n,)) if n > 1 else TABLE_TYPES[code]


def _numbers(v: np.ndarray, code: str) -> np.ndarray:
    """Logical values as such, complex ones as pairs of a real and an imaginary part."""
    if code == "L":
        return v == ord("T")
    if code in "CM":
        return np.ascontiguousarray(v).view(v.dtype.str.replace("c16", "f8").replace("c8", "f4")).reshape(len(v), -1)
    return v


def _varying(ends: np.ndarray, code: str, header: dict, i: int, heap: Callable[[int, int], bytes]) -> tuple[list, set[int]]:
    """Arrays of any length by their (count, place in the heap), and the rows whose array doesn't lie inside the heap."""
    out, bad = [], set()
    wide = 1 if code in "AX" else np.dtype(TABLE_TYPES[code]).itemsize
    for row, (count, at) in enumerate(ends.tolist()):
        size = -(-count // 8) if code == "X" else count * wide
        raw = heap(at, size) if count >= 0 and at >= 0 else b""
        if len(raw) < size or count < 0:
            out.append(None)
            bad.add(row)
        elif code == "A":
            out.append(raw.decode("latin-1").rstrip("\x00 "))
        elif code == "X":
            out.append(np.unpackbits(np.frombuffer(raw, "u1"))[:count].astype(float).tolist())
        else:
            out.append(_scaled(_numbers(np.frombuffer(raw, TABLE_TYPES[code]), code), header, i).astype(float).ravel().tolist())
    return out, bad


def binary_rows(header: dict, data: bytes, heap: Callable[[int, int], bytes], wanted: set[str] | None = None) -> tuple[dict[str, list], set[int]]:
    """Columns of rows of a binary table, all or those wanted, and the rows that hold something unreadable, which is None.

    Columns of several values, of bits and of complex numbers become lists. heap gives bytes by place and length."""
    fields = [(i, *field_of(header, i)) for i in range(1, int(header["TFIELDS"]) + 1)]
    kinds = [(f"f{i}", kind) if isinstance(kind, str) else (f"f{i}", *kind) for i, _, n, code, _ in fields if n for kind in [_stored(n, code)]]
    row = np.dtype(kinds)
    if row.itemsize > int(header["NAXIS1"]):
        raise ValueError("FITS rows are shorter than their columns")
    row = np.dtype({"names": row.names, "formats": [row.fields[f][0] for f in row.names], "offsets": [row.fields[f][1] for f in row.names], "itemsize": int(header["NAXIS1"])}) if row.names else row
    rows = len(data) // max(1, int(header["NAXIS1"]))
    table = np.frombuffer(data, row, rows) if rows and row.names else None
    out, bad = {}, set()
    for i, name, n, code, inner in fields:
        if wanted is not None and name not in wanted:
            continue
        if table is None or not n:
            out[name] = [None] * rows
            continue
        v = table[f"f{i}"]
        if code == "A":
            out[name] = [x.decode("latin-1").rstrip("\x00 ") for x in v]
        elif code in "PQ":
            out[name], missed = _varying(v[:, :2], inner, header, i, heap)
            bad |= missed
        elif code == "X":
            bits = np.unpackbits(v.reshape(rows, -1), axis=1)[:, :n]
            out[name] = bits[:, 0].astype(bool).tolist() if n == 1 else bits.astype(float).tolist()
        elif code == "L":
            out[name] = _numbers(v, code).tolist()
        else:
            held = _scaled(_numbers(v, code), header, i).tolist()
            if f"TNULL{i}" in header and v.ndim == 1 and v.dtype.kind in "iu":
                held = [None if raw == header[f"TNULL{i}"] else x for raw, x in zip(v.tolist(), held, strict=True)]
            out[name] = held
    return out, bad


def binary_table(header: dict, data: bytes) -> dict[str, list]:
    """Columns of a binary table."""
    rows = int(header["NAXIS1"]) * int(header["NAXIS2"])
    heap = data[int(header.get("THEAP", rows)) :]
    out, bad = binary_rows(header, data[:rows], lambda at, n: heap[at : at + n])
    if bad:
        raise ValueError(f"FITS arrays outside the heap in {len(bad)} rows")
    return out


def array_columns(values: np.ndarray) -> dict[str, list]:
    """feature_i columns of an array: rows are its first axis, all others are laid flat."""
    flat = values.reshape(len(values), -1) if values.ndim > 1 else values.reshape(-1, 1)
    return {f"feature_{i}": flat[:, i].astype(float).tolist() for i in range(flat.shape[1])}


def columns_of(data: bytes) -> dict[str, list]:
    """The first table of a file, else its first image."""
    found = units(data)
    for header, body in found:
        if header.get("XTENSION") in ("BINTABLE", "TABLE"):
            return (binary_table if header["XTENSION"] == "BINTABLE" else ascii_table)(header, body)
    for header, body in found:
        if header.get("XTENSION", "IMAGE") == "IMAGE" and int(header.get("NAXIS", 0)) and body:
            shape = [int(header[f"NAXIS{i}"]) for i in range(int(header["NAXIS"]), 0, -1)]
            return array_columns(_scaled(np.frombuffer(body, IMAGE_TYPES[int(header["BITPIX"])]).reshape(shape), header))
    raise ValueError("no table or image in the FITS file")


def read(spark: SparkSession, path: str, columns: list[str] | None = None, problems: bool = False) -> DataFrame:
    """The table of FITS files, by ranges of rows (see fits_source) where executors can open the files by their path; what only
    Spark's readers can open is read whole, one task a file."""
    from . import fits_source

    if fits_source.reachable(path):
        return fits_source.read(spark, path, columns, problems)
    if problems:
        raise ValueError(f"{path} is read whole, without a column of problems")
    whole = read_whole(spark, path)
    return whole.select(*(F.col(f"`{c}`") for c in columns)) if columns else whole


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """The table of FITS files, one task a file, with the columns of all of them: a column that a file lacks is null
    there, and a type is the widest that any file has (whole number, number, text; lists of numbers)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def kinds(batches):
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                rows += [(p, i, name, _kind(values)) for i, (name, values) in enumerate(columns_of(bytes(content)).items())]
            yield pd.DataFrame(rows, columns=["path", "i", "name", "kind"])

    # as many rows as distinct columns, in order of the first file that has them
    seen = files.mapInPandas(kinds, "path string, i int, name string, kind int").groupBy("name").agg(F.min(F.struct("path", "i")).alias("at"), F.max("kind").alias("kind"))
    wanted = {r.name: r.kind for r in seen.orderBy("at").collect()}
    schema = ", ".join(f"`{name}` {KINDS[kind]}" for name, kind in wanted.items())

    def run(batches):
        for b in batches:
            for content in b["content"]:
                held = columns_of(bytes(content))
                n = len(next(iter(held.values()), []))
                yield pd.DataFrame({name: pd.Series([_as(x, kind) for x in held.get(name, [None] * n)], dtype=object) for name, kind in wanted.items()})

    return files.select("content").mapInPandas(run, schema)


#: Types of columns, from the narrowest to the widest.
KINDS = ("boolean", "bigint", "double", "array<double>", "string")


def _kind(values: list) -> int:
    """The place in KINDS of the narrowest type that holds the values."""
    order = {bool: 0, int: 1, float: 2, list: 3, str: 4}
    return max((order[type(x)] for x in values if x is not None), default=1)


def _as(x, kind: int):
    if x is None or kind == 4 and isinstance(x, str):
        return x
    if kind == 3:
        return [float(v) for v in x] if isinstance(x, list) else [float(x)]
    return str(x) if kind == 4 else (bool, int, float)[kind](x)


def header(spark: SparkSession, path: str, keywords: list[str] | None = None) -> DataFrame:
    """path, key, value of the keywords that the files' headers have."""
    wanted = keywords or KEYWORDS

    def run(batches):
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                held: dict = {}
                for h, _ in units(bytes(content)):
                    held = h | held
                rows += [(p, k, str(held[k])) for k in wanted if k in held]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, key string, value string")


def _card(name: str, value, note: str = "") -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int | float):
        text = f"{value!r:>20}"
    else:
        text = "'" + str(value).replace("'", "''")[:66].ljust(8) + "'"
    return f"{name:<8}= {text}{' / ' + note if note else ''}"[:CARD].ljust(CARD).encode("ascii", "replace")


def _block(cards: list[bytes]) -> bytes:
    raw = b"".join(cards) + b"END".ljust(CARD)
    return raw.ljust(-(-len(raw) // BLOCK) * BLOCK)


def table_bytes(columns: dict[str, list], meta: dict | None = None) -> bytes:
    """A FITS file with one binary table of numbers and strings."""
    fields, forms = [], []
    for name, values in columns.items():
        v = np.asarray(values)
        if v.dtype.kind in "iub":
            fields.append((name, v.astype(">i8")))
            forms.append("K")
        elif v.dtype.kind == "f":
            fields.append((name, v.astype(">f8")))
            forms.append("D")
        else:
            raw = np.array([str("" if x is None else x).encode("latin-1", "replace") for x in values], "S")
            fields.append((name, raw))
            forms.append(f"{max(1, raw.dtype.itemsize)}A")
    rows = len(next(iter(columns.values()))) if columns else 0
    table = np.zeros(rows, [(f"f{i}", v.dtype if v.dtype.itemsize else "S1") for i, (_, v) in enumerate(fields)])
    for i, (_, v) in enumerate(fields):
        table[f"f{i}"] = v
    data = table.tobytes()
    first = _block([_card("SIMPLE", True), _card("BITPIX", 8), _card("NAXIS", 0), _card("EXTEND", True), *(_card(k[:8].upper(), v) for k, v in (meta or {}).items())])
    cards = [_card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", table.dtype.itemsize), _card("NAXIS2", rows), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(fields))]
    for i, ((name, _), form) in enumerate(zip(fields, forms, strict=True), 1):
        cards += [_card(f"TTYPE{i}", name), _card(f"TFORM{i}", form)]
    return first + _block(cards) + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\x00")


def flattened(df: DataFrame, array: str) -> DataFrame:
    """feature_i columns of a nested array column, as wide as its first row."""
    from ..functions.features import matrix_columns

    kind = df.schema[array].dataType.elementType.simpleString()
    size = df.select(F.size(F.flatten(array) if kind.startswith("array") else F.col(array))).first()[0]
    return matrix_columns(df, array, size)
