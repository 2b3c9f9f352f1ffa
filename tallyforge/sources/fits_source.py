"""FITS tables as a Spark data source: `spark.read.format("fits")`, once `read` or `register` has made it known.

A file's rows have a fixed width, so a range of them is a partition: a task seeks its bytes, and those of the arrays of any length
that its rows point at. Only headers are read to plan. Columns that aren't wanted are never decoded. A column that a file
lacks is null there, and a type is the widest that any file has.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructType

from ..session import ship
from . import fits

#: Bytes of rows in a partition, and in a batch.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
PROBLEM = "_problem"
#: The types of fits.KINDS, in its order.
TYPES = (BooleanType(), LongType(), DoubleType(), ArrayType(DoubleType()), StringType())


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if ":/" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def files_of(path: str) -> list[tuple[str, int]]:
    """Paths, in their own file system, and sizes: one file, those of a folder, or those of a pattern in the last part of the path."""
    system, at = _place(path)
    folder, _, name = at.rstrip("/").rpartition("/")
    if any(c in name for c in "*?["):
        found = [f for f in system.get_file_info(fs.FileSelector(folder or ".")) if f.is_file and fnmatch.fnmatchcase(f.base_name, name)]
    else:
        one = system.get_file_info(at)
        found = [one] if one.is_file else [f for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name[0] not in "._"]
    return sorted((f.path, f.size) for f in found)


def reachable(path: str) -> bool:
    """Whether workers can open the files by their path, without Spark's readers."""
    try:
        return bool(files_of(path))
    except (OSError, ValueError):  # no such file or file system here: Spark's readers decide
        return False


@dataclass
class Layout:
    """Where the first table of a file lies, else its first image."""

    header: dict
    at: int
    width: int
    rows: int
    heap: int
    heap_bytes: int
    kinds: dict[str, int]

    def decoded(self, f, first: int, n: int, wanted: set[str]) -> tuple[dict[str, list], set[int], int]:
        """Columns, rows with something unreadable, and how many rows are there."""
        f.seek(self.at + first * self.width)
        data = f.read(n * self.width)
        have = len(data) // self.width if self.width else n
        data, kind = data[: have * self.width], self.header.get("XTENSION")
        if kind == "BINTABLE":

            def heap(at: int, size: int) -> bytes:
                if at + size > self.heap_bytes:
                    return b""
                f.seek(self.heap + at)
                return f.read(size)

            return *fits.binary_rows(self.header, data, heap, wanted), have
        if kind == "TABLE":
            return fits.ascii_table(self.header | {"NAXIS2": have}, data), set(), have
        values = np.frombuffer(data, fits.IMAGE_TYPES[int(self.header["BITPIX"])]).reshape(have, -1)
        return fits.array_columns(fits._scaled(values, self.header)), set(), have


def _whole(header: dict, i: int) -> bool:
    return all(isinstance(header.get(f"{c}{i}", d), int) for c, d in (("TSCAL", 1), ("TZERO", 0)))


def _binary_kind(header: dict, i: int) -> tuple[str, int]:
    name, n, code, inner = fits.field_of(header, i)
    if code == "A" or code in "PQ" and inner == "A":
        return name, 4
    if code in "PQCM" or n > 1:
        return name, 3
    if code in "LX":
        return name, 0
    return name, 1 if code in "BIJK" and _whole(header, i) else 2


def _ascii_kind(header: dict, i: int) -> tuple[str, int]:
    code = str(header[f"TFORM{i}"]).strip()[0]
    return str(header.get(f"TTYPE{i}", f"col{i}")), 4 if code == "A" else 1 if code == "I" and _whole(header, i) else 2


def layout(f) -> Layout:
    image = None
    for header, at, size in fits.scan(f):
        kind = header.get("XTENSION", "IMAGE")
        if kind in ("BINTABLE", "TABLE"):
            width, rows = int(header["NAXIS1"]), int(header["NAXIS2"])
            of = _binary_kind if kind == "BINTABLE" else _ascii_kind
            theap = int(header.get("THEAP", width * rows))
            return Layout(header, at, width, rows, at + theap, max(0, size - theap), dict(of(header, i) for i in range(1, int(header["TFIELDS"]) + 1)))
        if image is None and kind == "IMAGE" and int(header.get("NAXIS", 0)) and size:
            rows = int(header[f"NAXIS{int(header['NAXIS'])}"])
            cells = size // rows // (abs(int(header["BITPIX"])) // 8)
            image = Layout(header, at, size // rows, rows, 0, 0, {f"feature_{i}": 2 for i in range(cells)})
    if image is None:
        raise ValueError("no table or image in the FITS file")
    return image


@dataclass
class Rows(InputPartition):
    """Rows of a file; without a number of rows, a file that can't be read at all."""

    path: str
    first: int
    n: int
    problem: str = ""

    def __hash__(self) -> int:
        return hash((self.path, self.first))


class FitsSource(DataSource):
    """Options: path; columns (names parted by new lines; all without it); problems ("true" gives what can't be read as nulls, with
    the reason in _problem, instead of an error); range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> StructType:
        kinds: dict[str, int] = {}
        system, _ = _place(self.options["path"])
        for path, _ in files_of(self.options["path"]):
            try:
                with system.open_input_file(path) as f:
                    found = layout(f).kinds
            except (ValueError, KeyError) as e:
                if not _forgiving(self.options):
                    raise ValueError(f"{path}: {e}") from e
                continue
            for name, kind in found.items():
                kinds[name] = max(kind, kinds.get(name, 0))
        names = self.options["columns"].split("\n") if self.options.get("columns") else list(kinds)
        if missing := [c for c in names if c not in kinds]:
            raise ValueError(f"no FITS column {missing[0]}")
        out = StructType()
        for name in names:
            out.add(name, TYPES[kinds[name]])
        return out.add(PROBLEM, "string") if _forgiving(self.options) else out

    def reader(self, schema: StructType) -> DataSourceReader:
        return FitsReader(schema, dict(self.options))


def _forgiving(options: dict) -> bool:
    return str(options.get("problems", "false")).lower() == "true"


class FitsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.fields, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        system, _ = _place(self.options["path"])
        held = int(self.options.get("range_bytes", RANGE_BYTES))
        out: list[InputPartition] = []
        for path, _ in files_of(self.options["path"]):
            try:
                with system.open_input_file(path) as f:
                    found = layout(f)
            except (ValueError, KeyError) as e:
                out.append(Rows(path, 0, -1, str(e)))
                continue
            step = max(1, held // max(1, found.width))
            out += [Rows(path, at, min(step, found.rows - at)) for at in range(0, found.rows, step)]
        return out or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        schema, forgiving = to_arrow_schema(self.fields), _forgiving(self.options)
        names = [f.name for f in self.fields if not (forgiving and f.name == PROBLEM)]
        kinds = {f.name: TYPES.index(f.dataType) for f in self.fields if f.name in names}

        def batch(columns: dict[str, list], n: int, said: list) -> pa.RecordBatch:
            held = [pa.array([fits._as(x, kinds[c]) for x in columns.get(c, [None] * n)], schema.field(c).type) for c in names]
            return pa.RecordBatch.from_arrays(held + ([pa.array(said, pa.string())] if forgiving else []), schema=schema)

        if part.n <= 0:
            if part.n < 0:
                if not forgiving:
                    raise ValueError(f"{part.path}: {part.problem}")
                yield batch({}, 1, [f"{part.path}: {part.problem}"])
            return
        system, _ = _place(self.options["path"])
        with system.open_input_file(part.path) as f:
            found = layout(f)
            step = max(1, BATCH_BYTES // max(1, found.width))
            for at in range(part.first, part.first + part.n, step):
                n = min(step, part.first + part.n - at)
                columns, bad, have = found.decoded(f, at, n, set(names))
                if (bad or have < n) and not forgiving:
                    raise ValueError(f"{part.path}: {len(bad)} rows from {at} on have arrays outside the heap, {n - have} are missing")
                yield batch(columns, have, [f"{part.path}: row {at + i} has an array outside the heap" if i in bad else None for i in range(have)])
                if have < n:
                    yield batch({}, 1, [f"{part.path}: {part.first + part.n - at - have} rows from {at + have} on are missing"])
                    return


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to the session."""
    ship(spark)
    spark.dataSource.register(FitsSource)
    return spark


def read(spark: SparkSession, path: str, columns: list[str] | None = None, problems: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The table of FITS files by ranges of rows. problems adds _problem and gives unreadable values, missing rows and files as
    nulls instead of ending the job."""
    reader = register(spark).read.format("fits").option("problems", str(problems).lower()).option("range_bytes", str(range_bytes))
    return (reader.option("columns", "\n".join(columns)) if columns else reader).load(path)
