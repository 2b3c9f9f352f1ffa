"""FITS files by ranges of rows: every column type, files that lack columns, broken files."""

import numpy as np
import pytest

from tallyforge.sources import fits, fits_source

ROWS = 700
CARD = fits._card


def padded(raw, fill=b"\0"):
    return raw.ljust(-(-len(raw) // 2880) * 2880, fill)


def every_type():
    """A file with all column types, and its rows."""
    kinds = [
        ("yes", "L"), ("bits", "10X"), ("byte", "B"), ("small", "I"), ("big", "J"), ("huge", "K"), ("name", "5A"), ("f", "E"), ("d", "D"),
        ("c", "C"), ("m", "2M"), ("three", "3E"), ("some", "1PE(9)"), ("more", "QJ(9)"), ("text", "PA(9)"), ("none", "0J"),
    ]
    rows, heap, want = b"", b"", []
    for i in range(ROWS):
        bits = [(i >> k) & 1 for k in range(10)]
        some, more, text = [float(x) / 2 for x in range(i % 5)], list(range(i % 3)), "abc"[: i % 4]
        row = (b"T" if i % 2 else b"F") + np.packbits(bits).tobytes() + bytes([i % 256]) + np.array(i, ">i2").tobytes() + np.array(-1 if i % 7 == 0 else i, ">i4").tobytes()
        row += np.array(i << 40, ">i8").tobytes() + f"n{i % 10}".encode().ljust(5) + np.array(i / 4, ">f4").tobytes() + np.array(i / 3, ">f8").tobytes()
        row += np.array(i + 2j, ">c8").tobytes() + np.array([1j, i], ">c16").tobytes() + np.array([i, 1, 2], ">f4").tobytes()
        for values, kind, place in ((some, ">f4", ">i4"), (more, ">i4", ">i8"), (text, "S", ">i4")):
            raw = values.encode() if kind == "S" else np.array(values, kind).tobytes()
            row += np.array([len(values), len(heap)], place).tobytes()
            heap += raw
        rows += row
        want.append((bool(i % 2), [float(b) for b in bits], i % 256, i * 2 + 1, None if i % 7 == 0 else i, i << 40, f"n{i % 10}", i / 4, i / 3, [float(i), 2.0], [0.0, 1.0, float(i), 0.0], [float(i), 1.0, 2.0], some, [float(x) for x in more], text, None))
    cards = [CARD("XTENSION", "BINTABLE"), CARD("BITPIX", 8), CARD("NAXIS", 2), CARD("NAXIS1", len(rows) // ROWS), CARD("NAXIS2", ROWS), CARD("PCOUNT", len(heap)), CARD("GCOUNT", 1), CARD("TFIELDS", len(kinds))]
    for k, (name, form) in enumerate(kinds, 1):
        cards += [CARD(f"TTYPE{k}", name), CARD(f"TFORM{k}", form)]
    cards += [CARD("TSCAL4", 2), CARD("TZERO4", 1), CARD("TNULL5", -1)]
    head = fits._block([CARD("SIMPLE", True), CARD("BITPIX", 8), CARD("NAXIS", 0)]) + fits._block(cards)
    return head, rows, heap, want


def test_every_column_type_by_ranges(spark, tmp_path):
    head, rows, heap, want = every_type()
    (tmp_path / "t.fits").write_bytes(head + padded(rows + heap))
    df = fits_source.read(spark, str(tmp_path / "t.fits"), range_bytes=8000)
    assert df.rdd.getNumPartitions() > 5
    got = sorted(map(tuple, df.collect()), key=lambda r: r[5])
    assert got == want
    assert sorted(map(tuple, fits.read_whole(spark, str(tmp_path / "t.fits")).collect()), key=lambda r: r[5])[:50] == want[:50]
    few = fits.read(spark, str(tmp_path / "t.fits"), ["d", "some"])
    assert few.columns == ["d", "some"] and sorted(map(tuple, few.collect())) == sorted((r[8], r[12]) for r in want)


def test_broken_files_are_rows_with_a_reason(spark, tmp_path):
    head, rows, heap, want = every_type()
    wide = len(rows) // ROWS
    far = bytearray(rows)
    place = 2 * wide - (8 + 16 + 8)  # the first array of the second row
    far[place : place + 8] = np.array([3, len(heap)], ">i4").tobytes()
    (tmp_path / "far.fits").write_bytes(head + padded(bytes(far) + heap))
    (tmp_path / "cut.fits").write_bytes(head + rows[: 10 * wide + 3])
    (tmp_path / "not.fits").write_bytes(b"nothing of the kind" * 200)
    df = fits.read(spark, str(tmp_path / "*.fits"), problems=True)
    got = df.collect()
    said = sorted(r["_problem"].rsplit("/", 1)[-1] for r in got if r["_problem"])
    assert [s for s in said if s.startswith("far")] == ["far.fits: row 1 has an array outside the heap"]
    assert "cut.fits: 690 rows from 10 on are missing" in said and any(s.startswith("not.fits") for s in said)
    assert sum(r["huge"] is not None for r in got) == ROWS + 10 and len(got) == ROWS + 12
    for name in ("far", "cut", "not"):
        with pytest.raises(Exception, match="heap|missing|FITS|header"):
            fits.read(spark, str(tmp_path / f"{name}.fits")).collect()


def test_types_widen_over_files_and_empty_tables(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(fits.table_bytes({"id": [1, 2], "x": [1, 2]}))
    (tmp_path / "b.fits").write_bytes(fits.table_bytes({"id": [3], "x": [0.5], "y": ["z"]}))
    (tmp_path / "c.fits").write_bytes(fits.table_bytes({"id": np.zeros(0, int), "x": np.zeros(0, int)}))
    df = fits.read(spark, str(tmp_path / "*.fits"))
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "y": "string"}
    assert sorted(map(tuple, df.collect())) == [(1, 1.0, None), (2, 2.0, None), (3, 0.5, "z")]
    assert fits.read(spark, str(tmp_path / "c.fits")).count() == 0
    assert fits.read(spark, str(tmp_path), ["id"]).count() == 3
