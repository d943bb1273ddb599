"""Shapefiles made here from the format's description."""

import datetime
import struct

import pytest

from viatrix.sources import geopackage as P, shapefile as H

SQUARE = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0), (0.0, 0.0)]  # clockwise
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
FAR = [(20.0, 20.0), (20.0, 21.0), (21.0, 21.0), (20.0, 20.0)]


def shape(kind, parts):
    points = [p for part in parts for p in part]
    if kind % 10 == 1:
        return struct.pack("<i2d", kind, *points[0]) + (struct.pack("<2d", 5, 6) if kind > 10 else b"")
    x, y = zip(*points)
    head = struct.pack("<i4d", kind, min(x), min(y), max(x), max(y))
    if kind == 8:
        return head + struct.pack("<i", len(points)) + b"".join(struct.pack("<2d", *p) for p in points)
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    return head + struct.pack(f"<2i{len(parts)}i", len(parts), len(points), *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def write(stem, shapes, rows, box=(0, 0, 30, 30)):
    """rows: (name, n, x, day, yes) as texts, after the mark of deletion."""
    header = struct.pack(">i20xi", 9994, 50) + struct.pack("<2i8d", 1000, 0, *box, 0, 0, 0, 0)
    body, index = b"", b""
    for i, s in enumerate(shapes):
        index += struct.pack(">2i", (100 + len(body)) // 2, len(s) // 2)
        body += struct.pack(">2i", i + 1, len(s) // 2) + s
    stem.with_suffix(".shp").write_bytes(header + body)
    stem.with_suffix(".shx").write_bytes(header + index)
    fields = [("name", "C", 8, 0), ("n", "N", 6, 0), ("x", "N", 8, 2), ("day", "D", 8, 0), ("yes", "L", 1, 0)]
    told = b"".join(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), size, decimals) for name, kind, size, decimals in fields)
    table = b"".join(mark.encode() + b"".join(v.encode().ljust(size) for v, (_, _, size, _) in zip(values, fields)) for mark, *values in rows)
    stem.with_suffix(".dbf").write_bytes(struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 32 + len(told) + 1, 1 + sum(f[2] for f in fields)) + told + b"\r" + table)


def test_shapes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "BATCH", 3)
    shapes = [shape(1, [[(1, 2)]]), shape(11, [[(3, 4)]]), shape(3, [[(0, 0), (5, 5)]]), shape(3, [[(0, 0), (1, 1)], [(2, 2), (3, 3)]]), shape(5, [HOLE, SQUARE]), shape(5, [FAR, SQUARE, HOLE]), shape(8, [[(7, 7)], [(8, 8)]]), struct.pack("<i", 0), shape(1, [[(1, 1)]])]
    rows = [(" ", f"ü{i}", str(i), f"{i}.25", "20240102", "T") for i in range(7)] + [(" ", "", "", "***", "", "?"), ("*", "gone", "1", "1", "", "F")]
    write(tmp_path / "a", shapes, rows)
    write(tmp_path / "b", [shape(1, [[(99, 99)]])], [(" ", "b", "50", "1", "", "N")], (99, 99, 99, 99))
    df = H.read_shapes(spark, str(tmp_path))
    assert df.dtypes == [("name", "string"), ("n", "bigint"), ("x", "double"), ("day", "date"), ("yes", "boolean"), ("geometry", "binary")]
    got = {r.n: r for r in df.collect()}
    assert sorted(got, key=str) == sorted([*range(7), None, 50], key=str)
    assert (got[2].name, got[2].x, got[2].day, got[2].yes) == ("ü2", 2.25, datetime.date(2024, 1, 2), True)
    assert tuple(got[None])[:5] == (None,) * 5 and got[None].geometry is None and got[50].yes is False
    parts = {n: P.parts(bytes(r.geometry))[:2] for n, r in got.items() if r.geometry is not None}
    assert parts[0] == ("POINT", [[(1, 2)]]) and parts[1] == ("POINT", [[(3, 4)]]) and parts[2] == ("LINESTRING", [[(0, 0), (5, 5)]])
    assert parts[3] == ("MULTILINESTRING", [[(0, 0), (1, 1)], [(2, 2), (3, 3)]]) and parts[6] == ("MULTIPOINT", [[(7, 7)], [(8, 8)]])
    assert parts[4] == ("POLYGON", [SQUARE, HOLE]) and parts[5] == ("MULTIPOLYGON", [FAR, SQUARE, HOLE])
    assert sorted(r.n for r in H.read_shapes(spark, str(tmp_path), (3.5, 3.5, 7.5, 7.5)).collect()) == [2, 4, 5, 6]
    assert H.read_shapes(spark, str(tmp_path / "b.shp")).count() == 1
    reader = H.ShapeReader({"path": str(tmp_path)}, df.schema)
    monkeypatch.setattr(H, "SHARE", 4)
    assert [(p.first, p.end) for p in reader.partitions()] == [(0, 4), (4, 8), (8, 9), (0, 1)]


def test_empty(spark, tmp_path):
    with pytest.raises(Exception, match="no shapefile"):
        H.read_shapes(spark, str(tmp_path)).count()
    write(tmp_path / "a", [], [])
    assert H.read_shapes(spark, str(tmp_path)).count() == 0
