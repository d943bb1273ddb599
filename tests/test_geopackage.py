"""GeoPackage layers: round trips with nulls and all kinds, layers by name, boxes; WKB in other layouts."""

import os
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from viatrix.sources import geopackage as P

SHAPES = [
    ("POINT", [[(1.0, 2.0)]]), ("LINESTRING", [[(0.0, 0.0), (3.0, 4.0)]]), ("POLYGON", [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]),
    ("MULTIPOINT", [[(5.0, 6.0)], [(7.0, 8.0)]]), ("MULTILINESTRING", [[(20.0, 20.0), (21.0, 21.0)], [(22.0, 22.0), (23.0, 24.0)]]), ("MULTIPOLYGON", [[(50.0, 50.0), (51.0, 50.0), (51.0, 51.0), (50.0, 50.0)]]),
    ("POINT", []), ("LINESTRING", [[]]),
]


@pytest.mark.parametrize("kind,lines", SHAPES)
def test_wkb(kind, lines):
    wkb = P.encoded(kind, lines)
    assert P.parts(wkb) == (kind, lines, len(wkb))
    content = P.blob(wkb, P.box_of(wkb))
    assert P.unblob(content) == (wkb, P.box_of(wkb))


def test_other_wkb():
    """Big-endian, heights as thousands, heights, measures and a reference system as flags."""
    assert P.parts(struct.pack(">BI3d", 0, 1001, 1, 2, 3))[:2] == ("POINT", [[(1, 2)]])
    assert P.parts(struct.pack("<BIII8d", 1, 2 | 0xE0000000, 2056, 2, 1, 2, 3, 4, 5, 6, 7, 8))[:2] == ("LINESTRING", [[(1, 2), (5, 6)]])
    wkb = struct.pack("<BI2d", 1, 1, 5, 6)
    assert P.unblob(struct.pack(">2sBBi6d", b"GP", 0, 0b100, 0, 5, 5, 6, 6, 1, 2) + wkb) == (wkb, (5, 6, 5, 6))
    assert P.unblob(struct.pack("<2sBBi", b"GP", 0, 1, 0) + wkb) == (wkb, (5, 6, 5, 6))


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "g")
    rows = [(i, f"n'{i}", i / 3, i % 2 == 0, i, P.encoded(*shape)) for i, shape in enumerate(SHAPES)] + [(98, None, None, None, None, None)]
    df = spark.createDataFrame(rows, 'fid int, "" string, x double, b boolean, n long, geom binary'.replace('""', "`a \"b`"))
    P.write_layer(df.coalesce(2), path, "my roads", "geom", 3)
    assert len(os.listdir(path)) >= 3
    got = P.read_layer(spark, path)
    assert got.dtypes == df.dtypes
    plain = lambda d: sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in d.collect())
    assert plain(got) == sorted(rows)
    assert [r.fid for r in P.read_layer(spark, path, "my roads", (8.0, 1.0, 20.0, 20.0)).orderBy("fid").collect()] == [2, 4]
    parts = got.where("fid < 6").select("fid", P.wkb_parts(F.col("geom")).alias("g")).orderBy("fid").collect()
    assert [(r.g.kind, [[tuple(p) for p in line] for line in r.g.parts]) for r in parts] == SHAPES[:6]
    assert got.where("fid = 98").select(P.wkb_parts(F.col("geom")).alias("g")).first().g is None
    with pytest.raises(Exception, match="no layer other"):
        P.read_layer(spark, path, "other").collect()
    P.write_layer(df.limit(1), path, "roads", "geom")  # what was there goes
    assert P.read_layer(spark, path, "roads").count() == 1 and len(os.listdir(path)) == 1


def test_file_of_others(spark, tmp_path):
    """Two layers, a sized text type, a geometry column of another name, a date."""
    c = sqlite3.connect(tmp_path / "a.gpkg")
    c.executescript(P.TABLES + "; CREATE TABLE one (id INTEGER PRIMARY KEY, g BLOB, name TEXT(20)); CREATE TABLE two (id INTEGER PRIMARY KEY, day DATE, geom POINT, small SMALLINT)")
    for name, column in (("one", "g"), ("two", "geom")):
        c.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier) VALUES (?, 'features', ?)", [name, name])
        c.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'POINT', 0, 0, 0)", [name, column])
    point = P.encoded("POINT", [[(1.0, 2.0)]])
    c.execute("INSERT INTO one VALUES (1, ?, 'a')", [P.blob(point, None)])
    c.execute("INSERT INTO two VALUES (1, '2024-01-02', ?, 5)", [P.blob(point, (1, 2, 1, 2))])
    c.commit()
    c.close()
    path = str(tmp_path / "a.gpkg")
    assert [tuple(r) for r in P.read_layer(spark, path).collect()] == [(bytearray(point), "a")]
    assert [tuple(r) for r in P.read_layer(spark, path, "two", (0.0, 0.0, 3.0, 3.0)).collect()] == [("2024-01-02", bytearray(point), 5)]
    assert P.read_layer(spark, path, "two", (5.0, 0.0, 6.0, 3.0)).count() == 0


def test_refused(spark, tmp_path):
    for schema, geometry in (("a int", "a"), ("g binary, a array<int>", "g")):
        with pytest.raises(ValueError):
            P.write_layer(spark.createDataFrame([], schema), str(tmp_path), "l", geometry)
