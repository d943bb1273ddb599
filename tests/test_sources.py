"""Readers and sinks on files made here."""

import pytest
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from viatrix.operators import graph_search as Q, sections as L
from viatrix.sources import geometry, readers


def test_swiss_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;name;x\n1;Zürich;1'234,5\n-99;[];nan\n2;b;y\n".encode("latin-1"))
    schema = StructType([StructField("id", IntegerType()), StructField("name", StringType()), StructField("x", DoubleType())])
    got = readers.read_swiss_csv(spark, str(tmp_path / "a.csv"), schema).collect()
    assert [tuple(r) for r in got] == [(1, "Zürich", 1234.5), (None, None, None), (2, "b", None)]


def test_numbered_files(spark, tmp_path):
    for n in (3, 7):
        (tmp_path / f"od_matrix_dev{n}_medium.csv").write_text("a\n1\n")
    got = readers.read_numbered(spark, str(tmp_path), r"dev(\d+)_", "dev", header=True)
    assert sorted(r.dev for r in got.collect()) == [3, 7]


def test_elevation_grid(spark, tmp_path):
    (tmp_path / "e.xyz").write_text("x y z\n" + "\n".join(f"{x} {y} {x + y}" for x in range(5, 25, 5) for y in range(5, 25, 5)))
    assert readers.read_elevation(spark, str(tmp_path / "e.xyz"), 10).count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "dev_id int, x double")
    readers.write_each(df, str(tmp_path / "out"), "dev_id")
    assert spark.read.parquet(str(tmp_path / "out/dev_id=1")).count() == 2
    calls = []
    build = lambda: calls.append(1) or df
    for use in (True, True, False):
        assert readers.cached(spark, str(tmp_path / "cache"), build, use).count() == 3
    assert len(calls) == 2


def test_bands_and_names(spark):
    df = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, value double")
    assert readers.stack_bands({"a": df, "b": df}).count() == 2
    assert readers.network_name("current")
    with pytest.raises(ValueError):
        readers.network_name("none")


def test_k_shortest(spark):
    e = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 1, 3, 5.0), (0, 3, 1, 1.0)], "graph_id int, u int, v int, w double")
    pairs = spark.createDataFrame([(0, 1, 3), (0, 2, 9)], "graph_id int, o int, d int")
    assert [(r.nth, r.length, r.path) for r in Q.k_shortest_simple(e, pairs, 2).orderBy("nth").collect()] == [(1, 2.0, [1, 2, 3]), (2, 5.0, [1, 3])]


def test_sections(spark):
    rows = [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 4, 2.0), (0, 4, 5, 2.0), (0, 4, 6, 2.0)]
    got = L.chains(spark.createDataFrame(rows, "network int, u int, v int, tracks double")).toPandas()
    assert sorted(tuple(sorted(zip(g.u, g.v))) for _, g in got.groupby("section")) == [((1, 2), (2, 3)), ((3, 4),), ((4, 5),), ((4, 6),)]


def test_inward_development(spark):
    z = spark.createDataFrame([(0, i, 10.0, 25.0, float(i)) for i in range(4)], "scenario long, zone long, potential double, target double, draw double")
    assert [r.filled for r in Q.inward_development(z).orderBy("zone").collect()] == [10.0, 10.0, 5.0, 0.0]


def test_geometry_texts(spark):
    texts = ["POINT (1 2)", "SRID=2056;LINESTRING(0 0, 1.5 -2e1)", "POLYGON ((0 0, 4 0, 4 4), (1 1, 2 1, 2 2))", "POINT Z (1 2 3)", "LINESTRING EMPTY", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.k, None if r.p is None else [tuple(x) for x in r.p], None if r.n is None else [len(x) for x in r.n]) for r in df.select("i", geometry.wkt_kind(df.t).alias("k"), geometry.wkt_points(df.t).alias("p"), geometry.wkt_parts(df.t).alias("n")).collect()}
    assert got[0] == ("POINT", [(1, 2)], [1]) and got[1] == ("LINESTRING", [(0, 0), (1.5, -20)], [2])
    assert got[2][2] == [3, 3] and len(got[2][1]) == 6 and got[3][1] == [(1, 2)]
    assert got[4] == ("LINESTRING", [], []) and got[5] == (None, [], []) and got[6] == (None, None, None)
    js = spark.createDataFrame([('{"type":"Point","coordinates":[1,2.5]}',), ('{"type":"LineString","coordinates":[[0,0],[1,2,9]]}',), ("no",), (None,)], "t string")
    assert [None if r.p is None else [tuple(x) for x in r.p] for r in js.select(geometry.geojson_points(js.t).alias("p")).collect()] == [[(1, 2.5)], [(0, 0), (1, 2)], None, None]


def test_result_paths():
    assert readers.result_path("r/", "AK_2035") == "r/baseline/network=AK_2035"
    assert readers.result_path("r", "AK 2035_enhanced") == "r/enhanced/network=AK_2035_enhanced"
    assert readers.result_path("r", "AK_2035_dev_100023") == "r/developments/dev_id=100023"


def test_plain_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2.5\n")
    schema = StructType([StructField("id", IntegerType()), StructField("x", DoubleType())])
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), schema).collect()] == [(1, 2.5)]


def test_workbook(spark, tmp_path):
    """Shared and own texts, gaps between cells, several books, and sheets found by name."""
    import zipfile

    from viatrix.sources import workbooks

    (tmp_path / "a.xlsx").write_bytes(workbooks.workbook({"One": [["x"]], "Two & more": [[], ["b", "a"], ["2.5", 1], [None, 3], [], ["-99", "x"]]}))
    main, link = workbooks.MAIN, workbooks.LINK
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="Two &amp; more" sheetId="1" r:id="q"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="q" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>a</t></si><si><r><t>b</t></r><r><t/></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="AB2" t="s"><v>1</v></c></row><row r="3"><c r="AB3"><v>7</v></c><c r="A3"><v>9</v></c></row></sheetData></worksheet>')
    schema = StructType([StructField("a", IntegerType()), StructField("b", DoubleType()), StructField("c", StringType())])
    got = readers.read_workbook(spark, str(tmp_path / "*.xlsx"), "Two & more", schema, 1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2.5, None), (3, None, None), (None, None, None), (9, 7.0, None)], key=str)
    assert [workbooks.column_number(x) for x in ("A1", "Z9", "AA10", "BC2")] == [0, 25, 26, 54]


def test_workbooks_by_tasks(spark, tmp_path):
    """A book for each name, with nulls, and what was there before gone; no rows make no book."""
    import os

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None), (3, "c", 2.0)], "id long, name string, x double")
    path = str(tmp_path / "books")
    readers.write_workbooks(df, path, "S", F.concat(F.lit("b"), F.col("id")), 1)
    readers.write_workbooks(df, path, "S", F.concat(F.lit("b"), F.floor(F.col("id") / 2)), 2)
    assert sorted(os.listdir(path)) == ["b0.xlsx", "b1.xlsx"]
    assert sorted(map(tuple, readers.read_workbook(spark, f"{path}/*.xlsx", "S", df.schema, 2).collect())) == [(1, "a", 1.5), (2, None, None), (3, "c", 2.0)]
    readers.write_workbooks(df.limit(0), path, "S", F.lit("b"))
    assert os.listdir(path) == []
