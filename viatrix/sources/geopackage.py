"""GeoPackage layers as tables, with geometries as WKB: a Python data source, and WKB as arrays of points."""

from __future__ import annotations

import math
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from viatrix.sources import shared_files as S

#: fixed values: kinds of geometries, and how many bytes of envelope each code of a header announces
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
#: fixed values: types of columns
READ = {"BOOLEAN": BooleanType, "TINYINT": ByteType, "SMALLINT": ShortType, "MEDIUMINT": IntegerType, "INT": LongType, "INTEGER": LongType, "FLOAT": FloatType, "DOUBLE": DoubleType, "REAL": DoubleType, "BLOB": BinaryType}
WRITE = {BooleanType: "BOOLEAN", ByteType: "TINYINT", ShortType: "SMALLINT", IntegerType: "MEDIUMINT", LongType: "INTEGER", FloatType: "FLOAT", DoubleType: "DOUBLE", BinaryType: "BLOB", StringType: "TEXT"}
#: fixed value: tables that every file has
TABLES = """CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT '1970-01-01T00:00:00.000Z',
  min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
INSERT INTO gpkg_spatial_ref_sys VALUES ('undefined cartesian', -1, 'NONE', -1, 'undefined', NULL), ('undefined geographic', 0, 'NONE', 0, 'undefined', NULL)"""
#: rows that are read or written at once
BATCH = 10_000


def parts(wkb: bytes, at: int = 0) -> tuple[str, list[list[tuple[float, float]]], int]:
    """(kind, points of each part, where it ends); heights and measures are left out. Parts are points, lines or rings."""
    order = "<" if wkb[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", wkb, at + 1)
    at += 5
    more = (code >> 31 & 1) + (code >> 30 & 1)  # extended: flags
    if code >> 29 & 1:
        at += 4
    code &= 0x0FFFFFFF
    more += (0, 1, 1, 2)[code // 1000]  # standard: thousands
    kind, wide = KINDS[code % 1000], 2 + more

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", wkb, at)
        at += 4
        return n

    def points(n: int) -> list[tuple[float, float]]:
        nonlocal at
        v = struct.unpack_from(f"{order}{n * wide}d", wkb, at)
        at += 8 * n * wide
        return list(zip(v[::wide], v[1::wide]))

    if kind == "POINT":
        p = points(1)
        return kind, [] if math.isnan(p[0][0]) else [p], at
    if kind == "LINESTRING":
        return kind, [points(count())], at
    if kind == "POLYGON":
        return kind, [points(count()) for _ in range(count())], at
    out = []
    for _ in range(count()):
        _, inner, at = parts(wkb, at)
        out += inner
    return kind, out, at


def encoded(kind: str, lines: list[list[tuple[float, float]]]) -> bytes:
    """WKB of a kind's parts; a POLYGON's parts are its rings, a MULTIPOLYGON's the rings of one polygon each."""
    code = {name: k for k, name in KINDS.items()}[kind]
    head = struct.pack("<BI", 1, code)
    run = lambda p: struct.pack(f"<I{2 * len(p)}d", len(p), *[v for xy in p for v in xy])
    if kind == "POINT":
        return head + struct.pack("<2d", *(lines[0][0] if lines and lines[0] else (math.nan, math.nan)))
    if kind == "LINESTRING":
        return head + run(lines[0] if lines else [])
    if kind == "POLYGON":
        return head + struct.pack("<I", len(lines)) + b"".join(map(run, lines))
    return head + struct.pack("<I", len(lines)) + b"".join(encoded(KINDS[code - 3], [p]) for p in lines)


def box_of(wkb: bytes) -> tuple[float, float, float, float] | None:
    """west, south, east, north; None for no points."""
    points = [p for line in parts(wkb)[1] for p in line]
    if not points:
        return None
    x, y = zip(*points)
    return min(x), min(y), max(x), max(y)


def blob(wkb: bytes, box: tuple[float, float, float, float] | None) -> bytes:
    """A geometry as files hold it: a header with its envelope, then WKB."""
    if box is None:
        return struct.pack("<2sBBi", b"GP", 0, 0b10001, -1) + wkb
    return struct.pack("<2sBBi4d", b"GP", 0, 0b00011, -1, box[0], box[2], box[1], box[3]) + wkb


def unblob(content: bytes) -> tuple[bytes, tuple[float, float, float, float] | None]:
    """(WKB, box) of a geometry in a file; the box is reckoned where the header has none."""
    flags = content[3]
    length = ENVELOPES[flags >> 1 & 7]
    wkb = content[8 + length :]
    if length:
        west, east, south, north = struct.unpack_from(("<" if flags & 1 else ">") + "4d", content, 8)
        return wkb, (west, south, east, north)
    return wkb, box_of(wkb)


def wkb_parts(wkb: Column) -> Column:
    """(kind, parts: an array of points for each point, line or ring) of WKB, plain or extended; null gives null."""

    @F.pandas_udf("kind string, parts array<array<struct<x: double, y: double>>>")
    def read(column: pd.Series) -> pd.DataFrame:
        found = [("", []) if w is None else parts(w)[:2] for w in column]
        return pd.DataFrame({"kind": [k for k, _ in found], "parts": [[[{"x": x, "y": y} for x, y in line] for line in p] for _, p in found]})

    return F.when(wkb.isNotNull(), read(wkb))


def points_wkb(kind: str, lines: Column) -> Column:
    """WKB of one kind from an array of parts, each an array of points (x, y); null gives null."""

    @F.pandas_udf("binary")
    def write(column: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else encoded(kind, [[(q["x"], q["y"]) for q in line] for line in p]) for p in column])

    return write(lines)


def connected(path: str, name: str) -> sqlite3.Connection:
    """A file of a folder, in place where the file system is this machine's, else in memory."""
    from pyarrow import fs

    system, _ = S.opened(path)
    if isinstance(system, fs.LocalFileSystem):
        return sqlite3.connect(f"file:{name.replace('?', '%3f').replace('#', '%23')}?mode=ro&immutable=1", uri=True)
    with system.open_input_stream(name) as f:
        content = f.read()
    c = sqlite3.connect(":memory:")
    c.deserialize(content)
    return c


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def layer_of(c: sqlite3.Connection, layer: str | None) -> tuple[str, str]:
    """(table, geometry column) of a layer, of the first one if none is named."""
    found = c.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
    for table, column in found:
        if layer in (None, table):
            return table, column
    raise ValueError(f"no layer {layer}; there are {', '.join(t for t, _ in found) or 'none'}")


class LayerReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.layer, self.box = options["path"], options.get("layer"), S.box_of(options.get("box"))
        self.schema = schema

    def partitions(self):
        return S.shares(S.listed(self.path, ".gpkg"), False) or [S.Files([])]

    def read(self, partition):
        types = to_arrow_schema(self.schema)
        for name in partition.names:
            c = connected(self.path, name)
            try:
                table, geometry = layer_of(c, self.layer)
                extent = c.execute("SELECT min_x, min_y, max_x, max_y FROM gpkg_contents WHERE table_name = ?", [table]).fetchone()
                if extent and None not in extent and not S.meets(extent, self.box):
                    continue
                for rows in self._batches(c, table, geometry):
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(map(bool_or_none, v) if pa.types.is_boolean(f.type) else v, f.type) for v, f in zip(columns, types)], schema=types)
            finally:
                c.close()

    def _batches(self, c, table: str, geometry: str) -> Iterator[list[tuple]]:
        place = self.schema.names.index(geometry)
        cursor = c.execute(f"SELECT {', '.join(map(quoted, self.schema.names))} FROM {quoted(table)}")
        while found := cursor.fetchmany(BATCH):
            rows = []
            for row in found:
                wkb, box = (None, None) if row[place] is None else unblob(row[place])
                if self.box is None or box is not None and S.meets(box, self.box):
                    rows.append((*row[:place], wkb, *row[place + 1 :]))
            if rows:
                yield rows


def bool_or_none(v):
    return None if v is None else bool(v)


class LayerWriter(DataSourceArrowWriter):
    """A file for every so many rows of a partition; a task holds one file."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.layer, self.geometry = options["path"], options["layer"], options["geometry"]
        self.most, self.schema, self.overwrite = int(options["rows"]), schema, overwrite

    def write(self, iterator):
        done, rows = [], []
        place = self.schema.names.index(self.geometry)

        def close():
            name = S.put(self.path, self._file(rows, place))
            done.append((name, f"part-{name[1:]}.gpkg"))
            rows.clear()

        for batch in iterator:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                rows.append(row)
                if len(rows) == self.most:
                    close()
        if rows:
            close()
        return S.Written(done)

    def _file(self, rows: list[tuple], place: int) -> bytes:
        c = sqlite3.connect(":memory:")
        c.executescript("PRAGMA application_id = 0x47504B47; PRAGMA user_version = 10300; " + TABLES)
        names = [f"{quoted(f.name)} {'GEOMETRY' if i == place else WRITE[type(f.dataType)]}" for i, f in enumerate(self.schema)]
        table = quoted(self.layer)
        c.execute(f"CREATE TABLE {table} ({quoted(self._key())} INTEGER PRIMARY KEY, {', '.join(names)})")
        boxes = [None if r[place] is None else box_of(r[place]) for r in rows]
        values = [(*r[:place], None if r[place] is None else blob(r[place], b), *r[place + 1 :]) for r, b in zip(rows, boxes)]
        c.executemany(f"INSERT INTO {table} ({', '.join(map(quoted, self.schema.names))}) VALUES ({', '.join('?' * len(names))})", values)
        sides = list(zip(*[b for b in boxes if b is not None]))
        extent = (min(sides[0]), min(sides[1]), max(sides[2]), max(sides[3])) if sides else (None,) * 4
        c.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, -1)", [self.layer, self.layer, *extent])
        c.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'GEOMETRY', -1, 2, 2)", [self.layer, self.geometry])
        c.commit()
        content = c.serialize()
        c.close()
        return content

    def _key(self) -> str:
        """A name for the key that no column has in any case of its letters."""
        taken, key = {n.lower() for n in self.schema.names}, "fid"
        while key in taken:
            key = "_" + key
        return key

    def commit(self, messages):
        S.commit(self.path, messages, ".gpkg", self.overwrite)

    def abort(self, messages):
        S.abort(self.path, messages)


class GeoPackage(DataSource):
    """Options to read: path (a file or folder), layer, box (west,south,east,north). write_layer() sets those to write."""

    @classmethod
    def name(cls):
        return "viatrix_geopackage"

    def schema(self):
        """Columns of the layer in the first file, without its key."""
        files = S.listed(self.options["path"], ".gpkg")
        if not files:
            raise FileNotFoundError(f"no GeoPackage in {self.options['path']}")
        c = connected(self.options["path"], files[0][0])
        try:
            table, geometry = layer_of(c, self.options.get("layer"))
            out = StructType()
            for _, name, kind, _, _, key in c.execute(f"PRAGMA table_info({quoted(table)})"):
                if not key:
                    out.add(StructField(name, BinaryType() if name == geometry else READ.get(kind.split("(")[0].upper(), StringType)()))
            return out
        finally:
            c.close()

    def reader(self, schema):
        return LayerReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return LayerWriter(dict(self.options), schema, overwrite)


def read_layer(spark: SparkSession, path: str, layer: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The features of a GeoPackage, or of a folder of them, with their geometry as WKB; those whose envelope misses the box are left out.

    Of a folder each file is a task, and a file whose extent misses the box is opened only. Features without points meet no box."""
    spark.dataSource.register(GeoPackage)
    reader = spark.read.format("viatrix_geopackage").option("path", path)
    for name, value in (("layer", layer), ("box", box and ",".join(map(repr, box)))):
        if value:
            reader = reader.option(name, value)
    return reader.load()


def write_layer(df: DataFrame, path: str, layer: str, geometry: str, rows: int = 50_000) -> None:
    """A folder of GeoPackages of at most so many rows, which replaces what was there; geometry is a column of WKB.

    To prune well by boxes, rows that lie near each other should stand in one partition: repartitionByRange on a tile's number."""
    kinds = {f.name: type(f.dataType) for f in df.schema}
    if kinds.get(geometry) is not BinaryType:
        raise ValueError(f"{geometry} is no column of WKB")
    if bad := [n for n, k in kinds.items() if k not in WRITE]:
        raise ValueError(f"GeoPackage has no type for {', '.join(bad)}")
    df.sparkSession.dataSource.register(GeoPackage)
    df.write.format("viatrix_geopackage").options(path=path, layer=layer, geometry=geometry, rows=str(rows)).mode("overwrite").save()
