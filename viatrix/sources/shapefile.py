"""Shapefiles as tables, with geometries as WKB: a Python data source whose tasks read ranges of records by the index file."""

from __future__ import annotations

import datetime
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType

from viatrix.sources import geopackage as P, shared_files as S

#: fixed values: kinds of shapes; those with heights are 10 more, those with measures 20 more
NOTHING, POINT, LINE, POLYGON, POINTS = 0, 1, 3, 5, 8
#: records that a task reads, and that are read at once
SHARE, BATCH = 200_000, 5_000


@dataclass
class Records(InputPartition):
    stem: str
    first: int
    end: int


def _contains(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    hits = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            hits += 1
    return hits % 2 == 1


def _polygons(rings: list[list[tuple[float, float]]]) -> bytes:
    """Clockwise rings are outer ones; a hole goes to the smallest outer ring around its first point, or stands by itself if none is."""
    doubled = [sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(r, r[1:])) for r in rings]
    outer = sorted((-a, i) for i, a in enumerate(doubled) if a <= 0)
    found = {i: [rings[i]] for i in sorted(i for _, i in outer)}
    for i, a in enumerate(doubled):
        if a > 0:
            home = next((o for _, o in outer if _contains(rings[o], *rings[i][0])), None)
            found.setdefault(i if home is None else home, []).append(rings[i])
    if len(found) == 1:
        return P.encoded("POLYGON", *found.values())
    return struct.pack("<BII", 1, 6, len(found)) + b"".join(P.encoded("POLYGON", rings) for rings in found.values())


def geometry(content: bytes) -> bytes | None:
    """WKB of a record's shape, without heights and measures."""
    (kind,) = struct.unpack_from("<i", content)
    kind = kind % 10 if kind < 30 else kind
    if kind == NOTHING:
        return None
    if kind == POINT:
        return P.encoded("POINT", [[struct.unpack_from("<2d", content, 4)]])
    if kind == POINTS:
        (n,) = struct.unpack_from("<i", content, 36)
        v = struct.unpack_from(f"<{2 * n}d", content, 40)
        return P.encoded("MULTIPOINT", [[p] for p in zip(v[::2], v[1::2])])
    if kind not in (LINE, POLYGON):
        raise ValueError(f"shapes of kind {kind} are not read")
    n, m = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{n}i", content, 44), m]
    v = struct.unpack_from(f"<{2 * m}d", content, 44 + 4 * n)
    points = list(zip(v[::2], v[1::2]))
    lines = [points[a:b] for a, b in zip(starts, starts[1:])]
    if kind == POLYGON:
        return _polygons(lines)
    return P.encoded("LINESTRING" if n == 1 else "MULTILINESTRING", lines)


class Attributes:
    """Fields of an open table of attributes, and its records by number."""

    def __init__(self, file):
        self.file = file
        self.n, self.start, self.length = struct.unpack("<IHH", file.read(12)[4:])
        raw = file.read(20 + self.start - 32)[20:]
        self.fields, at = [], 1  # a mark of deletion stands before the fields
        for i in range(0, len(raw) - 31, 32):
            if raw[i] == 0x0D:
                break
            name, kind, size, decimals = raw[i : i + 11].split(b"\0")[0].decode("latin-1"), chr(raw[i + 11]), raw[i + 16], raw[i + 17]
            self.fields.append((name, kind, at, size, decimals))
            at += size

    def schema(self) -> StructType:
        def of(kind, size, decimals):
            return {"F": DoubleType(), "L": BooleanType(), "D": DateType(), "N": LongType() if not decimals and size <= 18 else DoubleType()}.get(kind, StringType())

        return StructType([StructField(name, of(kind, size, decimals)) for name, kind, _, size, decimals in self.fields])

    def rows(self, first: int, end: int, encoding: str) -> list[list | None]:
        """Values of records; None for one that is marked as deleted. What can't be read as its type is null."""
        self.file.seek(self.start + first * self.length)
        raw, kinds, out = self.file.read((end - first) * self.length), self.schema(), []
        for at in range(0, len(raw) - self.length + 1, self.length):
            if raw[at : at + 1] == b"*":
                out.append(None)
                continue
            row = []
            for (_, _, place, size, _), f in zip(self.fields, kinds):
                row.append(self._value(raw[at + place : at + place + size].decode(encoding, "replace").strip(" \0"), f.dataType))
            out.append(row)
        return out

    @staticmethod
    def _value(text: str, kind):
        try:
            if isinstance(kind, StringType):
                return text or None
            if isinstance(kind, LongType):
                return int(text)
            if isinstance(kind, DoubleType):
                return float(text)
            if isinstance(kind, DateType):
                return datetime.datetime.strptime(text, "%Y%m%d").date()
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        except ValueError:
            return None


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.box, self.schema = options["path"], S.box_of(options.get("box")), schema
        self.encoding = options.get("encoding", "utf-8")

    def partitions(self):
        out = []
        for name, size in S.listed(self.path, ".shp"):
            system, _ = S.opened(self.path)
            n = (system.get_file_info(name[:-4] + ".shx").size - 100) // 8
            out += [Records(name[:-4], i, min(i + SHARE, n)) for i in range(0, n, SHARE)]
        return out or [Records("", 0, 0)]

    def read(self, partition):
        if partition.first == partition.end:
            return
        system, _ = S.opened(self.path)
        types = to_arrow_schema(self.schema)
        with system.open_input_file(partition.stem + ".shx") as index, system.open_input_file(partition.stem + ".shp") as shapes, system.open_input_file(partition.stem + ".dbf") as table:
            shapes.seek(36)
            if self.box and not S.meets(struct.unpack("<4d", shapes.read(32)), self.box):
                return
            attributes = Attributes(table)
            for first in range(partition.first, partition.end, BATCH):
                end = min(first + BATCH, partition.end)
                index.seek(100 + 8 * first)
                places = struct.unpack(f">{2 * (end - first)}i", index.read(8 * (end - first)))
                rows = []
                for row, offset, words in zip(attributes.rows(first, end, self.encoding), places[::2], places[1::2]):
                    shapes.seek(2 * offset + 8)
                    wkb = geometry(shapes.read(2 * words))
                    box = wkb and P.box_of(wkb)
                    if row is not None and (self.box is None or box is not None and S.meets(box, self.box)):
                        rows.append((*row, wkb))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), types)], schema=types)


class Shapefile(DataSource):
    """Options: path (a file or folder), box (west,south,east,north), encoding of texts."""

    @classmethod
    def name(cls):
        return "viatrix_shapefile"

    def schema(self):
        """Attributes of the first file, and ``geometry``."""
        files = S.listed(self.options["path"], ".shp")
        if not files:
            raise FileNotFoundError(f"no shapefile in {self.options['path']}")
        system, _ = S.opened(self.options["path"])
        with system.open_input_file(files[0][0][:-4] + ".dbf") as f:
            return Attributes(f).schema().add("geometry", BinaryType())

    def reader(self, schema):
        return ShapeReader(dict(self.options), schema)


def read_shapes(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, encoding: str = "utf-8") -> DataFrame:
    """Records of a shapefile, or of a folder of them with the same attributes, with their shape as WKB.

    A task reads a range of records, a batch at a time; files whose extent misses the box are opened only. With a box,
    records without a shape are left out; deleted ones always are."""
    spark.dataSource.register(Shapefile)
    reader = spark.read.format("viatrix_shapefile").option("path", path).option("encoding", encoding)
    return (reader if box is None else reader.option("box", ",".join(map(repr, box)))).load()
