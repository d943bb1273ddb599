"""GeoTIFF rasters as tables (band, x, y, value) of cell centres: a Python data source that reads and writes tiles."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from viatrix.sources import shared_files as S

#: fixed values: tags of the format
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, NO_DATA = 33550, 33922, 42113
#: fixed values: struct letters of field types
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: fixed values: numpy letters of sample formats
FORMATS = {1: "u", 2: "i", 3: "f"}
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946

SCHEMA = "band string, x double, y double, value double"


def encoded(values: np.ndarray, names: list[str], west: float, north: float, size: float) -> bytes:
    """A file of one tile: values (bands, rows, columns), NaN where there is none; rows and columns are a multiple of 16."""
    n, rows, cols = values.shape
    blocks = [zlib.compress(np.ascontiguousarray(v, "<f8").tobytes()) for v in values]
    at = 8 + np.cumsum([0] + [len(b) for b in blocks])
    fields = [
        (WIDTH, "I", [cols]), (HEIGHT, "I", [rows]), (BITS, "H", [64] * n), (COMPRESSION, "H", [DEFLATE]), (PHOTOMETRIC, "H", [1]),
        (DESCRIPTION, "s", json.dumps(names).encode() + b"\0"), (SAMPLES, "H", [n]), (PLANAR, "H", [2]), (TILE_WIDTH, "I", [cols]), (TILE_HEIGHT, "I", [rows]),
        (TILE_OFFSETS, "I", [int(a) for a in at[:-1]]), (TILE_BYTES, "I", [len(b) for b in blocks]), (SAMPLE_FORMAT, "H", [3] * n),
        (PIXEL_SCALE, "d", [size, size, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, west, north, 0.0]), (NO_DATA, "s", b"nan\0"),
    ]
    code = {letter: k for k, letter in TYPES.items()}
    start = int(at[-1] + at[-1] % 2)  # the directory begins at an even place
    free = start + 2 + 12 * len(fields) + 4
    entries, extra = b"", b""
    for tag, letter, v in fields:
        raw = v if letter == "s" else struct.pack(f"<{len(v)}{letter}", *v)
        if len(raw) > 4:
            raw += b"\0" * (len(raw) % 2)
            place, extra = struct.pack("<I", free + len(extra)), extra + raw
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, code[letter], len(v)) + place
    body = b"".join(blocks).ljust(start - 8, b"\0")
    return b"II" + struct.pack("<HI", 42, start) + body + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra


class Raster:
    """Header of an open file, and its blocks one at a time: strips or tiles, bands apart or side by side, either order of bytes."""

    def __init__(self, file):
        self.file = file
        self.order = "<" if self._at(0, 2) == b"II" else ">"
        kind, at = struct.unpack(self.order + "HI", self._at(2, 6))
        if kind != 42:
            raise ValueError("no TIFF file of 32-bit offsets")
        (n,) = struct.unpack(self.order + "H", self._at(at, 2))
        raw = self._at(at + 2, 12 * n)
        self.tags = dict(self._field(raw[12 * i : 12 * i + 12]) for i in range(n))
        one = lambda tag, default: self.tags.get(tag, [default])[0]
        self.cols, self.rows, self.bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.apart, self.compression = one(PLANAR, 1) == 2, one(COMPRESSION, PLAIN)
        if self.compression not in (PLAIN, DEFLATE, OLD_DEFLATE) or one(PREDICTOR, 1) != 1:
            raise ValueError(f"compression {self.compression} with predictor {one(PREDICTOR, 1)} is not read")
        self.kind = np.dtype(f"{self.order}{FORMATS[one(SAMPLE_FORMAT, 1)]}{one(BITS, 1) // 8}")
        self.tiled = TILE_OFFSETS in self.tags
        self.block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if self.tiled else (min(one(ROWS_PER_STRIP, self.rows), self.rows), self.cols)
        scale, tie = self.tags.get(PIXEL_SCALE, [1.0, 1.0]), self.tags.get(TIEPOINT, [0.0] * 6)
        self.dx, self.dy = scale[0], scale[1]
        self.west, self.north = tie[3] - tie[0] * self.dx, tie[4] + tie[1] * self.dy
        text = self.tags.get(NO_DATA, b"").rstrip(b"\0 ")
        self.nothing = float(text) if text else float("nan")
        self.box = (self.west, self.north - self.rows * self.dy, self.west + self.cols * self.dx, self.north)
        self.names = self._names()

    def _at(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def _field(self, entry: bytes) -> tuple[int, bytes | list]:
        tag, kind, n = struct.unpack(self.order + "HHI", entry[:8])
        letter = TYPES.get(kind, "B")
        length = n * struct.calcsize("<" + letter)
        raw = entry[8 : 8 + length] if length <= 4 else self._at(struct.unpack(self.order + "I", entry[8:])[0], length)
        return tag, raw if letter == "s" else list(struct.unpack(self.order + letter * n, raw))

    def _names(self) -> list[str]:
        """Names of bands from the description, where it lists as many; else their numbers from 1."""
        try:
            found = json.loads(self.tags.get(DESCRIPTION, b"").rstrip(b"\0"))
        except ValueError:
            found = None
        return found if isinstance(found, list) and len(found) == self.bands else [str(i + 1) for i in range(self.bands)]

    def blocks(self, nth: int, of: int, box) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """(band, x, y, value) of each block of a share that meets the box; no-data cells are left out."""
        high, wide = self.block
        down, across = -(-self.rows // high), -(-self.cols // wide)
        starts, lengths = (self.tags[t] for t in ((TILE_OFFSETS, TILE_BYTES) if self.tiled else (STRIP_OFFSETS, STRIP_BYTES)))
        for k in range(nth, len(starts), of):
            band, rest = divmod(k, down * across)
            r0, c0 = rest // across * high, rest % across * wide
            r1, c1 = min(r0 + high, self.rows), min(c0 + wide, self.cols)
            edges = (self.west + c0 * self.dx, self.north - r1 * self.dy, self.west + c1 * self.dx, self.north - r0 * self.dy)
            if not lengths[k] or not S.meets(edges, box):
                continue
            raw = self._at(starts[k], lengths[k])
            samples = 1 if self.apart else self.bands
            values = np.frombuffer(raw if self.compression == PLAIN else zlib.decompress(raw), self.kind)
            values = values.reshape(-1, wide, samples)[: r1 - r0, : c1 - c0].astype("f8")
            for j in range(samples):
                v = values[:, :, j]
                r, c = np.nonzero(~np.isnan(v) & (v != self.nothing))
                x, y = self.west + (c + c0 + 0.5) * self.dx, self.north - (r + r0 + 0.5) * self.dy
                yield self.names[band if self.apart else j], x, y, v[r, c]


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.box = options["path"], S.box_of(options.get("box"))

    def partitions(self):
        files = S.listed(self.path, ".tif")
        system, at = S.opened(self.path)
        note = f"{at}/_grid.json"
        if self.box and system.get_file_info(note).is_file:  # tiles of this grid are told by their names
            with system.open_input_stream(note) as f:
                g = json.loads(f.read())
            side = g["size"] * g["tile"]

            def near(name: str) -> bool:
                r, c = map(int, name.rsplit("/", 1)[-1].removesuffix(".tif").split("_")[1:3])
                return S.meets((g["west"] + c * side, g["north"] - (r + 1) * side, g["west"] + (c + 1) * side, g["north"] - r * side), self.box)

            files = [f for f in files if near(f[0])]
        return S.shares(files, True) or [S.Files([])]

    def read(self, partition):
        system, _ = S.opened(self.path)
        for name in partition.names:
            with system.open_input_file(name) as f:
                raster = Raster(f)
                if not S.meets(raster.box, self.box):
                    continue
                for band, x, y, v in raster.blocks(partition.nth, partition.of, self.box):
                    if len(v):
                        yield pa.RecordBatch.from_arrays([pa.array([band] * len(v)), pa.array(x), pa.array(y), pa.array(v)], names=["band", "x", "y", "value"])


class RasterWriter(DataSourceArrowWriter):
    """Takes rows of one tile after each other, so a task holds one tile."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.west, self.north, self.size = (float(options[k]) for k in ("west", "north", "size"))
        self.tile, self.names = int(options["tile"]), json.loads(options["bands"])

    def write(self, iterator):
        done, now, grid = [], None, None

        def close():
            if now is not None:
                west, north = (self.west + now[1] * self.tile * self.size, self.north - now[0] * self.tile * self.size)
                done.append((S.put(self.path, encoded(grid, self.names, west, north, self.size)), f"tile_{now[0]}_{now[1]}.tif"))

        for batch in iterator:
            rows = batch.to_pandas()
            cuts = np.flatnonzero((rows["tile_row"].diff() != 0) | (rows["tile_col"].diff() != 0)).tolist() + [len(rows)]
            for a, b in zip(cuts, cuts[1:]):
                part = rows.iloc[a:b]
                key = (int(part["tile_row"].iat[0]), int(part["tile_col"].iat[0]))
                if key != now:
                    close()
                    now, grid = key, np.full((len(self.names), self.tile, self.tile), np.nan)
                grid[part["band"], part["row"], part["col"]] = part["value"]
        close()
        return S.Written(done)

    def commit(self, messages):
        note = {"west": self.west, "north": self.north, "size": self.size, "tile": self.tile}
        S.commit(self.path, messages, ".tif", self.overwrite, {"_grid.json": json.dumps(note).encode()})

    def abort(self, messages):
        S.abort(self.path, messages)


class GeoTiff(DataSource):
    """Options to read: path (a file or folder), box (west,south,east,north). write_rasters() sets those to write."""

    @classmethod
    def name(cls):
        return "viatrix_geotiff"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RasterReader(dict(self.options))

    def writer(self, schema, overwrite):
        return RasterWriter(dict(self.options), overwrite)


def read_rasters(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(band, x, y, value) of all cells of a GeoTIFF, or of a folder of them, whose centres lie in the box.

    Bands have the names that the file lists, else numbers from 1; cells without data are left out. Files, and blocks in
    them, that miss the box are not read. A task reads a file or 64 MB of a larger one, block by block."""
    spark.dataSource.register(GeoTiff)
    reader = spark.read.format("viatrix_geotiff").option("path", path)
    if box is None:
        return reader.load()
    west, south, east, north = box
    return reader.option("box", ",".join(map(repr, box))).load().where(F.col("x").between(west, east) & F.col("y").between(south, north))


def write_rasters(df: DataFrame, path: str, west: float, north: float, size: float, bands: list[str], tile: int = 256) -> None:
    """Cells (band, x, y, value) as a folder of GeoTIFF tiles, which replaces what was there.

    Cell (0, 0) begins in the corner (west, north). Of several values in a cell the greatest stays; rows with a null, or of a band
    that is not listed, are left out. Cells are aggregated before they move, so a tile never has more rows than cells."""
    if tile % 16:
        raise ValueError("tile is no multiple of 16")
    at = lambda c: F.floor(c / F.lit(float(size))).cast("long")
    band = F.array_position(F.array(*map(F.lit, bands)), F.col("band")).cast("int") - 1
    cells = df.select(at(F.lit(float(north)) - F.col("y")).alias("r"), at(F.col("x") - F.lit(float(west))).alias("c"), band.alias("band"), "value")
    cells = cells.where("r is not null and c is not null and band >= 0 and value is not null").groupBy("r", "c", "band").agg(F.max("value").alias("value"))
    of_tile = lambda c, name: F.floor(F.col(c) / F.lit(tile)).cast("long").alias(name)
    in_tile = lambda c, name: F.pmod(F.col(c), F.lit(tile)).cast("int").alias(name)
    tiled = cells.select(of_tile("r", "tile_row"), of_tile("c", "tile_col"), in_tile("r", "row"), in_tile("c", "col"), "band", "value")
    df.sparkSession.dataSource.register(GeoTiff)
    options = {"path": path, "west": repr(float(west)), "north": repr(float(north)), "size": repr(float(size)), "tile": str(tile), "bands": json.dumps(bands)}
    tiled.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col").write.format("viatrix_geotiff").options(**options).mode("overwrite").save()

