"""GeoTIFF tiles: round trips, pruning, files of other layouts, and what is left out."""

import os
import struct

import numpy as np
import pytest

from viatrix.sources import geotiff as T


def rows(df):
    return sorted((r.band, r.x, r.y, r.value) for r in df.collect())


def test_round_trip(spark, tmp_path):
    cells = [(b, 100 + 10 * c + 5.0, 900 - 10 * r - 5.0, float(r * 100 + c + k)) for k, b in enumerate(("pop", "empl")) for r in range(40) for c in range(-3, 50) if (r + c) % 3]
    df = spark.createDataFrame(cells + [("pop", 105.0, 805.0, -7.0), ("pop", None, 1.0, 1.0), ("no", 105.0, 805.0, 1.0), ("pop", 105.0, 805.0, None), (None, 105.0, 805.0, 1.0)], T.SCHEMA)
    path = str(tmp_path / "r")
    T.write_rasters(df.repartition(5), path, 100, 900, 10, ["pop", "empl"], 16)
    expected = dict(((b, x, y), v) for b, x, y, v in cells)
    expected[("pop", 105.0, 805.0)] = max(expected.get(("pop", 105.0, 805.0), -7.0), -7.0)
    assert rows(T.read_rasters(spark, path)) == sorted((*k, v) for k, v in expected.items())
    box = (140.0, 800.0, 300.0, 860.0)
    got = rows(T.read_rasters(spark, path, box))
    assert got == sorted((*k, v) for k, v in expected.items() if 140 <= k[1] <= 300 and 800 <= k[2] <= 860) and got
    reader = T.RasterReader({"path": path, "box": "140,800,250,850"})
    assert [os.path.basename(f) for p in reader.partitions() for f in p.names] == ["tile_0_0.tif"]
    assert not [f for f in os.listdir(path) if f.startswith(".") and not f.endswith(".crc")]
    T.write_rasters(df.limit(0), path, 100, 900, 10, ["pop"], 16)  # what was there goes
    assert rows(T.read_rasters(spark, path)) == []


def strips(order, letter, kind, values, per_strip, nothing):
    """A file of strips with bands side by side, from the format's description."""
    n, m, k = values.shape
    parts = [values[i : i + per_strip].astype(f"{order}{letter}").tobytes() for i in range(0, n, per_strip)]
    at, data = [], b""
    for p in parts:
        at.append(8 + len(data))
        data += p
    text = nothing.encode() + b"\0"
    fields = [(256, "H", [m]), (257, "H", [n]), (258, "H", [values.astype(letter).itemsize * 8] * k), (259, "H", [1]), (273, "I", at), (277, "H", [k]), (278, "H", [per_strip]), (279, "I", [len(p) for p in parts]),
              (339, "H", [kind] * k), (33550, "d", [2.0, 3.0, 0.0]), (33922, "d", [0, 0, 0, 50.0, 70.0, 0]), (42113, "s", text)]
    start = 8 + len(data)
    free, entries, extra = start + 2 + 12 * len(fields) + 4, b"", b""
    for tag, f, v in fields:
        raw = v if f == "s" else struct.pack(f"{order}{len(v)}{f}", *v)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", free + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[f], len(v)) + place
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start) + data + struct.pack(order + "H", len(fields)) + entries + b"\0" * 4 + extra


@pytest.mark.parametrize("order,letter,kind", [("<", "u1", 1), (">", "i2", 2), (">", "f4", 3), ("<", "f8", 3)])
def test_other_layouts(spark, tmp_path, order, letter, kind):
    values = np.arange(7 * 5 * 2).reshape(7, 5, 2) % 11
    (tmp_path / "a.tif").write_bytes(strips(order, letter, kind, values, 3, "4"))
    expected = sorted((str(b + 1), 51.0 + 2 * c, 68.5 - 3 * r, float(values[r, c, b])) for r in range(7) for c in range(5) for b in range(2) if values[r, c, b] != 4)
    assert rows(T.read_rasters(spark, str(tmp_path))) == expected == rows(T.read_rasters(spark, str(tmp_path / "a.tif")))
    with open(tmp_path / "a.tif", "rb") as f:  # shares together are the whole
        raster = T.Raster(f)
        split = [(n, *t) for i in range(2) for n, x, y, v in raster.blocks(i, 2, None) for t in zip(x, y, v)]
    assert sorted(split) == expected


def test_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        T.write_rasters(spark.createDataFrame([], T.SCHEMA), str(tmp_path), 0, 0, 1, ["a"], 10)
