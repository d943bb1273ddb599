"""Geometry and profiles against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from viatrix.functions import exprs as X
from viatrix.operators import elevation as E, sections as L, spatial as G

C = F.col


def test_crossing_join(spark):
    r = random.Random(3)
    seg = [tuple(r.uniform(-40, 40) for _ in range(4)) for _ in range(60)]
    a = spark.createDataFrame([(i, *s) for i, s in enumerate(seg[:30])], "a int, ax double, ay double, bx double, by double")
    b = spark.createDataFrame([(i, *s) for i, s in enumerate(seg[30:])], "b int, cx double, cy double, dx double, dy double")

    def side(p, s):
        return (s[2] - s[0]) * (p[1] - s[1]) - (s[3] - s[1]) * (p[0] - s[0])

    def cross(s, t):
        return side(t[:2], s) * side(t[2:], s) < 0 and side(s[:2], t) * side(s[2:], t) < 0

    want = [(i, j) for i, s in enumerate(seg[:30]) for j, t in enumerate(seg[30:]) if cross(s, t)]
    assert len(want) > 20
    for cell in (3.0, 100.0):
        assert sorted((x.a, x.b) for x in G.crossing_join(a, b, cell).collect()) == want


def test_rasterise(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.1), (0.0, 4.0)]
    df = spark.createDataFrame([(1, ring), (2, []), (3, None)], "id int, ring array<struct<x:double,y:double>>")
    got = {(x.row, x.col) for x in G.rasterise(df, "id").collect()}
    assert got == {(i, j) for i in range(4) for j in range(4) if j + 0.5 < 2.1 + 0.95 * abs(i + 0.5 - 2)}


def test_covered_cells(spark):
    df = spark.createDataFrame([(1, 0.5, 0.25, 2.0, 1.0), (2, 1.0, 1.0, 1.0, 3.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    assert {(x.id, x.row, x.col, x.share) for x in G.covered_cells(df, "id").collect()} == {(1, 0, 0, 0.375), (1, 1, 0, 0.75)}


def test_split_at_points(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 5.0, 10.0, 5.0), (3, 50.0, 50.0, 60.0, 50.0)], "id int, ax double, ay double, bx double, by double").withColumnRenamed("id", "line")
    points = spark.createDataFrame([(1, 4.0, 1.0), (2, 7.0, 0.5), (3, 4.0, 0.2), (4, -1.0, 5.0), (5, 30.0, 30.0)], "id int, px double, py double")
    got = sorted((x.line, x.part, x.from_at, x.to_at) for x in G.split_at_points(lines, points, 3.0, "line").collect())
    assert got == [(1, 0, 0.0, 0.4), (1, 1, 0.4, 0.7), (1, 2, 0.7, 1.0), (2, 0, 0.0, 1.0), (3, 0, 0.0, 1.0)]


def test_fewest_changes(spark):
    r = random.Random(5)
    profiles = {k: [r.choice((0.0, 2.0, 4.0, 9.0)) for _ in range(8)] for k in range(12)} | {90: [1.0], 91: [0.0, 100.0], 92: [0.0, 0.0, 20.0, 0.0, 0.0]}
    df = spark.createDataFrame([(k, i, z) for k, zs in profiles.items() for i, z in enumerate(zs)], "link long, at int, z double")
    got = {x.link: (x.n, x.changes, x.kept) for x in E.fewest_changes(df, 3.5).collect()}
    assert got[92][1] == 1 and got[91][1] is None and got[90][1] == 0
    for k, zs in profiles.items():
        n, best = len(zs), None
        for size in range(n, 0, -1):
            for keep in itertools.combinations(range(n), size):
                if {0, n - 1} <= set(keep) and all(abs(zs[a] - zs[b]) <= 3.5 * (b - a) for a, b in itertools.combinations(keep, 2)):
                    best = n - size
                    break
            if best is not None:
                break
        assert got[k][:2] == (n, best)


def test_many_tracks(spark):
    f = lambda *a, **k: X.capacity(*[F.lit(float(x)) for x in a], **k)
    more = {"stop_trains": F.lit(25.0), "pass_trains": F.lit(5.0)}
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate([f(4, 9, 6, 2, 2), f(5, 9, 6, 2, 2), f(6, 9, 6, 2, 2), f(7, 9, 6, 2, 2), f(8, 9, 6, 2, 2), f(4, 20, 8, 4, 2, overflow="mixed", **more), f(4, 20, 8, 4, 2, **more), f(5, 9, 0, 2, 2)])]).first()
    assert list(row) == [40.0, 45.0, 60.0, 65.0, 80.0, 33.0, 40.0, None]


def test_section_paths(spark):
    e = spark.createDataFrame([(0, 3, 4, 1), (0, 3, 9, 1), (0, 1, 9, 1), (0, 5, 6, 2), (0, 6, 7, 2), (0, 5, 7, 2)], "network int, u int, v int, tracks int")
    assert {r.section: r.path for r in L.section_paths(L.chains(e)).collect()} == {"1-1-9": [1, 9, 3, 4], "2-5-6": [5, 6, 7, 5]}


def test_pattern_sections(spark):
    paths = spark.createDataFrame([(0, "a", [1, 2, 3, 4]), (0, "b", [10, 11, 12]), (0, "c", [20, 21]), (0, "d", [30, 31, 32, 33, 34])], "network int, section string, path array<int>")
    stops = spark.createDataFrame([(0, n, "S1") for n in (1, 2, 3, 10, 12, 30, 31, 32)] + [(0, n, "S2") for n in (10, 11, 12)], "network int, node int, service string")
    got = {}
    for r in L.split_by_pattern(paths, stops).orderBy("section", "part").collect():
        got.setdefault(r.section, []).append(r.path)
    assert got == {"a": [[1, 2, 3], [3, 4]], "b": [[10, 11, 12]], "c": [[20, 21]], "d": [[30, 31, 32], [32, 33, 34]]}
    assert L.split_by_pattern(paths, stops.limit(0)).count() == 4
