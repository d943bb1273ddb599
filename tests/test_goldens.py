"""Small cases worked out by hand, and invariants."""

from statistics import NormalDist

import pandas as pd
import pytest
from pyspark.sql import functions as F

from viatrix.functions import exprs as X
from viatrix.operators import assignment as A, graph_search as Q, network as N, relational as R, scenarios as S, sections as L, spatial as G, value as V

C = F.col


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize("text, nodes", [("-99", []), ("[-99]", []), ("[]", []), ("nan", []), ("", []), ("[6, 2122]", [6, 2122]), ("[2526]", [2526]), ("1018,2298", [1018, 2298]), ("1,8,8,5,,,3,5,1,,,2,4,9,7,,,1,0,1,8,", [1885, 351, 2497, 1018])])
def test_via(spark, text, nodes):
    assert one(spark, X.parse_via(F.lit(text)))[0] == nodes


def test_via_null(spark):
    assert one(spark, X.parse_via(F.lit(None).cast("string")))[0] == []


@pytest.mark.parametrize("x, text", [(2.0, "2"), (2.5, "2.5"), (0.33333, "0.333"), (None, "")])
def test_frequency_format(spark, x, text):
    assert one(spark, X.format_frequency(F.lit(x).cast("double")))[0] == text


def test_rounding_and_casts(spark):
    row = one(spark, X.minutes(F.lit(2.5)), X.minutes(F.lit(3.5)), X.int_or_zero(F.lit("x")), X.comma_float(F.lit("1,5")), X.truthy(F.lit(" Wahr ")), X.segment_key(F.lit("7-3")))
    assert list(row) == [2, 4, 0, 1.5, True, "3-7"]


def test_capacity(spark):
    f = lambda *a: X.capacity(*[F.lit(float(x)) for x in a])
    row = one(spark, f(1, 7, 7, 2, 0), f(1.5, 8, 8, 2, 0), f(2, 9, 9, 3, 0), f(2, 20, 8, 4, 2), f(3, 9, 9, 3, 0), *[X.double_mixed(F.lit(20.0), F.lit(8.0), F.lit(4), F.lit(2), k) for k in ("bad", "base", "good")])
    assert [float(x) for x in row] == [4.0, 7.5, 20.0, 13.0, 30.0, 10.0, 13.0, 13.0]


def test_explode_path(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([5],), (None,)], "path array<int>")
    assert [(r.from_node, r.to_node) for r in R.explode_path(df, "path").orderBy("hop").collect()] == [(1, 2), (2, 3), (3, 4)]


def test_null_keys_are_dropped(spark):
    df = spark.createDataFrame([(1, 2.0), (None, 3.0), (1, None)], "k int, x double")
    assert [tuple(r) for r in R.group_known(df, ["k"], R.sum_or_zero(C("x")).alias("x")).collect()] == [(1, 2.0)]


def test_transit_graph_times(spark):
    rows = [("S1", "A", "A", "B", 5.0), ("S1", "A", "B", "C", 7.0), ("S2", "A", "A", "C", 10.0), ("S3", "A", "B", "D", 4.0)]
    df = spark.createDataFrame([("g", *r) for r in rows], "graph_id string, service string, direction string, from_node string, to_node string, time double")
    graph = N.transit_graph(df)
    times = {(r.src, r.node): r.d for r in N.all_times(graph).collect()}
    assert times["entry_A", "exit_B"] == 11 and times["entry_A", "exit_C"] == 16 and times["entry_A", "exit_D"] == 27
    assert ("entry_C", "exit_A") not in times
    trips = spark.createDataFrame([("A", "C", 10.0), ("A", "D", 5.0), ("A", "B", 2.0), ("C", "A", 9.0), ("A", "A", 7.0)], "o string, d string, trips double")
    pairs = trips.select(F.lit("g").alias("graph_id"), F.concat(F.lit("entry_"), "o").alias("o"), F.concat(F.lit("exit_"), "d").alias("d"))
    flows = {tuple(r)[:4]: r.flow for r in N.assign_transit_flows(Q.paths_between(graph, pairs), trips).collect()}
    assert flows == {("A", "C", "S2", "A"): 10.0, ("A", "B", "S1", "A"): 7.0, ("B", "D", "S3", "A"): 5.0}


def test_min_plus_equals_dijkstra(spark):
    r = pd.DataFrame({"u": [i % 17 for i in range(60)], "v": [(i * 7 + 3) % 17 for i in range(60)], "w": [float(1 + i * 13 % 11) for i in range(60)]})
    e = spark.createDataFrame(r).withColumn("graph_id", F.lit(1)).where("u <> v")
    sources = e.select("graph_id", C("u").alias("src"), C("u").alias("node"), F.lit(0.0).alias("d")).distinct()
    a = {(x.src, x.node): x.d for x in N.min_plus(e, sources).collect()}
    b = {(x.src, x.node): x.d for x in N.all_times(e).collect() if x.src in r.u.values}
    assert a == b


def test_paths_between(spark):
    """Of equally short paths the first in order of nodes; nothing for what can't be reached or isn't there."""
    e = spark.createDataFrame([(0, 1, 3, 1.0), (0, 1, 2, 1.0), (0, 3, 4, 1.0), (0, 2, 4, 1.0), (0, 4, 5, 0.5), (0, 1, 5, 2.5), (0, 1, 3, 9.0)], "graph_id int, u int, v int, w double")
    pairs = spark.createDataFrame([(0, 1, 4), (0, 1, 5), (0, 5, 1), (0, 1, 8), (0, 8, 1), (0, 2, 2)], "graph_id int, o int, d int")
    got = {(r.o, r.d): (r.cost, r.path) for r in Q.paths_between(e, pairs).collect()}
    assert got == {(1, 4): (2.0, [1, 2, 4]), (1, 5): (2.5, [1, 2, 4, 5]), (2, 2): (0.0, [2])}


def test_later_rows_of_a_run_win(spark):
    rows = [("g", "A", "B", "S", "A", 5.0, 1), ("g", "A", "B", "S", "A", 7.5, 2), ("g", "B", "C", "S", "A", 3.0, 1), ("g", "B", "C", "S", "A", None, 2)]
    graph = N.transit_graph(spark.createDataFrame(rows, "graph_id string, from_node string, to_node string, service string, direction string, time double, nth int"))
    assert sorted(r.w for r in graph.where("kind = 'ride'").collect()) == [3.0, 8.0]


def test_via_of_new_links(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (7, 8, 1.0)], "u int, v int, w double")
    wanted = spark.createDataFrame([(1, 4), (1, 2), (1, 7), (1, 9)], "u int, v int")
    assert {(r.u, r.v): r.via for r in N.via_nodes(e, wanted).collect()} == {(1, 4): "[2,3]", (1, 2): "-99", (1, 7): "-99"}


def test_missing_connections(spark):
    both = [(0, 1), (0, 2), (0, 3)]
    links = spark.createDataFrame(both + [(v, u) for u, v in both], "u int, v int")
    calls = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (0, "a"), (0, "b")], "node int, service string")
    find = lambda *n: sorted(tuple(r) for r in N.missing_connections(links, calls, spark.createDataFrame([(i,) for i in n], "node int")).collect())
    assert find(1, 2, 3) == [(0, 1, 3), (0, 2, 3)] and find(1) == [(0, 1, 3)] and find(0) == []


def test_broken_graphs_are_left_out(spark, tmp_path):
    files = {"a": "FromNode;ToNode;TravelTime\n1;2;3.5\n2;3;\n", "b": "TravelTime;FromNode;ToNode\r\n2.5;8;9\r\n", "c": "FromNode;ToNode\n1;2\n", "d": "FromNode;ToNode;TravelTime\n1;2;x\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    graphs, bad = N.read_graphs(spark, str(tmp_path), "([a-z]).csv")
    assert sorted(map(tuple, graphs.collect())) == [("a", "1", "2", 4.0), ("b", "8", "9", 2.0)] and sorted(r.graph_id for r in bad.collect()) == ["c", "d"]


def test_snap(spark):
    fast = {(0, 0): 50, (4, 4): 100, (2, 0): 30}
    cells = spark.createDataFrame([(r, c, fast.get((r, c), 0)) for r in range(9) for c in range(9)], "row int, col int, speed int")
    got = {(r.row, r.col): (r.to_row, r.to_col) for r in G.snap_to_fast(cells, cells).collect()}
    assert got[1, 1] == (0, 0) and got[2, 2] == (0, 0) and got[3, 1] == (2, 0) and got[4, 4] == (4, 4) and got[6, 6] == (4, 4) and got[8, 8] == (8, 8) and got[2, 0] == (2, 0)


def test_nearest(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 0.0), (3, 5.0, 0.0)], "k int, ax double, ay double")
    sites = spark.createDataFrame([(7, 0.0, 1.0), (8, 0.0, -1.0), (9, 10.0, 0.0)], "id int, bx double, by double")
    assert {r.k: r.id for r in R.nearest(points, ["k"], sites, 2.0).collect()} == {1: 7, 2: 9, 3: 9}
    assert [r.id for r in R.nearest(points, ["k"], sites.limit(0), 2.0).collect()] == [None] * 3


def test_surrogate_ids_over_many_ranges(spark):
    df = spark.range(1000).select((C("id") * 7919 % 1000).alias("x"), (C("id") % 3).alias("y")).repartition(5)
    got = R.surrogate(df, "n", 100, C("y").desc(), C("x")).toPandas().sort_values(["y", "x"], ascending=[False, True])
    assert list(got.n) == list(range(100, 1100))


def test_enough_tracks(spark):
    """Worked by hand: 60 // 10 / 2 = 3 trains on one track, then 60 // 5 / 2 = 6 on one and a half, then 20 on two."""
    df = spark.createDataFrame([(i, 1.0, 10.0, 5.0, 2, 0, load, 1, 2000.0) for i, load in enumerate((1.0, 1.5, 5.0, 30.0))], "id int, tracks double, stop double, pass double, n_stop int, n_pass int, load double, segments int, length double")
    got = {r.id: (r.tracks, r.rounds, r.capacity, r.enough) for r in L.enough_tracks(df, 2.0, 10).collect()}
    assert got[0] == (1.0, 0, 3.0, True) and got[1] == (1.5, 1, 6.0, True) and got[2] == (2.0, 2, 20.0, True) and got[3][1] > 2


def test_discount(spark):
    got = one(spark, *[V.discount(F.lit(y), 0.03, 2050) for y in (2050, 2051, 2052, 2100)])
    assert [round(x, 6) for x in got] == [1.03, 1.0, 0.970874, 0.23495]
    total = spark.range(2051, 2101).agg(F.sum(V.discount(C("id"), 0.03, 2050))).first()[0]
    assert round(total, 6) == 26.501657


def test_savings(spark):
    assert [round(x, 6) for x in one(spark, *V.savings(F.lit(1000.0), F.lit(990.0)))] == [10.0, 54020.0]


def test_allocation(spark):
    z = spark.createDataFrame([(1, 100.0), (2, 300.0)], "zone int, pop double")
    assert {r.zone: round(r.relative, 9) for r in S.allocate(z, "pop", 40.0, 1.0).collect()} == {1: 1.1, 2: 1.1}


def test_latin_hypercube(spark):
    x = S.latin_hypercube(spark.range(40).withColumnRenamed("id", "scenario"), [2020, 2021], 3).toPandas()
    for _, u in x.groupby("year").u:
        assert sorted((u * 40).astype(int)) == list(range(40))


def test_panel_rows(spark):
    costs = spark.createDataFrame([("a", 5.0, 1.0), ("b", 6.0, 2.0)], "dev string, construction double, maintenance double")
    benefits = spark.createDataFrame([(d, s, 2050, 1.0) for d in "ab" for s in "xyz"], "dev string, scenario string, year int, benefit double")
    p = V.panel(costs, benefits, 2050, 2100).toPandas()
    assert len(p) == 306 and (p[p.year > 2050].const_cost == 0).all() and (p[p.year == 2050].maint_cost == 0).all()


def test_distance_join(spark):
    p = [(i, float(i * 37 % 100), float(i * 61 % 100)) for i in range(80)]
    df = spark.createDataFrame(p, "id int, x double, y double")
    got = R.distance_join(df.toDF("a", "ax", "ay"), df.toDF("b", "bx", "by"), 12.0)
    want = {(a, b) for a, ax, ay in p for b, bx, by in p if ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5 <= 12.0}
    assert {(r.a, r.b) for r in got.collect()} == want


def test_line_costs(spark):
    c = V.line_construction(F.lit(1000.0), F.lit(500.0), F.lit(100.0))
    assert [round(x, 2) for x in one(spark, c, V.line_maintenance(c))] == [92250000.0, 89943750.0]
    assert list(one(spark, V.too_full(F.lit(24), F.lit(2)), V.too_full(F.lit(23), F.lit(2)), V.too_full(F.lit(12), F.lit("12")), V.too_full(F.lit(11), F.lit("12")))) == [True, False, True, False]


def test_interventions(spark):
    def cost(segments, tracks, length, platforms):
        kind, added, more = V.intervention(*[F.lit(x) for x in (segments, tracks, length, platforms)])
        return list(one(spark, kind, added, more, V.intervention_cost(kind, F.lit(tracks), added, F.lit(length), more)))

    assert cost(1, 1.5, 1500.0, 2) == ["segment_passing_siding", 0.5, 0, 16625000.0]
    assert cost(1, 1.5, 900.0, 2) == ["segment_passing_siding", 1.0, 0, 29925000.0]
    assert cost(1, 2.0, 900.0, 2) == ["segment_passing_siding", 0.5, 0, 66500000.0]
    assert cost(3, 2.5, 0.0, 1) == ["station_track", 1.0, 1, 36600000.0]


def test_standard_normal(spark):
    u = [1e-9, 0.001, 0.02425, 0.03, 0.25, 0.5, 0.75, 0.98, 0.999999]
    got = spark.createDataFrame([(x,) for x in u], "u double").select("u", S.standard_normal(C("u")).alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.u)) <= 1.2e-9 * max(1, abs(r.z)) for r in got)


def test_service_cells(spark):
    row = one(spark, X.service_cells(F.lit("S5.4; S14.2.5,S5.6, IC, .3, X.y")), X.service_direction_cells(F.lit("S5.A.4, S5.B.2.5, S5.A.7, S9.1")), X.service_names(F.lit("S9.A.1; IC,S9 , ")), X.service_cells(F.lit(None).cast("string")), X.service_names(F.lit("")))
    assert [tuple(x) for x in row[0]] == [("S5", 6.0), ("S14", 2.5), ("X", 0.0)]
    assert [tuple(x) for x in row[1]] == [("S5", "A", 7.0), ("S5", "B", 2.5)]
    assert row[2] == ["IC", "S9"] and row[3] == [] and row[4] == []


def test_logit_assignment(spark):
    """Two routes with nothing in common against the same steps in plain numbers; a lone route takes all."""
    import math

    routes = spark.createDataFrame([(1, 4, 1, [1, 2, 4]), (1, 4, 2, [1, 3, 4]), (2, 4, 1, [2, 4])], "o int, d int, nth int, path array<int>")
    links = spark.createDataFrame([(1, 2, 5.0, 50.0), (2, 4, 5.0, 80.0), (1, 3, 6.0, 60.0), (3, 4, 6.0, 60.0)], "u int, v int, free double, capacity double")
    trips = spark.createDataFrame([(1, 4, 100.0), (2, 4, 30.0)], "o int, d int, trips double")
    got = {(r.o, r.nth): r.share for r in A.logit_assignment(routes, links, trips, 0.3, 6).collect()}
    x, time = 0.5, lambda free, load, cap: free * (1 + 0.25 * (load / cap) ** 2.4)
    for k in range(1, 7):
        one = time(5, 100 * x, 50) + time(5, 100 * x + 30, 80)
        two = time(6, 100 * (1 - x), 60) * 2
        x += (1 / (1 + math.exp(0.3 * (one - two))) - x) / k
    assert got[2, 1] == 1.0 and abs(got[1, 1] - x) < 1e-9 and abs(got[1, 1] + got[1, 2] - 1) < 1e-9
