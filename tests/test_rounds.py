"""Rounds of joins that move only what is not done, and results that no task holds whole."""

from pyspark.sql import functions as F

from viatrix.operators import network as N, relational as R, routing as P, sections as L
from viatrix.plans import route_plans


def test_many_graphs_are_searched_from_the_wanted_stations_only(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("one task a graph")

    monkeypatch.setattr(N, "all_times", whole)
    got = route_plans.g2(spark, "/root/testdata/sf0.001")
    assert {x.src for x in got.select("src").distinct().collect()} == {"0", "9"}


def test_arcs_that_came_to_an_end_move_no_more(spark):
    # a list of 64 arcs, and 100 of one arc
    long_ = [(0, i, i + 1, i + 2 if i < 63 else None) for i in range(64)]
    short = [(0, 1000 + 2 * i, 1001 + 2 * i, None) for i in range(100)]
    arcs = spark.createDataFrame(long_ + short, "network int, a int, b int, c int")
    got, tables = L.ranked(arcs.select("*", F.struct("a", "b").alias("least"), F.least("a", "b").alias("low")))
    assert [t.count() for t in tables] == [164, 63, 62, 60, 56, 48, 32]
    assert {x.a: (x.last_a, x.hops) for x in got.where("a < 64").collect()} == {i: (63, 63 - i) for i in range(64)}
    assert got.count() == 164 and got.where("not ends").isEmpty()


def test_patterns_of_many_sections_in_one_batch(spark):
    paths = spark.range(3000).select(F.lit(0).alias("network"), F.concat(F.lit("s"), "id").alias("section"), F.array(*[F.col("id") * 5 + i for i in range(5)]).alias("path"))
    stops = spark.range(15000).where("id % 5 < 3").select(F.lit(0).alias("network"), F.col("id").alias("node"), F.lit("S1").alias("service"))
    got = L.split_by_pattern(paths, stops)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    parts = {(x.section, x.part): x.path for x in got.collect()}
    assert len(parts) == 6000 and parts["s7", 0] == [35, 36, 37] and parts["s7", 1] == [37, 38, 39]


def test_nearest_meets_few_of_many_crowded_and_far_sites(spark, monkeypatch):
    met = []
    plain = R.written

    def counted(df):
        out = plain(df)
        met.append(out.count())
        return out

    monkeypatch.setattr(R, "written", counted)
    # 10,000 sites in one square of 100 by 100, five at each place; 400 points at 20 places, near and far
    sites = spark.range(10000).select("id", (F.col("id") * 7 % 2000 % 50 * 2).cast("double").alias("bx"), F.floor(F.col("id") * 7 % 2000 / 50).cast("double").alias("by"))
    points = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 20 * 53 - 300).cast("double").alias("ax"), (F.col("id") % 20 * 31 - 200).cast("double").alias("ay"))
    got = {x.k: (x.distance, x.id) for x in R.nearest(points, ["k"], sites, 100.0).collect()}
    assert max(met) == 2000 and sum(met) < 10000
    place = {(x.bx, x.by): x.id for x in sites.groupBy("bx", "by").agg(F.min("id").alias("id")).collect()}
    for p in points.collect():
        assert got[p.k] == min((((p.ax - x) ** 2 + (p.ay - y) ** 2) ** 0.5, i) for (x, y), i in place.items())


def test_nearest_leaves_points_without_a_place(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 0.0, 0.0)], "id long, bx double, by double")
    points = spark.createDataFrame([(1, 3.0, 4.0), (2, None, 0.0), (3, float("nan"), 0.0)], "k int, ax double, ay double")
    assert {x.k: (x.distance, x.id) for x in R.nearest(points, ["k"], sites, 2.0).collect()} == {1: (5.0, 1), 2: (None, None), 3: (None, None)}


def test_only_asked_paths_are_written_out(spark, monkeypatch):
    tables = []
    plain = P.written

    def told(df):
        out = plain(df)
        tables.append((out.count(), any(t.startswith("array") for _, t in out.dtypes)))
        return out

    monkeypatch.setattr(P, "written", told)
    tree = spark.range(200).select(F.lit(0).alias("graph_id"), F.lit(199).cast("long").alias("goal"), F.col("id").alias("node"), (199.0 - F.col("id")).alias("d"), F.when(F.col("id") < 199, F.col("id") + 1).alias("next"))
    pairs = spark.createDataFrame([(0, 3, 199), (0, 199, 199), (0, 500, 199)], "graph_id int, o long, d long")
    got = {x.o: (x.cost, x.path) for x in P.follow(tree, pairs).collect()}
    assert got == {3: (196.0, list(range(3, 200))), 199: (0.0, [199])}
    assert [n for n, lists in tables if lists] == [2]
