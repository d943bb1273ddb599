"""Keys of more suppliers than an int's square root, by tables of a few of them."""

from pyspark.sql import functions as F

from viatrix.operators import relational as R, spatial as G
from viatrix.plans import registry, route_plans as P


def many_suppliers(spark, sf_dir, tmp_path, n):
    spark.range(n).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    return str(tmp_path)


def test_segments_of_many_suppliers(spark, sf_dir, tmp_path):
    """u * v is beyond an int."""
    d = many_suppliers(spark, sf_dir, tmp_path, 60_000)
    got = registry.queries()["k4_segment_enrichment"](spark, d).groupBy("tracks").count().collect()
    assert {x.tracks for x in got} == {1, 2, 3}


def test_ids_of_many_suppliers(spark, sf_dir, tmp_path):
    """u * n + v is beyond an int; ids keep the order of (u, v)."""
    d = many_suppliers(spark, sf_dir, tmp_path, 60_000)
    x = registry.queries()["j23_positional_join"](spark, d)
    got = x.where("u = 59999").orderBy("v").collect()
    assert [r.id_edge for r in got] == [59_999 * 60_000 + r.v for r in got] and got
    assert P.id_type(46_340) == "int" and P.id_type(46_341) == "long"


def test_cells_go_to_the_plots(spark, sf_dir):
    """The planner takes exploded plots for as small as the table of parts; the cells are what is sent to all executors."""
    plan = registry.queries()["j25_area_weighted_overlay"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_convex_plots_are_dealt(spark):
    """One partition of plots becomes the work of many tasks, and no cell outside of a ring is worked out."""
    ring = "array(named_struct('x', 0.5D, 'y', 0.5D), named_struct('x', 40.5D, 'y', 40.5D), named_struct('x', 0.5D, 'y', 1.5D))"
    plots = spark.range(64).select(F.col("id"), F.expr(ring).alias("ring")).coalesce(1)
    x = G.convex_cells(plots, "id")
    assert x.rdd.getNumPartitions() > 1
    assert abs(x.where("id = 7").agg(F.sum("share")).first()[0] - 20.0) < 1e-9


def test_crowded_cells(spark):
    """600 points on two places are met in parts; all pairs are found once."""
    p = spark.range(600).select(F.col("id"), (F.col("id") % 2).cast("double").alias("x"))
    a, b = p.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.lit(0.0).alias("ay")), p.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.lit(0.0).alias("by"))
    got = R.distance_join(a, b, 0.5, most=50).select("a", "b")
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()  # neither side is sent whole to the one task of the other
    assert got.count() == got.distinct().count() == 2 * 300 * 300
