"""Shortest paths of more edges than min_plus once had rounds."""

from viatrix.operators import network as N


def test_min_plus_goes_on(spark):
    edges = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(66)], "graph_id int, u int, v int, w double").coalesce(1)
    sources = spark.createDataFrame([(0, 0, 0, 0.0)], "graph_id int, src int, node int, d double")
    assert {r.node: r.d for r in N.min_plus(edges, sources).collect()} == {i: float(i) for i in range(67)}
