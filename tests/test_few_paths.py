"""Searches from both ends against searches in plain Python, and the rows that they hold."""

import random

from pyspark.sql import functions as F

from viatrix.operators import graph_search as Q, network as N, routing as R


def test_few_paths(spark):
    """Many ties, nodes that the graph lacks or that are not reached, and pairs of one node."""
    r = random.Random(3)
    edges = spark.createDataFrame([(g, r.randrange(30), r.randrange(30), float(r.randrange(1, 4))) for g in (0, 5) for _ in range(70)] + [(0, 50, 51, 1.0)], "graph_id int, u int, v int, w double")
    pairs = spark.createDataFrame([(g, o, d) for g in (0, 5) for o in range(30) for d in range(0, 30, 2) if o != d] + [(0, 50, 51), (0, 51, 50), (5, 50, 51), (0, 77, 78), (0, 1, 99)], "graph_id int, o int, d int")
    tell = lambda df: sorted((x.graph_id, x.o, x.d, x.cost, tuple(x.path)) for x in df.collect())
    assert tell(R.few_paths_on(edges, pairs)) == tell(Q.paths_between(edges, pairs))


def test_balls_stay_small(spark, monkeypatch):
    """A ring of 4000 stations and 200 new links: what is held is far less than all stations for each of 200 goals."""
    rows, written = [], R.written
    monkeypatch.setattr(R, "written", lambda df: rows.append((x := written(df)).count()) or x)
    one = spark.range(4000).select(F.col("id").cast("int").alias("u"), ((F.col("id") + 1) % 4000).cast("int").alias("v"), F.lit(1.0).alias("w"))
    wanted = one.where("u % 20 = 0").select("u", ((F.col("u") + 5) % 4000).alias("v"))
    got = N.via_nodes(one.union(one.select("v", "u", "w")), wanted).collect()
    assert len(got) == 200 and all(x.via == "[" + ",".join(str((x.u + i) % 4000) for i in range(1, 5)) + "]" for x in got)
    assert max(rows) < 200 * 4000 / 10
