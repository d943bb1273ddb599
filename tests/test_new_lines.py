"""Lines of two halves against a plain search; and that every query reads the tables."""

import random

import pytest
from pyspark.sql import functions as F

from viatrix.operators import network as N
from viatrix.plans import registry


def halves(beside, ends, node, avoid):
    out, stack = [], [[node]]
    while stack:
        path = stack.pop()
        if path[-1] in ends:
            out.append(path)
            continue
        stack += [[*path, v] for v in beside.get(path[-1], ()) if v not in path and v not in avoid]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_new_lines(spark, seed):
    r = random.Random(seed)
    links = {tuple(sorted(r.sample(range(12), 2))) for _ in range(18)} | {(20 + i, 21 + i) for i in range(9)} | {(0, 20), (29, 30), (29, 31)}
    beside = {}
    for u, v in links:
        beside.setdefault(u, set()).add(v)
        beside.setdefault(v, set()).add(u)
    ends = {1, 5, 7, 30}
    missing = [(c, a, b) for c, near in beside.items() if len(near) > 2 for a in near for b in near if a < b and r.random() < 0.7]
    want = {}
    for c, a, b in sorted(missing):
        for x in halves(beside, ends, a, beside[c] - {a}):
            for y in halves(beside, ends, b, beside[c] - {b}):
                if not set(x[:-1]) & set(y[:-1]):
                    want.setdefault(tuple(y[::-1] + x), (c, a, b))
    edges = spark.createDataFrame([p for u, v in links for p in ((u, v), (v, u))], "u int, v int")
    got = N.new_lines(edges, spark.createDataFrame([(e,) for e in ends], "node int"), spark.createDataFrame(missing, "centre int, n1 int, n2 int")).collect()
    assert {tuple(x.path): (x.centre, x.n1, x.n2) for x in got} == want and len(got) == len(want) and max(map(len, want)) > 9
    order = sorted(got, key=lambda x: (x.centre, x.n1, x.n2, x.path))
    assert [x.name for x in order] == [f"X{i}" for i in range(len(order))]


def test_no_connection(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "u int, v int")
    assert N.new_lines(edges, edges.select(F.col("u").alias("node")), spark.createDataFrame([], "centre int, n1 int, n2 int")).count() == 0


class Opened(Exception):
    """A table of the driver was opened."""


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_reads_a_table(spark, monkeypatch, name):
    """Every query opens one of the given tables: it stops as soon as it does."""

    def parquet(self, *paths, **_):
        raise Opened

    monkeypatch.setattr(type(spark.read), "parquet", parquet)
    with pytest.raises(Opened):
        registry.queries()[name](spark, "/nowhere")
