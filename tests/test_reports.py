"""Report tables, box statistics, district populations and crossed cells on worked cases and by brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from viatrix.operators import reports as P, scenarios as S, spatial as G

RUNS = "scenario string, dev string, line string, net double, cost double, ratio double"


@pytest.fixture(scope="module")
def runs(spark):
    rows = [("base", "a", "L1", 2e6, 1e6, 3.0), ("base", "a", "L1", -1e6, 1e6, 0.0), ("base", "b", "L2", -3e6, 0.0, None), ("high", "a", "L1", 5e6, 3e6, 2.0), ("high", "c", "L3", 5e6, 1e6, 6.0)]
    return spark.createDataFrame(rows, RUNS)


def test_reports(runs):
    v = {r.scenario: r for r in P.viability(runs).collect()}
    assert (v["base"].n_developments, v["base"].n_any, v["base"].n_all, v["base"].n_none, v["base"].n_runs, v["base"].n_viable) == (2, 1, 0, 1, 3, 1)
    assert (v["high"].pct_all, v["high"].pct_viable, v["base"].pct_viable) == (100, 100, 33.333333)
    c = {r.scenario: r for r in P.costs(runs, "base").collect()}
    assert (c["base"].total_change, c["base"].mean_pct, c["base"].n_lower, c["base"].n_higher) == (0, 0, 0, 0)
    assert (c["high"].total_cost, c["high"].total_change, c["high"].total_pct, c["high"].mean_change, c["high"].mean_pct, c["high"].n_higher) == (4, 3, 300, 2, 200, 1)
    b = {r.scenario: r for r in P.benefit_cost_ratios(runs).collect()}
    assert (b["base"].mean_ratio, b["base"].n_paying, b["base"].n_losing, b["base"].pct_paying) == (1.5, 1, 0, 50)
    n = {r.scenario: r for r in P.net_benefits(runs).collect()}
    assert (n["base"].total_net, n["base"].n_positive, n["base"].pct_negative) == (-2.5, 1, 50)
    assert [(r.rank, r.dev) for r in P.top_developments(runs.where("scenario = 'high'"), 1).collect()] == [(1, "a")]


def test_no_runs(runs):
    for f in (P.viability, lambda x: P.costs(x, "base"), P.benefit_cost_ratios, P.net_benefits, P.top_developments):
        assert f(runs.limit(0)).count() == 0


def test_box(spark):
    got = P.box_statistics(spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 100)] + [("a", None), ("b", 7.0), ("c", None)], "k string, v double"), "k", "v").orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 6, 2.25, 3.5, 4.75, 1.0, 5.0, 1), ("b", 1, 7.0, 7.0, 7.0, 7.0, 7.0, 0)]


def test_population(spark):
    rows = [("up", 1, 100.0), ("up", 1, 0.0), ("up", 3, 121.0), ("down", 1, 10.0), ("down", 3, 9.0), ("new", 3, 5.0), ("new", 3, None)]
    panel = spark.createDataFrame(rows, "district string, year int, value double")
    nation = spark.createDataFrame([(1, 100.0), (3, 110.0)], "year int, value double")
    rates = spark.createDataFrame([(3, 9.0), (4, 0.1), (5, 0.2)], "year int, rate double")
    got = {(r.district, r.year): (r.value, r.growth) for r in S.district_population(panel, nation, rates, 1, 1, 3).collect()}
    assert len(got) == 15
    assert got["up", 1] == (100, None) and got["up", 2] == (0, -1) and got["up", 3] == (121, None)
    f = math.sqrt(0.21 / 0.1)
    assert got["up", 4] == pytest.approx((121 * (1 + 0.1 * f), 0.1 * f)) and got["up", 5] == pytest.approx((121 * (1 + 0.1 * f) * (1 + 0.2 * f), 0.2 * f))
    assert got["down", 4] == got["new", 4] == (None, None) and got["new", 3][0] == 5


def test_crossed_cells(spark):
    rng = random.Random(3)
    lines = [(i, *[rng.randint(-12, 12) / rng.choice((1, 2, 2)) for _ in range(4)]) for i in range(120)]
    lines += [(200, 0.0, 0.0, 4.0, 0.0), (201, 1.0, -3.0, 1.0, 2.5), (202, 2.0, 2.0, 2.0, 2.0), (203, 0.5, 0.5, 0.5, 0.5), (204, 0.0, 0.0, 3.0, 3.0), (205, -2.0, 2.0, 2.0, -2.0), (206, -11.0, 0.25, 11.0, 0.5)]
    df = spark.createDataFrame(pd.DataFrame(lines, columns=["id", "ax", "ay", "bx", "by"]))
    got = sorted(map(tuple, G.crossed_cells(df, 1.0, "id").collect()))
    expected = []
    r, c = np.meshgrid(np.arange(-14, 15), np.arange(-14, 15), indexing="ij")
    for i, ax, ay, bx, by in lines:
        sides = [np.sign((bx - ax) * (r + j - ay) - (by - ay) * (c + k - ax)) for j in (0, 1) for k in (0, 1)]
        hit = (max(ax, bx) >= c) & (min(ax, bx) <= c + 1) & (max(ay, by) >= r) & (min(ay, by) <= r + 1) & (np.max(sides, 0) >= 0) & (np.min(sides, 0) <= 0)
        expected += [(i, int(a), int(b)) for a, b in zip(r[hit], c[hit])]
    assert got == sorted(expected)
    odd = spark.createDataFrame([(1, None, 0.0, 1.0, 1.0)], "id int, ax double, ay double, bx double, by double")
    assert G.crossed_cells(odd, 1.0, "id").count() == 0
