"""Queries of report tables, district populations, access points, merged lines and speeds of crossed cells (A21, E6, N1, O5, P3, P8)."""

from pyspark.sql import Window, functions as F

from viatrix.functions import exprs as X
from viatrix.operators import relational as R, reports as P, scenarios as S, sections as L, spatial as G
from viatrix.plans import domain as D
from viatrix.plans.registry import register
from viatrix.session import table

C = F.col


def runs(s, d):
    """A run for each year of a scenario (orders' priority) and development (brand)."""
    o = table(s, d, "orders").select("o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("scenario"), F.year("o_orderdate").alias("run"))
    p = table(s, d, "part").select("p_partkey", C("p_brand").alias("dev"))
    x = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").join(o, C("l_orderkey") == C("o_orderkey")).join(p, C("l_partkey") == C("p_partkey"))
    x = x.groupBy("scenario", "dev", "run").agg(F.round(F.sum("l_extendedprice"), 2).alias("benefit"), F.sum(C("l_quantity") * 2088).alias("cost"))
    return x.select("scenario", "dev", F.concat(F.lit("Line "), F.right("dev", F.lit(2))).alias("line"), (C("benefit") - C("cost")).alias("net"), "cost", F.try_divide("benefit", "cost").alias("ratio"))


RUNS = """runs AS (SELECT scenario, dev, 'Line ' || right(dev, 2) AS line, benefit - cost AS net, cost, benefit / nullif(cost, 0) AS ratio
  FROM (SELECT left(o_orderpriority, 1) AS scenario, p_brand AS dev, year(o_orderdate) AS run, round(sum(l_extendedprice), 2) AS benefit, sum(l_quantity * 2088) AS cost
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)),
m AS (SELECT scenario, dev, min(line) AS line, avg(net) AS net, avg(cost) AS cost, avg(ratio) AS ratio, count(*) AS n_runs, count(*) FILTER (WHERE net > 0) AS n_viable FROM runs GROUP BY scenario, dev)"""


def spread_sql(x, name):
    return ", ".join(f"round({f}({x}), 6) AS {k}_{name}" for f, k in (("avg", "mean"), ("median", "median"), ("min", "min"), ("max", "max"), ("stddev_samp", "std")))


def counts_sql(condition, name):
    return f"count(*) FILTER (WHERE {condition}) AS n_{name}, round(100.0 * count(*) FILTER (WHERE {condition}) / count(*), 6)::DOUBLE AS pct_{name}"


@register("p3_viability", f"WITH {RUNS} SELECT scenario, count(*) AS n_developments, {counts_sql('n_viable > 0', 'any')}, {counts_sql('n_viable = n_runs', 'all')}, {counts_sql('n_viable = 0', 'none')}, sum(n_runs)::BIGINT AS n_runs, sum(n_viable)::BIGINT AS n_viable, round(100.0 * sum(n_viable) / sum(n_runs), 6)::DOUBLE AS pct_viable FROM m GROUP BY scenario")
def p3_viability(s, d):
    return P.viability(runs(s, d))


P3C = f"""WITH {RUNS}, t AS (SELECT sum(cost) / 1e6 AS before FROM m WHERE scenario = '1'),
c AS (SELECT m.scenario, m.cost, m.cost - b.cost AS change, CASE WHEN m.scenario = '1' THEN 0.0 ELSE 100 * (m.cost - b.cost) / nullif(b.cost, 0) END AS pct FROM m LEFT JOIN m b ON b.scenario = '1' AND b.dev = m.dev)
SELECT scenario, round(sum(cost) / 1e6, 6) AS total_cost, round(sum(cost) / 1e6 - before, 6) AS total_change, round(100 * (sum(cost) / 1e6 - before) / nullif(before, 0), 6) AS total_pct, round(avg(cost) / 1e6, 6) AS mean_cost, round(avg(change) / 1e6, 6) AS mean_change,
{spread_sql('pct', 'pct')}, count(*) FILTER (WHERE change < 0) AS n_lower, count(*) FILTER (WHERE change > 0) AS n_higher FROM c, t GROUP BY scenario, before"""


@register("p3_costs", P3C)
def p3_costs(s, d):
    """Against the scenario of the first priority."""
    return P.costs(runs(s, d), "1")


@register("p3_benefit_cost_ratios", f"WITH {RUNS} SELECT scenario, {spread_sql('ratio', 'ratio')}, {counts_sql('ratio >= 1', 'paying')}, {counts_sql('ratio < 1', 'losing')} FROM m GROUP BY scenario")
def p3_ratios(s, d):
    return P.benefit_cost_ratios(runs(s, d))


@register("p3_net_benefits", f"WITH {RUNS} SELECT scenario, round(sum(net / 1e6), 6) AS total_net, {spread_sql('net / 1e6', 'net')}, {counts_sql('net > 0', 'positive')}, {counts_sql('net <= 0', 'negative')} FROM m GROUP BY scenario")
def p3_net(s, d):
    return P.net_benefits(runs(s, d))


@register("p3_top_developments", f"WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY net DESC NULLS LAST, dev) AS rank FROM m) SELECT scenario, rank, dev, line, round(net / 1e6, 6) AS net, round(ratio, 6) AS ratio, round(cost / 1e6, 6) AS cost FROM r WHERE rank <= 10")
def p3_top(s, d):
    return P.top_developments(runs(s, d))


P8 = f"""WITH {RUNS}, q AS (SELECT dev, count(*) AS n, quantile_cont(net, 0.25) AS q1, quantile_cont(net, 0.5) AS median, quantile_cont(net, 0.75) AS q3 FROM runs GROUP BY dev),
x AS (SELECT *, net BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM runs JOIN q USING (dev))
SELECT dev, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(net) FILTER (WHERE inside), 6) AS low, round(max(net) FILTER (WHERE inside), 6) AS high, count(*) FILTER (WHERE NOT inside) AS outliers FROM x GROUP BY ALL"""


@register("p8_box_statistics", P8)
def p8_box(s, d):
    return P.box_statistics(runs(s, d), "dev", "net")


N1 = f"""WITH {D.PANEL},
full_ AS (SELECT k.district, k.year, coalesce(p.value, 0.0) AS value FROM (SELECT district, y::INT AS year FROM (SELECT DISTINCT district FROM panel) CROSS JOIN range(1995, 2001) r(y)) k LEFT JOIN panel p ON p.district = k.district AND p.year = k.year),
seen AS (SELECT district, year, value, value / nullif(lag(value) OVER (PARTITION BY district ORDER BY year), 0) - 1 AS growth FROM full_),
nation AS (SELECT sum(value) FILTER (WHERE year = 2000) / nullif(sum(value) FILTER (WHERE year = 1996), 0) - 1 AS nation FROM panel),
f AS (SELECT district, max(value) FILTER (WHERE year = 2000) AS start, (max(value) FILTER (WHERE year = 2000) / nullif(max(value) FILTER (WHERE year = 1996), 0) - 1) / nullif(nation, 0) AS relative FROM full_, nation GROUP BY district, nation),
h AS (SELECT district, start, y::INT AS year, (0.012 - (y - 2000) * 0.0002) * CASE WHEN relative >= 0 THEN pow(relative, 1.0 / 4) END AS growth FROM f CROSS JOIN range(2001, 2051) r(y)),
e AS (SELECT district, year, start * CASE WHEN growth IS NOT NULL THEN exp(sum(ln(1 + growth)) OVER (PARTITION BY district ORDER BY year)) END AS value, growth FROM h)
SELECT district, year, round(value, 2) AS value, round(growth, 8) AS growth FROM (SELECT * FROM seen UNION ALL SELECT * FROM e)"""


@register("n1_district_population", N1)
def n1_population(s, d):
    """Regions' totals of 1995 to 2000, and on to 2050 by national rates times the regions' factors."""
    panel = D.panel(s, d)
    rates = s.range(2001, 2051).select(C("id").cast("int").alias("year"), (0.012 - (C("id") - 2000) * 0.0002).alias("rate"))
    x = S.district_population(panel.where("year <= 2000"), panel.groupBy("year").agg(F.sum("value").alias("value")), rates, 1995, 1996, 2000)
    return x.select("district", "year", F.round("value", 2).alias("value"), F.round("growth", 8).alias("growth"))


O5 = """WITH z AS (SELECT c_custkey AS zone, (c_custkey * 37 % 997)::DOUBLE AS x, (c_custkey * 53 % 991)::DOUBLE AS y FROM customer),
c AS (SELECT *, CASE WHEN x BETWEEN 400 AND 600 AND y BETWEEN 400 AND 600 THEN 1 WHEN x BETWEEN 250 AND 750 AND y BETWEEN 250 AND 750 THEN 2 WHEN zone % 5 = 0 THEN 4 ELSE 3 END AS category FROM z),
a AS (SELECT * FROM (SELECT s_suppkey AS id, (s_suppkey * 61 % 983)::DOUBLE AS ax, (s_suppkey * 29 % 977)::DOUBLE AS ay FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)) WHERE ax BETWEEN 250 AND 750 AND ay BETWEEN 250 AND 750 AND NOT (ax BETWEEN 400 AND 600 AND ay BETWEEN 400 AND 600)),
n AS (SELECT zone, id, row_number() OVER (PARTITION BY zone ORDER BY sqrt(pow(x - ax, 2) + pow(y - ay, 2)), id) AS k FROM c CROSS JOIN a WHERE category > 2)
SELECT zone, category::INT AS category, coalesce(id, -1)::BIGINT AS access_point FROM c LEFT JOIN (SELECT * FROM n WHERE k = 1) USING (zone)"""


@register("o5_access_points", O5)
def o5_access(s, d):
    """Zones within the corridor, within its margin, or without; those without go to the nearest served station in the margin, others to -1."""
    box = lambda x, y, low, high: x.between(low, high) & y.between(low, high)
    k, q = C("c_custkey"), C("s_suppkey")
    z = table(s, d, "customer").select(k.alias("zone"), (k * 37 % 997).cast("double").alias("ax"), (k * 53 % 991).cast("double").alias("ay"))
    x, y = C("ax"), C("ay")
    z = z.withColumn("category", F.when(box(x, y, 400, 600), 1).when(box(x, y, 250, 750), 2).when(C("zone") % 5 == 0, 4).otherwise(3))
    a = table(s, d, "supplier").select(q.alias("id"), (q * 61 % 983).cast("double").alias("bx"), (q * 29 % 977).cast("double").alias("by"))
    a = a.where(box(C("bx"), C("by"), 250, 750) & ~box(C("bx"), C("by"), 400, 600)).join(table(s, d, "lineitem").select(C("l_suppkey").alias("id")).distinct(), "id", "left_semi")
    far = R.nearest(z.where("category > 2"), ["zone"], a, 100.0).select("zone", "category", F.coalesce("id", F.lit(-1)).alias("access_point"))
    return z.where("category <= 2").select("zone", "category", F.lit(-1).cast("long").alias("access_point")).unionByName(far)


E6 = f"""WITH {D.SPEEDS}, r AS (SELECT (s_suppkey * 37 % side)::DOUBLE AS ax, (s_suppkey * 53 % side)::DOUBLE AS ay, (s_suppkey * 37 % side + s_suppkey * 11 % 9 - 4)::DOUBLE AS qx, (s_suppkey * 53 % side + s_suppkey * 7 % 9 - 4)::DOUBLE AS qy, 30 + s_suppkey % 6 * 10 AS kph FROM supplier, side),
k AS (SELECT c."row", c.col, max(kph) AS kph FROM cell c JOIN r ON greatest(ax, qx) >= col AND least(ax, qx) <= col + 1 AND greatest(ay, qy) >= "row" AND least(ay, qy) <= "row" + 1
  AND greatest((qx - ax) * ("row" - ay) - (qy - ay) * (col - ax), (qx - ax) * ("row" - ay) - (qy - ay) * (col + 1 - ax), (qx - ax) * ("row" + 1 - ay) - (qy - ay) * (col - ax), (qx - ax) * ("row" + 1 - ay) - (qy - ay) * (col + 1 - ax)) >= 0
  AND least((qx - ax) * ("row" - ay) - (qy - ay) * (col - ax), (qx - ax) * ("row" - ay) - (qy - ay) * (col + 1 - ax), (qx - ax) * ("row" + 1 - ay) - (qy - ay) * (col - ax), (qx - ax) * ("row" + 1 - ay) - (qy - ay) * (col + 1 - ax)) <= 0 GROUP BY ALL)
SELECT c."row", c.col, (CASE WHEN speed = 0 THEN 0 ELSE coalesce(kph, 4) END)::INT AS speed FROM cell c LEFT JOIN k ON k."row" = c."row" AND k.col = c.col"""


@register("e6_crossed_speed_raster", E6)
def e6_crossed(s, d):
    """The greatest speed of the roads that cross or touch a cell, 4 where none does, 0 where the land can't be passed."""
    k, side = C("s_suppkey"), C("side")
    cells = D.speeds(s, d)
    x = table(s, d, "supplier").select("s_suppkey").join(F.broadcast(table(s, d, "customer").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("side"))))  # one row
    col, row = k * 37 % side, k * 53 % side
    ends = {"ax": col, "ay": row, "bx": col + k * 11 % 9 - 4, "by": row + k * 7 % 9 - 4}
    roads = x.select(*[c.cast("double").alias(n) for n, c in ends.items()], (30 + k % 6 * 10).alias("kph"))
    best = G.crossed_cells(roads, 1.0, "kph").groupBy("row", "col").agg(F.max("kph").alias("kph"))
    return cells.join(best, ["row", "col"], "left").select("row", "col", F.when(C("speed") == 0, 0).otherwise(F.coalesce("kph", F.lit(4))).cast("int").alias("speed"))


A21 = """WITH o AS (SELECT c_nationkey AS line, o_orderkey AS k, o_custkey::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT line, k, y, lead(k) OVER w AS next, lead(y) OVER w AS next_y, (k // 97) % 3 = 0 AS tunnel FROM o WINDOW w AS (PARTITION BY line ORDER BY k)),
c AS (SELECT *, CASE WHEN tunnel IS DISTINCT FROM lag(tunnel) OVER (PARTITION BY line ORDER BY k) THEN 1 ELSE 0 END AS fresh FROM s WHERE next IS NOT NULL),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY line ORDER BY k) AS island FROM c)
SELECT (line * 10 + CASE WHEN tunnel THEN 1 ELSE 0 END)::BIGINT AS part_of, count(*) + 1 AS n_points, round(sum(sqrt(pow(next - k, 2) + pow(next_y - y, 2))), 4) AS length, min(k)::DOUBLE AS west, max(next)::DOUBLE AS east FROM i GROUP BY line, tunnel, island"""


@register("a21_merged_lines", A21)
def a21_lines(s, d):
    """The pieces of each nation's line, from order to order, put together within and without tunnels; a piece lies between two orders."""
    nation = table(s, d, "customer").select("c_custkey", C("c_nationkey").alias("line"))
    o = table(s, d, "orders").select("o_custkey", C("o_orderkey").alias("k")).join(nation, C("o_custkey") == C("c_custkey"))
    w = Window.partitionBy("line").orderBy("k")
    here = F.struct(C("k").cast("double").alias("x"), C("o_custkey").cast("double").alias("y"))
    x = o.select("k", (C("line") * 10 + (F.floor(C("k") / 97) % 3 == 0).cast("long")).alias("part_of"), F.array(here, F.lead(here).over(w)).alias("points")).where("points[1] is not null")
    m = L.merged_lines(x, "part_of")
    xs = F.transform("points", lambda p: p["x"])
    return m.select("part_of", F.size("points").cast("long").alias("n_points"), F.round(X.line_length(C("points")), 4).alias("length"), F.array_min(xs).alias("west"), F.array_max(xs).alias("east"))
