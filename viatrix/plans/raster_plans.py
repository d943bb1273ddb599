"""Queries of grids, elevation, sections, loops and further reports (G7-G9, E, K5, K11, N6, V8, P, and the rest of F, J, A, U, X)."""

from pyspark.sql import Window, functions as F

from viatrix.functions import exprs as X
from viatrix.operators import relational as R, routing as P, scenarios as S, spatial as G
from viatrix.plans import domain as D
from viatrix.plans.appraisal_plans import B5, discounted
from viatrix.plans.network_plans import LINES, lines
from viatrix.plans.registry import register
from viatrix.plans.relational_plans import SITES, sites
from viatrix.session import table

C = F.col


@register("g8_k_shortest_paths")
def g8(s, d):
    """The two shortest paths without repeats of each pair of suppliers that goods go between; tested against all paths of small graphs."""
    e = D.net(s, d).select(F.lit(0).alias("graph_id"), "u", "v", C("tt").cast("double").alias("w"))
    return P.k_shortest(e, D.od(s, d).select(F.lit(0).alias("graph_id"), "o", "d"), 2)


E1 = "WITH p AS (SELECT user_id, event_id, value, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(before) AS n, round(avg(abs(value - before) / 50), 8) AS mean_slope, (coalesce(avg(abs(value - before) / 50) > 0.05, FALSE) OR count(*) FILTER (WHERE abs(value - before) / 50 < 0.05) > 40) AS check_needed FROM p GROUP BY user_id"


def profile(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("user_id", "event_id", "ts", "value", (F.abs(C("value") - F.lag("value").over(w)) / 50).alias("slope"))


@register("e1_elevation_profile", E1.replace("mean_slope", "mean_slope"))
def e1(s, d):
    g = profile(s, d).groupBy("user_id").agg(F.count("slope").alias("n"), F.round(F.avg("slope"), 8).alias("mean_slope"), F.coalesce(F.avg("slope") > 0.05, F.lit(False)).alias("steep"), F.sum((C("slope") < 0.05).cast("int")).alias("flat"))
    return g.select("user_id", "n", "mean_slope", (C("steep") | (F.coalesce("flat", F.lit(0)) > 40)).alias("check_needed"))


E3 = """WITH p AS (SELECT user_id, event_id, CASE WHEN value > 60 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END AS f, lag(CASE WHEN value > 60 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END) OVER w AS a, lead(CASE WHEN value > 60 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) FILTER (WHERE f = 1 AND (a = 1 OR b = 1)) AS bridge, count(*) FILTER (WHERE f = -1 AND (a = -1 OR b = -1)) AS tunnel FROM p GROUP BY user_id"""


@register("e3_tunnel_bridge_flags", E3)
def e3(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(s, d, "events").withColumn("f", F.when(C("value") > 60, 1).when(C("value") < 20, -1).otherwise(0))
    p = p.select("user_id", "f", F.lag("f").over(w).alias("a"), F.lead("f").over(w).alias("b"))
    two = lambda x: F.count(F.when((C("f") == x) & ((C("a") == x) | (C("b") == x)), 1))
    return p.groupBy("user_id").agg(two(1).alias("bridge"), two(-1).alias("tunnel"))


E4 = f"""WITH n AS (SELECT count(*) AS n FROM supplier), x AS (SELECT s_suppkey AS i, {S.draw_sql('s_suppkey', '1', 21)} AS a, {S.draw_sql('s_suppkey', '2', 22)} AS b FROM supplier),
p AS (SELECT i, (row_number() OVER (ORDER BY a, i) - 0.5) / n * 100 AS x, (row_number() OVER (ORDER BY b, i) - 0.5) / n * 100 AS y FROM x, n)
SELECT i AS id, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE NOT (x BETWEEN 40 AND 60 AND y BETWEEN 30 AND 55)"""


@register("e4_candidate_points", E4)
def e4(s, d):
    """A Latin hypercube of candidates, one for each supplier, without those in a protected area; ranks come range by range."""
    x = table(s, d, "supplier").select(C("s_suppkey").alias("id"))
    n = F.broadcast(x.agg(F.count(F.lit(1)).alias("n")))  # one row
    x = x.select("id", S.draw(C("id"), F.lit(1), 21).alias("a"), S.draw(C("id"), F.lit(2), 22).alias("b"))
    x = R.surrogate(R.surrogate(x, "i", 1, C("a"), C("id")), "j", 1, C("b"), C("id")).join(n)
    at = lambda c: (C(c) - 0.5) / C("n") * 100
    p = x.select("id", at("i").alias("x"), at("j").alias("y"))
    return p.where(~(C("x").between(40, 60) & C("y").between(30, 55))).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("e5_protected_mask", f'WITH {D.CELLS} SELECT "row", col, CASE WHEN "row" IN (3, 7, 9) OR col % 11 = 0 THEN 39 ELSE 0 END AS burn FROM cells')
def e5(s, d):
    return D.cells(s, d).select("row", "col", F.when(C("row").isin(3, 7, 9) | (C("col") % 11 == 0), 39).otherwise(0).alias("burn"))


@register("e6_speed_raster", f'WITH {D.CELLS}, r AS (SELECT (s_suppkey * 7 % 100)::INT AS "row", max(30 + s_suppkey % 6 * 10)::INT AS speed FROM supplier GROUP BY ALL) SELECT c."row", c.col, CASE WHEN c.value = 0 THEN 0 ELSE coalesce(speed, 4) END AS speed FROM cells c LEFT JOIN r ON c."row" = r."row"')
def e6(s, d):
    r = table(s, d, "supplier").groupBy((C("s_suppkey") * 7 % 100).cast("int").alias("row")).agg(F.max(30 + C("s_suppkey") % 6 * 10).cast("int").alias("speed"))
    return D.cells(s, d).join(r, "row", "left").select("row", "col", F.when(C("value") == 0, 0).otherwise(F.coalesce("speed", F.lit(4))).alias("speed"))


X16 = f"""WITH {D.CELLS}, side AS (SELECT i::INT AS i, 0.3137 + i * 1.71 AS at FROM range(-1, 60) r(i)),
n AS (SELECT a.i AS "row", b.i AS col, value, (1 - abs(a.at - c."row" - 0.5)) * (1 - abs(b.at - c.col - 0.5)) AS w
  FROM side a CROSS JOIN side b JOIN cells c ON c."row" BETWEEN floor(a.at - 0.5) AND floor(a.at - 0.5) + 1 AND c.col BETWEEN floor(b.at - 0.5) AND floor(b.at - 0.5) + 1)
SELECT "row", col, round(sum(value * w) / sum(w), 6) AS value FROM n GROUP BY ALL"""


@register("x16_bilinear_resample", X16)
def x16(s, d):
    """To a grid of larger cells that begins elsewhere; cells without customers have no value."""
    return G.bilinear(D.cells(s, d), 0.3137, 0.3137, 1.71).select("row", "col", F.round("value", 6).alias("value"))


@register("x11_inverse_normal", f"SELECT c_custkey, round({S.standard_normal_sql('((c_custkey + 0.5) / n)')}, 8) AS z FROM customer, (SELECT count(*) AS n FROM customer)")
def x11(s, d):
    x = table(s, d, "customer").select("c_custkey")
    x = x.join(F.broadcast(x.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return x.select("c_custkey", F.round(S.standard_normal((C("c_custkey") + 0.5) / C("n")), 8).alias("z"))


@register("x10_powers", "SELECT s_suppkey, round(pow(abs(s_acctbal), 1.06), 4) AS p, round(sqrt(abs(s_acctbal)), 8) AS r, round(ln(1 + abs(s_acctbal)), 8) AS l FROM supplier")
def x10(s, d):
    a = F.abs("s_acctbal")
    return table(s, d, "supplier").select("s_suppkey", F.round(F.pow(a, F.lit(1.06)), 4).alias("p"), F.round(F.sqrt(a), 8).alias("r"), F.round(F.log(1 + a), 8).alias("l"))


@register("f14_corridor_rectangle", f"WITH {SITES} SELECT min(x) - 5 AS west, max(x) + 5 AS east, min(y) - 5 AS south, max(y) + 5 AS north FROM sites WHERE id < 10")
def f14(s, d):
    return sites(s, d).where("id < 10").agg((F.min("x") - 5).alias("west"), (F.max("x") + 5).alias("east"), (F.min("y") - 5).alias("south"), (F.max("y") + 5).alias("north"))


@register("a9_collect_communes", "SELECT c_nationkey AS station, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS communes FROM customer GROUP BY ALL")
def a9(s, d):
    x = table(s, d, "customer").groupBy(C("c_nationkey").alias("station")).agg(F.array_sort(F.collect_list("c_custkey")).alias("c"))
    return x.select("station", F.array_join(C("c").cast("array<string>"), ",").alias("communes"))


@register("a10_set_containment", f"WITH {D.NET}, {LINES}, n AS (SELECT service, u AS node FROM m UNION SELECT service, v FROM m) SELECT DISTINCT service FROM n WHERE NOT EXISTS (SELECT 1 FROM n m JOIN supplier ON m.node = s_suppkey WHERE m.service = n.service AND s_acctbal < 0)")
def a10(s, d):
    """Lines whose stations all lie inside: those of suppliers without debts."""
    n = lines(s, d).select("service", F.explode(F.array("u", "v")).alias("node")).distinct()
    outside = table(s, d, "supplier").where("s_acctbal < 0").select(C("s_suppkey").alias("node"))
    return n.join(n.join(outside, "node").select("service"), "service", "left_anti").select("service").distinct()


@register("a18_weighted_total", f"WITH {D.TRIPS}, {D.EDGES} SELECT round(sum(trips * tt) / 60, 6) AS hours FROM trips JOIN edges ON o = u AND d = v")
def a18(s, d):
    return D.trips(s, d).join(D.edges(s), (C("o") == C("u")) & (C("d") == C("v"))).agg(F.round(F.sum(C("trips") * C("tt")) / 60, 6).alias("hours"))


@register("u5_ordered_distinct", "SELECT l_orderkey, string_agg(s::VARCHAR, ',' ORDER BY n) AS distinct_suppliers FROM (SELECT l_orderkey, l_suppkey AS s, min(l_linenumber * 100000 + l_suppkey) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def u5(s, d):
    first = table(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min(C("l_linenumber") * 100000 + C("l_suppkey")).alias("n"))
    return first.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string")), ",").alias("distinct_suppliers"))


@register("u8_pivot_flat_names", f"WITH b AS ({B5}) SELECT dev, max(cost) FILTER (WHERE scenario = 'BUILDING') AS cost_building, max(cost) FILTER (WHERE scenario = 'MACHINERY') AS cost_machinery, max(benefit) FILTER (WHERE scenario = 'BUILDING') AS benefit_building, max(benefit) FILTER (WHERE scenario = 'MACHINERY') AS benefit_machinery FROM b GROUP BY dev")
def u8(s, d):
    p = discounted(s, d).groupBy("dev").pivot("scenario", ["BUILDING", "MACHINERY"]).agg(F.max("cost").alias("cost"), F.max("benefit").alias("benefit"))
    return p.select("dev", *[C(f"{k.upper()}_{v}").alias(f"{v}_{k}") for v in ("cost", "benefit") for k in ("building", "machinery")])


@register("b2_road_costs", f"WITH {D.DEVS} SELECT dev, round(length * 20.5 + n * 1000, 2) AS building_costs, round(length * 0.9, 2) AS maintenance, round(length * 0.0123 * 50, 4) AS climate_cost, round(length * 0.3 * 50, 4) AS nature FROM devs")
def b2(s, d):
    n = C("length")
    return D.developments(s, d).select("dev", F.round(n * 20.5 + C("n") * 1000, 2).alias("building_costs"), F.round(n * 0.9, 2).alias("maintenance"), F.round(n * 0.0123 * 50, 4).alias("climate_cost"), F.round(n * 0.3 * 50, 4).alias("nature"))


@register("p2_pricing_summary", f"WITH b AS ({B5}), m AS (SELECT dev, max(benefit - cost) FILTER (WHERE scenario = 'BUILDING') AS base, max(benefit - cost) FILTER (WHERE scenario = 'FURNITURE') AS other FROM b GROUP BY dev) SELECT dev, round(base, 2) AS base, round(other - base, 2) AS change FROM m")
def p2(s, d):
    pick = lambda k: F.max(F.when(C("scenario") == k, C("benefit") - C("cost")))
    m = discounted(s, d).groupBy("dev").agg(pick("BUILDING").alias("base"), pick("FURNITURE").alias("other"))
    return m.select("dev", F.round("base", 2).alias("base"), F.round(C("other") - C("base"), 2).alias("change"))


@register("p4_pipeline_comparison", f"WITH b AS ({B5}), o AS (SELECT dev, sum(cost) AS old FROM b WHERE scenario <> 'BUILDING' GROUP BY dev), n AS (SELECT dev, sum(cost) * 0.9 AS new FROM b WHERE dev <> 'Brand#11' GROUP BY dev) SELECT dev, round(coalesce(old, 0), 2) AS old, round(coalesce(new, 0), 4) AS new FROM o FULL JOIN n USING (dev)")
def p4(s, d):
    b = discounted(s, d)
    o = b.where("scenario <> 'BUILDING'").groupBy("dev").agg(F.sum("cost").alias("old"))
    n = b.where("dev <> 'Brand#11'").groupBy("dev").agg((F.sum("cost") * 0.9).alias("new"))
    return o.join(n, "dev", "full").select("dev", F.round(F.coalesce("old", F.lit(0.0)), 2).alias("old"), F.round(F.coalesce("new", F.lit(0.0)), 4).alias("new"))


@register("p7_growth_map", f"WITH {D.PANEL} SELECT district, round(max(value) FILTER (WHERE year = 1999) / max(value) FILTER (WHERE year = 1996) - 1, 8) AS growth FROM panel GROUP BY district")
def p7(s, d):
    at = lambda y: F.max(F.when(C("year") == y, C("value")))
    return D.panel(s, d).groupBy("district").agg(F.round(F.try_divide(at(1999), at(1996)) - 1, 8).alias("growth"))


@register("p8_best_and_worst", f"WITH b AS ({B5}), m AS (SELECT dev, avg(benefit - cost) AS x FROM b GROUP BY dev) SELECT 'best' AS kind, dev FROM (SELECT dev FROM m ORDER BY x DESC, dev LIMIT 5) UNION ALL SELECT 'worst', dev FROM (SELECT dev FROM m ORDER BY x, dev LIMIT 5)")
def p8(s, d):
    m = discounted(s, d).groupBy("dev").agg(F.avg(C("benefit") - C("cost")).alias("x"))
    return m.orderBy(F.desc("x"), "dev").limit(5).select(F.lit("best").alias("kind"), "dev").unionByName(m.orderBy("x", "dev").limit(5).select(F.lit("worst").alias("kind"), "dev"))


@register("p9_station_categories", f"WITH {D.SERVICES}, b AS (SELECT from_node AS node, sum(frequency) AS f FROM services GROUP BY ALL) SELECT node, CASE WHEN f > 100 THEN 'red' WHEN f > 50 THEN 'orange' ELSE 'green' END AS colour FROM b")
def p9(s, d):
    b = D.services(s, d).groupBy(C("from_node").alias("node")).agg(F.sum("frequency").alias("f"))
    return b.select("node", F.when(C("f") > 100, "red").when(C("f") > 50, "orange").otherwise("green").alias("colour"))


@register("x3_round_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice / 7, 6) AS a, round(l_discount * l_tax, 6) AS b FROM lineitem")
def x3(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(C("l_extendedprice") / 7, 6).alias("a"), F.round(C("l_discount") * C("l_tax"), 6).alias("b"))


@register("x9_reverse_list", "SELECT o_orderkey, array_to_string(list_reverse(string_split(o_orderpriority, '-')), '-') AS reversed FROM orders")
def x9(s, d):
    return table(s, d, "orders").select("o_orderkey", F.array_join(X.reversed_list(F.split("o_orderpriority", "-")), "-").alias("reversed"))
