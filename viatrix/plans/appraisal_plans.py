"""Queries of demand, scenarios, capacity, costs, benefits and reports (O, N, V, K, B, E, P) and the flagship."""

from pyspark.sql import Window, functions as F

from viatrix.functions import exprs as X
from viatrix.operators import network as N, relational as R, scenarios as S, value as V
from viatrix.plans import domain as D
from viatrix.plans.registry import register
from viatrix.session import saved, table

C = F.col
#: brands that stand for developments in the flagship
PICK = ("Brand#11", "Brand#12", "Brand#13")


def flagship_networks(s, d):
    """Status quo and one network for each development."""
    e = D.edges(s).select("u", "v", C("tt").cast("double").alias("w"))
    dev = table(s, d, "part").select(C("p_brand").alias("graph_id")).distinct()
    n = dev.select("graph_id", (F.regexp_extract("graph_id", "[0-9]+", 0).cast("int") % 25).alias("u"))
    new = n.select("graph_id", "u", ((C("u") + 9) % 25).alias("v"), F.lit(2.0).alias("w"))
    both = new.union(new.select("graph_id", "v", "u", "w"))
    base = e.join(F.broadcast(dev.union(s.createDataFrame([("sq",)], "graph_id string"))))  # brands: a bounded list
    return base.unionByName(both)


RECURSE = D.EDGES + """,
brand AS (SELECT DISTINCT p_brand AS g, (regexp_extract(p_brand, '[0-9]+')::INT % 25)::INT AS i FROM part),
net AS (SELECT g, u, v, tt FROM (SELECT g FROM brand UNION ALL SELECT 'sq') CROSS JOIN edges UNION ALL SELECT g, i, ((i + 9) % 25)::INT, 2 FROM brand UNION ALL SELECT g, ((i + 9) % 25)::INT, i, 2 FROM brand),
walk AS (SELECT g, u AS src, v AS node, min(tt)::INT AS d, 1 AS hops FROM net GROUP BY ALL
  UNION SELECT w.g, w.src, e.v, min(w.d + e.tt)::INT, w.hops + 1 FROM walk w JOIN net e ON w.g = e.g AND w.node = e.u WHERE w.hops < 24 GROUP BY w.g, w.src, e.v, w.hops),
best AS (SELECT g, src, node, min(d)::DOUBLE AS d FROM walk WHERE src <> node GROUP BY ALL)"""
FLAGSHIP = f"""WITH RECURSIVE {D.TRIPS}, {RECURSE},
kept AS (SELECT o, d, trips FROM trips JOIN nation a ON o = a.n_nationkey JOIN nation b ON d = b.n_nationkey WHERE o <> d AND (a.n_regionkey = 0 OR b.n_regionkey = 0)),
ttt AS (SELECT g, sum(trips * best.d) / 60 AS hours FROM kept JOIN best ON o = src AND kept.d = node GROUP BY g),
cost AS (SELECT p_brand AS dev, sum(p_retailprice) * 33.25 AS construction FROM part GROUP BY ALL),
years AS (SELECT y::INT AS year FROM range(1995, 2002) r(y)),
p AS (SELECT c.dev, year, (q.hours - t.hours) * (1 + 0.02 * (year - 1995)) * 365 * 14.8 AS benefit,
        CASE WHEN year = 1995 THEN construction ELSE construction * 0.03 * 0.65 END AS cost
      FROM cost c JOIN ttt t ON t.g = c.dev JOIN ttt q ON q.g = 'sq' CROSS JOIN years)
SELECT dev, round(sum(benefit * pow(1.03, -(year - 1995 - 1))), 2) AS benefit, round(sum(cost * pow(1.03, -(year - 1995 - 1))), 2) AS cost,
       row_number() OVER (ORDER BY round(sum((benefit - cost) * pow(1.03, -(year - 1995 - 1))), 2) DESC, dev) AS rank
FROM p GROUP BY dev"""


def perimeter(s, d):
    t = R.role_join(D.trips(s, d), table(s, d, "nation"), "n_nationkey", "n_regionkey", {"o": "ro", "d": "rd"})
    return t.withColumn("trips", F.when((C("ro") == 0) | (C("rd") == 0), C("trips")).otherwise(0.0)).select("o", "d", "trips")


def total_times(s, d):
    """(graph_id, hours) of the perimeter's trips."""
    times = N.all_times(flagship_networks(s, d)).where("src <> node").select("graph_id", "src", "node", C("d").alias("t"))
    trips = perimeter(s, d).where("o <> d and trips > 0")
    return times.join(trips, (C("src") == C("o")) & (C("node") == C("d"))).groupBy("graph_id").agg((F.sum(C("trips") * C("t")) / 60).alias("hours"))


@register("flagship_developments", FLAGSHIP)
def flagship(s, d):
    hours = saved(total_times(s, d))  # a row a network
    today = hours.where("graph_id = 'sq'").select(C("hours").alias("today"))
    benefit = hours.where("graph_id <> 'sq'").join(F.broadcast(today))  # one row
    benefit = benefit.select(C("graph_id").alias("dev"), F.lit("base").alias("scenario"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"), V.savings(C("today"), C("hours"))[1].alias("b"))
    benefit = benefit.select("dev", "scenario", "year", (C("b") * (1 + 0.02 * (C("year") - 1995))).alias("benefit"))
    cost = table(s, d, "part").groupBy(C("p_brand").alias("dev")).agg((F.sum("p_retailprice") * (V.TRACK / 1000)).alias("construction"))
    cost = cost.withColumn("maintenance", C("construction") * V.MAINTENANCE * V.MAINTENANCE_SHARE)
    f = V.discount(C("year"), 0.03, 1995)
    p = V.panel(cost, benefit, 1995, 2001).withColumn("cost", C("const_cost") + C("maint_cost"))
    out = p.groupBy("dev").agg(F.round(F.sum(C("benefit") * f), 2).alias("benefit"), F.round(F.sum(C("cost") * f), 2).alias("cost"), F.round(F.sum((C("benefit") - C("cost")) * f), 2).alias("net"))
    return out.select("dev", "benefit", "cost", F.row_number().over(Window.orderBy(F.desc("net"), "dev")).cast("long").alias("rank"))


@register("o1_commune_to_station", f"WITH {D.TRIPS} SELECT a.n_name AS from_station, b.n_name AS to_station, trips FROM trips JOIN nation a ON o = a.n_nationkey JOIN nation b ON d = b.n_nationkey WHERE o <> d")
def o1(s, d):
    return R.role_join(D.trips(s, d).where("o <> d"), table(s, d, "nation"), "n_nationkey", "n_name", {"o": "from_station", "d": "to_station"}).select("from_station", "to_station", "trips")


@register("o2_perimeter", f"WITH {D.TRIPS} SELECT o, d, CASE WHEN a.n_regionkey = 0 OR b.n_regionkey = 0 THEN trips ELSE 0.0 END AS trips FROM trips JOIN nation a ON o = a.n_nationkey JOIN nation b ON d = b.n_nationkey")
def o2(s, d):
    return perimeter(s, d)


O3 = f"""WITH {D.TRIPS}, pop AS (SELECT c_nationkey AS c, (c_custkey % 3)::INT AS z, sum(greatest(c_acctbal, 0.0)) AS pop FROM customer GROUP BY ALL), emp AS (SELECT s_nationkey AS c, (s_suppkey % 2)::INT AS z, sum(greatest(s_acctbal, 0.0)) AS emp FROM supplier GROUP BY ALL),
tp AS (SELECT c, sum(pop) AS total FROM pop GROUP BY c), te AS (SELECT c, sum(emp) AS total FROM emp GROUP BY c)
SELECT pop.z AS from_zone, emp.z AS to_zone, round(sum(trips * pop.pop / tp.total * emp.emp / te.total), 3) AS trips FROM trips JOIN pop ON o = pop.c JOIN tp ON o = tp.c JOIN emp ON d = emp.c JOIN te ON d = te.c WHERE tp.total > 0 AND te.total > 0 GROUP BY ALL"""


@register("o3_disaggregation", O3)
def o3(s, d):
    def shares(t, key, zone, weight, name, end):
        x = table(s, d, t).groupBy(C(key).alias(end), zone.cast("int").alias(name)).agg(F.sum(F.greatest(C(weight), F.lit(0.0))).alias("w"))
        return x.withColumn(f"share_{name}", F.try_divide("w", F.sum("w").over(Window.partitionBy(end)))).drop("w")  # a few zones a commune

    a = shares("customer", "c_nationkey", C("c_custkey") % 3, "c_acctbal", "from_zone", "o")
    b = shares("supplier", "s_nationkey", C("s_suppkey") % 2, "s_acctbal", "to_zone", "d")
    return D.trips(s, d).join(a, "o").join(b, "d").groupBy("from_zone", "to_zone").agg(F.round(F.sum(C("trips") * C("share_from_zone") * C("share_to_zone")), 3).alias("trips"))


@register("o4_internal_zones", "SELECT o_custkey AS o, l_suppkey AS d, sum(l_quantity) AS wert FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey < 100 AND l_suppkey < 10 GROUP BY ALL")
def o4(s, d):
    x = table(s, d, "lineitem").where("l_suppkey < 10").select("l_orderkey", "l_suppkey", "l_quantity").join(table(s, d, "orders").where("o_custkey < 100").select("o_orderkey", "o_custkey"), C("l_orderkey") == C("o_orderkey"))
    return x.groupBy(C("o_custkey").alias("o"), C("l_suppkey").alias("d")).agg(F.sum("l_quantity").alias("wert"))


@register("o5_scale_category", "SELECT c_custkey, CASE WHEN c_acctbal > 7500 THEN 4 WHEN c_acctbal > 5000 THEN 3 WHEN c_acctbal > 2500 THEN 2 ELSE 1 END AS category FROM customer")
def o5(s, d):
    b = C("c_acctbal")
    return table(s, d, "customer").select("c_custkey", F.when(b > 7500, 4).when(b > 5000, 3).when(b > 2500, 2).otherwise(1).alias("category"))


@register("n1_district_growth", f"WITH {D.PANEL}, g AS (SELECT district, min(value) AS low, max(value) AS high FROM panel GROUP BY ALL) SELECT district, y::INT AS year, round(pow(high / low, 1.0 / 32) * pow(1.003, y - 2050), 8) AS rate FROM g CROSS JOIN range(2050, 2061) r(y)")
def n1(s, d):
    g = D.panel(s, d).groupBy("district").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    g = g.select("district", F.pow(F.try_divide("high", "low"), F.lit(1.0 / 32)).alias("g"), F.explode(F.sequence(F.lit(2050), F.lit(2060))).alias("year"))
    return g.select("district", "year", F.round(C("g") * F.pow(F.lit(1.003), C("year") - 2050), 8).alias("rate"))


LHS = f"""x AS (SELECT s AS scenario, y::INT AS year, {S.draw_sql('s', 'y', 42)} AS r, {S.draw_sql('s', 'y', 43)} AS j, {S.draw_sql('s', 'y', 44)} AS r2, {S.draw_sql('s', 'y', 45)} AS j2 FROM (SELECT s_suppkey AS s FROM supplier) CROSS JOIN range(2018, 2028) b(y)),
lhs AS (SELECT scenario, year, (row_number() OVER (PARTITION BY year ORDER BY r, scenario) - j) / count(*) OVER (PARTITION BY year) AS u, (row_number() OVER (PARTITION BY year ORDER BY r2, scenario) - j2) / count(*) OVER (PARTITION BY year) AS v FROM x)"""
YEARS = list(range(2018, 2028))


def draws(s, d):
    """As many scenarios as there are suppliers."""
    n = table(s, d, "supplier").select(C("s_suppkey").alias("scenario"))
    return S.latin_hypercube(n, YEARS, 42).join(S.latin_hypercube(n, YEARS, 44).withColumnRenamed("u", "v"), ["scenario", "year"])


@register("n2_latin_hypercube", f"WITH {LHS} SELECT scenario, year, round(u, 10) AS u, round(v, 10) AS v FROM lhs")
def n2(s, d):
    return draws(s, d).select("scenario", "year", F.round("u", 10).alias("u"), F.round("v", 10).alias("v"))


N2P = f"""WITH {LHS}, g AS (SELECT scenario, year, CASE WHEN year = 2018 THEN 0 ELSE 0.01 + ({S.standard_normal_sql('u')}) * (0.015 + 0.0003 * (year - 2018)) END AS g, CASE WHEN year = 2018 THEN 0 ELSE ({S.standard_normal_sql('v')}) * 0.02 END AS e FROM lhs)
SELECT scenario, year, round(1000 * (list_product(list(1 + g) OVER w) + sum(e) OVER w), 5) AS population FROM g WINDOW w AS (PARTITION BY scenario ORDER BY year ROWS UNBOUNDED PRECEDING)"""


@register("n2_population_scenarios", N2P)
def n2p(s, d):
    x = S.scenario_paths(draws(s, d), F.lit(1000.0), 0.01, 0.015 + 0.0003 * (C("year") - 2018), 0.02)
    return x.select("scenario", "year", F.round("value", 5).alias("population"))


N3 = f"""WITH {LHS}, g AS (SELECT scenario, year, CASE WHEN year = 2018 THEN 0 ELSE 0.0045 + ({S.standard_normal_sql('u')}) * (0.015 + 0.03 * (year - 2018) / 82) END AS g, CASE WHEN year = 2018 THEN 0 ELSE ({S.standard_normal_sql('v')}) * 0.02 END AS e FROM lhs)
SELECT scenario, year, round(0.209 * (list_product(list(1 + g) OVER w) + sum(e) OVER w), 8) AS modal_split FROM g WINDOW w AS (PARTITION BY scenario ORDER BY year ROWS UNBOUNDED PRECEDING)"""


@register("n3_modal_split", N3)
def n3(s, d):
    x = S.scenario_paths(draws(s, d), F.lit(0.209), 0.0045, 0.015 + 0.03 * (C("year") - 2018) / 82, 0.02)
    return x.select("scenario", "year", F.round("value", 8).alias("modal_split"))


N4 = f"""WITH {D.TRIPS}, f AS (SELECT r_regionkey, 1 + 0.05 * r_regionkey AS f FROM region WHERE r_regionkey < 4),
g AS (SELECT c_nationkey AS st, sum(greatest(c_acctbal, 0) * coalesce(f, 1)) / nullif(sum(greatest(c_acctbal, 0)), 0) AS g FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN f ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT o, d, round(trips * sqrt(coalesce(a.g, 1) * coalesce(b.g, 1)), 4) AS trips FROM trips LEFT JOIN g a ON o = a.st LEFT JOIN g b ON d = b.st"""


@register("n4_od_growth", N4)
def n4(s, d):
    n = table(s, d, "nation").select(C("n_nationkey").alias("c_nationkey"), F.when(C("n_regionkey") < 4, 1 + 0.05 * C("n_regionkey")).otherwise(1.0).alias("f"))
    w = F.greatest("c_acctbal", F.lit(0.0))
    g = table(s, d, "customer").join(n, "c_nationkey").groupBy(C("c_nationkey").alias("st")).agg(F.try_divide(F.sum(w * C("f")), F.sum(w)).alias("g"))
    x = R.role_join(D.trips(s, d), g, "st", "g", {"o": "a", "d": "b"})
    return x.select("o", "d", F.round(C("trips") * F.sqrt(F.coalesce("a", F.lit(1.0)) * F.coalesce("b", F.lit(1.0))), 4).alias("trips"))


@register("n5_allocation", "WITH z AS (SELECT s_nationkey AS zone, sum(abs(s_acctbal)) AS pop FROM supplier GROUP BY ALL) SELECT zone, round(40000 * pow(pop, 1.06) / sum(pow(pop, 1.06)) OVER (), 4) AS allocated FROM z")
def n5(s, d):
    z = table(s, d, "supplier").groupBy(C("s_nationkey").alias("zone")).agg(F.sum(F.abs("s_acctbal")).alias("pop"))
    return S.allocate(z, "pop", 40000.0, 1.06).select("zone", F.round("allocated", 4).alias("allocated"))


@register("n7_low_medium_high", f"WITH {D.PANEL}, g AS (SELECT district, max(value) / min(value) AS s1 FROM panel GROUP BY ALL) SELECT district, round(s1, 8) AS s1, round(s1 - (s1 - 1) / 3, 8) AS s2, round(s1 + (s1 - 1) / 3, 8) AS s3 FROM g")
def n7(s, d):
    g = D.panel(s, d).groupBy("district").agg(F.try_divide(F.max("value"), F.min("value")).alias("s1"))
    return g.select("district", F.round("s1", 8).alias("s1"), F.round(C("s1") - (C("s1") - 1) / 3, 8).alias("s2"), F.round(C("s1") + (C("s1") - 1) / 3, 8).alias("s3"))


@register("n8_growth_on_cells", f'WITH {D.CELLS} SELECT "row", col, round(value * (1 + ("row" // 20) * 0.1) * CASE WHEN col < 50 THEN 1.05 ELSE 1 END, 6) AS value FROM cells')
def n8(s, d):
    f = s.range(5).select(C("id").cast("int").alias("zone"), (1 + C("id") * 0.1).alias("f"))
    x = D.cells(s, d).withColumn("zone", F.floor(C("row") / 20).cast("int")).join(F.broadcast(f), "zone")
    return x.select("row", "col", F.round(C("value") * C("f") * F.when(C("col") < 50, 1.05).otherwise(1.0), 6).alias("value"))


@register("n9_dummy_scenarios", f"SELECT s AS scenario, round({' * '.join(f'(1 + 0.1 * ({S.draw_sql(chr(115), str(k), 7)}))' for k in range(4))}, 8) AS factor FROM (SELECT s_suppkey AS s FROM supplier)")
def n9(s, d):
    f = F.lit(1.0)
    for k in range(4):
        f = f * (1 + 0.1 * S.draw(C("s_suppkey"), F.lit(k), 7))
    return table(s, d, "supplier").select(C("s_suppkey").alias("scenario"), F.round(f, 8).alias("factor"))


@register("v1_total_travel_times", FLAGSHIP[: FLAGSHIP.index("cost AS (SELECT p_brand")].rstrip().rstrip(",") + " SELECT g AS graph_id, round(hours, 4) AS hours FROM ttt")
def v1(s, d):
    return total_times(s, d).select("graph_id", F.round("hours", 4).alias("hours"))


@register("v2_savings", FLAGSHIP[: FLAGSHIP.index("cost AS (SELECT p_brand")].rstrip().rstrip(",") + " SELECT t.g AS dev, round(q.hours - t.hours, 4) AS daily, round((q.hours - t.hours) * 365 * 14.8, 2) AS yearly FROM ttt t JOIN ttt q ON q.g = 'sq' WHERE t.g <> 'sq'")
def v2(s, d):
    h = saved(total_times(s, d))
    today = h.where("graph_id = 'sq'").select(C("hours").alias("today"))
    daily, yearly = V.savings(C("today"), C("hours"))
    return h.where("graph_id <> 'sq'").join(F.broadcast(today)).select(C("graph_id").alias("dev"), F.round(daily, 4).alias("daily"), F.round(yearly, 2).alias("yearly"))


@register("v3_improvements", f"WITH RECURSIVE {RECURSE} SELECT * FROM (SELECT a.g AS dev, a.src, a.node, q.d - a.d AS gain, row_number() OVER (PARTITION BY a.g ORDER BY q.d - a.d DESC, a.src, a.node) AS rank FROM best a JOIN best q ON q.g = 'sq' AND a.src = q.src AND a.node = q.node WHERE a.g <> 'sq') WHERE rank <= 20")
def v3(s, d):
    t = N.all_times(flagship_networks(s, d)).where("src <> node").select("graph_id", "src", "node", "d")
    q = t.where("graph_id = 'sq'").select("src", "node", C("d").alias("today"))
    x = t.where("graph_id <> 'sq'").join(q, ["src", "node"]).select(C("graph_id").alias("dev"), "src", "node", (C("today") - C("d")).alias("gain"))
    return R.top_n(x, ["dev"], 20, C("gain").desc(), C("src"), C("node")).withColumn("rank", C("rank").cast("long"))


@register("v4_road_savings", f"WITH {D.DEVS} SELECT dev, round((cost - length / 10.0) * 14.8 * 2.5 * 250 * 30, 2) AS saving FROM devs")
def v4(s, d):
    return D.developments(s, d).select("dev", F.round(V.road_savings(C("cost"), C("length") / 10.0, 30), 2).alias("saving"))


@register("v5_accessibility", f'WITH {D.CELLS} SELECT ("row" // 25)::INT AS zone, round(sum(value * 1.14 * 365 * 50 * ("row" * 3 + col) * 14.8 / 3600), 2) AS cost FROM cells GROUP BY ALL')
def v5(s, d):
    return D.cells(s, d).groupBy(F.floor(C("row") / 25).cast("int").alias("zone")).agg(F.round(F.sum(C("value") * 1.14 * 365 * 50 * (C("row") * 3 + C("col")) * 14.8 / 3600), 2).alias("cost"))


@register("v6_link_cost", f"WITH {D.SERVICES}, e AS (SELECT from_node, to_node, tt, sum(frequency)::DOUBLE AS flow FROM services GROUP BY ALL) SELECT from_node, to_node, round(tt * (1 + 0.25 * pow(flow / 100, 2.4)), 6) AS time, round(tt * (flow + 0.25 * 100 * pow(flow / 100, 3.4) / 3.4), 4) AS integral FROM e")
def v6(s, d):
    e = D.services(s, d).groupBy("from_node", "to_node", "tt").agg(F.sum("frequency").cast("double").alias("flow"))
    return e.select("from_node", "to_node", F.round(V.bpr(C("tt"), C("flow"), F.lit(100.0)), 6).alias("time"), F.round(V.bpr_integral(C("tt"), C("flow"), F.lit(100.0)), 4).alias("integral"))


V7 = f"WITH {D.NET}, r AS (SELECT u AS route, v AS link, tt FROM edges UNION ALL SELECT s_suppkey, s_suppkey, 2 FROM supplier), t AS (SELECT route, sum(tt)::DOUBLE AS total FROM r GROUP BY route), c AS (SELECT a.route AS a, b.route AS b, sum(a.tt)::DOUBLE AS common FROM r a JOIN r b ON a.link = b.link GROUP BY ALL) SELECT c.a AS route, round(ln(sum(common / sqrt(x.total * y.total))), 6) AS commonality FROM c JOIN t x ON c.a = x.route JOIN t y ON c.b = y.route GROUP BY c.a"


@register("v7_commonality", V7)
def v7(s, d):
    r = D.net(s, d).select(C("u").alias("route"), C("v").alias("link"), "tt").union(table(s, d, "supplier").select("s_suppkey", "s_suppkey", F.lit(2)))
    total = r.groupBy("route").agg(F.sum("tt").cast("double").alias("total"))
    common = r.join(r.select(C("route").alias("other"), "link"), "link").groupBy("route", "other").agg(F.sum("tt").alias("common"))
    x = common.join(total, "route").join(total.select(C("route").alias("other"), C("total").alias("theirs")), "other")
    return x.groupBy("route").agg(F.round(F.log(F.sum(C("common") / F.sqrt(C("total") * C("theirs")))), 6).alias("commonality"))


@register("k2_station_metrics", f"WITH {D.SERVICES} SELECT from_node AS node, sum(frequency)::BIGINT AS tph, sum(frequency) / 2.0 AS tphpd, string_agg(DISTINCT service, ', ' ORDER BY service) AS services FROM services GROUP BY from_node")
def k2(s, d):
    return D.services(s, d).groupBy(C("from_node").alias("node")).agg(F.sum("frequency").alias("tph"), (F.sum("frequency") / 2.0).alias("tphpd"), F.array_join(F.array_sort(F.collect_set("service")), ", ").alias("services"))


@register("k3_segment_metrics", f"WITH {D.SERVICES} SELECT least(from_node, to_node) AS u, greatest(from_node, to_node) AS v, coalesce(sum(frequency) FILTER (WHERE service <> 'NO'), 0)::BIGINT AS stopping, coalesce(sum(frequency) FILTER (WHERE service = 'NO'), 0)::BIGINT AS passing, max(tt)::INT AS time FROM services GROUP BY 1, 2")
def k3(s, d):
    x = R.undirected(D.services(s, d).withColumnsRenamed({"from_node": "u", "to_node": "v"}))
    stop = C("service") != "NO"
    return x.groupBy("u", "v").agg(F.sum(F.when(stop, C("frequency")).otherwise(0)).alias("stopping"), F.sum(F.when(~stop, C("frequency")).otherwise(0)).alias("passing"), F.max("tt").alias("time"))


SECTIONS = "sections AS (SELECT s_suppkey AS id, [1.0, 1.5, 2.0, 3.0, 4.0][1 + s_suppkey % 5] AS tracks, (5 + s_suppkey % 20)::DOUBLE AS stop, (3 + s_suppkey % 9)::DOUBLE AS pass, s_suppkey % 6 AS n_stop, s_suppkey % 4 AS n_pass FROM supplier)"
K6 = f"""WITH {SECTIONS}, t AS (SELECT *, CASE WHEN tracks - floor(tracks) >= 0.5 THEN stop / 2 ELSE stop END AS s, CASE WHEN tracks - floor(tracks) >= 0.5 THEN pass / 2 ELSE pass END AS p FROM sections)
SELECT id, (CASE WHEN floor(tracks) <= 1 THEN floor(60 / s) / 2
  WHEN floor(tracks) = 2 THEN CASE WHEN n_stop = 0 OR n_pass = 0 THEN 20 ELSE floor(60 / (3 + least(1, n_stop + n_pass - 1) / (n_stop + n_pass) * greatest(0, s - p - 3))) END
  WHEN floor(tracks) = 3 THEN CASE WHEN n_stop = 0 OR n_pass = 0 THEN 30 ELSE floor(60 / (3 + 1 / (n_stop + n_pass) * greatest(0, s - p - 3)) + 60 / p / 2) END ELSE 40 END)::DOUBLE AS capacity FROM t"""


def sections(s, d):
    k = C("s_suppkey")
    return table(s, d, "supplier").select(k.alias("id"), F.get(F.array(*map(F.lit, (1.0, 1.5, 2.0, 3.0, 4.0))), (k % 5).cast("int")).alias("tracks"), (5 + k % 20).cast("double").alias("stop"), (3 + k % 9).cast("double").alias("pass"), (k % 6).alias("n_stop"), (k % 4).alias("n_pass"))


@register("k6_k7_section_capacity", K6)
def k6(s, d):
    return sections(s, d).select("id", X.capacity(C("tracks"), C("stop"), C("pass"), C("n_stop"), C("n_pass")).cast("double").alias("capacity"))


@register("k6_grouping_strategies", f"WITH {SECTIONS} SELECT id, floor(60 / (3 + least(least(n_stop, n_pass), n_stop + n_pass - 1) / (n_stop + n_pass) * greatest(0, stop - pass - 3)))::DOUBLE AS bad, floor(60 / (3 + least(least(n_stop, n_pass) - 1, n_stop + n_pass - 1) / (n_stop + n_pass) * greatest(0, stop - pass - 3)))::DOUBLE AS base FROM sections WHERE n_stop > 0 AND n_pass > 0")
def k6b(s, d):
    x = sections(s, d).where("n_stop > 0 and n_pass > 0")
    return x.select("id", *[X.double_mixed(C("stop"), C("pass"), C("n_stop"), C("n_pass"), k).cast("double").alias(k) for k in ("bad", "base")])


@register("k8_constrained", "WITH s AS (SELECT s_suppkey AS id, floor(60 / (5 + s_suppkey % 20)) / 2 AS capacity, (s_suppkey % 6)::DOUBLE AS tphpd FROM supplier) SELECT id, capacity::DOUBLE AS capacity, tphpd FROM s WHERE capacity - tphpd < 2")
def k8(s, d):
    x = sections(s, d).select("id", X.single_track(C("stop")).cast("double").alias("capacity"), C("n_stop").cast("double").alias("tphpd"))
    return x.where(C("capacity") - C("tphpd") < 2.0)


K9 = """WITH s AS (SELECT s_suppkey AS id, s_suppkey % 3 + 1 AS segments, [1.0, 1.5, 2.0, 2.5][1 + s_suppkey % 4] AS tracks, (400 + s_suppkey * 37 % 2000)::DOUBLE AS len, s_suppkey % 5 AS platforms FROM supplier),
k AS (SELECT *, segments > 1 AS station, tracks - floor(tracks) = 0.5 AS half FROM s),
c AS (SELECT *, CASE WHEN station OR (half AND len < 1000) THEN 1.0 ELSE 0.5 END AS added FROM k),
m AS (SELECT *, CASE WHEN station THEN floor(tracks) * 18300000 WHEN half AND added = 0.5 THEN len * 33250 - floor(tracks) * 33250000 WHEN added = 1.0 THEN len * 33250 ELSE floor(tracks) * 33250000 END AS cost FROM c)
SELECT id, CASE WHEN station THEN 'station_track' ELSE 'segment_passing_siding' END AS type, added::DOUBLE AS added, CASE WHEN station AND platforms < 2 THEN 1 ELSE 0 END AS platforms_added, round(cost, 2)::DOUBLE AS cost, round(cost * 0.03, 2)::DOUBLE AS maintenance FROM m"""


@register("k9_k10_interventions", K9)
def k9(s, d):
    k = C("s_suppkey")
    x = table(s, d, "supplier").select(k.alias("id"), (k % 3 + 1).alias("segments"), F.get(F.array(*map(F.lit, (1.0, 1.5, 2.0, 2.5))), (k % 4).cast("int")).alias("tracks"), (400 + k * 37 % 2000).cast("double").alias("len"), (k % 5).alias("platforms"))
    kind, added, platforms = V.intervention(C("segments"), C("tracks"), C("len"), C("platforms"))
    x = x.select("id", "tracks", "len", kind.alias("type"), added.alias("added"), platforms.alias("platforms_added"))
    cost = V.intervention_cost(C("type"), C("tracks"), C("added"), C("len"), C("platforms_added"))
    return x.select("id", "type", "added", "platforms_added", F.round(cost, 2).alias("cost"), F.round(cost * V.MAINTENANCE, 2).alias("maintenance"))


@register("k12_costs_by_overlap", "WITH seg AS (SELECT DISTINCT p_brand AS dev, p_size AS segment FROM part), i AS (SELECT DISTINCT s_suppkey AS id, s_suppkey % 12 AS segment, 1000.0 * s_suppkey AS cost FROM supplier) SELECT dev, sum(cost) AS cost FROM (SELECT DISTINCT dev, id, cost FROM seg JOIN i USING (segment)) GROUP BY dev")
def k12(s, d):
    seg = table(s, d, "part").select(C("p_brand").alias("dev"), C("p_size").cast("long").alias("segment")).distinct()
    i = table(s, d, "supplier").select(C("s_suppkey").alias("id"), (C("s_suppkey") % 12).alias("segment"), (1000.0 * C("s_suppkey")).alias("cost"))
    return seg.join(i, "segment").select("dev", "id", "cost").distinct().groupBy("dev").agg(F.sum("cost").alias("cost"))


@register("b1_construction_cost", f"WITH {D.DEVS}, c AS (SELECT dev, length, length * 33250.0 + n * 10 * 104000.0 + n * 5 * 70000.0 AS c FROM devs) SELECT dev, round(c, 2) AS construction, round(c * 0.03 * 50 * 0.65, 2) AS maintenance, round(length / 2 * 879 * (1 - 0.623) * 1.1, 4) AS operating FROM c")
def b1(s, d):
    """New lines, by metres of free track, tunnel and bridge."""
    x = D.developments(s, d).withColumn("c", V.line_construction(C("length"), C("n") * 10, C("n") * 5))
    return x.select("dev", F.round("c", 2).alias("construction"), F.round(V.line_maintenance(C("c")), 2).alias("maintenance"), F.round(V.uncovered_operation(C("length"), True), 4).alias("operating"))


B1A = f"""WITH {D.SERVICES}, l AS (SELECT from_node AS u, to_node AS v, sum(frequency) AS f FROM services GROUP BY ALL),
k AS (SELECT u, v, f, CASE (u + v) % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 2 END AS per, (u * 100 + v) * 33250.0 + (u % 5) * 10 * 104000.0 + (v % 3) * 70000.0 AS c FROM l),
h AS (SELECT i AS dev, (i + j) % 25 AS u, (i + j + 1) % 25 AS v FROM range(0, 25, 2) a(i) CROSS JOIN range(3) b(j)),
t AS (SELECT dev, coalesce(sum(c), 0.0) AS c FROM h LEFT JOIN (SELECT * FROM k WHERE f / per >= 12) USING (u, v) GROUP BY dev)
SELECT dev, round(c, 2) AS construction, round(c * 0.03 * 50 * 0.65, 2) AS maintenance FROM t"""


@register("b1_extension_cost", B1A)
def b1a(s, d):
    """Extended lines pay for links that are too full."""
    u, v = C("from_node"), C("to_node")
    l = D.services(s, d).groupBy("from_node", "to_node").agg(F.sum("frequency").alias("frequency"))  # noqa: E741
    tracks = F.get(F.array(*map(F.lit, (None, "12", "2", "23"))), (u + v) % 4)
    l = l.select(u.alias("u"), v.alias("v"), "frequency", tracks.alias("tracks"), (u * 100 + v).cast("double").alias("track_m"), (u % 5 * 10).cast("double").alias("tunnel_m"), (v % 3).cast("double").alias("bridge_m"))  # noqa: E741
    hops = s.range(0, 25, 2).select(C("id").alias("dev"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).select("dev", ((C("dev") + C("j")) % 25).cast("int").alias("u"), ((C("dev") + C("j") + 1) % 25).cast("int").alias("v"))
    return V.extension_costs(l, hops).select("dev", F.round("construction", 2).alias("construction"), F.round("maintenance", 2).alias("maintenance"))


B3 = f"WITH {D.DEVS} SELECT dev, c_mktsegment AS scenario, y::INT AS year, CASE WHEN y = 2050 THEN round(cost, 2) ELSE 0.0 END AS const_cost, CASE WHEN y > 2050 THEN round(round(cost, 2) * 0.03, 4) ELSE 0.0 END AS maint_cost, round(length * (y - 2049) / 7.0, 4) AS benefit FROM devs CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN range(2050, 2101) r(y)"


def cba(s, d):
    x = D.developments(s, d)
    scenarios = table(s, d, "customer").select(C("c_mktsegment").alias("scenario")).distinct()
    b = x.join(F.broadcast(scenarios)).select("dev", "scenario", "length", F.explode(F.sequence(F.lit(2050), F.lit(2100))).alias("year"))  # a few scenarios
    b = b.select("dev", "scenario", "year", F.round(C("length") * (C("year") - 2049) / 7.0, 4).alias("benefit"))
    return V.panel(x.select("dev", F.round("cost", 2).alias("construction"), F.round(F.round("cost", 2) * 0.03, 4).alias("maintenance")), b, 2050, 2100)


@register("b3_cba_panel", B3)
def b3(s, d):
    return cba(s, d)


B5 = f"WITH p AS ({B3}) SELECT dev, scenario, round(sum((const_cost + maint_cost) * pow(1.03, -(year - 2051))), 2) AS cost, round(sum(benefit * pow(1.03, -(year - 2051))), 2) AS benefit FROM p GROUP BY ALL"


def discounted(s, d):
    f = V.discount(C("year"), 0.03, 2050)
    return cba(s, d).groupBy("dev", "scenario").agg(F.round(F.sum((C("const_cost") + C("maint_cost")) * f), 2).alias("cost"), F.round(F.sum(C("benefit") * f), 2).alias("benefit"))


@register("b4_b5_discounted_totals", B5)
def b5(s, d):
    return discounted(s, d)


@register("b6_low_medium_high_costs", f"WITH {D.DEVS} SELECT dev, round(-cost * 0.9, 2) AS low, round(-cost, 2) AS medium, round(-cost * 1.1, 2) AS high FROM devs")
def b6(s, d):
    return D.developments(s, d).select("dev", F.round(-C("cost") * 0.9, 2).alias("low"), F.round(-C("cost"), 2).alias("medium"), F.round(-C("cost") * 1.1, 2).alias("high"))


@register("p1_net_benefit", f"WITH b AS ({B5}) SELECT dev, scenario, round(benefit - cost, 2) AS net_benefit, round(benefit / nullif(cost, 0), 6) AS cba_ratio, benefit > cost AS viable FROM b")
def p1(s, d):
    return discounted(s, d).select("dev", "scenario", F.round(C("benefit") - C("cost"), 2).alias("net_benefit"), F.round(F.try_divide("benefit", "cost"), 6).alias("cba_ratio"), (C("benefit") > C("cost")).alias("viable"))


@register("p3_report_statistics", f"WITH b AS ({B5}), m AS (SELECT dev, avg(benefit / cost) AS r FROM b GROUP BY dev) SELECT round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(min(r), 6) AS low, round(max(r), 6) AS high, count(*) AS n FROM m")
def p3(s, d):
    m = discounted(s, d).groupBy("dev").agg(F.avg(F.try_divide("benefit", "cost")).alias("r"))
    return m.agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.median("r"), 6).alias("median"), F.round(F.min("r"), 6).alias("low"), F.round(F.max("r"), 6).alias("high"), F.count(F.lit(1)).alias("n"))


@register("p5_viable_counts", f"WITH b AS ({B5}) SELECT dev, count(*) FILTER (WHERE benefit > cost) AS viable FROM b GROUP BY dev HAVING viable > 0")
def p5(s, d):
    return discounted(s, d).groupBy("dev").agg(F.sum((C("benefit") > C("cost")).cast("long")).alias("viable")).where("viable > 0")


@register("p10_scenario_viewer", f"WITH b AS ({B5}) SELECT dev, round(benefit - cost, 2) AS net_benefit FROM b WHERE scenario = 'BUILDING'")
def p10(s, d):
    return discounted(s, d).where("scenario = 'BUILDING'").select("dev", F.round(C("benefit") - C("cost"), 2).alias("net_benefit")).orderBy(F.desc("net_benefit"), "dev")
