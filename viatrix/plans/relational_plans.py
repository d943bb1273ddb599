"""Queries of projections, joins, aggregates, windows, order and reshaping (F, J, A, W, T, U)."""

from pyspark.sql import Window, functions as F

from viatrix.functions import exprs as X
from viatrix.operators import relational as R
from viatrix.plans import domain as D
from viatrix.plans.registry import register
from viatrix.session import table

C = F.col


@register("f1_conjunctive_filter", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1998 AND o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def f1(s, d):
    # a range of the column itself reaches the scan; a function of it would not
    o = table(s, d, "orders").where((C("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")) & (C("o_orderdate") < F.lit("1999-01-01").cast("timestamp")))
    return o.where("o_orderstatus = 'F'").where(C("o_orderpriority").startswith("1")).select("o_orderkey", "o_custkey", "o_totalprice")


@register("f2_zero_inside", f"WITH {D.TRIPS} SELECT o, d, CASE WHEN o = d THEN 0.0 ELSE trips END AS trips FROM trips")
def f2(s, d):
    return D.trips(s, d).withColumn("trips", F.when(C("o") == C("d"), 0.0).otherwise(C("trips")))


@register("f3_peak_share", f"WITH {D.TRIPS} SELECT o, d, round(trips * 0.13, 4) AS peak, round(trips * 0.1, 4) AS road_peak FROM trips")
def f3(s, d):
    return D.trips(s, d).select("o", "d", F.round(C("trips") * 0.13, 4).alias("peak"), F.round(C("trips") * 0.1, 4).alias("road_peak"))


@register("f4_membership", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (0, 2, 3)")
def f4(s, d):
    return table(s, d, "nation").where(C("n_regionkey").isin(0, 2, 3)).select("n_nationkey", "n_name")


@register("f5_anti_membership", "SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority LIKE '1%')")
def f5(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where(C("o_orderpriority").startswith("1")).select("o_custkey"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@register("f6_coordinate_box", f'WITH {D.CELLS} SELECT "row", col, round(value, 2) AS value FROM cells WHERE "row" BETWEEN 20 AND 50 AND col BETWEEN 10 AND 60')
def f6(s, d):
    return D.cells(s, d).where(C("row").between(20, 50) & C("col").between(10, 60)).withColumn("value", F.round("value", 2))


@register("f7_attribute_filter", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 20 AND p_brand <> 'Brand#11' AND p_type IS NOT NULL")
def f7(s, d):
    return table(s, d, "part").where("p_size < 20 and p_brand <> 'Brand#11' and p_type is not null").select("p_partkey", "p_name", "p_size")


@register("f8_boolean_decode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' TRUE ' WHEN 'O' THEN 'no' ELSE 'wahr' END IN (' TRUE ', 'wahr') AS flag FROM orders")
def f8(s, d):
    raw = F.when(C("o_orderstatus") == "F", " TRUE ").when(C("o_orderstatus") == "O", "no").otherwise("wahr")
    return table(s, d, "orders").select("o_orderkey", X.truthy(raw).alias("flag"))


@register("f9_endpoints", f"WITH {D.NET} SELECT u, v, u % 5 AS x_origin, u // 5 AS y_origin, v % 5 AS x_destination, v // 5 AS y_destination FROM edges")
def f9(s, d):
    point = lambda n: F.struct((n % 5).alias("x"), F.floor(n / 5).cast("int").alias("y"))
    e = D.net(s, d).withColumn("line", F.array(point(C("u")), point(C("v"))))
    a, b = F.element_at("line", 1), F.element_at("line", -1)
    return e.select("u", "v", a["x"].alias("x_origin"), a["y"].alias("y_origin"), b["x"].alias("x_destination"), b["y"].alias("y_destination"))


@register("f10_coalesce_backfill", "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, p_partkey % 7)::BIGINT AS tracks FROM part")
def f10(s, d):
    return table(s, d, "part").select("p_partkey", F.coalesce(F.when(C("p_size") % 3 == 0, C("p_size")), C("p_partkey") % 7).cast("long").alias("tracks"))


@register("f11_fill_typed", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 30 END AS speed, CASE WHEN p_size % 5 > 0 THEN p_type ELSE '-99' END AS via FROM part")
def f11(s, d):
    return table(s, d, "part").select("p_partkey", F.when(C("p_size") % 2 == 0, C("p_size")).alias("speed"), F.when(C("p_size") % 5 > 0, C("p_type")).alias("via")).na.fill({"speed": 30, "via": "-99"})


@register("f12_drop_incomplete", "SELECT p_partkey, p_size FROM part WHERE p_size % 3 <> 0 AND p_size % 4 <> 0")
def f12(s, d):
    p = table(s, d, "part").select("p_partkey", "p_size", F.when(C("p_size") % 3 != 0, 1).alias("a"), F.when(C("p_size") % 4 != 0, 1).alias("b"))
    return p.na.drop(subset=["a", "b"]).select("p_partkey", "p_size")


@register("f15_station_lookup", "SELECT n_name AS station, n_nationkey AS station_id FROM nation WHERE n_regionkey = 1")
def f15(s, d):
    wanted = table(s, d, "nation").where("n_regionkey = 1").select(C("n_name").alias("station"))
    found = wanted.join(F.broadcast(table(s, d, "nation")), C("station") == C("n_name"), "left")
    return found.select("station", F.coalesce("n_nationkey", F.raise_error(F.concat(F.lit("no station "), "station"))).alias("station_id"))


@register("f16_surrogate_ids", f"WITH {D.DEVS} SELECT dev, 100000 + row_number() OVER (ORDER BY dev) - 1 AS dev_id, 101000 + row_number() OVER (ORDER BY cost DESC, dev) - 1 AS line_id FROM devs")
def f16(s, d):
    return R.surrogate(R.surrogate(D.developments(s, d), "dev_id", 100000, C("dev")), "line_id", 101000, C("cost").desc(), C("dev")).select("dev", C("dev_id").cast("long").alias("dev_id"), C("line_id").cast("long").alias("line_id"))


@register("j1_role_playing_dimension", f"WITH {D.TRIPS} SELECT o, d, a.n_name AS from_station, b.n_name AS to_station, trips FROM trips LEFT JOIN nation a ON o = a.n_nationkey LEFT JOIN nation b ON d = b.n_nationkey")
def j1(s, d):
    return R.role_join(D.trips(s, d), table(s, d, "nation"), "n_nationkey", "n_name", {"o": "from_station", "d": "to_station"}).select("o", "d", "from_station", "to_station", "trips")


J2 = f"WITH {D.SERVICES}, c AS (SELECT from_node, to_node, avg(frequency) AS tracks, sum(tt)::BIGINT AS length FROM services GROUP BY ALL) SELECT u, v, tt, round(tracks, 6) AS tracks, length FROM edges LEFT JOIN c ON u = from_node AND v = to_node"


@register("j2_aggregated_build_side", J2)
def j2(s, d):
    c = D.services(s, d).groupBy(C("from_node").alias("u"), C("to_node").alias("v")).agg(F.round(F.avg("frequency"), 6).alias("tracks"), F.sum("tt").alias("length"))
    return D.edges(s).join(c, ["u", "v"], "left")


@register("j3_inner_chain", """SELECT l_orderkey, l_partkey, l_suppkey, c_custkey, n_name, r_name, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""")
def j3(s, d):
    t = lambda n: table(s, d, n)
    x = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), C("l_orderkey") == C("o_orderkey"))
    x = x.join(t("customer").select("c_custkey", "c_nationkey"), C("o_custkey") == C("c_custkey")).join(t("nation"), C("c_nationkey") == C("n_nationkey")).join(t("region"), C("n_regionkey") == C("r_regionkey"))
    return x.join(t("part").select("p_partkey", "p_brand"), C("l_partkey") == C("p_partkey")).select("l_orderkey", "l_partkey", "l_suppkey", "c_custkey", "n_name", "r_name", "p_brand")


@register("j5_right_join", "SELECT n_name, coalesce(s.n_suppliers, 0) AS n_suppliers FROM (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
def j5(s, d):
    x = table(s, d, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_suppliers"))
    return x.join(table(s, d, "nation"), C("s_nationkey") == C("n_nationkey"), "right").select("n_name", F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


J6 = """WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_suppkey AS k, sum(l_quantity) AS y FROM lineitem WHERE l_quantity > 48 GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS k, coalesce(y, 0) - coalesce(x, 0) AS difference FROM a FULL JOIN b ON a.k = b.k"""


@register("j6_flow_difference", J6)
def j6(s, d):
    l = table(s, d, "lineitem")
    a = l.where("l_returnflag = 'R'").groupBy(C("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("x"))
    b = l.where("l_quantity > 48").groupBy(C("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("y"))
    return a.join(b, "k", "full").select("k", (F.coalesce("y", F.lit(0.0)) - F.coalesce("x", F.lit(0.0))).alias("difference"))


@register("j7_lookup_default", f"WITH {D.TRIPS} SELECT o, d, round(trips * coalesce(f, 1.0), 4) AS scaled FROM trips LEFT JOIN (SELECT n_nationkey, 1.0 + n_regionkey / 10.0 AS f FROM nation WHERE n_regionkey < 3) ON o = n_nationkey")
def j7(s, d):
    f = table(s, d, "nation").where("n_regionkey < 3").select(C("n_nationkey").alias("o"), (1.0 + C("n_regionkey") / 10.0).alias("f"))
    return D.trips(s, d).join(f, "o", "left").select("o", "d", F.round(C("trips") * F.coalesce("f", F.lit(1.0)), 4).alias("scaled"))


@register("j8_unordered_pair", f"WITH {D.TRIPS}, {D.EDGES}, p AS (SELECT least(o, d) AS a, greatest(o, d) AS b, sum(trips) AS total FROM trips GROUP BY ALL) SELECT u, v, coalesce(total, 0.0) AS both_ways FROM edges LEFT JOIN p ON least(u, v) = a AND greatest(u, v) = b WHERE u < v")
def j8(s, d):
    p = R.undirected(D.trips(s, d).withColumnsRenamed({"o": "u", "d": "v"})).groupBy("u", "v").agg(F.sum("trips").alias("both_ways"))
    return D.edges(s).where("u < v").select("u", "v").join(p, ["u", "v"], "left").na.fill({"both_ways": 0.0})


J9 = f"WITH {D.NET}, q AS (SELECT (s_suppkey * 3 % n)::INT AS a, ((s_suppkey * 3 % n + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END + n) % n)::INT AS b FROM supplier, size), single AS (SELECT u, v, tt FROM edges WHERE u < v) SELECT a, b, (SELECT min(tt) FROM single WHERE (u = a AND v = b) OR (u = b AND v = a)) AS tt FROM q"


@register("j9_either_direction", J9)
def j9(s, d):
    i, n = C("s_suppkey"), C("n")
    x = table(s, d, "supplier").select("s_suppkey")
    x = x.join(F.broadcast(x.agg(F.count(F.lit(1)).alias("n"))))  # one row
    q = x.select((i * 3 % n).cast("int").alias("a"), ((i * 3 % n + F.when(i % 2 == 0, 1).otherwise(-1) + n) % n).cast("int").alias("b"))
    q = q.withColumns({"u": F.least("a", "b"), "v": F.greatest("a", "b")})
    return q.join(D.net(s, d).where("u < v"), ["u", "v"], "left").select("a", "b", "tt")


@register("j10_touches_corridor", "SELECT DISTINCT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey IN (3, 7)")
def j10(s, d):
    inside = table(s, d, "supplier").where(C("s_nationkey").isin(3, 7)).select("s_suppkey")
    return table(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(inside, C("l_suppkey") == C("s_suppkey"), "left_semi").select("l_orderkey").distinct()


@register("j11_array_overlap", "SELECT DISTINCT a.p_brand AS dev, b.p_brand AS intervention FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_brand < b.p_brand")
def j11(s, d):
    seg = table(s, d, "part").select("p_brand", F.concat_ws("-", "p_size", "p_type").alias("segment")).distinct()
    return seg.withColumnRenamed("p_brand", "dev").join(seg.withColumnRenamed("p_brand", "intervention"), "segment").where("dev < intervention").select("dev", "intervention").distinct()


SITES = "sites AS (SELECT n_nationkey AS id, (n_nationkey * 13 % 100)::DOUBLE AS x, (n_nationkey * 29 % 100)::DOUBLE AS y FROM nation)"


def sites(s, d):
    return table(s, d, "nation").select(C("n_nationkey").alias("id"), (C("n_nationkey") * 13 % 100).cast("double").alias("x"), (C("n_nationkey") * 29 % 100).cast("double").alias("y"))


@register("j12_nearest", f'WITH {D.CELLS}, {SITES} SELECT "row", col, id AS station FROM (SELECT "row", col, id, row_number() OVER (PARTITION BY "row", col ORDER BY ("row" - x) * ("row" - x) + (col - y) * (col - y), id) AS n FROM cells CROSS JOIN sites) WHERE n = 1')
def j12(s, d):
    points = D.cells(s, d).select("row", "col", C("row").cast("double").alias("ax"), C("col").cast("double").alias("ay"))
    x = R.nearest(points, ["row", "col"], sites(s, d).select("id", C("x").alias("bx"), C("y").alias("by")), 20.0)
    return x.select("row", "col", C("id").alias("station"))


@register("j13_k_nearest", f"WITH {SITES} SELECT a, b, n::BIGINT AS rank FROM (SELECT p.id AS a, q.id AS b, row_number() OVER (PARTITION BY p.id ORDER BY (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y), q.id) AS n FROM sites p JOIN sites q ON p.id <> q.id AND (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y) <= 1600) WHERE n <= 5")
def j13(s, d):
    p = sites(s, d)
    pairs = R.distance_join(p.select(C("id").alias("a"), C("x").alias("ax"), C("y").alias("ay")), p.select(C("id").alias("b"), C("x").alias("bx"), C("y").alias("by")), 40.0).where("a <> b")
    return R.top_n(pairs, ["a"], 5, C("distance"), C("b")).select("a", "b", C("rank").cast("long").alias("rank"))


@register("j14_distance_self_join", 'WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 17 % 97)::DOUBLE AS x, (s_suppkey * 31 % 89)::DOUBLE AS y FROM supplier) SELECT p.id AS a, q.id AS b FROM p JOIN p q ON p.id < q.id AND sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) <= 9')
def j14(s, d):
    p = table(s, d, "supplier").select(C("s_suppkey").alias("id"), (C("s_suppkey") * 17 % 97).cast("double").alias("x"), (C("s_suppkey") * 31 % 89).cast("double").alias("y"))
    return R.distance_join(p.select(C("id").alias("a"), C("x").alias("ax"), C("y").alias("ay")), p.select(C("id").alias("b"), C("x").alias("bx"), C("y").alias("by")), 9.0).where("a < b").select("a", "b")


RING = [(10.0, 10.0), (80.0, 20.0), (60.0, 85.0), (15.0, 60.0)]
PIP = " + ".join(f"CASE WHEN (({y1} > py) <> ({y2} > py)) AND px < {x1} + (py - {y1}) * {(x2 - x1) / (y2 - y1)!r} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1]))


@register("j15_point_in_polygon", f'WITH {D.CELLS}, p AS (SELECT "row", col, "row" + 0.25 AS px, col + 0.25 AS py FROM cells) SELECT "row", col FROM p WHERE ({PIP}) % 2 = 1')
def j15(s, d):
    return D.cells(s, d).where(X.inside_polygon(C("row") + 0.25, C("col") + 0.25, RING)).select("row", "col")


@register("j16_crossing", f"WITH {D.EDGES}, {SITES}, n AS (SELECT id, ({PIP}) % 2 = 1 AS inside FROM (SELECT id, x + 0.25 AS px, y + 0.25 AS py FROM sites)) SELECT u, v FROM edges JOIN n a ON u = a.id JOIN n b ON v = b.id WHERE a.inside <> b.inside")
def j16(s, d):
    n = sites(s, d).select("id", X.inside_polygon(C("x") + 0.25, C("y") + 0.25, RING).alias("inside"))
    e = R.role_join(D.edges(s), n, "id", "inside", {"u": "a", "v": "b"})
    return e.where("a <> b").select("u", "v")


@register("j18_cells_to_commune_to_zone", f'WITH {D.CELLS} SELECT ("row" // 10)::INT AS commune, (col // 25)::INT AS zone, round(sum(value), 2) AS value, count(*) AS n_cells FROM cells GROUP BY ALL')
def j18(s, d):
    return D.cells(s, d).groupBy(F.floor(C("row") / 10).cast("int").alias("commune"), F.floor(C("col") / 25).cast("int").alias("zone")).agg(F.round(F.sum("value"), 2).alias("value"), F.count(F.lit(1)).alias("n_cells"))


@register("j20_broadcast_update", f"WITH {D.DEVS} SELECT dev, y::INT AS year, CASE WHEN y = 2050 THEN round(cost, 2) ELSE 0.0 END AS const_cost FROM devs CROSS JOIN range(2050, 2056) r(y)")
def j20(s, d):
    years = F.sequence(F.lit(2050), F.lit(2055))
    return D.developments(s, d).select("dev", "cost", F.explode(years).alias("year")).select("dev", "year", F.when(C("year") == 2050, F.round("cost", 2)).otherwise(0.0).alias("const_cost"))


@register("j21_aligned_update", "SELECT p_partkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END, p_retailprice) AS price FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def j21(s, d):
    new = table(s, d, "supplier").select(C("s_suppkey").alias("p_partkey"), F.when(C("s_suppkey") % 2 == 0, C("s_acctbal")).alias("new"))
    return table(s, d, "part").join(new, "p_partkey", "left").select("p_partkey", F.coalesce("new", "p_retailprice").alias("price"))


@register("j22_matrix_add", f"WITH {D.TRIPS} SELECT coalesce(a.o, b.d) AS o, coalesce(a.d, b.o) AS d, a.trips + b.trips AS total FROM (SELECT * FROM trips WHERE o % 3 <> 0) a FULL JOIN trips b ON a.o = b.d AND a.d = b.o")
def j22(s, d):
    t = D.trips(s, d)
    a, b = t.where("o % 3 <> 0").withColumnRenamed("trips", "x"), t.select(C("d").alias("o"), C("o").alias("d"), C("trips").alias("y"))
    return a.join(b, ["o", "d"], "full").select("o", "d", (C("x") + C("y")).alias("total"))


@register("j24_zone_adjacency", f'WITH {D.CELLS}, z AS (SELECT "row" AS r, col AS c, ("row" // 20) * 5 + col // 20 AS zone FROM cells) SELECT DISTINCT a.zone::INT AS zone, b.zone::INT AS neighbour FROM z a JOIN z b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.zone <> b.zone')
def j24(s, d):
    z = D.cells(s, d).select("row", "col", (F.floor(C("row") / 20) * 5 + F.floor(C("col") / 20)).cast("int").alias("zone"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = z.withColumn("o", F.explode(around)).select((C("row") + C("o.i")).alias("row"), (C("col") + C("o.j")).alias("col"), C("zone").alias("neighbour"))
    return z.join(b, ["row", "col"]).where("zone <> neighbour").select("zone", "neighbour").distinct()


@register("a1_sum_two_keys", f"WITH {D.PANEL} SELECT district, year, round(value, 2) AS value FROM panel")
def a1(s, d):
    return D.panel(s, d).withColumn("value", F.round("value", 2))


@register("a2_multi_sum", "SELECT p_brand AS dev, p_type AS scenario, count(*) AS n, round(sum(p_retailprice), 2) AS cost, sum(p_size)::BIGINT AS size FROM part GROUP BY ALL")
def a2(s, d):
    return table(s, d, "part").groupBy(C("p_brand").alias("dev"), C("p_type").alias("scenario")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("cost"), F.sum("p_size").alias("size"))


@register("a3_first_and_sum", "SELECT p_brand, arg_min(p_name, p_partkey) AS first_name, sum(p_size)::BIGINT AS size FROM part GROUP BY ALL")
def a3(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(R.first_by(C("p_name"), C("p_partkey")).alias("first_name"), F.sum("p_size").alias("size"))


@register("a4_merge_undirected", f"WITH {D.SERVICES} SELECT least(from_node, to_node) AS u, greatest(from_node, to_node) AS v, sum(frequency)::BIGINT AS frequency, sum(tt)::BIGINT AS time, arg_min(service, (from_node, service)) AS service FROM services GROUP BY 1, 2")
def a4(s, d):
    x = D.services(s, d).withColumnsRenamed({"from_node": "u", "to_node": "v"}).withColumn("first", C("u"))
    return R.merge_edges(x, "frequency", "tt", C("first"), C("service"))


@register("a5_max_by_key", f"WITH {D.SERVICES} SELECT from_node AS node, service, direction, max(frequency)::BIGINT AS frequency FROM services GROUP BY ALL")
def a5(s, d):
    return D.services(s, d).groupBy(C("from_node").alias("node"), "service", "direction").agg(F.max("frequency").alias("frequency"))


@register("a6_conditional_sums", f"WITH {D.SERVICES} SELECT from_node, to_node, coalesce(sum(frequency) FILTER (WHERE service LIKE 'A%'), 0)::BIGINT AS stopping, coalesce(sum(frequency) FILTER (WHERE service NOT LIKE 'A%'), 0)::BIGINT AS passing FROM services GROUP BY ALL")
def a6(s, d):
    stop = C("service").startswith("A")
    return D.services(s, d).groupBy("from_node", "to_node").agg(F.sum(F.when(stop, C("frequency")).otherwise(0)).alias("stopping"), F.sum(F.when(~stop, C("frequency")).otherwise(0)).alias("passing"))


A7 = f"WITH {D.SERVICES}, m AS (SELECT from_node AS node, service, sum(frequency)::BIGINT AS f FROM services GROUP BY ALL) SELECT node, string_agg(service || '.' || f, ', ' ORDER BY service) AS services_tph, string_agg(service, ', ' ORDER BY service) AS service_list FROM m GROUP BY node"


@register("a7_format_service_map", A7)
def a7(s, d):
    m = D.services(s, d).groupBy(C("from_node").alias("node"), "service").agg(F.sum("frequency").alias("f"))
    cell = F.concat("service", F.lit("."), X.format_frequency(C("f").cast("double")))
    return m.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list(cell)), ", ").alias("services_tph"), F.array_join(F.array_sort(F.collect_set("service")), ", ").alias("service_list"))


@register("a11_count_pivot", "SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey % 3 = 0) AS small, count(*) FILTER (WHERE c_nationkey % 3 = 1) AS medium, count(*) FILTER (WHERE c_nationkey % 3 = 2) AS large FROM customer GROUP BY ALL")
def a11(s, d):
    x = table(s, d, "customer").withColumn("class", C("c_nationkey") % 3).groupBy("c_mktsegment").pivot("class", [0, 1, 2]).agg(F.count(F.lit(1))).na.fill(0)
    return x.withColumnsRenamed({"0": "small", "1": "medium", "2": "large"})


@register("a12_viability_counts", "SELECT p_brand AS dev, count(*) AS n, count(DISTINCT p_type) AS n_types, count(*) FILTER (WHERE p_retailprice > 1200) AS viable, round(100.0 * count(*) FILTER (WHERE p_retailprice > 1200) / count(*), 6) AS share FROM part GROUP BY ALL")
def a12(s, d):
    v = F.sum((C("p_retailprice") > 1200).cast("long"))
    return table(s, d, "part").groupBy(C("p_brand").alias("dev")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("n_types"), v.alias("viable"), F.round(100.0 * v / F.count(F.lit(1)), 6).alias("share"))


A13 = "WITH b AS (SELECT o_orderpriority AS scenario, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL) SELECT scenario, round(m, 3) AS mean, round(sd, 3) AS std, low, high, round(m - 1.65 * sd, 3) AS lower, round(m + 1.65 * sd, 3) AS upper FROM b"


@register("a13_band", A13)
def a13(s, d):
    b = table(s, d, "orders").groupBy(C("o_orderpriority").alias("scenario")).agg(F.avg("o_totalprice").alias("m"), F.stddev("o_totalprice").alias("sd"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return b.select("scenario", F.round("m", 3).alias("mean"), F.round("sd", 3).alias("std"), "low", "high", F.round(C("m") - 1.65 * C("sd"), 3).alias("lower"), F.round(C("m") + 1.65 * C("sd"), 3).alias("upper"))


@register("a14_two_level", "WITH m AS (SELECT p_type, p_brand, avg(p_retailprice) AS x FROM part GROUP BY ALL) SELECT p_type, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(min(x), 4) AS low, round(max(x), 4) AS high FROM m GROUP BY p_type")
def a14(s, d):
    m = table(s, d, "part").groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("x"))
    return m.groupBy("p_type").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.median("x"), 4).alias("median"), F.round(F.min("x"), 4).alias("low"), F.round(F.max("x"), 4).alias("high"))


@register("a15_argmin_completed", f"WITH {D.TRIPS}, b AS (SELECT o, arg_min(d, (trips, d)) AS closest, min(trips) AS trips FROM trips WHERE o % 4 <> 0 GROUP BY o) SELECT n_nationkey AS o, closest::DOUBLE AS closest, trips FROM nation LEFT JOIN b ON o = n_nationkey")
def a15(s, d):
    b = R.keep_first(D.trips(s, d).where("o % 4 <> 0"), ["o"], C("trips"), C("d")).select("o", C("d").cast("double").alias("closest"), "trips")
    return table(s, d, "nation").select(C("n_nationkey").alias("o")).join(b, "o", "left")


@register("a16_argmax_of_mean", "SELECT p_brand AS best FROM part GROUP BY p_brand ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 1")
def a16(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m")).orderBy(F.desc("m"), "p_brand").limit(1).select(C("p_brand").alias("best"))


@register("a17_weighted_average", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity) / 24, 6) AS capacity FROM lineitem GROUP BY ALL")
def a17(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.try_divide(F.sum(C("l_extendedprice") * C("l_quantity")), F.sum("l_quantity")) / 24, 6).alias("capacity"))


@register("a19_zonal_sum", f'WITH {D.CELLS} SELECT (("row" // 20) * 5 + col // 20)::INT AS zone, round(sum(value), 2) AS value FROM cells WHERE value > 0 GROUP BY ALL')
def a19(s, d):
    return D.cells(s, d).where("value > 0").groupBy((F.floor(C("row") / 20) * 5 + F.floor(C("col") / 20)).cast("int").alias("zone")).agg(F.round(F.sum("value"), 2).alias("value"))


@register("a20_crossings", f"WITH {D.NET} SELECT u AS node, count(*) AS degree FROM topo GROUP BY u HAVING count(*) >= 3")
def a20(s, d):
    return D.net(s, d).groupBy(C("u").alias("node")).agg(F.count(F.lit(1)).alias("degree")).where("degree >= 3")


@register("a22_marginals", f"WITH {D.TRIPS} SELECT 'origin' AS side, o AS station, sum(trips) AS trips FROM trips GROUP BY o UNION ALL SELECT 'destination', d, sum(trips) FROM trips GROUP BY d UNION ALL SELECT 'total', -1, sum(trips) FROM trips")
def a22(s, d):
    g = D.trips(s, d).groupingSets([[C("o")], [C("d")], []], "o", "d").agg(F.sum("trips").alias("trips"), F.grouping_id().alias("g"))
    return g.select(F.when(C("g") == 1, "origin").when(C("g") == 2, "destination").otherwise("total").alias("side"), F.coalesce("o", "d", F.lit(-1)).alias("station"), "trips")


@register("a23_histogram", "SELECT least(floor(l_discount / 0.02), 4)::INT AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def a23(s, d):
    return table(s, d, "lineitem").groupBy(F.least(F.floor(C("l_discount") / 0.02), F.lit(4)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("a24_empirical_cdf", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) / count(*) OVER (PARTITION BY s_nationkey) AS cdf FROM supplier")
def a24(s, d):
    w = Window.partitionBy("s_nationkey")
    return table(s, d, "supplier").select("s_suppkey", (F.row_number().over(w.orderBy("s_acctbal", "s_suppkey")) / F.count(F.lit(1)).over(w)).alias("cdf"))


@register("a25_across_scenarios", "SELECT p_brand AS dev, round(avg(c), 4) AS mean, round(stddev_samp(c), 4) AS std, round(stddev_samp(c) / avg(c), 6) AS cv FROM (SELECT p_brand, p_type, sum(p_retailprice) AS c FROM part GROUP BY ALL) GROUP BY ALL")
def a25(s, d):
    x = table(s, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("c"))
    return x.groupBy(C("p_brand").alias("dev")).agg(F.round(F.avg("c"), 4).alias("mean"), F.round(F.stddev("c"), 4).alias("std"), F.round(F.try_divide(F.stddev("c"), F.avg("c")), 6).alias("cv"))


def by():
    return Window.partitionBy("district").orderBy("year")


@register("w1_pct_change", f"WITH {D.PANEL} SELECT district, year, round(value / nullif(lag(value) OVER (PARTITION BY district ORDER BY year), 0) - 1, 8) AS growth FROM panel")
def w1(s, d):
    return D.panel(s, d).select("district", "year", F.round(F.try_divide("value", F.lag("value").over(by())) - 1, 8).alias("growth"))


@register("w2_cumulative_sum", f"WITH {D.PANEL} SELECT district, year, round(sum(value) OVER (PARTITION BY district ORDER BY year ROWS UNBOUNDED PRECEDING), 2) AS total FROM panel")
def w2(s, d):
    return D.panel(s, d).select("district", "year", F.round(F.sum("value").over(by().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("total"))


@register("w3_cumulative_product", f"WITH {D.PANEL}, g AS (SELECT district, year, 0.01 * (year % 5) AS g FROM panel) SELECT district, year, round(list_product(list(1 + g) OVER (PARTITION BY district ORDER BY year ROWS UNBOUNDED PRECEDING)), 8) AS idx FROM g")
def w3(s, d):
    g = D.panel(s, d).select("district", "year", (0.01 * (C("year") % 5)).alias("g"))
    upto = F.collect_list(1 + C("g")).over(by().rowsBetween(Window.unboundedPreceding, 0))
    return g.select("district", "year", F.round(F.aggregate(upto, F.lit(1.0), lambda a, x: a * x), 8).alias("idx"))


@register("w4_compounding", f"WITH {D.PANEL}, p AS (SELECT district, max(value) AS p0 FROM panel GROUP BY ALL) SELECT district, y::INT AS year, round(p0 * pow(1.004, y - 2050), 2) AS value FROM p CROSS JOIN range(2051, 2061) r(y)")
def w4(s, d):
    p = D.panel(s, d).groupBy("district").agg(F.max("value").alias("p0"))
    return p.select("district", "p0", F.explode(F.sequence(F.lit(2051), F.lit(2060))).alias("year")).select("district", "year", F.round(C("p0") * F.pow(F.lit(1.004), C("year") - 2050), 2).alias("value"))


@register("w5_index", f"WITH {D.PANEL} SELECT district, year, round(100 * value / first_value(value) OVER (PARTITION BY district ORDER BY year), 6) AS idx FROM panel")
def w5(s, d):
    return D.panel(s, d).select("district", "year", F.round(100 * C("value") / F.first("value").over(by()), 6).alias("idx"))


@register("w6_ratio_to_start", f"WITH {D.PANEL} SELECT p.district, p.year, round(coalesce(p.value / b.value, 1), 8) AS factor FROM panel p LEFT JOIN panel b ON p.district = b.district AND b.year = 1996")
def w6(s, d):
    p = D.panel(s, d)
    b = p.where("year = 1996").select("district", C("value").alias("base"))
    return p.join(b, "district", "left").select("district", "year", F.round(F.coalesce(F.try_divide("value", "base"), F.lit(1.0)), 8).alias("factor"))


@register("w7_rank", f"WITH {D.DEVS} SELECT dev, row_number() OVER (ORDER BY cost / n DESC, dev) AS rank FROM devs QUALIFY rank <= 10")
def w7(s, d):
    return D.developments(s, d).withColumn("m", C("cost") / C("n")).orderBy(F.desc("m"), "dev").limit(10).select("dev", F.row_number().over(Window.orderBy(F.desc("m"), "dev")).cast("long").alias("rank"))


PATH = "path AS (SELECT l_orderkey, list(s_nationkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS path FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


def paths(s, d):
    x = table(s, d, "lineitem").join(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), C("l_suppkey") == C("s_suppkey"))
    row = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "s_nationkey")
    return x.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["s_nationkey"]).alias("path"))


@register("w8_consecutive_pairs", f"WITH {PATH}, h AS (SELECT l_orderkey, unnest(range(1, len(path))) AS i, path FROM path) SELECT path[i] AS from_node, path[i + 1] AS to_node, count(*) AS n FROM h GROUP BY ALL")
def w8(s, d):
    return R.explode_path(paths(s, d), "path", "l_orderkey").groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("n"))


PROFILE = "profile AS (SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)"


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@register("w9_first_differences", f"WITH {PROFILE} SELECT user_id, event_id, round(abs(step) / 50, 8) AS slope FROM profile WHERE step IS NOT NULL")
def w9(s, d):
    x = table(s, d, "events").select("user_id", "event_id", (C("value") - F.lag("value").over(by_user())).alias("step"))
    return x.where("step is not null").select("user_id", "event_id", F.round(F.abs("step") / 50, 8).alias("slope"))


W10 = """WITH f AS (SELECT user_id, ts, event_id, CASE WHEN value > 60 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END AS flag FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, flag ORDER BY ts, event_id) AS island FROM f)
SELECT user_id, flag, min(event_id) AS first_event, count(*) AS n FROM g WHERE flag <> 0 GROUP BY user_id, flag, island HAVING count(*) >= 2"""


@register("w10_run_lengths", W10.replace("min(event_id)", "arg_min(event_id, (ts, event_id))"))
def w10(s, d):
    f = table(s, d, "events").select("user_id", "ts", "event_id", F.when(C("value") > 60, 1).when(C("value") < 20, -1).otherwise(0).alias("flag"))
    changed = F.coalesce(F.lag("flag").over(by_user()) != C("flag"), F.lit(True)).cast("int")
    f = f.withColumn("changed", changed).withColumn("island", F.sum("changed").over(by_user()))
    return f.where("flag <> 0").groupBy("user_id", "island", "flag").agg(R.first_by(C("event_id"), C("ts"), C("event_id")).alias("first_event"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("island")


W11 = f"""WITH {D.NET}, c AS (SELECT u // 10 AS section, u, sum(tt) OVER (PARTITION BY u // 10 ORDER BY u) AS cum, sum(tt) OVER (PARTITION BY u // 10) / 2.0 AS mid FROM edges WHERE v = u + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY abs(cum - mid), cum) AS nth FROM c) SELECT section, u AS station, cum::BIGINT AS at FROM r WHERE nth = 1"""


@register("w11_midpoint_station", W11)
def w11(s, d):
    """Of each section, ten stations of the ring, the one nearest to half of its time."""
    line = D.net(s, d).where("v = u + 1").withColumn("section", F.floor(C("u") / 10).cast("int"))
    by = Window.partitionBy("section")
    c = line.select("section", "u", F.sum("tt").over(by.orderBy("u")).alias("cum"), (F.sum("tt").over(by) / 2.0).alias("mid"))
    m = c.groupBy("section").agg(F.min(F.struct(F.abs(C("cum") - C("mid")), "cum", "u")).alias("m"))
    return m.select("section", C("m.u").alias("station"), C("m.cum").alias("at"))


@register("w12_interpolate", "SELECT o_orderkey, round(0.015 + (0.045 - 0.015) * (year(o_orderdate) - 1992) / 82, 8) AS sigma FROM orders")
def w12(s, d):
    """A value between two years' at each order's year."""
    return table(s, d, "orders").select("o_orderkey", F.round(0.015 + (0.045 - 0.015) * (F.year("o_orderdate") - 1992) / 82, 8).alias("sigma"))


@register("t2_largest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t2(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@register("t3_top_per_group", f"WITH {D.TRIPS} SELECT o, d, trips, row_number() OVER (PARTITION BY o ORDER BY trips DESC, d) AS rank FROM trips QUALIFY rank <= 20")
def t3(s, d):
    return R.top_n(D.trips(s, d), ["o"], 20, C("trips").desc(), C("d")).withColumn("rank", C("rank").cast("long"))


@register("t4_best_filled", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 4 = 0 THEN p_size END DESC NULLS LAST, p_partkey) AS n FROM part) WHERE n = 1")
def t4(s, d):
    return R.keep_first(table(s, d, "part"), ["p_brand"], F.when(C("p_size") % 4 == 0, C("p_size")).desc_nulls_last(), C("p_partkey")).select("p_brand", "p_partkey")


@register("u1_union_aligned", "SELECT s_suppkey AS key, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def u1(s, d):
    return table(s, d, "supplier").select(C("s_suppkey").alias("key"), C("s_acctbal").alias("balance")).unionByName(table(s, d, "customer").select(C("c_custkey").alias("key"), C("c_acctbal").alias("balance"), C("c_mktsegment").alias("segment")), allowMissingColumns=True)


@register("u2_u3_u4_id_sets", "SELECT 'union' AS kind, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_suppkey FROM lineitem INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def u2(s, d):
    t = lambda n, c: table(s, d, n).select(C(c).alias("k"))
    kinds = {"union": t("supplier", "s_nationkey").union(t("customer", "c_nationkey")).distinct(), "intersect": t("lineitem", "l_suppkey").intersect(t("orders", "o_custkey")), "except": t("customer", "c_custkey").subtract(t("orders", "o_custkey"))}
    out = None
    for k, x in kinds.items():
        x = x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
        out = x if out is None else out.unionByName(x)
    return out


@register("u6_drop_duplicates", "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL")
def u6(s, d):
    return table(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"))


@register("u7_pivot_wide", f"WITH {D.PANEL} PIVOT (SELECT district, year, round(value, 2) AS value FROM panel WHERE year BETWEEN 1996 AND 1998) ON year IN (1996, 1997, 1998) USING coalesce(sum(value), 0)")
def u7(s, d):
    return D.panel(s, d).where(C("year").between(1996, 1998)).groupBy("district").pivot("year", [1996, 1997, 1998]).agg(F.round(F.sum("value"), 2)).na.fill(0.0)


@register("u9_wide_to_long", "UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) ON size, price INTO NAME kind VALUE value")
def u9(s, d):
    return table(s, d, "part").select("p_partkey", C("p_size").cast("double").alias("size"), C("p_retailprice").alias("price")).unpivot(["p_partkey"], ["size", "price"], "kind", "value")


@register("u10_grid_completion", f"WITH {D.PANEL}, k AS (SELECT r_name AS district, y::INT AS year FROM region CROSS JOIN range(1990, 2006) r(y)) SELECT k.district, k.year, round(coalesce(value, 0), 2) AS value FROM k LEFT JOIN panel p ON k.district = p.district AND k.year = p.year")
def u10(s, d):
    keys = table(s, d, "region").select(C("r_name").alias("district"), F.explode(F.sequence(F.lit(1990), F.lit(2005))).alias("year"))
    return R.complete(D.panel(s, d).withColumn("value", F.round("value", 2)), keys, ["district", "year"], {"value": 0.0})


@register("u12_explode_path", f"WITH {PATH}, h AS (SELECT l_orderkey, path, unnest(range(1, len(path))) AS i FROM path) SELECT l_orderkey, (i - 1)::INT AS hop, path[i] AS from_node, coalesce(n_name, 'Unknown Node ' || path[i]) AS from_station FROM h LEFT JOIN nation ON n_nationkey = path[i] AND n_nationkey < 20")
def u12(s, d):
    names = table(s, d, "nation").where("n_nationkey < 20").select(C("n_nationkey").alias("from_node"), "n_name")
    h = R.explode_path(paths(s, d), "path", "l_orderkey").join(F.broadcast(names), "from_node", "left")
    return h.select("l_orderkey", "hop", "from_node", F.coalesce("n_name", F.concat(F.lit("Unknown Node "), "from_node")).alias("from_station"))


@register("u13_mirror", f"WITH {PATH}, x AS (SELECT l_orderkey, path[1] AS a, path[-1] AS b, path FROM path WHERE len(path) >= 3) SELECT l_orderkey, a, b, array_to_string(path, ',') AS via, 'A' AS direction FROM x UNION ALL SELECT l_orderkey, b, a, array_to_string(list_reverse(path), ','), 'B' FROM x")
def u13(s, d):
    x = paths(s, d).where("size(path) >= 3").select("l_orderkey", F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("b"), C("path").alias("via"))
    return R.mirror(x, "a", "b", "via").withColumn("via", F.array_join(C("via").cast("array<string>"), ","))


@register("u14_both_axes", f"WITH {D.TRIPS} SELECT o // 5 AS o_zone, d // 5 AS d_zone, sum(trips) AS trips FROM trips WHERE o // 5 <> d // 5 GROUP BY ALL")
def u14(s, d):
    return D.trips(s, d).groupBy(F.floor(C("o") / 5).cast("int").alias("o_zone"), F.floor(C("d") / 5).cast("int").alias("d_zone")).agg(F.sum("trips").alias("trips")).where("o_zone <> d_zone")
