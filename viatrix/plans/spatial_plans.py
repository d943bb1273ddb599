"""Queries of segments, polygons, tiles and road topology, and what else completes the inventory (S, F, J, A, T, U, X, G, K, E, P)."""

from pyspark.sql import Window, functions as F

from viatrix.functions import exprs as X
from viatrix.operators import elevation as E, network as N, relational as R, spatial as G
from viatrix.plans import domain as D
from viatrix.plans.registry import register
from viatrix.plans.relational_plans import SITES, sites
from viatrix.session import table
from viatrix.sources import geometry, geopackage, geotiff, readers

C = F.col
LINKS = "links AS (SELECT u, v, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS \"by\" FROM edges JOIN sites p ON u = p.id JOIN sites q ON v = q.id WHERE u < v)"
RIVERS = """rivers AS (SELECT s_suppkey AS river, s_suppkey % 3 AS class, (s_suppkey * 17 % 97)::DOUBLE + 0.37 AS cx, (s_suppkey * 31 % 89)::DOUBLE + 0.41 AS cy,
  (s_suppkey * 17 % 97)::DOUBLE + 0.37 + (s_suppkey * 7 % 23 - 11)::DOUBLE AS dx, (s_suppkey * 31 % 89)::DOUBLE + 0.41 + (s_suppkey * 5 % 19 - 9)::DOUBLE AS dy FROM supplier)"""


def links(s, d):
    """(u, v, ax, ay, bx, by): straight lines of the network, one direction."""
    p = sites(s, d)
    e = D.edges(s).where("u < v").select("u", "v")
    e = e.join(p.select(C("id").alias("u"), C("x").alias("ax"), C("y").alias("ay")), "u")
    return e.join(p.select(C("id").alias("v"), C("x").alias("bx"), C("y").alias("by")), "v").select("u", "v", "ax", "ay", "bx", "by")


def rivers(s, d):
    k = C("s_suppkey")
    x, y = (k * 17 % 97).cast("double") + 0.37, (k * 31 % 89).cast("double") + 0.41
    return table(s, d, "supplier").select(k.alias("river"), (k % 3).alias("class"), x.alias("cx"), y.alias("cy"), (x + (k * 7 % 23 - 11).cast("double")).alias("dx"), (y + (k * 5 % 19 - 9).cast("double")).alias("dy"))


def _side(p, a, b):
    return f'sign(({b}x - {a}x) * ("{p}y" - "{a}y") - ("{b}y" - "{a}y") * ({p}x - {a}x))'


CROSS = f"{_side('c', 'a', 'b')} * {_side('d', 'a', 'b')} < 0 AND {_side('a', 'c', 'd')} * {_side('b', 'c', 'd')} < 0"


@register("j17_river_crossings", f"WITH {D.EDGES}, {SITES}, {LINKS}, {RIVERS} SELECT u, v, class, count(*) AS crossings FROM links JOIN rivers ON {CROSS} GROUP BY ALL")
def j17(s, d):
    x = G.crossing_join(links(s, d), rivers(s, d), 10.0)
    return x.groupBy("u", "v", "class").agg(F.count(F.lit(1)).alias("crossings"))


J25 = f"""WITH {D.CELLS}, plots AS (SELECT p_partkey AS plot, (p_partkey % 90)::DOUBLE + 0.25 AS x0, (p_partkey * 7 % 90)::DOUBLE + 0.5 AS y0, (p_partkey % 90)::DOUBLE + 0.25 + 1 + p_size % 4 AS x1, (p_partkey * 7 % 90)::DOUBLE + 1.25 + p_size % 3 AS y1 FROM part)
SELECT plot, round(sum(value * (least("row" + 1, x1) - greatest("row", x0)) * (least(col + 1, y1) - greatest(col, y0))), 6) AS potential
FROM plots JOIN cells ON "row" + 1 > x0 AND "row" < x1 AND col + 1 > y0 AND col < y1 GROUP BY plot"""


@register("j25_area_weighted_overlay", J25)
def j25(s, d):
    k = C("p_partkey")
    x, y = (k % 90).cast("double") + 0.25, (k * 7 % 90).cast("double") + 0.5
    plots = table(s, d, "part").select(k.alias("plot"), x.alias("x0"), y.alias("y0"), (x + 1 + C("p_size") % 4).alias("x1"), (y + 0.75 + C("p_size") % 3).alias("y1"))
    x = G.covered_cells(plots, "plot").join(F.broadcast(D.cells(s, d)), ["row", "col"])  # 100 x 100 cells at most
    return x.groupBy("plot").agg(F.round(F.sum(C("value") * C("share")), 6).alias("potential"))


NEAR = f"""p AS (SELECT "row", col, u, v, ax, ay, bx, "by", greatest(0.0, least(1.0, (("row" + 0.5 - ax) * (bx - ax) + (col + 0.5 - ay) * ("by" - ay)) / nullif((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay), 0))) AS t FROM cells CROSS JOIN links),
near AS (SELECT "row", col, min(sqrt(pow("row" + 0.5 - (ax + t * (bx - ax)), 2) + pow(col + 0.5 - (ay + t * ("by" - ay)), 2))) AS distance FROM p GROUP BY ALL)"""


@register("j25_convex_overlay")
def j25_convex(s, d):
    """Customers' balances of cells by the share that each supplier's plot, a turned triangle, covers; tested against plain clipping."""
    k = C("s_suppkey")
    turn, x, y = k * 0.7, k * 37 % 83 + 0.3, k * 53 % 79 + 0.6
    corner = lambda a, b: F.struct((x + a * F.cos(turn) - b * F.sin(turn)).alias("x"), (y + a * F.sin(turn) + b * F.cos(turn)).alias("y"))
    plots = table(s, d, "supplier").select("s_suppkey", F.array(corner(F.lit(0.0), F.lit(0.0)), corner(F.lit(6.0), F.lit(0.0)), corner(F.lit(0.0), F.lit(8.0))).alias("ring"))
    over = G.convex_cells(plots, "s_suppkey").join(F.broadcast(D.cells(s, d)), ["row", "col"])  # 100 x 100 cells at most
    return over.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum(C("share") * C("value")), 4).alias("value"))


@register("x13_noise_rings", f"WITH {D.CELLS}, {D.EDGES}, {SITES}, {LINKS}, {NEAR} SELECT CASE WHEN distance <= 1 THEN 1 WHEN distance <= 2.5 THEN 2 ELSE 3 END AS ring, count(*) AS n_cells, round(sum(value), 2) AS exposed FROM near JOIN cells USING (\"row\", col) WHERE distance <= 4 GROUP BY ALL")
def x13(s, d):
    near = G.cells_near(links(s, d), 4.0).join(D.cells(s, d), ["row", "col"])
    return near.groupBy(F.when(C("distance") <= 1, 1).when(C("distance") <= 2.5, 2).otherwise(3).alias("ring")).agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("value"), 2).alias("exposed"))


#: a station for each supplier, on the raster of the customers' cells
X14 = f"""WITH {D.SPEEDS}, sites AS (SELECT s_suppkey AS id, (s_suppkey * 17 % side) + 0.25 AS x, (s_suppkey * s_suppkey * 29 % side) + 0.75 AS y FROM supplier, side),
n AS (SELECT "row", col, min((sqrt(("row" + 0.5 - x) * ("row" + 0.5 - x) + (col + 0.5 - y) * (col + 0.5 - y)), id))[2] AS site FROM cell CROSS JOIN sites GROUP BY ALL)
SELECT site, count(*) AS area, min("row") AS west, max("row") AS east, min(col) AS south, max(col) AS north FROM n GROUP BY site"""


@register("x14_voronoi_zones", X14)
def x14(s, d):
    """The zone of each supplier's station: the cells that it is nearest to, of equally near ones the smallest id.

    Cells meet the stations of their own and neighbouring squares only; squares double for cells that found none.
    """
    cells = D.speeds(s, d).select("row", "col", (C("row") + 0.5).alias("ax"), (C("col") + 0.5).alias("ay"))
    side = table(s, d, "customer").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("side"))  # one row
    k = C("s_suppkey")
    at = table(s, d, "supplier").join(F.broadcast(side)).select(k.alias("id"), (k * 17 % C("side") + 0.25).alias("bx"), (k * k * 29 % C("side") + 0.75).alias("by"))
    near = R.nearest(N.saved(cells), ["row", "col"], N.saved(at), 4.0)
    return near.groupBy(C("id").alias("site")).agg(F.count(F.lit(1)).alias("area"), F.min("row").alias("west"), F.max("row").alias("east"), F.min("col").alias("south"), F.max("col").alias("north"))


X15 = """WITH z AS (SELECT r_regionkey AS zone, r_regionkey * 15.3 AS x0, r_regionkey * 7.1 AS y0 FROM region),
c AS (SELECT r + 0.5 AS px, k + 0.5 AS py FROM range(120) a(r) CROSS JOIN range(120) b(k))
SELECT zone, (px - 0.5)::INT AS "row", (py - 0.5)::INT AS col FROM z JOIN c ON py > y0 AND py < y0 + 20 AND px > x0 AND px < x0 + 10.2 * (1 - (py - y0) / 20)"""


@register("x15_rasterise_polygons", X15)
def x15(s, d):
    x, y = C("r_regionkey") * 15.3, C("r_regionkey") * 7.1
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    z = table(s, d, "region").select(C("r_regionkey").alias("zone"), F.array(corner(x, y), corner(x + 10.2, y), corner(x, y + 20.0)).alias("ring"))
    return G.rasterise(z, "zone")


S8 = "SELECT i * 10 + j AS tile, a + i * (c - a) / 10 AS x0, b + j * (e - b) / 10 AS y0, a + (i + 1) * (c - a) / 10 AS x1, b + (j + 1) * (e - b) / 10 AS y1 FROM (SELECT min(s_acctbal) AS a, max(s_acctbal) AS c, 1.0 AS b, count(*)::DOUBLE AS e FROM supplier) CROSS JOIN range(10) r(i) CROSS JOIN range(10) q(j)"


@register("s8_tile_grid", f"SELECT tile, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM ({S8})")
def s8(s, d):
    """Ten by ten tiles of the area that the suppliers lie in."""
    a, c, e = table(s, d, "supplier").agg(F.min("s_acctbal"), F.max("s_acctbal"), F.count(F.lit(1))).first()  # one row
    return G.tiles(s, a, 1.0, c, float(e)).select("tile", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@register("s6_stacked_bands", f"WITH {D.CELLS} SELECT \"row\", col, 'pop' AS band, value FROM cells UNION ALL SELECT \"row\", col, 'empl', value * 0.5 FROM cells WHERE value > 100")
def s6(s, d):
    c = D.cells(s, d)
    return readers.stack_bands({"pop": c, "empl": c.where("value > 100").withColumn("value", C("value") * 0.5)})


@register("s6_geotiff", f"""WITH {D.SPEEDS}, c AS (SELECT 2600000 + (col + 0.5) * 25 AS x, 1200000 - ("row" + 0.5) * 25 AS y, speed FROM cell)
SELECT band, x::DOUBLE AS x, y::DOUBLE AS y, value FROM (SELECT 'speed' AS band, x, y, speed AS value FROM c UNION ALL SELECT 'minutes', x, y, round(1.5 / speed, 9) FROM c WHERE speed > 0) WHERE x BETWEEN 2600100 AND 2600600 AND y >= 1190000""")
def s6_geotiff(s, d):
    """A raster of two bands as a folder of GeoTIFF tiles, of which a strip is read; cells that can't be passed have no minutes."""
    x = D.speeds(s, d).select((2600000 + (C("col") + 0.5) * 25).alias("x"), (1200000 - (C("row") + 0.5) * 25).alias("y"), "speed")
    minutes = x.where("speed > 0").select(F.lit("minutes").alias("band"), "x", "y", F.round(1.5 / C("speed"), 9).alias("value"))
    cells = x.select(F.lit("speed").alias("band"), "x", "y", C("speed").alias("value")).unionByName(minutes)
    geotiff.write_rasters(cells, path := readers.scratch(s, "raster"), 2600000, 1200000, 25, ["speed", "minutes"], 64)
    return geotiff.read_rasters(s, path, (2600100.0, 1190000.0, 2600600.0, 1200000.0))


@register("f13_select_and_rename", "SELECT c_custkey AS station, c_name AS name, c_acctbal AS balance FROM customer")
def f13(s, d):
    return table(s, d, "customer").drop("c_mktsegment").withColumnsRenamed({"c_custkey": "station", "c_name": "name", "c_acctbal": "balance"}).select("station", "name", "balance")


@register("j19_cross_product", f"WITH {D.DEVS} SELECT dev, scenario, year::INT AS year FROM devs CROSS JOIN (SELECT DISTINCT c_mktsegment AS scenario FROM customer) CROSS JOIN range(2050, 2101) t(year)")
def j19(s, d):
    scenario = table(s, d, "customer").select(C("c_mktsegment").alias("scenario")).distinct()
    # developments and scenarios are short lists; years are made in place
    return D.developments(s, d).select("dev").crossJoin(scenario).withColumn("year", F.explode(F.sequence(F.lit(2050), F.lit(2100))))


@register("u11_zero_panel", "SELECT r_name AS district, year::INT AS year, coalesce(v, 0.0) AS value FROM region CROSS JOIN range(1990, 2000) t(year) LEFT JOIN (SELECT n_regionkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) ON k = r_regionkey AND y = year")
def u11(s, d):
    keys = table(s, d, "region").select(C("r_name").alias("district"), F.explode(F.sequence(F.lit(1990), F.lit(1999))).alias("year"))
    return R.complete(D.panel(s, d), keys, ["district", "year"], {"value": 0.0}).select("district", "year", "value")


@register("a8_sorted_services", f"WITH {D.SERVICES} SELECT from_node AS node, string_agg(service, ', ' ORDER BY service) AS services FROM (SELECT DISTINCT from_node, service FROM services) GROUP BY ALL")
def a8(s, d):
    return D.services(s, d).groupBy(C("from_node").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("service")), ", ").alias("services"))


@register("a21_merged_parts", f"WITH {D.SERVICES}, {SITES} SELECT service, direction, count(*) AS n_parts, round(sum(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))), 6) AS length, min(least(p.x, q.x)) AS west, max(greatest(p.x, q.x)) AS east FROM services JOIN sites p ON from_node = p.id JOIN sites q ON to_node = q.id GROUP BY ALL")
def a21(s, d):
    p = sites(s, d)
    x = D.services(s, d).join(p.select(C("id").alias("from_node"), C("x").alias("ax"), C("y").alias("ay")), "from_node").join(p.select(C("id").alias("to_node"), C("x").alias("bx"), C("y").alias("by")), "to_node")
    return x.groupBy("service", "direction").agg(F.count(F.lit(1)).alias("n_parts"), F.round(F.sum(X.distance(C("ax"), C("ay"), C("bx"), C("by"))), 6).alias("length"), F.min(F.least("ax", "bx")).alias("west"), F.max(F.greatest("ax", "bx")).alias("east"))


@register("t1_full_sort", "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def t1(s, d):
    # the place within a priority shows the order, which a comparison of rows does not see
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    x = table(s, d, "orders").select("o_orderkey", "o_orderpriority", F.row_number().over(w).cast("long").alias("place"))
    return x.orderBy("o_orderpriority", "place")


G15 = f"""WITH {D.EDGES}, {SITES}, l AS (SELECT 101000 + i AS dev_id, [i, (i + 1) % 25, (i + 9) % 25, (i + 10) % 25] AS path FROM range(0, 25, 4) r(i)), h AS (SELECT dev_id, path, unnest(range(1, 4)) AS k FROM l),
p AS (SELECT dev_id, k - 1 AS hop, path[k]::INT AS from_node, path[k + 1]::INT AS to_node FROM h)
SELECT dev_id, hop::INT AS hop, from_node, to_node, round(coalesce((SELECT min(tt) FROM edges WHERE u = least(from_node, to_node) AND v = greatest(from_node, to_node)), sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 10), 6) AS time
FROM p JOIN sites a ON from_node = a.id JOIN sites b ON to_node = b.id"""


@register("g15_new_line_links", G15)
def g15(s, d):
    """Hops of new lines: the time of a link that is there, else of the straight line."""
    i = C("id")
    l = s.range(0, 25, 4).select((101000 + i).alias("dev_id"), F.transform(F.array(i, (i + 1) % 25, (i + 9) % 25, (i + 10) % 25), lambda n: n.cast("int")).alias("path"))  # noqa: E741
    h = R.explode_path(l, "path", "dev_id")
    known = R.undirected(D.edges(s)).groupBy("u", "v").agg(F.min("tt").alias("tt"))
    h = h.withColumns({"u": F.least("from_node", "to_node"), "v": F.greatest("from_node", "to_node")}).join(known, ["u", "v"], "left")
    p = sites(s, d)
    h = h.join(p.select(C("id").alias("from_node"), C("x").alias("ax"), C("y").alias("ay")), "from_node").join(p.select(C("id").alias("to_node"), C("x").alias("bx"), C("y").alias("by")), "to_node")
    return h.select("dev_id", "hop", "from_node", "to_node", F.round(F.coalesce("tt", X.distance(C("ax"), C("ay"), C("bx"), C("by")) / 10), 6).alias("time"))


G16 = f"""WITH {D.SERVICES}, {SITES}, deg AS (SELECT service, from_node AS node, count(DISTINCT to_node) AS n FROM services GROUP BY ALL), tip AS (SELECT service, node FROM deg WHERE n <= 2),
c AS (SELECT service, node, q.id AS to_node, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS far FROM tip JOIN sites p ON node = p.id JOIN sites q ON q.id <> node AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY service, node ORDER BY far, to_node) AS k FROM c),
kept AS (SELECT service, node, to_node, far FROM r WHERE k <= 5 AND NOT EXISTS (SELECT 1 FROM services z WHERE z.service = r.service AND z.from_node = r.node AND z.to_node = r.to_node))
SELECT service, node, to_node, round(far, 6) AS far, 100000 + row_number() OVER (ORDER BY service, node, to_node) - 1 AS dev_id FROM kept"""


@register("g16_extended_lines", G16)
def g16(s, d):
    """Ends of lines to the nearest five stations in reach that the line does not serve next to them."""
    x = D.services(s, d).select("service", C("from_node").alias("node"), "to_node").distinct()
    tip = x.groupBy("service", "node").agg(F.count(F.lit(1)).alias("n")).where("n <= 2").drop("n")
    p = sites(s, d)
    near = R.distance_join(p.select(C("id").alias("node"), C("x").alias("ax"), C("y").alias("ay")), p.select(C("id").alias("to_node"), C("x").alias("bx"), C("y").alias("by")), 30.0).where("node <> to_node")
    c = R.top_n(tip.join(near, "node"), ["service", "node"], 5, C("distance"), C("to_node"))
    kept = c.join(x, ["service", "node", "to_node"], "left_anti")
    return R.surrogate(kept, "dev_id", 100000, C("service"), C("node"), C("to_node")).select("service", "node", "to_node", F.round("distance", 6).alias("far"), C("dev_id").cast("long").alias("dev_id"))


G18 = f"""WITH {D.EDGES}, {SITES}, {LINKS}, pts AS (SELECT s_suppkey AS id, (s_suppkey * 11 % 101)::DOUBLE + 0.3 AS px, (s_suppkey * 19 % 97)::DOUBLE + 0.6 AS py FROM supplier),
t AS (SELECT id, u, v, ax, ay, bx, "by", px, py, ((px - ax) * (bx - ax) + (py - ay) * ("by" - ay)) / nullif(pow(bx - ax, 2) + pow("by" - ay, 2), 0) AS pos FROM pts CROSS JOIN links),
f AS (SELECT *, sqrt(pow(px - (ax + greatest(0, least(1, pos)) * (bx - ax)), 2) + pow(py - (ay + greatest(0, least(1, pos)) * ("by" - ay)), 2)) AS far FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(far, 9), u, v) AS k FROM f WHERE far <= 6),
cut AS (SELECT DISTINCT u, v, pos FROM b WHERE k = 1 AND pos > 0 AND pos < 1)
SELECT links.u, links.v, count(pos) + 1 AS n_parts, round(coalesce(min(pos), 1.0), 6) AS first_cut FROM links LEFT JOIN cut ON links.u = cut.u AND links.v = cut.v GROUP BY ALL"""


@register("g18_split_at_access_points", G18)
def g18(s, d):
    k = C("s_suppkey")
    points = table(s, d, "supplier").select(k.alias("id"), ((k * 11 % 101).cast("double") + 0.3).alias("px"), ((k * 19 % 97).cast("double") + 0.6).alias("py"))
    parts = G.split_at_points(links(s, d), points, 6.0, "u", "v")
    return parts.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n_parts"), F.round(F.min("to_at"), 6).alias("first_cut"))


K7 = """WITH t AS (SELECT s_suppkey AS id, 4 + s_suppkey % 9 AS tracks, (5 + s_suppkey % 20)::DOUBLE AS s, (3 + s_suppkey % 9)::DOUBLE AS p, s_suppkey % 6 AS a, s_suppkey % 4 AS b, (s_suppkey % 40)::DOUBLE AS st, (s_suppkey * 3 % 40)::DOUBLE AS pt FROM supplier),
x AS (SELECT *, CASE WHEN a > 0 AND b > 0 AND (st > 20) <> (pt > 20) THEN 20 + floor(60 / (3 + least(1, a + b - 1) / (a + b) * greatest(0, s - p - 3))) ELSE 40 END AS block FROM t)
SELECT id, tracks::INT AS tracks, tracks // 4 * block + [0.0, 30 / p, 20.0, 20 + 30 / p][1 + tracks % 4] AS capacity FROM x"""


@register("k7_multi_track_capacity", K7)
def k7(s, d):
    k = C("s_suppkey")
    x = table(s, d, "supplier").select(k.alias("id"), (4 + k % 9).cast("int").alias("tracks"), (5 + k % 20).cast("double").alias("stop"), (3 + k % 9).cast("double").alias("pass"), (k % 6).alias("n_stop"), (k % 4).alias("n_pass"), (k % 40).cast("double").alias("st"), (k * 3 % 40).cast("double").alias("pt"))
    return x.select("id", "tracks", X.capacity(C("tracks"), C("stop"), C("pass"), C("n_stop"), C("n_pass"), "good", C("st"), C("pt"), "mixed").alias("capacity"))


def height_profiles(s, d):
    """Profiles (link, at, z) of users' values, 40 points each."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(s, d, "events").select("user_id", "ts", "event_id", "value").withColumn("n", F.row_number().over(w) - 1)
    p = p.select((C("user_id") * 1000 + F.floor(C("n") / 40)).alias("link"), (C("n") % 40).cast("int").alias("at"), C("value").alias("z"))
    return p.where("z is not null")


@register("e2_fewest_slope_changes")
def e2(s, d):
    """At 3.5 a step; longest chains are tested by brute force."""
    return E.fewest_changes(height_profiles(s, d), 3.5).select("link", "n", "changes")


@register("e2_feasible_heights")
def e2_heights(s, d):
    """The heights themselves; tested for every slope, and by the number of points that move."""
    return E.feasible_heights(N.saved(height_profiles(s, d)), 3.5).select("link", "at", "z", F.round("height", 6).alias("height"), "moved")


P6 = """WITH h AS (SELECT left(o_orderpriority, 1) AS network, year(o_orderdate)::INT AS year, c_mktsegment AS scenario, sum(o_totalprice) / 1000 AS hours FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
b AS (SELECT network, year, avg(hours) AS mean, avg(hours) - 1.65 * stddev_samp(hours) AS low, avg(hours) + 1.65 * stddev_samp(hours) AS high FROM h GROUP BY ALL)
SELECT b.network, b.year, round(b.mean, 4) AS mean, round(b.low, 4) AS low, round(b.high, 4) AS high, round(b.mean - q.mean, 4) AS change FROM b JOIN b q ON q.network = '1' AND q.year = b.year WHERE b.network <> '1'"""


@register("p6_travel_time_development", P6)
def p6(s, d):
    o = table(s, d, "orders").select("o_custkey", F.left("o_orderpriority", F.lit(1)).alias("network"), F.year("o_orderdate").alias("year"), "o_totalprice")
    h = o.join(table(s, d, "customer").select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("scenario")), "o_custkey").groupBy("network", "year", "scenario").agg((F.sum("o_totalprice") / 1000).alias("hours"))
    m, v = F.avg("hours"), F.stddev_samp("hours")
    b = h.groupBy("network", "year").agg(m.alias("mean"), (m - 1.65 * v).alias("low"), (m + 1.65 * v).alias("high"))
    q = b.where("network = '1'").select("year", C("mean").alias("today"))
    return b.where("network <> '1'").join(q, "year").select("network", "year", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")], F.round(C("mean") - C("today"), 4).alias("change"))


@register("s5_geometry_texts", "SELECT s_suppkey, 3::BIGINT AS n_points, round(sqrt(pow(s_suppkey + 0.5 - 1, 2) + pow(s_acctbal - 2, 2)) + sqrt(pow(s_suppkey + 0.5, 2) + pow(s_acctbal + 7.25, 2)), 6) AS length FROM supplier")
def s5(s, d):
    text = F.concat(F.lit("LINESTRING Z (1 2 9.5, "), C("s_suppkey") + 0.5, F.lit(" "), C("s_acctbal"), F.lit(" 8, 0 -7.25 7)"))
    x = table(s, d, "supplier").select("s_suppkey", geometry.wkt_points(text).alias("p"))
    return x.select("s_suppkey", F.size("p").cast("long").alias("n_points"), F.round(X.line_length(C("p")), 6).alias("length"))


@register("s5_geopackage", """WITH r AS (SELECT c_custkey, c_name, c_acctbal, (c_custkey * 37 % 997)::DOUBLE AS ax, (c_custkey * 53 % 991)::DOUBLE AS ay, (c_custkey * 37 % 997 + c_custkey * 11 % 41 - 20)::DOUBLE AS qx, (c_custkey * 53 % 991 + c_custkey * 7 % 43 - 21)::DOUBLE AS qy FROM customer)
SELECT c_custkey, c_name, c_acctbal, 'LINESTRING' AS kind, 2::INT AS n_points, round(sqrt(pow(ax - qx, 2) + pow(ay - qy, 2)), 6) AS length FROM r WHERE least(ax, qx) <= 400 AND greatest(ax, qx) >= 100 AND least(ay, qy) <= 600 AND greatest(ay, qy) >= 200""")
def s5_geopackage(s, d):
    """A road for each customer in GeoPackages by strips of land; the roads whose envelope meets a box are read again."""
    k = C("c_custkey")
    x, y = k * 37 % 997, k * 53 % 991
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    line = F.array(F.array(point(x, y), point(x + k * 11 % 41 - 20, y + k * 7 % 43 - 21)))
    roads = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.floor(x / 100).alias("strip"), geopackage.points_wkb("LINESTRING", line).alias("geom"))
    geopackage.write_layer(roads.repartitionByRange("strip").drop("strip"), path := readers.scratch(s, "roads"), "roads", "geom")
    found = geopackage.read_layer(s, path, "roads", (100.0, 200.0, 400.0, 600.0)).withColumn("g", geopackage.wkb_parts(C("geom")))
    return found.select("c_custkey", "c_name", "c_acctbal", "g.kind", F.size(C("g.parts")[0]).alias("n_points"), F.round(X.line_length(C("g.parts")[0]), 6).alias("length"))


#: a straight road for each customer
ROADS = "l AS (SELECT c_custkey AS line, (c_custkey * 37 % 997)::DOUBLE AS ax, (c_custkey * 53 % 991)::DOUBLE AS ay, (c_custkey * 37 % 997 + c_custkey * 11 % 41 - 20)::DOUBLE AS qx, (c_custkey * 53 % 991 + c_custkey * 7 % 43 - 21)::DOUBLE AS qy FROM customer)"
G18N = f"""WITH RECURSIVE {ROADS},
x AS (SELECT a.line AS one, b.line AS two, ((b.ax - a.ax) * (b.qy - b.ay) - (b.ay - a.ay) * (b.qx - b.ax)) / ((a.qx - a.ax) * (b.qy - b.ay) - (a.qy - a.ay) * (b.qx - b.ax)) AS t, a.ax, a.ay, a.qx, a.qy
  FROM l a JOIN l b ON a.line < b.line AND abs(a.ax - b.ax) <= 42 AND abs(a.ay - b.ay) <= 44
  WHERE sign((b.qx - b.ax) * (a.ay - b.ay) - (b.qy - b.ay) * (a.ax - b.ax)) * sign((b.qx - b.ax) * (a.qy - b.ay) - (b.qy - b.ay) * (a.qx - b.ax)) < 0
    AND sign((a.qx - a.ax) * (b.ay - a.ay) - (a.qy - a.ay) * (b.ax - a.ax)) * sign((a.qx - a.ax) * (b.qy - a.ay) - (a.qy - a.ay) * (b.qx - a.ax)) < 0),
p AS (SELECT (one, two) AS id, [one, two] AS lines, ax + t * (qx - ax) AS x, ay + t * (qy - ay) AS y FROM x
  UNION ALL SELECT (line, -1::BIGINT), [line], ax, ay FROM l UNION ALL SELECT (line, -2::BIGINT), [line], qx, qy FROM l),
near AS (SELECT p.id AS a, q.id AS b FROM p JOIN p q ON p.id <> q.id AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 2),
reach AS (SELECT id AS a, id AS b FROM p UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
named AS (SELECT a AS id, min(b) AS node FROM reach GROUP BY a),
nodes AS (SELECT node, avg(x) AS x, avg(y) AS y FROM p JOIN named USING (id) GROUP BY node),
along AS (SELECT l.line, node, (p.x - ax) * (qx - ax) + (p.y - ay) * (qy - ay) AS pos FROM (SELECT id, x, y, unnest(lines) AS line FROM p) p JOIN named USING (id) JOIN l ON l.line = p.line),
hops AS (SELECT line, node AS u, lead(node) OVER (PARTITION BY line ORDER BY pos, node) AS v FROM along),
edges AS (SELECT DISTINCT line, least(u, v) AS u, greatest(u, v) AS v FROM hops WHERE v IS NOT NULL AND u <> v),
degree AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node)
SELECT node[1] AS line, node[2] AS other, round(x, 6) AS x, round(y, 6) AS y, coalesce(degree, 0)::BIGINT AS degree FROM nodes LEFT JOIN degree USING (node)"""


@register("g18_road_topology", G18N)
def g18_topology(s, d):
    """Roads split where they cross; ends and crossings no farther than two metres apart are one node. A node is named by its least line, and the line it crosses or -1 and -2 for ends."""
    k = C("c_custkey")
    x, y = k * 37 % 997, k * 53 % 991
    roads = table(s, d, "customer").select(k.alias("line"), *[v.cast("double").alias(n) for n, v in (("ax", x), ("ay", y), ("bx", x + k * 11 % 41 - 20), ("by", y + k * 7 % 43 - 21))])
    nodes, _ = G.noded(roads, 2.0, 40.0)
    return nodes.select(C("node.one").alias("line"), C("node.two").alias("other"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "degree")
