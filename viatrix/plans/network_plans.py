"""Queries of graphs and scalar functions (G, S, X)."""

from pyspark.sql import functions as F

from viatrix.functions import exprs as X
from viatrix.operators import network as N, relational as R, routing as P
from viatrix.plans import domain as D
from viatrix.plans.registry import register
from viatrix.plans.relational_plans import PATH, paths
from viatrix.session import table

C = F.col
#: parallel runs of one service and direction with time by service, as edges of the transit graph
SUBS = f"""{D.SERVICES},
s AS (SELECT DISTINCT from_node, to_node, service, direction, tt FROM services),
ride AS (SELECT 'sub_' || from_node || '_' || service || '_' || direction AS u, 'sub_' || to_node || '_' || service || '_' || direction AS v, min(tt)::DOUBLE AS w, 'ride' AS kind FROM s GROUP BY ALL),
stops AS (SELECT from_node AS station, 'sub_' || from_node || '_' || service || '_' || direction AS sub FROM s UNION SELECT to_node, 'sub_' || to_node || '_' || service || '_' || direction FROM s),
graph AS (SELECT * FROM ride UNION ALL SELECT 'entry_' || station, sub, 3.0, 'board' FROM stops UNION ALL SELECT sub, 'exit_' || station, 3.0, 'alight' FROM stops
  UNION ALL SELECT a.sub, b.sub, 12.0, 'change' FROM stops a JOIN stops b ON a.station = b.station AND a.sub <> b.sub)"""


def transit(s, d):
    """The transit graph of today; its rows are few and used by every kind of edge, so they are saved."""
    x = D.services(s, d).select(F.lit("sq").alias("graph_id"), "from_node", "to_node", "service", "direction", C("tt").cast("double").alias("time")).distinct()
    return N.transit_graph(N.saved(x))


@register("g1_transit_graph", f"WITH {SUBS} SELECT 'sq' AS graph_id, u, v, w, kind FROM graph")
def g1(s, d):
    return transit(s, d)


G3 = f"WITH RECURSIVE {D.SHORTEST} SELECT src AS from_id, node AS to_id, d AS time, n_name AS from_station FROM best JOIN nation ON src = n_nationkey"


@register("g3_all_pairs_times", G3)
def g3(s, d):
    t = D.sq_times(s).select(C("src").alias("from_id"), C("node").alias("to_id"), C("d").alias("time"))
    return R.role_join(t, table(s, d, "nation"), "n_nationkey", "n_name", {"from_id": "from_station"})


@register("g3_min_plus_times", f"WITH RECURSIVE {D.FAR} SELECT src, node, d FROM best")
def g3b(s, d):
    """Distances to blocks of sources, against the links."""
    e = D.net(s, d).select(F.lit(0).alias("graph_id"), C("v").alias("u"), C("u").alias("v"), C("tt").cast("double").alias("w"))
    return P.all_distances(e).where("goal <> node").select(C("goal").alias("src"), "node", "d")


@register("g6_closest_of_many", f"WITH RECURSIVE {D.SHORTEST}, t AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey % 7 = 0 THEN 0.0 END AS zero FROM nation) SELECT t.node, coalesce(zero, (SELECT min(d) FROM best WHERE best.node = t.node AND src % 7 = 0)) AS time FROM t")
def g6(s, d):
    e = D.edges(s).select(F.lit("sq").alias("graph_id"), "u", "v", C("tt").cast("double").alias("w"))
    trains = table(s, d, "nation").where("n_nationkey % 7 = 0").select(F.lit("sq").alias("graph_id"), F.lit(0).alias("src"), C("n_nationkey").alias("node"), F.lit(0.0).alias("d"))
    return N.min_plus(e, trains).select("node", C("d").alias("time"))


#: lines that share the links of the suppliers' network among them, a few links each
LINES = "m AS (SELECT DISTINCT (least(u, v) * 3 + greatest(u, v)) % n AS service, least(u, v) AS u, greatest(u, v) AS v FROM topo, size)"


def lines(s, d):
    """(service, u, v) of as many lines as suppliers, one direction."""
    n = table(s, d, "supplier").agg(F.count(F.lit(1)).cast("int").alias("n"))
    x = R.undirected(D.net(s, d)).join(F.broadcast(n))  # one row
    return x.select(((C("u") * 3 + C("v")) % C("n")).alias("service"), "u", "v").distinct()


@register("g12_end_stations", f"WITH {D.NET}, {LINES}, e AS (SELECT service, u AS node FROM m UNION ALL SELECT service, v FROM m) SELECT service, node FROM e GROUP BY ALL HAVING count(*) = 1")
def g12(s, d):
    m = lines(s, d)
    return m.select("service", F.explode(F.array("u", "v")).alias("node")).groupBy("service", "node").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


G14 = f"""WITH RECURSIVE {D.NET}, {LINES}, calls AS (SELECT DISTINCT service, unnest([u, v]) AS node FROM m),
ends AS (SELECT s_suppkey::INT AS node FROM supplier WHERE s_acctbal >= 1000), inside AS (SELECT s_suppkey::INT AS node FROM supplier WHERE s_nationkey < 12),
missing AS (SELECT a.u AS centre, a.v AS n1, b.v AS n2 FROM topo a JOIN topo b ON a.u = b.u AND a.v < b.v WHERE a.u IN (SELECT u FROM topo GROUP BY u HAVING count(*) > 2)
  AND NOT EXISTS (SELECT 1 FROM calls c JOIN calls e ON c.service = e.service WHERE c.node = a.v AND e.node = b.v) AND (a.v IN (SELECT node FROM inside) OR b.v IN (SELECT node FROM inside))),
starts AS (SELECT DISTINCT centre, node, list_filter(borders, lambda x: x <> node) AS avoid FROM (SELECT centre, unnest([n1, n2]) AS node FROM missing) JOIN (SELECT u AS centre, list(v) AS borders FROM topo GROUP BY u) USING (centre)),
walk AS (SELECT centre, node, avoid, [node] AS path, node AS tip FROM starts
  UNION ALL SELECT centre, node, avoid, list_append(path, v), v FROM walk JOIN topo ON tip = u WHERE tip NOT IN (SELECT node FROM ends) AND NOT list_contains(path, v) AND NOT list_contains(avoid, v)),
halves AS (SELECT centre, node, path FROM walk WHERE tip IN (SELECT node FROM ends)),
whole AS (SELECT m.centre, n1, n2, list_concat(list_reverse(b.path), a.path) AS path FROM missing m JOIN halves a ON a.centre = m.centre AND a.node = n1 JOIN halves b ON b.centre = m.centre AND b.node = n2
  WHERE NOT list_has_any(a.path[:len(a.path) - 1], b.path[:len(b.path) - 1])),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY centre, n1, n2) AS k FROM whole) WHERE k = 1)
SELECT 'X' || (row_number() OVER (ORDER BY centre, n1, n2, path) - 1) AS name, array_to_string(path, '-') AS line, centre, n1, n2 FROM once"""


@register("g14_new_lines", G14)
def g14(s, d):
    """Lines that join neighbours without a direct service, of two half lines to end stations, of any length."""
    net = N.saved(D.net(s, d).select("u", "v"))
    calls = lines(s, d).select("service", F.explode(F.array("u", "v")).alias("node"))
    of = lambda rule: table(s, d, "supplier").where(rule).select(C("s_suppkey").cast("int").alias("node"))
    x = N.new_lines(net, of("s_acctbal >= 1000"), N.missing_connections(net, calls, of("s_nationkey < 12")))
    return x.select("name", F.array_join(C("path").cast("array<string>"), "-").alias("line"), "centre", "n1", "n2")


#: a new link for each brand
NEW_LINKS = "n AS (SELECT dev_id, (dev_id % n)::INT AS u, ((dev_id * 5 + 9) % n)::INT AS v FROM (SELECT DISTINCT regexp_extract(p_brand, '[0-9]+')::INT AS dev_id FROM part), size)"


@register("g17_development_networks", f"WITH {D.NET}, {NEW_LINKS} SELECT dev_id, e.u, e.v, tt, 'No' AS new_dev FROM edges e CROSS JOIN n UNION ALL SELECT dev_id, u, v, 2, 'Yes' FROM n UNION ALL SELECT dev_id, v, u, 2, 'Yes' FROM n")
def g17(s, d):
    size = table(s, d, "supplier").agg(F.count(F.lit(1)).cast("int").alias("n"))  # one row
    n = table(s, d, "part").select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("dev_id")).distinct().join(F.broadcast(size))
    n = n.select("dev_id", (C("dev_id") % C("n")).alias("u"), ((C("dev_id") * 5 + 9) % C("n")).alias("v"))
    # each development's network is the feature: all links with each development, dealt by the plan and sent nowhere whole
    base = D.net(s, d).select("u", "v", "tt", F.lit("No").alias("new_dev")).join(n.select("dev_id"))
    new = n.select("dev_id", "u", "v", F.lit(2).alias("tt"), F.lit("Yes").alias("new_dev"))
    return base.select("dev_id", "u", "v", "tt", "new_dev").union(new).union(new.select("dev_id", "v", "u", "tt", "new_dev"))


S3 = f"WITH {PATH} SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE array_to_string(path, ',') END AS via FROM path"


@register("s3_via_parser", S3)
def s3(s, d):
    digits = F.array_join(F.transform("path", lambda n: F.array_join(F.split(n.cast("string"), ""), ",")), ",,,")
    plain = F.array_join(C("path").cast("array<string>"), ",")
    kind = C("l_orderkey") % 5
    raw = F.when(kind == 0, F.when(C("l_orderkey") % 2 == 0, "-99").otherwise("[-99]")).when(kind == 1, F.concat(F.lit("["), F.array_join(C("path").cast("array<string>"), ", "), F.lit("]"))).when((kind == 2) & (F.size("path") > 1), digits).otherwise(plain)
    return paths(s, d).select("l_orderkey", F.array_join(X.parse_via(raw).cast("array<string>"), ",").alias("via"))


S14 = f"""WITH {PATH}, h AS (SELECT l_orderkey AS line, unnest(range(1, len(path))) AS i, path AS st FROM path),
t AS (SELECT line, st[i] AS a, st[i + 1] AS b, (2 + (st[i] * 3 + st[i + 1] + i) % 9)::INT AS time FROM h) SELECT line, a, b, time, 'A' AS direction FROM t UNION ALL SELECT line, b, a, time, 'B' FROM t"""


@register("s14_add_service_line", S14)
def s14(s, d):
    """A line for each order, whose stations and minutes come as two lists; its runs in both directions."""
    minutes = F.transform(F.slice("path", 2, F.array_size("path") - 1), lambda n, i: 2 + (F.get("path", i) * 3 + n + i + 1) % 9)
    line = paths(s, d).where("size(path) > 1").select(C("l_orderkey").alias("line"), "path", minutes.alias("tt"))
    h = R.explode_path(line, "path", "line", "tt").select("line", C("from_node").alias("a"), C("to_node").alias("b"), F.get("tt", C("hop")).alias("time"))
    return R.mirror(h, "a", "b")


@register("x1_lenient_numbers", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS size, CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE 0.0 END AS price FROM part")
def x1(s, d):
    return table(s, d, "part").select("p_partkey", X.int_or_zero(F.when(C("p_size") % 2 == 0, C("p_size").cast("string")).otherwise("n/a")).alias("size"), X.comma_float(F.when(C("p_size") % 3 == 0, F.translate(C("p_retailprice").cast("string"), ".", ",")).otherwise("x")).alias("price"))


@register("x2_half_even", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(l_quantity / 2, 0)::INT AS minutes FROM lineitem")
def x2(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", X.minutes(C("l_quantity") / 2).alias("minutes"))


@register("x4_frequency_format", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN (s_suppkey)::VARCHAR WHEN 2 THEN (s_suppkey)::VARCHAR || '.5' ELSE (s_suppkey)::VARCHAR || '.333' END AS f FROM supplier")
def x4(s, d):
    k = C("s_suppkey") % 4
    f = F.when(k == 1, C("s_suppkey").cast("double")).when(k == 2, C("s_suppkey") + 0.5).when(k == 3, C("s_suppkey") + 1 / 3)
    return table(s, d, "supplier").select("s_suppkey", X.format_frequency(f).alias("f"))


@register("x5_service_cells", f"WITH {D.SERVICES} SELECT from_node AS node, service, max(frequency)::DOUBLE AS frequency FROM services GROUP BY ALL")
def x5(s, d):
    cell = F.concat("service", F.lit("."), C("frequency").cast("double").cast("string"))  # '12.0' has a dot of its own
    text = D.services(s, d).groupBy(C("from_node").alias("node")).agg(F.array_join(F.collect_list(cell), ", ").alias("cells"))
    return text.select("node", F.explode(X.service_cells(C("cells"))).alias("c")).groupBy("node", C("c.service").alias("service")).agg(F.max("c.frequency").alias("frequency"))


@register("x5_direction_cells", f"WITH {D.SERVICES} SELECT from_node AS node, service, direction, max(frequency)::DOUBLE + 0.5 AS frequency FROM services GROUP BY ALL")
def x5b(s, d):
    cell = F.concat_ws(".", "service", "direction", (C("frequency") + 0.5).cast("string"))
    text = D.services(s, d).groupBy(C("from_node").alias("node")).agg(F.array_join(F.collect_list(cell), "; ").alias("cells"))
    return text.select("node", F.explode(X.service_direction_cells(C("cells"))).alias("c")).select("node", "c.service", "c.direction", "c.frequency")


@register("x6_segment_key", f"WITH {D.NET} SELECT u, v, least(u, v) || '-' || greatest(u, v) AS segment FROM topo")
def x6(s, d):
    return D.net(s, d).select("u", "v", X.segment_key(F.concat_ws("-", "u", "v")).alias("segment"))


@register("x7_strings", "SELECT p_partkey, p_partkey::INT AS dev, regexp_replace(p_name, '[^a-zA-Z0-9_-]+', '_', 'g') AS label FROM part")
def x7(s, d):
    name = F.concat(F.lit("Development_"), "p_partkey")
    return table(s, d, "part").select("p_partkey", F.regexp_extract(name, "Development_(\\d+)", 1).cast("int").alias("dev"), F.regexp_replace("p_name", "[^a-zA-Z0-9_-]+", "_").alias("label"))


@register("x8_line_name", "SELECT p_partkey, CASE WHEN p_partkey < 1000 THEN p_partkey || '_' || p_brand ELSE 'X' || (p_partkey - 1000) END AS line FROM part")
def x8(s, d):
    return table(s, d, "part").select("p_partkey", X.line_name(C("p_partkey") + 100000, C("p_brand")).alias("line"))


@register("x12_line_length", f"WITH {PATH}, h AS (SELECT l_orderkey, path, unnest(range(1, len(path))) AS i FROM path) SELECT l_orderkey, round(sum(sqrt(pow(path[i] % 5 - path[i+1] % 5, 2) + pow(path[i] // 5 - path[i+1] // 5, 2))), 6) AS length FROM h GROUP BY ALL")
def x12(s, d):
    points = F.transform("path", lambda n: F.struct((n % 5).cast("double").alias("x"), F.floor(n / 5).cast("double").alias("y")))
    return paths(s, d).where("size(path) > 1").select("l_orderkey", F.round(X.line_length(points), 6).alias("length"))


@register("x17_coordinate_offsets", "SELECT n_nationkey, n_nationkey * 1000 + 2000000 AS e, n_nationkey * 500 + 1000000 AS n FROM nation")
def x17(s, d):
    return table(s, d, "nation").select("n_nationkey", (C("n_nationkey") * 1000 + 2000000).alias("e"), (C("n_nationkey") * 500 + 1000000).alias("n"))
