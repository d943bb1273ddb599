"""Domain relations derived from the test tables, in Spark and as SQL fragments for the oracle."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from viatrix.session import table

NODES = 25


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """(o, d, trips) between stations (nations)."""
    t = lambda n: table(spark, sf, n)
    facts = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    facts = facts.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("o")), F.col("o_custkey") == F.col("c_custkey"))
    facts = facts.join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("d")), F.col("l_suppkey") == F.col("s_suppkey"))
    return facts.groupBy("o", "d").agg(F.sum("l_quantity").alias("trips"))


TRIPS = """trips AS (SELECT c_nationkey AS o, s_nationkey AS d, sum(l_quantity) AS trips FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def topology(spark: SparkSession) -> DataFrame:
    """(u, v) of the fixed network of stations, both directions."""
    n = spark.range(NODES).select(F.col("id").cast("int").alias("u"))
    ring = n.select("u", ((F.col("u") + 1) % NODES).alias("v"))
    chord = n.where("u % 4 = 0").select("u", ((7 * F.col("u") + 3) % NODES).alias("v")).where("u <> v")
    one = ring.union(chord)
    return one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


TOPO = """one AS (SELECT i::INT AS u, ((i + 1) % 25)::INT AS v FROM range(25) r(i) UNION SELECT i::INT, ((7 * i + 3) % 25)::INT FROM range(25) r(i) WHERE i % 4 = 0 AND i <> (7 * i + 3) % 25),
topo AS (SELECT u, v FROM one UNION SELECT v, u FROM one)"""


def travel_time(u, v):
    return 1 + (F.least(u, v) * 7 + F.greatest(u, v) * 3) % 17


def edges(spark: SparkSession) -> DataFrame:
    """(u, v, tt)."""
    return topology(spark).withColumn("tt", travel_time(F.col("u"), F.col("v")))


EDGES = TOPO + """,
edges AS (SELECT u, v, (1 + (least(u, v) * 7 + greatest(u, v) * 3) % 17)::INT AS tt FROM topo)"""


def net(spark: SparkSession, sf: str) -> DataFrame:
    """(u, v, tt) of a network with a station for each supplier, both directions: a ring, and a link that goes far from each station."""
    x = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("u"))
    x = x.join(F.broadcast(x.agg(F.count(F.lit(1)).cast("int").alias("n"))))  # one row
    one = x.select("u", ((F.col("u") + 1) % F.col("n")).alias("v")).union(x.select("u", ((7 * F.col("u") + 3) % F.col("n")))).where("u <> v")
    both = one.union(one.select("v", "u")).distinct()
    return both.withColumn("tt", travel_time(F.col("u"), F.col("v")))


#: edges (u, v, tt) as net() has them, and size (n)
NET = """size AS (SELECT count(*)::INT AS n FROM supplier),
one AS (SELECT s_suppkey::INT AS u, ((s_suppkey + 1) % n)::INT AS v FROM supplier, size UNION SELECT s_suppkey::INT, ((7 * s_suppkey + 3) % n)::INT FROM supplier, size),
topo AS (SELECT u, v FROM one WHERE u <> v UNION SELECT v, u FROM one WHERE u <> v),
edges AS (SELECT u, v, (1 + (least(u, v) * 7 + greatest(u, v) * 3) % 17)::INT AS tt FROM topo)"""

#: distances on it: walks of so many links reach every station by the shortest way
FAR = NET + """,
walk AS (SELECT u AS src, v AS node, tt AS d, 1 AS hops FROM edges
  UNION SELECT w.src, e.v, min(w.d + e.tt)::INT, w.hops + 1 FROM walk w JOIN edges e ON w.node = e.u WHERE w.hops < 30 GROUP BY w.src, e.v, w.hops),
best AS (SELECT src, node, min(d)::DOUBLE AS d FROM walk WHERE src <> node GROUP BY ALL)"""


def od(spark: SparkSession, sf: str) -> DataFrame:
    """(o, d, trips) between the suppliers that stand one after the other in an order."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("int").alias("o"), F.lead("l_suppkey").over(by).cast("int").alias("d"), F.lead("l_quantity").over(by).alias("trips"))
    return x.where("o <> d").groupBy("o", "d").agg(F.sum("trips").alias("trips"))


OD = """od AS (SELECT o, d, sum(trips) AS trips FROM (SELECT l_suppkey::INT AS o, lead(l_suppkey) OVER w::INT AS d, lead(l_quantity) OVER w AS trips FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity)) WHERE o <> d GROUP BY ALL)"""


def speeds(spark: SparkSession, sf: str) -> DataFrame:
    """(row, col, speed) of a square raster with a cell for each customer, whose balance tells the speed; 0 can't be passed."""
    x = table(spark, sf, "customer").select("c_custkey", F.floor(F.abs("c_acctbal")).cast("long").alias("b"))
    x = x.join(F.broadcast(x.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("side"))))  # one row
    speed = F.when(F.col("b") % 7 == 0, 0).otherwise((F.col("b") % 3 + 1) * 10)
    return x.select(F.floor(F.col("c_custkey") / F.col("side")).cast("int").alias("row"), (F.col("c_custkey") % F.col("side")).cast("int").alias("col"), speed.cast("double").alias("speed"))


SPEEDS = """side AS (SELECT ceil(sqrt(count(*)))::BIGINT AS side FROM customer),
cell AS (SELECT (c_custkey // side)::INT AS "row", (c_custkey % side)::INT AS col,
  (CASE WHEN floor(abs(c_acctbal))::BIGINT % 7 = 0 THEN 0 ELSE (floor(abs(c_acctbal))::BIGINT % 3 + 1) * 10 END)::DOUBLE AS speed FROM customer, side)"""


def services(spark: SparkSession, sf: str) -> DataFrame:
    """(from_node, to_node, service, direction, frequency, tt): services on the topology, from the facts."""
    t = lambda n: table(spark, sf, n)
    f = t("lineitem").select("l_orderkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("service"))
    f = f.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", F.col("c_nationkey").alias("u")), F.col("o_custkey") == F.col("c_custkey"))
    f = f.join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("v")), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("u", "v", "service").agg(F.count(F.lit(1)).alias("n"))
    e = edges(spark).join(f, ["u", "v"], "left")
    return e.select(F.col("u").alias("from_node"), F.col("v").alias("to_node"), F.coalesce("service", F.lit("X")).alias("service"), F.when(F.col("u") < F.col("v"), "A").otherwise("B").alias("direction"), F.coalesce("n", F.lit(1)).cast("long").alias("frequency"), "tt")


SERVICES = EDGES + """,
counted AS (SELECT c_nationkey AS u, s_nationkey AS v, l_returnflag || l_linestatus AS service, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
services AS (SELECT e.u AS from_node, e.v AS to_node, coalesce(service, 'X') AS service, CASE WHEN e.u < e.v THEN 'A' ELSE 'B' END AS direction, coalesce(n, 1)::BIGINT AS frequency, tt
  FROM edges e LEFT JOIN counted c ON e.u = c.u AND e.v = c.v)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """(district, year, value): orders' totals by region and year."""
    t = lambda n: table(spark, sf, n)
    o = t("orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.groupBy("c_nationkey", "year").agg(F.sum("o_totalprice").alias("part"))  # few rows go on
    o = o.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy(F.col("r_name").alias("district"), "year").agg(F.sum("part").alias("value"))


PANEL = """panel AS (SELECT r_name AS district, year(o_orderdate)::INT AS year, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(row, col, value): customers' balances on a 100 x 100 grid."""
    c = table(spark, sf, "customer")
    return c.groupBy((F.col("c_custkey") % 100).cast("int").alias("row"), ((F.col("c_custkey") * 37 + F.floor(F.col("c_custkey") / 100) * 11) % 100).cast("int").alias("col")).agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("value"))


CELLS = """cells AS (SELECT (c_custkey % 100)::INT AS "row", ((c_custkey * 37 + c_custkey // 100 * 11) % 100)::INT AS col, sum(greatest(c_acctbal, 0.0)) AS value FROM customer GROUP BY ALL)"""


def developments(spark: SparkSession, sf: str) -> DataFrame:
    """(dev, n, length, cost): a development for each brand."""
    p = table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("dev")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p_size") * 100).alias("length"), F.sum("p_retailprice").alias("cost"))


DEVS = """devs AS (SELECT p_brand AS dev, count(*) AS n, sum(p_size * 100)::BIGINT AS length, sum(p_retailprice) AS cost FROM part GROUP BY ALL)"""

#: walks of up to so many hops reach every station
HOPS = 24
SHORTEST = EDGES + """,
walk AS (SELECT u AS src, v AS node, tt AS d, 1 AS hops FROM edges
  UNION SELECT w.src, e.v, min(w.d + e.tt)::INT, w.hops + 1 FROM walk w JOIN edges e ON w.node = e.u WHERE w.hops < 24 GROUP BY w.src, e.v, w.hops),
best AS (SELECT src, node, min(d)::DOUBLE AS d FROM walk WHERE src <> node GROUP BY ALL)"""


def sq_times(spark: SparkSession) -> DataFrame:
    """(src, node, d) between all stations today."""
    from viatrix.operators.network import all_times

    e = edges(spark).select(F.lit("sq").alias("graph_id"), "u", "v", F.col("tt").cast("double").alias("w"))
    return all_times(e).where("src <> node").select("src", "node", "d")
