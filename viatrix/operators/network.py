"""Graph operators on edge tables."""

import heapq
import itertools
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from viatrix.session import saved


def min_plus(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Shortest distances (graph_id, src, node, d) from sources (graph_id, src, node, d) over edges (graph_id, u, v, w).

    One join and one grouping a round; only the frontier of nodes that came nearer goes on. Ends as soon as none does,
    however many edges the paths have; raises ValueError if a cycle of negative length goes on for ever.
    """
    state = frontier = saved(sources.groupBy("graph_id", "src", "node").agg(F.min("d").alias("d")))
    for i in itertools.count(1):
        step = frontier.join(edges.withColumnRenamed("u", "node"), ["graph_id", "node"]).select("graph_id", "src", F.col("v").alias("node"), (F.col("d") + F.col("w")).alias("d"))
        step = step.groupBy("graph_id", "src", "node").agg(F.min("d").alias("new"))
        state = state.join(step, ["graph_id", "src", "node"], "full").select("graph_id", "src", "node", F.least("d", "new").alias("d"), (F.col("new") < F.coalesce("d", F.lit(float("inf")))).alias("nearer"))
        state = saved(state)
        frontier = state.where("nearer").drop("nearer")
        state = state.drop("nearer")
        if frontier.isEmpty():
            return state
        # no shortest path has more edges than there are nodes to reach; short ones are done before that count is worth it
        if i % 64 == 0 and i > edges.select("v").distinct().count():
            raise ValueError("edges have a cycle of negative length")


def transit_graph(services: DataFrame) -> DataFrame:
    """Edges (graph_id, u, v, w, kind) between entry, exit and service nodes of stations.

    services: graph_id, from_node, to_node, service, direction, time, and nth where rows have an order. Boarding and
    alighting take 3, a change between any two services of a station 12 minutes. Of rows of one service, direction and pair of
    stations the last one's time counts; without an order the shortest.
    """
    told = F.bround("time")
    time = F.max_by(told, "nth") if "nth" in services.columns else F.min(told)
    sub = lambda c: F.concat_ws("_", F.lit("sub"), c, F.col("service"), F.col("direction"))
    ride = services.where("time is not null").groupBy("graph_id", sub(F.col("from_node")).alias("u"), sub(F.col("to_node")).alias("v")).agg(time.alias("w")).withColumn("kind", F.lit("ride"))
    ends = [services.select("graph_id", F.col(c).alias("station"), sub(F.col(c)).alias("sub")) for c in ("from_node", "to_node")]
    stops = ends[0].union(ends[1]).distinct()
    board = stops.select("graph_id", F.concat(F.lit("entry_"), "station").alias("u"), F.col("sub").alias("v"), F.lit(3.0).alias("w"), F.lit("board").alias("kind"))
    alight = stops.select("graph_id", F.col("sub").alias("u"), F.concat(F.lit("exit_"), "station").alias("v"), F.lit(3.0).alias("w"), F.lit("alight").alias("kind"))
    other = stops.select("graph_id", "station", F.col("sub").alias("v"))
    change = stops.withColumnRenamed("sub", "u").join(other, ["graph_id", "station"]).where("u <> v").select("graph_id", "u", "v", F.lit(12.0).alias("w"), F.lit("change").alias("kind"))
    return ride.unionByName(board).unionByName(alight).unionByName(change)


def all_times(edges: DataFrame) -> DataFrame:
    """(graph_id, src, node, d) for all pairs of each graph, one task a graph: many small networks.

    For one large network use min_plus, and for paths graph_search.paths_between.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = defaultdict(dict)
        for u, v, w in zip(pdf.u.tolist(), pdf.v.tolist(), pdf.w.tolist()):
            out[u][v] = min(w, out[u].get(v, float("inf")))
        rows = []
        for src in sorted({*pdf.u.tolist(), *pdf.v.tolist()}):
            best, heap, done = {src: 0.0}, [(0.0, src)], set()
            while heap:
                d, u = heapq.heappop(heap)
                if u in done:
                    continue
                done.add(u)
                for v, w in out[u].items():
                    if d + w < best.get(v, float("inf")):
                        best[v] = d + w
                        heapq.heappush(heap, (d + w, v))
            rows += [(key[0], src, node, d) for node, d in best.items()]
        return pd.DataFrame(rows, columns=["graph_id", "src", "node", "d"])

    kind = dict(edges.dtypes)["u"]
    return edges.groupBy("graph_id").applyInPandas(run, f"graph_id {dict(edges.dtypes)['graph_id']}, src {kind}, node {kind}, d double")


def assign_transit_flows(paths: DataFrame, trips: DataFrame) -> DataFrame:
    """Loads (from_node, to_node, service, direction, flow) of the rides on a transit graph's shortest paths.

    paths (o, d, path) between entry and exit nodes, trips (o, d, trips) between stations. Boarding, alighting and changing load
    nothing; trips without a path load nothing either. Station names hold no underscore.
    """
    from viatrix.operators.relational import explode_path

    wanted = trips.where("o <> d and trips > 0").select(F.concat(F.lit("entry_"), "o").alias("o"), F.concat(F.lit("exit_"), "d").alias("d"), "trips")
    hops = explode_path(wanted.join(paths.select("o", "d", "path"), ["o", "d"]), "path", "trips")
    part = lambda c, i: F.regexp_extract(c, "^sub_([^_]*)_(.*)_([^_]*)$", i)
    told = hops.where("from_node like 'sub%' and to_node like 'sub%'").select(part("from_node", 1).alias("from_node"), part("to_node", 1).alias("to_node"), part("from_node", 2).alias("service"), part("from_node", 3).alias("direction"), "trips")
    return told.where("from_node <> to_node").groupBy("from_node", "to_node", "service", "direction").agg(F.sum("trips").alias("flow"))


def half_lines(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(centre, node, path): every path without repeats from a start to the first end station on it, however long.

    edges (u, v); starts (centre, node, avoid), with the nodes that its paths don't touch; ends (node). A start that is an end station is a
    path by itself. Nodes from which no end station can be reached are left out first; the frontier goes on until it is empty.
    """
    ends = saved(ends.select("node").distinct())
    useful = reached = ends
    back = saved(edges.select(F.col("v").alias("node"), F.col("u").alias("before")).distinct())
    while not reached.isEmpty():  # a round for each link of distance to an end station
        reached = saved(reached.join(back, "node").select(F.col("before").alias("node")).distinct().join(useful, "node", "left_anti"))
        useful = saved(useful.union(reached).coalesce(8))
    step = edges.select(F.col("u").alias("tip"), F.col("v").alias("to")).distinct()
    step = saved(step.join(useful.select(F.col("node").alias("to")), "to").join(ends.select(F.col("node").alias("to"), F.lit(True).alias("last")), "to", "left").select("tip", "to", F.coalesce("last", F.lit(False)).alias("last")))
    start = starts.join(ends.withColumn("last", F.lit(True)), "node", "left").select("centre", "node", "avoid", F.array("node").alias("path"), F.coalesce("last", F.lit(False)).alias("last"))
    paths = saved(start)
    out = paths.where("last").select("centre", "node", "path")
    while not (front := paths.where("not last")).isEmpty():
        on = front.withColumn("tip", F.element_at("path", -1)).join(step.withColumnRenamed("last", "ended"), "tip").where("not array_contains(path, to) and not array_contains(avoid, to)")
        paths = saved(on.select("centre", "node", "avoid", F.concat("path", F.array("to")).alias("path"), F.col("ended").alias("last")))
        out = out.union(paths.where("last").select("centre", "node", "path"))
    return out


def new_lines(edges: DataFrame, ends: DataFrame, missing: DataFrame) -> DataFrame:
    """(name, path, centre, n1, n2): lines over missing connections (centre, n1, n2), each of two half lines that end at end stations (node).

    Half lines from n1 and from n2 touch no other neighbour of the centre. Two of them make a line if they have no node in common but
    for their ends; it runs from the end of n2's to that of n1's. A path is named once, for its first connection in order, as X and a number.
    """
    from viatrix.operators.relational import keep_first, surrogate

    missing = saved(missing.select("centre", "n1", "n2").distinct())
    beside = edges.select(F.col("u").alias("centre"), "v").groupBy("centre").agg(F.collect_set("v").alias("borders"))  # neighbours of one node
    nodes = missing.select("centre", F.explode(F.array("n1", "n2")).alias("node")).distinct().join(beside, "centre")
    halves = saved(half_lines(edges, nodes.select("centre", "node", F.array_remove("borders", F.col("node")).alias("avoid")), ends))
    both = missing.join(halves.select("centre", F.col("node").alias("n1"), F.col("path").alias("a")), ["centre", "n1"]).join(halves.select("centre", F.col("node").alias("n2"), F.col("path").alias("b")), ["centre", "n2"])
    inner = lambda c: F.slice(c, 1, F.size(c) - 1)
    whole = both.where(~F.arrays_overlap(inner("a"), inner("b"))).select("centre", "n1", "n2", F.concat(F.reverse("b"), "a").alias("path"))
    once = keep_first(whole, ["path"], F.col("centre"), F.col("n1"), F.col("n2"))
    numbered = surrogate(once, "i", 0, F.col("centre"), F.col("n1"), F.col("n2"), F.col("path"))
    return numbered.select(F.concat(F.lit("X"), "i").alias("name"), "path", "centre", "n1", "n2")


def via_nodes(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(u, v, via) of new links (u, v): the nodes between its ends on the shortest path over edges (u, v, w), as "[a,b]".

    -99 stands where there is no node between or no path; a link with an end that the network lacks is left out.
    """
    from viatrix.operators.routing import few_paths_on

    graph = edges.select(F.lit(0).alias("graph_id"), "u", "v", "w")
    known = edges.select(F.col("u").alias("n")).union(edges.select("v")).distinct()
    wanted = wanted.select("u", "v").join(known.withColumnRenamed("n", "u"), "u", "left_semi").join(known.withColumnRenamed("n", "v"), "v", "left_semi")
    paths = few_paths_on(graph, wanted.select(F.lit(0).alias("graph_id"), F.col("u").alias("o"), F.col("v").alias("d"))).select(F.col("o").alias("u"), F.col("d").alias("v"), "path")
    inner = F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))
    text = F.concat(F.lit("["), F.array_join(inner.cast("array<string>"), ","), F.lit("]"))
    return wanted.join(paths.hint("merge"), ["u", "v"], "left").select("u", "v", F.when(F.size("path") > 2, text).otherwise("-99").alias("via"))


def missing_connections(links: DataFrame, calls: DataFrame, inside: DataFrame) -> DataFrame:
    """(centre, n1, n2): neighbours of a node with more than two that no service has in common, one at least inside.

    links (u, v) in both directions, calls (node, service), inside (node).
    """
    links = links.select("u", "v").distinct()
    centre = links.groupBy(F.col("u").alias("centre")).agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("centre")
    border = centre.join(links.withColumnRenamed("u", "centre"), "centre")
    pairs = border.withColumnRenamed("v", "n1").join(border.withColumnRenamed("v", "n2"), "centre").where("n1 < n2")
    calls = calls.select("node", "service").distinct()
    both = pairs.select("n1", "n2").distinct().join(calls.toDF("n1", "service"), "n1").join(calls.toDF("n2", "service"), ["n2", "service"]).select("n1", "n2").distinct()
    within = inside.select("node").distinct().withColumn("within", F.lit(True))
    left = pairs.join(both, ["n1", "n2"], "left_anti").join(within.toDF("n1", "in1"), "n1", "left").join(within.toDF("n2", "in2"), "n2", "left")
    return left.where("in1 or in2").select("centre", "n1", "n2")


def edited(services: DataFrame, edits: DataFrame) -> DataFrame:
    """Services (from_node, to_node, service, frequency) of each variant after its edits.

    edits: variant, action, service, from_node, to_node, value. ``scale`` multiplies a service's frequency, ``drop``
    takes a service out, or its run between two stations if they are given, and ``add`` puts a run in.
    """
    e = lambda action, *names: edits.where(F.col("action") == action).select("variant", *names)
    variants = edits.select("variant").distinct()
    base = services.select("from_node", "to_node", "service", F.col("frequency").cast("double").alias("frequency")).join(F.broadcast(variants))  # a handful of variants
    scale = e("scale", "service", "value").groupBy("variant", "service").agg(F.product("value").alias("by"))
    gone = e("drop", "service", "from_node", "to_node")
    base = base.join(F.broadcast(scale), ["variant", "service"], "left").withColumn("frequency", F.col("frequency") * F.coalesce("by", F.lit(1.0)))  # a row an edit
    base = base.join(F.broadcast(gone.where("from_node is null").select("variant", "service").distinct()), ["variant", "service"], "left_anti")
    base = base.join(F.broadcast(gone.where("from_node is not null").distinct()), ["variant", "service", "from_node", "to_node"], "left_anti")
    names = ["variant", "from_node", "to_node", "service", "frequency"]
    return base.select(names).unionByName(e("add", "from_node", "to_node", "service", F.col("value").alias("frequency")).select(names))


def read_graphs(spark: SparkSession, glob: str, pattern: str, names: tuple[str, str, str] = ("FromNode", "ToNode", "TravelTime")) -> tuple[DataFrame, DataFrame]:
    """Edges (graph_id, u, v, w) of all readable files of a folder, and (graph_id) of those left out.

    A file is a ';' table with a header; graph_id is what pattern's group finds in its path. Times are rounded, half to even, and edges
    without one left out. A file that lacks one of the columns, or has a time that is no number, is left out whole.
    """
    files = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.input_file_name(), pattern, 1).alias("graph_id"), F.split(F.rtrim("value"), "\r?\n").alias("lines"))
    header = F.split(F.get("lines", F.lit(0)), ";")
    files = files.withColumns({n: F.array_position(header, n).cast("int") - 1 for n in names}).withColumn("good", F.least(*names) >= 0)
    rows = files.select("graph_id", "good", *names, F.explode(F.slice("lines", 2, F.size("lines"))).alias("line")).withColumn("f", F.split("line", ";"))
    u, v, w = (F.when(F.col("good"), F.get("f", F.col(n))) for n in names)
    rows = rows.select("graph_id", "good", u.alias("u"), v.alias("v"), F.trim(w).alias("text")).withColumn("w", F.bround(F.col("text").try_cast("double")))
    bad = rows.groupBy("graph_id").agg(F.max((~F.col("good") | F.col("w").isNull() & (F.col("text") != "")).cast("int")).alias("bad")).where("bad = 1").select("graph_id")
    return rows.join(bad, "graph_id", "left_anti").where("w is not null").select("graph_id", "u", "v", "w"), bad
