"""Line sections in order and split where a service changes how it stops; corridors, enrichment and tracks enough for the load."""

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from viatrix.functions.exprs import capacity
from viatrix.operators.value import intervention
from viatrix.session import discard, written


def ranked(arcs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(network, a, b, last_a, last_b, hops, least, low, ends) of arcs (network, a, b, c, least, low), by pointer jumping; and the tables of written() that it reads.

    An arc leads from a to b and on to the arc from b to c; c is null where the list ends. Each round an arc takes over what the
    arc that it points to knows, so that after round k it knows of 2**k arcs: the last of them, how many lie ahead, and the
    least segment and node among them. What has come to an end is told and moves no more. A ring has no end: once 2**k exceeds the number of
    all arcs, ``ends`` is false for arcs of rings.
    """
    on = F.col("c").isNotNull()
    state = arcs.select(
        "network", "a", "b", F.when(on, F.col("b")).otherwise(F.col("a")).alias("last_a"), F.when(on, F.col("c")).otherwise(F.col("b")).alias("last_b"),
        on.cast("long").alias("hops"), "least", "low", (~on).alias("ends"),
    )
    tables, reach = [written(state)], 1
    total = tables[0].count()

    def known() -> DataFrame:
        return reduce(DataFrame.unionByName, [t.where("ends") for t in tables[:-1]], tables[-1])

    while reach <= 2 * total and not (open_ := tables[-1].where("not ends")).isEmpty():
        ahead = known().select("network", F.col("a").alias("last_a"), F.col("b").alias("last_b"), F.col("last_a").alias("xa"), F.col("last_b").alias("xb"), F.col("hops").alias("more"), F.col("least").alias("other"), F.col("low").alias("lower"), F.col("ends").alias("done"))
        moved = open_.join(ahead, ["network", "last_a", "last_b"])
        moved = moved.select("network", "a", "b", F.col("xa").alias("last_a"), F.col("xb").alias("last_b"), (F.col("hops") + F.col("more")).alias("hops"), F.least("least", "other").alias("least"), F.least("low", "lower").alias("low"), F.col("done").alias("ends"))
        tables.append(written(moved))
        reach *= 2
    return known(), tables


def chains(segments: DataFrame) -> DataFrame:
    """(network, section, u, v, from_node, to_node, at): segments in their sections, and where they stand in them.

    segments: network, u < v, tracks, and tokens where services matter. A section is a longest chain of segments of equal tracks and tokens
    through nodes of two segments; its name is made of its tracks and smallest segment. Each segment makes two arcs,
    and lists of arcs are ranked by pointer jumping: no task holds a network or a section. A chain begins at its smaller
    end; a section that ends where it began, at its smallest node, towards the smaller neighbour.
    """
    told = segments if "tokens" in segments.columns else segments.withColumn("tokens", F.lit(""))
    ends = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    # all segments of a section have its tracks, so the least one tells them too
    arcs = written(told.select("network", F.struct("u", "v", "tracks").alias("least"), F.struct("tracks", "tokens").alias("kind"), F.explode(ends).alias("e")).select("network", "e.a", "e.b", "least", "kind"))
    # at a node of two segments of one kind, the arc into it goes on along the other
    beside = arcs.groupBy("network", F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("x"), F.max("b").alias("y"), F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    through = beside.where("n = 2 and lo <=> hi").select("network", "b", "x", "y")
    lists = arcs.drop("kind").join(through, ["network", "b"], "left").select("network", "a", "b", F.when(F.col("x") == F.col("a"), F.col("y")).otherwise(F.col("x")).alias("c"), "least", F.least("a", "b").alias("low"))
    first, tables = ranked(lists)
    # rings, and chains from a node back to it, are cut at their smallest node
    back = first.select("network", F.col("b").alias("a"), F.col("a").alias("b"), F.col("last_b").alias("start"), F.col("hops").alias("before"), F.col("least").alias("least_back"), F.col("low").alias("low_back"))
    both = first.join(back, ["network", "a", "b"]).withColumns({"least": F.least("least", "least_back"), "low": F.least("low", "low_back"), "closed": ~F.col("ends") | (F.col("last_b") == F.col("start"))})
    # of the two ways along an open chain the one from its smaller end
    both = written(both.where("closed or start < last_b").select("network", "a", "b", "least", "low", "before", "closed"))
    discard(arcs, *tables)
    open_ = both.where("not closed").select("network", "a", "b", "least", F.col("before").alias("at"))
    ring = both.where("closed").select("network", "a", "b", "least", "low")
    if not ring.isEmpty():
        # where such a chain was closed by a node with other segments, it goes on there as a ring does
        ends_at = ring.select("network", "least", F.col("a").alias("from_a"), F.col("b").alias("from_b"))
        onward = ring.join(ends_at.select("network", "least", F.col("from_a").alias("b"), F.col("from_b").alias("c")), ["network", "least", "b"]).where("c <> a")
        cut = written(onward.select("network", "a", "b", F.when(F.col("b") == F.col("low"), None).otherwise(F.col("c")).alias("c"), "least", "low"))
        again, _ = ranked(cut)
        size = ring.groupBy("network", "least").agg((F.count(F.lit(1)) / 2).cast("long").alias("n"))
        # of the two ways round the one that leaves the smallest node for its smaller neighbour
        leaves = cut.where("a = low").groupBy("network", "least").agg(F.min("b").alias("to"))
        way = again.join(cut.select("network", "a", "b", F.col("least").alias("of")), ["network", "a", "b"]).drop("least").withColumnRenamed("of", "least")
        # the last arc of either way enters the smallest node; it comes from the neighbour that the way did not leave for
        last = leaves.join(cut.where("b = low").select("network", "least", F.col("a").alias("last_a")), ["network", "least"]).where("last_a <> to").select("network", "least", "last_a")
        way = way.join(last, ["network", "least", "last_a"]).join(size, ["network", "least"])
        open_ = open_.union(way.select("network", "a", "b", "least", (F.col("n") - 1 - F.col("hops")).alias("at")))
    tracks = F.col("least.tracks")
    text = F.when(tracks == F.floor(tracks), F.floor(tracks).cast("string")).otherwise(tracks.cast("double").cast("string"))
    return open_.select("network", F.concat_ws("-", text, "least.u", "least.v").alias("section"), F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.col("a").alias("from_node"), F.col("b").alias("to_node"), "at")


def section_paths(chained: DataFrame) -> DataFrame:
    """(network, section, path): the nodes of each section, in order, of chains()."""
    x = chained.groupBy("network", "section").agg(F.array_sort(F.collect_list(F.struct("at", "from_node", "to_node"))).alias("x"))
    return x.select("network", "section", F.concat(F.array(F.get("x", F.lit(0))["from_node"]), F.transform("x", lambda s: s["to_node"])).alias("path"))


def merged_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, points) of lines (key, points) of one key put together where two of them meet, and only two.

    Lines are taken apart into their segments, of which equal ones count once, and go on through points of two segments; so a line
    that others branch off from is cut there, and a closed one begins and ends at one point. Segments that cross between their
    ends are not split: spatial.noded() does that. Lines without a segment, and points with a null, are left out.
    """
    point = lambda p: F.concat_ws(" ", (p["x"] + F.lit(0.0)).cast("string"), (p["y"] + F.lit(0.0)).cast("string"))  # noqa: E731  0 and -0 are one place
    known = F.transform(F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull()), point)
    x = lines.select(F.col(key).alias("network"), known.alias("p")).where("size(p) > 1")
    x = x.select("network", F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))).alias("s")).where("s.a <> s.b")
    segments = x.select("network", F.least("s.a", "s.b").alias("u"), F.greatest("s.a", "s.b").alias("v")).distinct()
    paths = section_paths(chains(segments.withColumn("tracks", F.lit(1.0))))
    back = F.transform(F.transform("path", lambda n: F.split(n, " ")), lambda n: F.struct(n[0].cast("double").alias("x"), n[1].cast("double").alias("y")))
    return paths.select(F.col("network").alias(key), back.alias("points"))


def parts_of(calls: list[list[str]], from_path_start: bool) -> list[tuple[int, int]]:
    """(first node, number of nodes) of the parts of a path whose nodes are called at by these services."""
    before: dict[str, list[int]] = {s: [0] for s in sorted({s for c in calls for s in c})}  # stops before each node
    for c in calls:
        for service, n in before.items():
            n.append(n[-1] + (service in c))

    def pattern(n: list[int], a: int, i: int) -> str:
        """How a service stops from a to i: at all, at the two ends only, at some or at none."""
        stops = n[i + 1] - n[a]
        if stops in (0, i + 1 - a):
            return "all" if stops else "none"
        return "ends" if stops == 2 and n[a + 1] > n[a] and n[i + 1] > n[i] else "some"

    parts, start, last = [], 0, None
    for i in range(2, len(calls)):
        if i - start < 2:
            continue
        now = [pattern(n, 0 if from_path_start else start, i) for n in before.values()]
        if last is not None and now != last:
            parts.append((start, i - start))
            start, last = i - 1, None
        else:
            last = now
    return [*parts, (start, len(calls) - start)]


def split_by_pattern(paths: DataFrame, stops: DataFrame, from_path_start: bool = False) -> DataFrame:
    """(network, section, part, path): sections (network, section, path) cut where one more node would change a service's pattern.

    stops: network, node, service. Patterns are told from three nodes on, of the part that grows; with
    from_path_start of the path from its first node, as older results have it. A path that no service
    stops on stays whole.
    """
    nodes = paths.select("network", "section", F.posexplode("path").alias("at", "node"))
    calls = stops.groupBy("network", "node").agg(F.collect_set(F.col("service").cast("string")).alias("calls"))  # services of one node
    known = nodes.join(calls, ["network", "node"], "left").select("network", "section", F.struct("at", "node", F.coalesce("calls", F.array().cast("array<string>")).alias("calls")).alias("x"))
    known = known.groupBy("network", "section").agg(F.array_sort(F.collect_list("x")).alias("x")).select("network", "section", "x.node", "x.calls")

    def run(batches):
        for batch in batches:  # many sections each
            parts = [parts_of(c, from_path_start) for c in batch.column(3).to_pylist()]
            first, n = ([[p[i] for p in of] for of in parts] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(first, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["network", "section", "path", "first", "n"])

    kinds = dict(paths.dtypes)
    cut = known.mapInArrow(run, f"network {kinds['network']}, section string, path {kinds['path']}, first array<int>, n array<int>")
    cut = cut.select("network", "section", "path", F.posexplode(F.arrays_zip("first", "n")).alias("part", "p"))
    return cut.select("network", "section", "part", F.slice("path", F.col("p.first") + 1, F.col("p.n")).alias("path"))


def corridor_nodes(links: DataFrame, inside: DataFrame, new: DataFrame) -> DataFrame:
    """(node_set, node, new): stations of a corridor today ("baseline"), with those one link beyond it ("extended"), and with the ends of new links ("development").

    links (u, v) of today, inside (node), new (u, v). new marks stations that no link of today reaches.
    """
    ends = lambda x: x.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    served = ends(links)
    within = served.join(inside, "node", "left_semi")
    u, v = within.withColumnRenamed("node", "u"), within.withColumnRenamed("node", "v")
    beyond = ends(links.join(u, "u", "left_semi").union(links.join(v, "v", "left_semi").select("u", "v")))
    named = lambda x, name: x.select(F.lit(name).alias("node_set"), "node")
    sets = named(within, "baseline").union(named(within, "extended")).union(named(beyond, "extended")).union(named(within, "development")).union(named(ends(new), "development")).distinct()
    return sets.join(served.withColumn("served", F.lit(True)), "node", "left").select("node_set", "node", F.col("served").isNull().alias("new"))


def enriched(now: DataFrame, known: DataFrame, better: DataFrame, key: list[str], default: dict[str, Column]) -> DataFrame:
    """now with its infrastructure: known values, where demand (tph) has grown the better ones, and defaults where there are none.

    known has key, tph and the columns of default, better has key and these columns; both have one row a key at most.
    """
    old = known.select(*key, F.col("tph").alias("_before"), *[F.col(c).alias(f"_known_{c}") for c in default])
    new = better.select(*key, F.lit(True).alias("_better"), *[F.col(c).alias(f"_better_{c}") for c in default])
    x = now.join(old, key, "left").join(new, key, "left")
    grown, stays = F.col("tph") > F.col("_before"), F.col("_before").isNotNull()
    chosen = [F.when(stays & ~grown, F.col(f"_known_{c}")).when(stays & grown & F.col("_better"), F.col(f"_better_{c}")).otherwise(value).alias(c) for c, value in default.items()]
    return x.select(*now.columns, *chosen)


def strategies(n: Column) -> Column:
    """Ways of grouping that n trains are offered."""
    some = lambda *names: F.array(*map(F.lit, names))
    return F.when(n >= 6, some("bad", "base", "good")).when(n >= 4, some("bad", "good")).when(n >= 2, some("bad")).otherwise(F.array().cast("array<string>"))


def enough_tracks(sections: DataFrame, spare: float, rounds: int) -> DataFrame:
    """sections with tracks, rounds, capacity and enough: interventions are applied to a section until its capacity exceeds its load by ``spare``.

    sections: id, tracks, stop, pass, n_stop, n_pass, load, segments, length. No section depends on another, so each goes through
    its rounds in its own row, and capacity is computed anew from the tracks of the round before.
    """

    def of(tracks: Column) -> Column:
        return capacity(tracks, F.col("stop"), F.col("pass"), F.col("n_stop"), F.col("n_pass")).cast("double")

    def one(state: Column, _: Column) -> Column:
        short = state["capacity"] - F.col("load") < spare
        added = intervention(F.col("segments"), state["tracks"], F.col("length"), F.lit(0))[1]
        tracks = F.when(short, state["tracks"] + added).otherwise(state["tracks"])
        return F.struct(tracks.alias("tracks"), (state["rounds"] + short.cast("int")).alias("rounds"), of(tracks).alias("capacity"))

    start = F.struct(F.col("tracks").cast("double").alias("tracks"), F.lit(0).alias("rounds"), of(F.col("tracks")).alias("capacity"))
    x = sections.withColumn("_end", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one))
    return x.drop("tracks").select("*", "_end.*").drop("_end").withColumn("enough", F.col("capacity") - F.col("load") >= spare)
