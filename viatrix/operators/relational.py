"""Relational verbs with the null, order and tie rules of the appraisal tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from viatrix.session import discard, saved, written


def group_known(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Grouping that leaves null keys out."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(*aggregates)


def sum_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def first_by(x: Column, *order: Column) -> Column:
    """The first non-null value in a stated order."""
    return F.min_by(x, F.when(x.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])))


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key: the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_n(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def role_join(facts: DataFrame, dimension: DataFrame, key: str, value: str, roles: dict[str, str]) -> DataFrame:
    """One left join for each role a dimension plays: roles maps the facts' columns to new names."""
    for column, name in roles.items():
        d = dimension.select(F.col(key).alias(f"_{name}"), F.col(value).alias(name))
        facts = facts.join(d, facts[column] == d[f"_{name}"], "left").drop(f"_{name}")
    return facts


def undirected(df: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Ends in ascending order."""
    return df.withColumns({u: F.least(u, v), v: F.greatest(u, v)})


def merge_edges(df: DataFrame, frequency: str, time: str, *order: Column) -> DataFrame:
    """Parallel edges in both directions become one: sums, and the first service in order."""
    return undirected(df).groupBy("u", "v").agg(F.sum(frequency).alias("frequency"), F.sum(time).alias("time"), first_by(F.col("service"), *order).alias("service"))


def explode_path(df: DataFrame, path: str, *keep: str) -> DataFrame:
    """Hops (from_node, to_node, hop) of an array of nodes."""
    pairs = F.arrays_zip(F.slice(path, 1, F.array_size(path) - 1).alias("a"), F.slice(path, 2, F.array_size(path) - 1).alias("b"))
    return df.where(F.array_size(path) >= 2).select(*keep, F.posexplode(pairs).alias("hop", "p")).select(*keep, "hop", F.col("p.a").alias("from_node"), F.col("p.b").alias("to_node"))


def mirror(df: DataFrame, a: str, b: str, via: str | None = None) -> DataFrame:
    """Rows and their reverse, direction A and B."""
    changed = {a: F.col(b), b: F.col(a)} | ({via: F.reverse(via)} if via else {})
    return df.withColumn("direction", F.lit("A")).unionByName(df.select(*[changed.get(c, F.col(c)).alias(c) for c in df.columns]).withColumn("direction", F.lit("B")))


def complete(df: DataFrame, keys: DataFrame, on: Sequence[str], fill: dict[str, float]) -> DataFrame:
    """A row for every key, with fill where df has none."""
    return keys.join(df, list(on), "left").na.fill(fill)


def surrogate(df: DataFrame, name: str, base: int, *order: Column) -> DataFrame:
    """Numbers from base on in a total order: rows are dealt by ranges of the order and numbered within, behind the sizes of the ranges before."""
    part, before = "_part", "_before"
    dealt = saved(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    sizes = sizes.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias(before))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(name, nth).join(F.broadcast(sizes), part).withColumn(name, F.col(name) - 1 + F.col(before) + base).drop(part, before)


def nearest(points: DataFrame, key: Sequence[str], sites: DataFrame, radius: float) -> DataFrame:
    """points (key, ax, ay) with the id and distance of their nearest site (id, bx, by); of equally near ones the smallest id.

    Places count once, however many points or sites share them. Squares of land that hold sites are halved round by round: a place keeps those that
    may hold its nearest site, which no other square is sure to come nearer than, until squares are smaller than the radius and hold few
    sites each. So what a place meets depends neither on how far away nor on how crowded the sites are.
    """
    C, kind = F.col, dict(sites.dtypes)["id"]
    known = lambda df, *names: df.where(" and ".join(f"{n} is not null and not isnan({n})" for n in names))
    at = written(known(sites.withColumns({"bx": C("bx").cast("double"), "by": C("by").cast("double")}), "bx", "by").groupBy("bx", "by").agg(F.min("id").alias("id")))
    extent = at.agg(F.min("bx").alias("x"), F.min("by").alias("y"), F.greatest(F.max("bx") - F.min("bx"), F.max("by") - F.min("by")).alias("side")).first()  # one row
    if extent["x"] is None:
        return points.withColumns({"distance": F.lit(None).cast("double"), "id": F.lit(None).cast(kind)})
    side = 1.0
    while side <= extent["side"]:
        side *= 2
    number = lambda c, low, size: F.floor((C(c) - low) / size).cast("long")
    asked = known(points.select(C("ax").cast("double").alias("ax"), C("ay").cast("double").alias("ay")), "ax", "ay").distinct()
    left = written(asked.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")}))
    rounds = 0
    while rounds < 48:
        rounds, side = rounds + 1, side / 2
        squares = at.groupBy(number("bx", extent["x"], side).alias("ki"), number("by", extent["y"], side).alias("kj"))
        squares = written(squares.agg(*[f(c).alias(f"{n}{c[1]}") for c in ("bx", "by") for n, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n")))
        beyond = lambda c: F.greatest(C(f"lo{c}") - C(f"a{c}"), C(f"a{c}") - C(f"hi{c}"), F.lit(0.0))
        across = lambda c: F.greatest(F.abs(C(f"a{c}") - C(f"lo{c}")), F.abs(C(f"a{c}") - C(f"hi{c}")))
        halves = left.join(squares.withColumns({"i": F.floor(C("ki") / 2), "j": F.floor(C("kj") / 2)}), ["i", "j"])
        halves = halves.select("ax", "ay", "ki", "kj", F.hypot(beyond("x"), beyond("y")).alias("near"), F.hypot(across("x"), across("y")).alias("far"))
        # a square's sites are all as near as its far corner; sums of doubles may be off in their last digits
        sure = halves.groupBy("ax", "ay").agg(F.min("far").alias("most"), F.collect_list(F.struct("ki", "kj", "near")).alias("of"))
        kept = sure.select("ax", "ay", F.explode(F.filter("of", lambda s: s["near"] <= C("most") * (1 + 1e-9))).alias("s"))
        old, left = left, written(kept.select("ax", "ay", C("s.ki").alias("i"), C("s.kj").alias("j")))
        crowd = squares.agg(F.max("n")).first()[0]
        discard(old, squares)
        if side <= radius and crowd <= 16:
            break
    told = left.join(at.withColumns({"i": number("bx", extent["x"], side), "j": number("by", extent["y"], side)}), ["i", "j"])
    d = F.sqrt((C("ax") - C("bx")) ** 2 + (C("ay") - C("by")) ** 2)
    told = written(told.groupBy("ax", "ay").agg(F.min(F.struct(d.alias("distance"), "id")).alias("m")))
    discard(left, at)
    return points.join(told, ["ax", "ay"], "left").select(*points.columns, "m.distance", "m.id")


def distance_join(a: DataFrame, b: DataFrame, radius: float, most: int = 4096) -> DataFrame:
    """Pairs (ax, ay, ..., bx, by, ...) no farther apart than radius: equal grid cells after b is dealt to the 3 x 3 around it.

    The rows of b in a cell are dealt to parts of about ``most``, and the rows of a meet each part, so that a crowded cell is the work of many tasks.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.withColumns({"_i": cell("ax"), "_j": cell("ay")})
    right = b.withColumn("_o", F.explode(around)).withColumns({"_i": cell("bx") + F.col("_o.i"), "_j": cell("by") + F.col("_o.j")}).drop("_o")
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    crowd = right.groupBy("_i", "_j").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")).where("_parts > 1")
    part = F.pmod(F.hash("bx", "by", *[c for c in b.columns if c not in ("bx", "by")]), F.coalesce("_parts", F.lit(1))).alias("_p")
    right = right.join(crowd, ["_i", "_j"], "left").select(*b.columns, "_i", "_j", part)
    left = left.join(crowd, ["_i", "_j"], "left").withColumn("_p", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    # a number of tasks of its own: both sides are small next to what they make, by which neither should be sent whole to the tasks that read the other
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["_i", "_j", "_p"]
    met = left.repartition(tasks, *key).join(right.repartition(tasks, *key).hint("merge"), key)
    return met.drop(*key).withColumn("distance", d).where(F.col("distance") <= radius)


def positional_join(rows: DataFrame, group: str, key: str, lists: DataFrame, values: str, name: str) -> DataFrame:
    """rows with the values of their group's list, the first to the row of the smallest key; lists: (group, values), one row a group."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1)
    told = lists.select(group, F.posexplode(values).alias("_nth", name))
    return ranked.join(told, [group, "_nth"], "left").drop("_nth")
