"""Column expressions with the semantics that appraisal tables need: half-even rounding, lenient casts, encoded lists."""

from pyspark.sql import Column, functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def minutes(x: Column) -> Column:
    """Travel time as whole minutes."""
    return F.bround(x, 0).cast("int")


def int_or_zero(x: Column) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(0))


def comma_float(x: Column) -> Column:
    """Decimal comma to double; 0 if unreadable."""
    return F.coalesce(F.translate(x, ",", ".").try_cast("double"), F.lit(0.0))


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("true", "1", "yes", "wahr")


def parse_via(x: Column) -> Column:
    """Node list from its text forms: '[6, 2122]', '2526', a sentinel or '', and digits set apart by commas with ',,,' between nodes.

    Sentinels (-99) and unreadable parts give no node.
    """
    digits = F.transform(F.split(x, ",,,"), lambda g: F.regexp_replace(g, "[^0-9]", ""))
    plain = F.regexp_extract_all(x, F.lit("-?[0-9]+"), F.lit(0))
    parts = F.when(x.contains(",,,"), digits).otherwise(plain)
    numbers = F.transform(parts, lambda g: g.try_cast("int"))
    return F.coalesce(F.filter(numbers, lambda n: n.isNotNull() & (n >= 0)), F.array().cast("array<int>"))


def reversed_list(x: Column) -> Column:
    return F.reverse(x)


def format_frequency(x: Column) -> Column:
    """A whole number plainly, else up to three digits without trailing zeros; null is empty."""
    whole = F.bround(x, 0)
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", x), "0+$", ""), "\\.$", "")
    return F.when(x.isNull(), F.lit("")).when(F.abs(x - whole) <= 1e-6, whole.cast("bigint").cast("string")).otherwise(short)


def _tokens(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "[;,]"), lambda p: F.trim(p)), lambda p: p != "")


def _largest(parts: Column, *keys: str) -> Column:
    """One struct for each distinct key of (keys, frequency), with the largest frequency."""
    key = lambda p: F.struct(*[p[k].alias(k) for k in keys])
    return F.transform(F.array_distinct(F.transform(parts, key)), lambda k: F.struct(*[k[n].alias(n) for n in keys], F.array_max(F.transform(F.filter(parts, lambda p: key(p) == k), lambda p: p["frequency"])).alias("frequency")))


def service_cells(x: Column) -> Column:
    """'S5.4, S14.2.5' as an array of (service, frequency): what follows the first dot is the number; the largest counts.

    Parts without a dot or a name are left out, an unreadable number is 0, and null has no parts.
    """
    parts = F.transform(F.filter(_tokens(F.coalesce(x, F.lit(""))), lambda p: p.contains(".")), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^.]*)\.", 1)).alias("service"), comma_float(F.regexp_extract(p, r"^[^.]*\.(.*)$", 1)).alias("frequency")))
    return _largest(F.filter(parts, lambda p: p["service"] != ""), "service")


def service_direction_cells(x: Column) -> Column:
    """'S5.A.4, S14.B.2.5' as an array of (service, direction, frequency), by the same rules."""
    pattern = r"^([^.]*)\.([^.]*)\.(.*)$"
    told = F.filter(_tokens(F.coalesce(x, F.lit(""))), lambda p: p.rlike(pattern))
    parts = F.transform(told, lambda p: F.struct(F.trim(F.regexp_extract(p, pattern, 1)).alias("service"), F.trim(F.regexp_extract(p, pattern, 2)).alias("direction"), comma_float(F.regexp_extract(p, pattern, 3)).alias("frequency")))
    return _largest(F.filter(parts, lambda p: p["service"] != ""), "service", "direction")


def service_names(x: Column) -> Column:
    """Names in a list of services, each once and in order."""
    names = F.transform(_tokens(F.coalesce(x, F.lit(""))), lambda p: F.trim(F.element_at(F.split(p, r"\."), 1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def segment_key(x: Column) -> Column:
    """'b-a' as 'a-b' with the smaller number first."""
    p = F.transform(F.split(x, "-"), lambda n: F.trim(n).cast("int"))
    return F.concat_ws("-", F.least(p[0], p[1]), F.greatest(p[0], p[1]))


def line_name(dev: Column, line: Column) -> Column:
    """Developments up to 100999 extend a line, those from 101000 are new ones."""
    return F.when(dev < 101000, F.concat((dev - 100000).cast("string"), F.lit("_"), line)).otherwise(F.concat(F.lit("X"), (dev - 101000).cast("string")))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def line_length(points: Column) -> Column:
    """Length of an array of (x, y)."""
    steps = F.zip_with(F.slice(points, 1, F.array_size(points) - 1), F.slice(points, 2, F.array_size(points) - 1), lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a fixed ring: odd number of crossings to the right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            at = F.lit(x1) + (y - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


# capacity of line sections, trains an hour and direction


def single_track(stopping: Column) -> Column:
    return F.floor(F.lit(60.0) / stopping) / 2


def double_uniform(headway: float = 3.0) -> float:
    return float(int(60 // headway))


def overtaking_penalty(stop: Column, passing: Column, headway: float = 3.0) -> Column:
    return F.greatest(F.lit(0.0), stop - passing - F.lit(headway))


def double_mixed(stop: Column, passing: Column, n_stop: Column, n_pass: Column, strategy: str, headway: float = 3.0) -> Column:
    """Mixed traffic on two tracks, by how trains are grouped: bad, base or good."""
    n = n_stop + n_pass
    fewest = F.least(n_stop, n_pass)
    changes = {"bad": fewest, "base": fewest - 1, "good": F.lit(1)}[strategy]
    changes = F.least(changes, n - 1)
    return F.floor(F.lit(60.0) / (F.lit(headway) + changes / n * overtaking_penalty(stop, passing, headway)))


def capacity(tracks: Column, stop: Column, passing: Column, n_stop: Column, n_pass: Column, strategy: str = "good", stop_trains: Column | None = None, pass_trains: Column | None = None, overflow: str = "homogeneous") -> Column:
    """Trains an hour and direction on any number of tracks; half a track more halves the times of the section.

    Four tracks are two pairs, one for each kind of train. If just one kind has more trains (stop_trains, pass_trains; none
    told: few) than its pair takes, overflow says what the other pair does: "homogeneous" keeps it apart, "mixed" shares it.
    Beyond four, blocks of four add up, and of what remains one track takes passing trains alone, two are a
    pair, three both.
    """
    half = (tracks - F.floor(tracks)) >= 0.5
    s, p = F.when(half, stop / 2).otherwise(stop), F.when(half, passing / 2).otherwise(passing)
    uniform = (n_stop == 0) | (n_pass == 0)
    pair, lone = F.lit(double_uniform()), F.when(p > 0, F.lit(60.0) / p / 2)
    two = F.when(uniform, pair).otherwise(double_mixed(s, p, n_stop, n_pass, strategy))
    three = F.when(uniform, 1.5 * pair).otherwise(F.floor(F.lit(60.0) / (F.lit(3.0) + F.lit(1) / (n_stop + n_pass) * overtaking_penalty(s, p)) + lone))
    block = 2 * pair
    if overflow == "mixed":
        over = [F.coalesce((F.lit(0.0) if x is None else x) > pair, F.lit(False)) for x in (stop_trains, pass_trains)]
        block = F.when(~uniform & (over[0] != over[1]), pair + double_mixed(s, p, n_stop, n_pass, "good")).otherwise(block)
    whole = F.floor(tracks)
    rest = whole % 4
    more = F.when(rest == 1, lone).when(rest == 2, pair).when(rest == 3, pair + lone).otherwise(F.lit(0.0))
    return F.when(whole <= 1, single_track(s)).when(whole == 2, two).when(whole == 3, three).otherwise(F.floor(whole / 4) * block + more)
