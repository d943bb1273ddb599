"""Costs, benefits and their discounting."""

from pyspark.sql import Column, DataFrame, functions as F

#: fixed values: value of time a hour, days, and unit costs a metre and in percent
VTTS, DAYS = 14.8, 365
TRACK, TUNNEL, BRIDGE = 33250.0, 104000.0, 70000.0
MAINTENANCE, MAINTENANCE_SHARE = 0.03, 0.65
#: fixed values: uncovered operation a metre of line, share of it that is covered, detour of new lines, years, services a track
OPERATING, COVERED, DETOUR, YEARS, SERVICES_A_TRACK = 879.0, 0.623, 1.1, 50, 12
#: fixed values: a siding on a segment, a track at a station, a platform
SEGMENT_SIDING, STATION_TRACK, PLATFORM = 33_250_000.0, 18_300_000.0, 0.0


def discount(year: Column, rate: float, base: int) -> Column:
    """1 / (1 + rate) ** (year - base - 1): the year after base counts in full."""
    return F.pow(F.lit(1 + rate), -(year - base - 1).cast("double"))


def savings(before: Column, after: Column) -> tuple[Column, Column]:
    """Hours a day, and money a year."""
    return before - after, (before - after) * DAYS * VTTS


def road_savings(before: Column, after: Column, duration: int) -> Column:
    return (before - after) * VTTS * 2.5 * 250 * duration


def bpr(free: Column, flow: Column, capacity: Column, alpha: float = 0.25, gamma: float = 2.4) -> Column:
    """Travel time of a loaded link."""
    return free * (1 + alpha * F.pow(F.try_divide(flow, capacity), F.lit(gamma)))


def bpr_integral(free: Column, flow: Column, capacity: Column, alpha: float = 0.25, gamma: float = 2.4) -> Column:
    return free * (flow + alpha * capacity * F.pow(F.try_divide(flow, capacity), F.lit(gamma + 1)) / (gamma + 1))


def line_construction(track: Column, tunnel: Column, bridge: Column) -> Column:
    """Cost of metres of free track, tunnel and bridge."""
    return track * TRACK + tunnel * TUNNEL + bridge * BRIDGE


def line_maintenance(construction: Column, years: int = YEARS, share: float = MAINTENANCE_SHARE) -> Column:
    """Of all years; the rest of what is due is part of operating costs."""
    return construction * MAINTENANCE * years * share


def uncovered_operation(length: Column, new_line: bool) -> Column:
    """A year; length counts both directions. New lines are longer than the straight line."""
    return length / 2 * OPERATING * (1 - COVERED) * (DETOUR if new_line else 1.0)


def too_full(frequency: Column, tracks: Column, limit: float = SERVICES_A_TRACK) -> Column:
    """Whether so many services a track or more run; a number of tracks counts by its smallest digit, as in mixed segments ("12" is one)."""
    digits = F.transform(F.regexp_extract_all(tracks.cast("string"), F.lit("[0-9]"), F.lit(0)), lambda x: x.cast("int"))
    return F.coalesce(F.try_divide(frequency, F.array_min(digits)) >= limit, frequency > 0)


def extension_costs(links: DataFrame, hops: DataFrame, limit: float = SERVICES_A_TRACK) -> DataFrame:
    """(dev, construction, maintenance) of developments that use links which are too full; 0 for those that use none.

    links: u, v, frequency, tracks, track_m, tunnel_m, bridge_m, with links of unknown tracks left out; hops: dev, u, v. Each
    development is seen alone.
    """
    full = links.where(F.col("tracks").isNotNull()).where(too_full(F.col("frequency"), F.col("tracks"), limit))
    cost = line_construction(*[F.coalesce(c, F.lit(0.0)) for c in ("track_m", "tunnel_m", "bridge_m")])
    used = hops.select("dev", "u", "v").distinct().join(full.select("u", "v", cost.alias("cost")), ["u", "v"], "left")
    total = used.groupBy("dev").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("construction"))
    return total.withColumn("maintenance", line_maintenance(F.col("construction")))


def intervention(segments: Column, tracks: Column, length: Column, platforms: Column) -> tuple[Column, Column, Column]:
    """Kind, tracks and platforms to add: a station track in the middle of several segments, else a siding on the one.

    A short segment with half a track gets a whole one, since what completes it would cost less than nothing.
    """
    station = segments > 1
    short = (tracks % 1 == 0.5) & (length < 1000)
    kind = F.when(station, "station_track").otherwise("segment_passing_siding")
    return kind, F.when(station | short, 1.0).otherwise(0.5), F.when(station & (platforms < 2), 1).otherwise(0)


def intervention_cost(kind: Column, tracks: Column, added: Column, length: Column, platforms: Column) -> Column:
    """Construction; an unknown kind is null. Yearly maintenance is MAINTENANCE of it."""
    base = F.floor(tracks)
    siding = F.when((tracks % 1 == 0.5) & (added == 0.5), length * TRACK - base * SEGMENT_SIDING).when(added == 1.0, length * TRACK).otherwise(base * SEGMENT_SIDING)
    return F.when(kind == "station_track", base * STATION_TRACK + platforms * PLATFORM).when(kind == "segment_passing_siding", siding)


def panel(costs: DataFrame, benefits: DataFrame, start: int, end: int) -> DataFrame:
    """(dev, scenario, year, const_cost, maint_cost, benefit): construction in the first year only, maintenance after it.

    costs: (dev, construction, maintenance a year); benefits: (dev, scenario, year, benefit).
    """
    keys = costs.join(benefits.select("dev", "scenario").distinct(), "dev").withColumn("year", F.explode(F.sequence(F.lit(start), F.lit(end))))
    x = keys.join(benefits, ["dev", "scenario", "year"], "left")
    first = F.col("year") == start
    return x.select("dev", "scenario", "year", F.when(first, F.col("construction")).otherwise(0.0).alias("const_cost"), F.when(first, 0.0).otherwise(F.col("maintenance")).alias("maint_cost"), F.coalesce("benefit", F.lit(0.0)).alias("benefit"))
