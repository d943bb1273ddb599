"""Scenario ensembles, growth and allocation."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from viatrix.operators.relational import complete
from viatrix.session import saved

P = 2_147_483_647


def draw(a: Column, b: Column, seed: int) -> Column:
    """A number in (0, 1) from two integers, by modular arithmetic that any SQL engine repeats."""
    x = (a * 48271 + b * 69621 + F.lit(seed * 40692)) % P
    x = (x * 16807 + 12345) % P
    x = (x * 48271 + 7) % P
    return (x + F.lit(0.5)) / F.lit(float(P))


def draw_sql(a: str, b: str, seed: int) -> str:
    """draw() in SQL."""
    x = f"(({a}) * 48271 + ({b}) * 69621 + {seed * 40692})::BIGINT % {P}"
    x = f"(({x}) * 16807 + 12345) % {P}"
    return f"(((({x}) * 48271 + 7) % {P}) + 0.5) / {float(P)!r}"


def latin_hypercube(scenarios: DataFrame, years: list[int], seed: int) -> DataFrame:
    """(scenario, year, u): in every year each of the n equal strata is hit once, in a drawn order.

    scenarios: (scenario) numbered from 0. Ranks are taken within a year, so years are worked on apart.
    """
    x = scenarios.select("scenario", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
    x = x.withColumns({"r": draw(F.col("scenario"), F.col("year"), seed), "j": draw(F.col("scenario"), F.col("year"), seed + 1)})
    w = Window.partitionBy("year")
    return x.select("scenario", "year", ((F.row_number().over(w.orderBy("r", "scenario")) - F.col("j")) / F.count(F.lit(1)).over(w)).alias("u"))


#: fixed values: coefficients of P. J. Acklam's rational approximation of the normal quantile, highest power first, and where its tails begin
MIDDLE_UP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_DOWN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_UP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_DOWN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def standard_normal(u: Column) -> Column:
    """Quantile of the standard normal for 0 < u < 1, by rational functions (relative error below 1.2e-9), all in the JVM."""

    def poly(x: Column, factors: tuple[float, ...]) -> Column:
        out = F.lit(factors[0])
        for f in factors[1:]:
            out = out * x + f
        return out

    low, q = F.least(u, 1 - u), u - 0.5
    t = F.sqrt(-2 * F.log(low))
    tail = poly(t, TAIL_UP) / poly(t, TAIL_DOWN)  # of the lower tail
    return F.when(low < TAIL, F.when(u < 0.5, tail).otherwise(-tail)).otherwise(q * poly(q * q, MIDDLE_UP) / poly(q * q, MIDDLE_DOWN))


def standard_normal_sql(u: str) -> str:
    """standard_normal() in SQL."""

    def poly(x: str, factors: tuple[float, ...]) -> str:
        out = f"({factors[0]!r}::DOUBLE)"
        for f in factors[1:]:
            out = f"({out} * {x} + ({f!r}::DOUBLE))"
        return out

    t, q = f"sqrt(-2 * ln(least({u}, 1 - {u})))", f"({u} - 0.5)"
    tail = f"{poly(t, TAIL_UP)} / {poly(t, TAIL_DOWN)}"
    return f"CASE WHEN least({u}, 1 - {u}) < {TAIL} THEN CASE WHEN {u} < 0.5 THEN {tail} ELSE -({tail}) END ELSE {q} * {poly(f'({q} * {q})', MIDDLE_UP)} / {poly(f'({q} * {q})', MIDDLE_DOWN)} END"


def scenario_paths(draws: DataFrame, base: Column, growth: float, sigma: Column, shock: float) -> DataFrame:
    """(scenario, year, value): base times the running product of 1 + g plus the running sum of shocks; none in the first year.

    draws: (scenario, year, u, v). sigma is an expression of year.
    """
    first = F.min("year").over(Window.partitionBy("scenario"))
    by = Window.partitionBy("scenario").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    x = draws.withColumn("start", F.col("year") == first)
    x = x.select("scenario", "year", F.when(F.col("start"), 0.0).otherwise(growth + standard_normal(F.col("u")) * sigma).alias("g"), F.when(F.col("start"), 0.0).otherwise(standard_normal(F.col("v")) * shock).alias("e"))
    product = F.aggregate(F.collect_list(1 + F.col("g")).over(by), F.lit(1.0), lambda a, b: a * b)
    return x.select("scenario", "year", (base * (product + F.sum("e").over(by))).alias("value"))


def allocate(zones: DataFrame, population: str, growth: float, power: float) -> DataFrame:
    """zones with allocated growth and relative size, in proportion to population to a power."""
    w = F.pow(population, F.lit(power))
    total = zones.agg(F.sum(w).alias("_total"))
    x = zones.join(F.broadcast(total)).withColumn("allocated", F.lit(growth) * w / F.col("_total")).drop("_total")  # one row
    return x.withColumn("relative", F.try_divide("allocated", population) + 1)


def district_population(panel: DataFrame, national: DataFrame, rates: DataFrame, first: int, base: int, last: int) -> DataFrame:
    """(district, year, value, growth): observed from first to last, then as far as rates (year, rate) go.

    Years without a value count zero; growth is null after a zero and in the first year. A district's yearly rate is the national
    one times a factor: the root, of as many years as lie between base and last, of its growth in them by that of national (year,
    value). Districts whose growth has another sign than the nation's, or that had nothing in the base year, have no factor and nulls from last on.
    """
    c = F.col
    years = panel.select("district").distinct().select("district", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    seen = complete(panel.groupBy("district", "year").agg(F.sum("value").alias("value")), years, ["district", "year"], {"value": 0.0}).select("district", "year", "value")
    before = F.lag("value").over(Window.partitionBy("district").orderBy("year"))
    seen = saved(seen.withColumn("growth", F.try_divide(c("value"), F.nullif(before, F.lit(0.0))) - 1))
    at = lambda year: F.max(F.when(c("year") == year, c("value")))
    grown = lambda: F.try_divide(at(last), F.nullif(at(base), F.lit(0.0))) - 1
    nation = national.agg(grown().alias("nation"))
    told = rates.where(c("year") > last).agg(F.array_sort(F.collect_list(F.struct("year", "rate"))).alias("rates"))  # a year each
    x = seen.groupBy("district").agg(at(last).alias("start"), grown().alias("own")).join(F.broadcast(nation)).join(F.broadcast(told))  # one row each
    relative = F.try_divide("own", F.nullif(c("nation"), F.lit(0.0)))
    x = x.select("district", "start", F.when(relative >= 0, F.pow(relative, F.lit(1.0 / (last - base)))).alias("factor"), F.inline("rates"))
    growth = c("rate") * c("factor")
    so_far = F.when(c("factor").isNotNull(), F.exp(F.sum(F.log1p(growth)).over(Window.partitionBy("district").orderBy("year"))))
    return seen.unionByName(x.select("district", "year", (c("start") * so_far).alias("value"), growth.alias("growth")))
