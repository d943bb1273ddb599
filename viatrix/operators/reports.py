"""Report tables over runs (scenario, dev, line, net, cost, ratio): one run is a development in one future of a scenario.

Runs are grouped by scenario and development first, so all that follows has a row for each of these. Sums are given in millions.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

C = F.col


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" and c not in keep else C(c) for c, kind in df.dtypes])


def _share(condition: Column) -> Column:
    """Per cent of rows; rows for which it is not known count as rows."""
    return 100.0 * F.count_if(condition) / F.count(F.lit(1))


def _spread(c: Column, name: str) -> list[Column]:
    return [F.avg(c).alias(f"mean_{name}"), F.median(c).alias(f"median_{name}"), F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}"), F.stddev_samp(c).alias(f"std_{name}")]


def by_development(runs: DataFrame) -> DataFrame:
    """(scenario, dev, line, net, cost, ratio, n_runs, n_viable): means over runs; a run is viable if its net benefit is positive. Of several lines the least is named."""
    return runs.groupBy("scenario", "dev").agg(F.min("line").alias("line"), F.avg("net").alias("net"), F.avg("cost").alias("cost"), F.avg("ratio").alias("ratio"), F.count(F.lit(1)).alias("n_runs"), F.count_if(C("net") > 0).alias("n_viable"))


def viability(runs: DataFrame) -> DataFrame:
    """How many developments of a scenario are viable in any, in all and in none of its runs, and how many runs are."""
    some, every, none = C("n_viable") > 0, C("n_viable") == C("n_runs"), C("n_viable") == 0
    x = by_development(runs).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_developments"), F.count_if(some).alias("n_any"), _share(some).alias("pct_any"), F.count_if(every).alias("n_all"), _share(every).alias("pct_all"),
        F.count_if(none).alias("n_none"), _share(none).alias("pct_none"), F.sum("n_runs").alias("n_runs"), F.sum("n_viable").alias("n_viable"), (100.0 * F.sum("n_viable") / F.sum("n_runs")).alias("pct_viable"),
    )
    return _rounded(x)


def costs(runs: DataFrame, base: str) -> DataFrame:
    """Costs of a scenario and how they differ from the base; a development that the base lacks counts in totals only. Shares of a base cost of zero are null."""
    x = by_development(runs).select("scenario", "dev", "cost")
    of_base = x.where(C("scenario") == base).select("dev", C("cost").alias("before"))
    total = of_base.agg(F.sum("before").alias("total_before"))
    change = C("cost") - C("before")
    x = x.join(of_base, "dev", "left").withColumns({"change": change, "pct": F.when(C("scenario") == base, 0.0).otherwise(F.try_divide(100 * change, "before"))})
    million = lambda c: c / 1e6
    x = x.groupBy("scenario").agg(
        million(F.sum("cost")).alias("total_cost"), million(F.avg("cost")).alias("mean_cost"), million(F.avg("change")).alias("mean_change"), *_spread(C("pct"), "pct"),
        F.count_if(C("change") < 0).alias("n_lower"), F.count_if(C("change") > 0).alias("n_higher"),
    )
    x = x.join(F.broadcast(total))  # one row
    whole = C("total_cost") - C("total_before") / 1e6
    return _rounded(x.withColumns({"total_change": whole, "total_pct": F.try_divide(100 * whole, C("total_before") / 1e6)}).drop("total_before"))


def benefit_cost_ratios(runs: DataFrame, least: float = 1.0) -> DataFrame:
    """Spread of developments' mean ratios, and how many reach the least one that pays; developments without a ratio are in neither count."""
    r = C("ratio")
    return _rounded(by_development(runs).groupBy("scenario").agg(*_spread(r, "ratio"), F.count_if(r >= least).alias("n_paying"), _share(r >= least).alias("pct_paying"), F.count_if(r < least).alias("n_losing"), _share(r < least).alias("pct_losing")))


def net_benefits(runs: DataFrame) -> DataFrame:
    """Spread of developments' mean net benefits in millions, and how many are positive."""
    m = C("net") / 1e6
    x = by_development(runs).groupBy("scenario").agg(F.sum(m).alias("total_net"), *_spread(m, "net"), F.count_if(m > 0).alias("n_positive"), _share(m > 0).alias("pct_positive"), F.count_if(m <= 0).alias("n_negative"), _share(m <= 0).alias("pct_negative"))
    return _rounded(x)


def top_developments(runs: DataFrame, n: int = 10) -> DataFrame:
    """The n developments of each scenario with the greatest mean net benefit; of equal ones the one of the smaller name comes first."""
    place = F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc_nulls_last("net"), "dev")).cast("long")
    x = by_development(runs).withColumn("rank", place).where(C("rank") <= n)
    return _rounded(x.select("scenario", "rank", "dev", "line", (C("net") / 1e6).alias("net"), "ratio", (C("cost") / 1e6).alias("cost")))


def box_statistics(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, q1, median, q3, low, high, outliers): whiskers end at the last values within 1.5 times the distance of the quartiles, beyond which outliers lie. Nulls are left out; quartiles lie between two values in proportion."""
    x = df.where(C(value).isNotNull()).select(by, C(value).alias("x"))
    q = x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.5)).alias("median"), F.percentile("x", F.lit(0.75)).alias("q3"))
    q = q.withColumn("reach", 1.5 * (C("q3") - C("q1")))
    inside = C("x").between(C("q1") - C("reach"), C("q3") + C("reach"))
    ends = x.join(q, by).groupBy(by, "n", "q1", "median", "q3").agg(F.min(F.when(inside, C("x"))).alias("low"), F.max(F.when(inside, C("x"))).alias("high"), F.count_if(~inside).alias("outliers"))
    return _rounded(ends, by)
