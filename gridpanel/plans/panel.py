"""Coverage, recovery, trends and feature frames on the canonical panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.exact import exact_mean
from gridpanel.functions.numbers import rate_label, ratio, round_report
from gridpanel.operators.aggregates import coverage_filter, dedupe, median_split, slope, yearly_sum
from gridpanel.operators.filters import drop_incomplete, fill_missing, filter_panel
from gridpanel.operators.joins import drop_entities, keep_entities, same_period
from gridpanel.operators.sets import intersect_entities
from gridpanel.operators.windows import (
    by_year,
    change_pct,
    next_consecutive,
    previous_row,
    rolling_mean3,
    whole,
    zscore,
)

SPENDING = ("total_expenses", "expense_protection", "expense_breeding", "expense_feeding")


def stable_entities(
    panel: DataFrame, species: str, start: int, end: int, min_years: int, metric: str = "count"
) -> DataFrame:
    """Hosts with a value in at least ``min_years`` distinct years of the window."""
    reported = filter_panel(panel, metric, species, (start, end), with_value=True)
    return coverage_filter(reported, min_years).select("host")


def recovery(
    panel: DataFrame, entities: DataFrame, species: str, base: Sequence[int], points: tuple[int, int],
    metric: str = "count",
) -> DataFrame:
    """Totals at two later years against the mean of the base years' totals.

    Only hosts with a value in *all* those years count. No such host: no row.
    """
    years = [*base, *points]
    first, second = points
    rows = filter_panel(panel, metric, species, with_value=True).filter(F.col("year").isin(years))
    yearly = keep_entities(dedupe(rows), entities)  # facts are combined before the join
    at = lambda *ys: F.sum(F.when(F.col("year").isin(list(ys)), F.col("value")))
    hosts = yearly.groupBy("host").agg(
        F.count(F.lit(1)).alias("_years"), at(*base).alias("_b"), at(first).alias("_p"), at(second).alias("_q")
    ).filter(F.col("_years") == len(years))
    totals = hosts.agg(
        F.count(F.lit(1)).alias("n_hosts"),
        (F.sum("_b") / len(base)).alias("before"),
        F.sum("_p").alias("after_1"),
        F.sum("_q").alias("after_2"),
    ).filter("n_hosts > 0")
    diff = lambda after: F.col(after) - F.col("before")
    share = lambda after: F.try_divide(diff(after), F.col("before")) * 100
    return totals.select(
        F.lit(species).alias("species"),
        "n_hosts",
        round_report(F.col("before"), 1).alias("before"),
        "after_1",
        "after_2",
        round_report(diff("after_1"), 1).alias("change_1"),
        round_report(share("after_1"), 1).alias("change_pct_1"),
        round_report(diff("after_2"), 1).alias("change_2"),
        round_report(share("after_2"), 1).alias("change_pct_2"),
    )


def trend_forecast(
    panel: DataFrame, species: str, anchors: tuple[int, int], horizon: Sequence[int],
    metric: str = "count", same_composition: bool = True,
) -> DataFrame:
    """Straight line through the totals of two anchor years, continued over the horizon.

    By default only hosts reporting in both anchors are summed, so that the
    totals are comparable. No value at an anchor: no forecast.
    """
    yearly = dedupe(filter_panel(panel, metric, species).filter(F.col("year").isin(list(anchors))))
    if same_composition:
        yearly = keep_entities(yearly, intersect_entities(yearly, list(anchors)))
    totals = yearly_sum(yearly)
    year = F.col("year").cast("double")
    line = totals.agg(
        F.regr_slope("total", year).alias("_s"), F.regr_intercept("total", year).alias("_i"), F.count("total").alias("_n")
    ).filter("_n = 2")
    ahead = line.withColumn("year", F.explode(F.array(*[F.lit(y) for y in horizon])))
    return ahead.select("year", (F.col("_s") * F.col("year") + F.col("_i")).alias("forecast"))


def forecast_totals(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("period").agg(F.sum("forecast").alias("total"))


def scenario_band(baseline: DataFrame, trend: DataFrame) -> DataFrame:
    """Lower and upper bound of two scenarios per year; a missing one is skipped."""
    both = baseline.select("year", F.col("forecast").alias("_a")).join(
        trend.select("year", F.col("forecast").alias("_b")), "year", "full"
    )
    return both.select("year", F.least("_a", "_b").alias("lower"), F.greatest("_a", "_b").alias("upper"))


def split_gap_years(panel: DataFrame, species: str, gap_years: Sequence[int], metric: str = "count") -> DataFrame:
    """Yearly totals, flagged where reporting was incomplete."""
    totals = yearly_sum(dedupe(filter_panel(panel, metric, species)))
    return totals.withColumn("incomplete", F.col("year").isin(list(gap_years)))


def suppress_forecast(df: DataFrame, volatile: Sequence[str]) -> DataFrame:
    """Species without a forecast because they are too volatile."""
    return df.filter(~F.col("species").isin(list(volatile)))


def anomaly_features(panel: DataFrame, species: str, min_points: int = 10, metric: str = "count") -> DataFrame:
    """Value, change against the previous calendar year, and distance from the host's mean."""
    yearly = dedupe(filter_panel(panel, metric, species, with_value=True))
    value = F.col("value")
    shaped = yearly.select(
        "host", "year", "value",
        change_pct(value).alias("change_pct"),
        zscore(value).alias("deviation"),
        F.count(F.lit(1)).over(whole()).alias("_n"),
    )
    complete = drop_incomplete(shaped.filter(F.col("_n") >= min_points), ["value", "change_pct", "deviation"])
    return complete.drop("_n")


def harvest_features(
    populations: DataFrame, harvest: DataFrame, species: str, last_year: int, threshold: float,
    expanding: bool = False,
) -> DataFrame:
    """Harvest rate, its label, the host's population trend and last reported rate.

    Both tables are tagged and aggregated together, which is the inner join on
    (year, host) at the price of one shuffle. ``expanding`` fits the trend on the
    years up to the row only; the default uses the host's whole history.
    """
    counted = filter_panel(populations, "count", species).select("year", "host", F.lit(0).alias("_t"), "value")
    shot = filter_panel(harvest, "shot_heads", species, (None, last_year)).select(
        "year", "host", F.lit(1).alias("_t"), "value"
    )
    mean = lambda t: F.avg(F.when(F.col("_t") == t, F.col("value")))
    both = counted.unionByName(shot).groupBy("year", "host").agg(
        mean(0).alias("population"), mean(1).alias("shot_heads")
    )
    rows = drop_incomplete(both, ["population", "shot_heads"], positive=["population"])
    rate = ratio(F.col("shot_heads"), F.col("population"))
    labelled = rows.withColumn("harvest_rate", rate).withColumn("label", rate_label(F.col("harvest_rate"), threshold))
    return lagged_trend(labelled, expanding)


def lagged_trend(labelled: DataFrame, expanding: bool = False) -> DataFrame:
    """Trend and previous reported rate of each host; rows without a previous rate are dropped."""
    span = by_year().rowsBetween(Window.unboundedPreceding, 0) if expanding else whole()
    year = F.col("year").cast("double")
    points = F.count("population").over(span)
    trend = F.when(points >= 3, F.regr_slope(F.col("population"), year).over(span)).otherwise(0.0)
    shaped = labelled.withColumn("pop_trend", trend).withColumn(
        "harvest_rate_lag", previous_row(F.col("harvest_rate"))
    )
    return shaped.na.drop(subset=["harvest_rate_lag"])


def lag_regression_features(
    populations: DataFrame, finances: DataFrame, species: str, spending: Sequence[str] = SPENDING
) -> DataFrame:
    """Smoothed spending of year T with the population of T and T+1.

    The rolling mean runs over reported rows, before pairs across a gap are dropped. An
    entity-year with any finance value, of whatever metric, counts as reported.
    """
    pop = dedupe(filter_panel(populations, "count", species)).withColumnRenamed("value", "population_t")
    mean = lambda m: exact_mean(F.when(F.col("metric") == m, F.col("value")))
    fin = finances.groupBy("year", "host").agg(*[mean(m).alias(m) for m in spending], F.count("value").alias("_n"))
    fin = fin.filter("_n > 0").drop("_n")
    joined = same_period(pop, fin)
    smooth = joined.select("year", "host", "population_t", *[rolling_mean3(F.col(m)).alias(m) for m in spending])
    paired = next_consecutive(smooth, "population_t", "population_t1")
    filled = fill_missing(paired, [spending[-1]])
    complete = drop_incomplete(filled, ["population_t", "population_t1", *spending[:-1]])
    return complete.withColumn("delta", delta_target(F.col("population_t1"), F.col("population_t")))


def delta_target(after: Column, before: Column) -> Column:
    return after - before


def stability_threshold(features: DataFrame, spending: Sequence[str] = SPENDING) -> DataFrame:
    """Median spending over all rows and where the population did not fall."""
    medians = median_split(features, spending, F.col("delta") >= 0)
    return medians.select(
        "feature",
        round_report(F.col("median_all"), 1).alias("median_all"),
        round_report(F.col("median_subset"), 1).alias("median_stable"),
    )


def entity_features(
    populations: DataFrame, finances: DataFrame, species: Sequence[str], trend_species: str,
    excluded: DataFrame | None = None, expense: str = "total_expenses",
) -> DataFrame:
    """One row per host: means of the listed species, years reported, trend, mean expense.

    Facts are reduced to one row per (host, year) first; the host level then only
    sees as many rows as there are years. Years whose values are null still count.
    """
    counts = filter_panel(populations, "count")
    mean = lambda s: F.avg(F.when(F.col("species") == s, F.col("value")))
    yearly = counts.groupBy("host", "year").agg(*[mean(s).alias(f"_{i}") for i, s in enumerate(species)])
    trend_col = f"_{list(species).index(trend_species)}"
    year = F.col("year").cast("double")
    hosts = yearly.groupBy("host").agg(
        *[F.avg(f"_{i}").alias(f"mean_{s.lower()}") for i, s in enumerate(species)],
        F.count(F.lit(1)).alias("n_years"),
        slope(F.col(trend_col), year).alias("trend"),
    )
    spent = filter_panel(finances, expense).groupBy("host").agg(F.avg("value").alias("expenses"))
    joined = hosts.join(spent, "host", "left")
    if excluded is not None:
        joined = drop_entities(joined, excluded)
    return fill_missing(joined, [*[f"mean_{s.lower()}" for s in species], "expenses"])
