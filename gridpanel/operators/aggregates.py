"""Aggregations over panels. All combine map-side, so hot keys shrink before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.functions.exact import exact_mean, exact_sum
from gridpanel.operators.joins import join_dim
from gridpanel.operators.ranking import exact_quantiles


def dedupe(df: DataFrame, keys: Sequence[str] = ("year", "host"), how: str = "mean") -> DataFrame:
    """One row per key: spellings merged into one entity are averaged (or summed).

    Sums are exact, so the result doesn't depend on how rows are dealt to tasks.
    """
    agg = {"mean": exact_mean, "sum": exact_sum}[how]
    return df.groupBy(*keys).agg(agg(F.col("value")).alias("value"))


def yearly_sum(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total per year (and ``by``); a year of nulls only totals 0."""
    return df.groupBy(*by, "year").agg(F.coalesce(exact_sum(F.col("value")), F.lit(0.0)).alias("total"))


def mean_of_sums(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean per (year, host), summed per year, averaged over the years; for each ``by``."""
    return yearly_sum(dedupe(df, [*by, "year", "host"]), by).groupBy(*by).agg(F.avg("total").alias("mean_total"))


def distinct_years(df: DataFrame) -> DataFrame:
    """Distinct years per host, via distinct pairs so that no task holds a host's rows."""
    return df.select("host", "year").distinct().groupBy("host").agg(F.count("year").alias("n_years"))


def coverage_filter(df: DataFrame, min_years: int) -> DataFrame:
    return distinct_years(df).filter(F.col("n_years") >= min_years)


def cond_means(df: DataFrame, species: Sequence[str], key: str = "host") -> DataFrame:
    """Mean per host for each listed species, one row per host."""
    return df.groupBy(key).agg(
        *[F.avg(F.when(F.col("species") == s, F.col("value"))).alias(f"mean_{s.lower()}") for s in species]
    )


def slope(value: Column, year: Column, min_points: int = 3) -> Column:
    """Least-squares slope of value on year, 0 with fewer than ``min_points`` points."""
    points = F.count(F.when(value.isNotNull() & year.isNotNull(), F.lit(1)))
    return F.when(points >= min_points, F.coalesce(F.regr_slope(value, year), F.lit(0.0))).otherwise(0.0)


def ols_slope(df: DataFrame, min_points: int = 3, series: Sequence[str] = ("host",)) -> DataFrame:
    """Trend and intercept per series over deduplicated years."""
    year = F.col("year").cast("double")
    return df.groupBy(*series).agg(
        slope(F.col("value"), year, min_points).alias("slope"),
        F.regr_intercept(F.col("value"), year).alias("intercept"),
        F.count("value").alias("n"),
    )


def mean_std(df: DataFrame, series: Sequence[str] = ("host",)) -> DataFrame:
    """Mean and sample standard deviation per series."""
    return df.groupBy(*series).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def share_by_year(df: DataFrame, label: str = "label") -> DataFrame:
    """Percentage of positive labels per year."""
    return df.groupBy("year").agg((F.avg(label) * 100).alias("positive_pct"))


def actual_vs_pred_by_year(df: DataFrame, actual: str, pred: str) -> DataFrame:
    return df.groupBy("year").agg(F.avg(actual).alias("actual"), F.avg(pred).alias("predicted"))


def mean_of_present(df: DataFrame, col: str) -> DataFrame:
    """Mean of the non-null values and how many there are."""
    return df.agg(F.avg(col).alias("mean"), F.count(col).alias("n"))


def fold_mean_std(df: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation over folds, for each ``by``."""
    return df.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("folds"))


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Fixed-width bins over the observed range (last bin closed), per group."""
    by = list(by)
    span = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    if by:
        ranged = join_dim(df, span, by)
    else:
        low, high = span.first()  # one row of two numbers
        ranged = df.withColumn("_lo", F.lit(low).cast("double")).withColumn("_hi", F.lit(high).cast("double"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.coalesce(F.floor(F.try_divide(F.col(col) - F.col("_lo"), width)), F.lit(0))
    binned = ranged.filter(F.col(col).isNotNull()).withColumn("bin", F.least(slot, F.lit(bins - 1)).cast("int"))
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def percentile_cut(df: DataFrame, col: str, percents: Sequence[float]) -> DataFrame:
    """Linear-interpolated percentiles of a column: (pct, cut)."""
    cuts = exact_quantiles(df, col, [p / 100 for p in percents])
    return cuts.select((F.col("q") * 100).alias("pct"), F.col("value").alias("cut"))


def median_split(df: DataFrame, features: Sequence[str], subset: Column) -> DataFrame:
    """Median of each feature over all rows and over the rows of a subset."""
    flagged = df.withColumn("_in", F.coalesce(subset, F.lit(False)))
    groups = F.when(F.col("_in"), F.array(F.lit("all"), F.lit("subset"))).otherwise(F.array(F.lit("all")))
    long = flagged.select(*features, F.explode(groups).alias("grp")).unpivot(
        ["grp"], list(features), "feature", "value"
    )
    medians = exact_quantiles(long, "value", [0.5], by=["feature", "grp"])
    return medians.groupBy("feature").agg(
        F.max(F.when(F.col("grp") == "all", F.col("value"))).alias("median_all"),
        F.max(F.when(F.col("grp") == "subset", F.col("value"))).alias("median_subset"),
    )
