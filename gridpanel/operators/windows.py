"""Per-entity windows.

Inputs hold one row per series and year, so a window partition is bounded by the
number of years, whatever the number of raw facts behind it. A series is a host, or a host's
species and metric where all of a panel is analysed at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


HOST = ("host",)


def by_year(series: Sequence[str] = HOST) -> WindowSpec:
    """The rows of one series in time order; ``series`` names the columns that tell series apart."""
    return Window.partitionBy(*series).orderBy("year")


def whole(series: Sequence[str] = HOST) -> WindowSpec:
    return Window.partitionBy(*series)


def previous_row(c: Column | str, series: Sequence[str] = HOST) -> Column:
    """Value of the series' previous reported row, however long ago."""
    return F.lag(c, 1).over(by_year(series))


def previous_year(c: Column | str, series: Sequence[str] = HOST) -> Column:
    """Value of the calendar year before; NULL if that year was not reported."""
    w = by_year(series)
    return F.when(F.lag("year", 1).over(w) == F.col("year") - 1, F.lag(c, 1).over(w))


def rolling_mean3(c: Column | str, series: Sequence[str] = HOST) -> Column:
    """Mean of the current and two preceding rows, skipping nulls."""
    return F.avg(c).over(by_year(series).rowsBetween(-2, 0))


def change_pct(c: Column, series: Sequence[str] = HOST) -> Column:
    """Percentage change against the calendar year before."""
    before = previous_year(c, series)
    return F.try_divide(c - before, before) * 100


def zscore(c: Column, series: Sequence[str] = HOST) -> Column:
    """Distance from the series' mean in sample standard deviations, 0 if it never varies."""
    w = whole(series)
    spread = F.stddev_samp(c).over(w)
    return F.when(spread > 0, F.try_divide(c - F.avg(c).over(w), spread)).otherwise(0.0)


def next_consecutive(df: DataFrame, value: str, name: str, series: Sequence[str] = HOST) -> DataFrame:
    """Pair each row with the following year's value; rows before a gap are dropped."""
    w = by_year(series)
    ahead = df.withColumn(name, F.lead(value).over(w)).withColumn("_year", F.lead("year").over(w))
    return ahead.filter(F.col("_year") - F.col("year") == 1).drop("_year")
