"""Set operations on entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_entities(df: DataFrame, col: str = "host") -> DataFrame:
    return df.select(col).distinct()


def reporting_in(df: DataFrame, year: int, series: Sequence[str] = ("host",)) -> DataFrame:
    """Series with a value in a year."""
    return df.filter((F.col("year") == year) & F.col("value").isNotNull()).select(*series).distinct()


def intersect_entities(df: DataFrame, years: Sequence[int], series: Sequence[str] = ("host",)) -> DataFrame:
    """Series reporting in every one of the years."""
    found = reporting_in(df, years[0], series)
    for year in years[1:]:
        found = found.intersect(reporting_in(df, year, series))
    return found


def overlap_pct(inner: DataFrame, outer: DataFrame, keys: Sequence[str] = ("host", "year")) -> DataFrame:
    """Share of the inner set found in the outer one, in percent."""
    keys = list(keys)
    both = inner.select(*keys).distinct().join(
        outer.select(*keys).distinct().withColumn("_in", F.lit(1)), keys, "left"
    )
    return both.agg((F.try_divide(F.count("_in"), F.count(F.lit(1))) * 100).alias("overlap_pct"))
