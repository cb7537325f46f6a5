"""Row filters and value rules on long facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.operators.joins import drop_entities


def drop_null_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys))


def filter_panel(
    df: DataFrame,
    metric: str,
    species: str | None = None,
    years: tuple[int | None, int | None] = (None, None),
    with_value: bool = False,
) -> DataFrame:
    """One metric (of one species) in a span of years; every condition reaches the scan."""
    out = df.filter(F.col("metric") == metric)
    if species is not None:
        out = out.filter(F.col("species") == species)
    low, high = years
    if low is not None:
        out = out.filter(F.col("year") >= low)
    if high is not None:
        out = out.filter(F.col("year") <= high)
    return out.filter(F.col("value").isNotNull()) if with_value else out


def drop_incomplete(df: DataFrame, required: Sequence[str], positive: Sequence[str] = ()) -> DataFrame:
    """Complete rows only; ``positive`` names denominators that must exceed zero."""
    out = df.na.drop(subset=list(required))
    for col in positive:
        out = out.filter(F.col(col) > 0)
    return out


def fill_missing(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.na.fill(value, list(cols))


def rescale_units(df: DataFrame, rules: Sequence[tuple[str, int, int, float]]) -> DataFrame:
    """Divide a metric by a divisor within a range of years.

    ``rules`` is configuration: (metric, first year, last year, divisor).
    """
    divisor = F.lit(1.0)
    for metric, first, last, value in rules:
        hit = (F.col("metric") == metric) & F.col("year").between(first, last)
        divisor = F.when(hit, F.lit(float(value))).otherwise(divisor)
    return df.withColumn("value", F.col("value") / divisor)


def exclude_entities(df: DataFrame, excluded: DataFrame, on: Sequence[str] = ("host",)) -> DataFrame:
    return drop_entities(df, excluded, on)
