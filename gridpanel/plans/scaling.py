"""Scaling with the population standard deviation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stats = Mapping[str, tuple[float, float]]


def scaler(df: DataFrame, cols: Sequence[str]) -> Stats:
    """Mean and population deviation per column, two numbers each; a constant column scales by 1."""
    aggs = [f(c) for c in cols for f in (F.avg, F.stddev_pop)]
    row = df.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).first()
    return {c: (row[2 * i] or 0.0, row[2 * i + 1] or 1.0) for i, c in enumerate(cols)}


def scaled(df: DataFrame, stats: Stats, prefix: str = "") -> DataFrame:
    """Columns shifted and scaled; with a prefix the originals are kept."""
    return df.withColumns({
        f"{prefix}{c}": (F.col(c) - F.lit(mean)) / F.lit(spread) for c, (mean, spread) in stats.items()
    })


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return scaled(df, scaler(df, cols))
