"""Validation folds as columns, so one frame serves every fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.operators.joins import join_dim
from gridpanel.operators.ranking import global_index
from gridpanel.session import materialize


def time_order_index(df: DataFrame, order: Sequence[str] = ("year", "host")) -> DataFrame:
    """0-based position of each row in time order."""
    return global_index(df, list(order))


def _fold_of(position: Column, rows: int, n: int) -> Column:
    """Expanding folds: ``n`` equal test blocks at the end, everything earlier is -1."""
    size = rows // (n + 1)
    start = rows - n * size
    return F.when(position >= start, F.floor((position - start) / F.lit(max(size, 1)))).otherwise(F.lit(-1)).cast("int")


def temporal_folds(df: DataFrame, order: Sequence[str] = ("year", "host"), n: int = 5, by: str = "row") -> DataFrame:
    """Add ``fold``: a row is tested in its fold and trains every later one.

    ``by="row"`` cuts by row position, so one year may straddle a boundary;
    ``by="period"`` keeps each value of the first order column in one fold.
    """
    if by == "row":
        placed = time_order_index(df, order)
        return placed.withColumn("fold", _fold_of(F.col("idx"), placed.count(), n))
    period = order[0]
    df = materialize(df, "rows")  # counted, summed up and joined: computed once
    sizes = df.groupBy(period).agg(F.count(F.lit(1)).alias("_n"))
    # one row per period
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(period)) - F.col("_n")
    starts = sizes.select(period, before.alias("_start"))
    folds = starts.select(period, _fold_of(F.col("_start"), df.count(), n).alias("fold"))
    return join_dim(df, folds, [period])


def shuffled_folds(df: DataFrame, label: str, key: Sequence[str], n: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: stratified and shuffled by a hash of the key, hence blind to time.

    The hash is the md5 of key and seed as text, so other engines find the same folds.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    mixed = df.withColumn("_mix", F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary")))
    placed = global_index(mixed, ["_mix", *key], by=[label], name="_pos")
    return placed.withColumn("fold", (F.col("_pos") % n).cast("int")).drop("_mix", "_pos")
