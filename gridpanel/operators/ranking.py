"""Global order without a single-task sort: positions, quantiles, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.operators.joins import join_dim
from gridpanel.session import shared_folder

_AT = (1 << 33) - 1  # low bits of monotonically_increasing_id: position inside the partition


def ordered_parts(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partition and sort, then fix the partitions with a checkpoint.

    Adds ``_part`` (partition number, ascending with the order) and ``_at``
    (position inside it). Both are stable because later jobs read the
    checkpoint files, also after an executor is lost.
    """
    shared_folder(df.sparkSession)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    here = F.monotonically_increasing_id().bitwiseAND(F.lit(_AT))
    return placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", here)


def global_index(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """0-based position in ``order`` (within each ``by`` group); ``order`` must be unique.

    Every partition is sorted on its own; only its row count is summed up.
    """
    by = list(by)
    placed = ordered_parts(df, [*by, *order])
    # one row per partition and group
    sizes = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *by, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start")
    )
    if by:
        located = join_dim(placed, starts, [*by, "_part"])
    else:
        located = placed.join(F.broadcast(starts), "_part")  # one row per partition
    return located.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles: (by..., q, value).

    Equal values are counted first (a value shared by a third of the rows is one
    row per task), the distinct values are range-partitioned, and only the
    partitions that hold a wanted rank are looked into. The built-in exact
    ``percentile`` would gather all distinct values in one task.
    """
    by = list(by)
    group = by or [F.lit(0)]
    weighted = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    placed = ordered_parts(weighted, [*by, col])
    sizes = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_pn"))
    running = Window.partitionBy(*group).orderBy("_part")
    sizes = sizes.withColumn("_before", F.sum("_pn").over(running) - F.col("_pn")).withColumn(
        "_total", F.sum("_pn").over(Window.partitionBy(*group))
    )
    wanted = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    exact_rank = F.col("q") * (F.col("_total") - 1)
    wanted = wanted.withColumn("_frac", exact_rank - F.floor(exact_rank)).withColumn(
        "_rank", F.explode(F.array_distinct(F.array(F.floor(exact_rank), F.ceil(exact_rank))))
    )
    wanted = wanted.withColumn("_low", F.col("_rank") == F.floor(exact_rank)).filter(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_pn"))
    )
    within = Window.partitionBy(*by, "_part").orderBy(col)
    touched = placed.join(wanted.select(*by, "_part").distinct(), [*by, "_part"], "left_semi")
    ranked = touched.withColumn("_cum", F.sum("_n").over(within))
    hits = ranked.join(wanted, [*by, "_part"]).filter(
        (F.col("_rank") >= F.col("_before") + F.col("_cum") - F.col("_n"))
        & (F.col("_rank") < F.col("_before") + F.col("_cum"))
    )
    ends = hits.groupBy(*by, "q", "_frac").agg(
        F.max(F.when(F.col("_low"), F.col(col))).alias("_lo"),
        F.max(F.when(~F.col("_low"), F.col(col))).alias("_hi"),
    )
    value = F.col("_lo") + (F.coalesce("_hi", "_lo") - F.col("_lo")) * F.col("_frac")
    return ends.select(*by, "q", value.alias("value"))


def sort_multi(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.orderBy(*cols)


def sort_nulls_last(df: DataFrame, col: str, ties: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(col), ties)


def lowest(df: DataFrame, score: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The k lowest scores; each task keeps k rows, ties are broken by key."""
    return df.orderBy(F.asc(score), *ties).limit(k)


def most_frequent(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k keys with most rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def argmax_first(df: DataFrame, arg: str, score: str) -> DataFrame:
    """The smallest ``arg`` among those with the highest score."""
    return df.agg(F.max_by(arg, F.struct(F.col(score), -F.col(arg))).alias(arg))


def rank_by(df: DataFrame, col: str, ties: str) -> DataFrame:
    return df.orderBy(F.desc(col), ties)
