"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpanel.session import shared_folder

_AT = (1 << 33) - 1  # low bits of monotonically_increasing_id: position inside the partition


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes, or of one row."""
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def dense_index(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str, total: str | None = None) -> DataFrame:
    """Gapless 0-based position of each row in ``order`` within ``by``; ``total``: a column for the group's rows.

    Rows are range-partitioned on (by, order), so a group with a third of all
    rows is spread over partitions; only counts per partition and group are
    summed. The checkpoint fixes the partitions, so a lost executor can't
    change a number. Equal rows get different positions in any order.
    """
    shared_folder(df.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).checkpoint()
    here = F.monotonically_increasing_id().bitwiseAND(F.lit(_AT))
    placed = placed.withColumns({"_part": F.spark_partition_id(), "_at": here})
    groups = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    sizes = [F.sum("_n").over(Window.partitionBy(*by)).alias(total)] if total else []
    starts = groups.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_from"), shift.alias("_shift"), *sizes)
    match = F.col("_part") == F.col("_from")
    for i, c in enumerate(by):
        match &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    # one row per partition and group
    located = placed.join(starts, match).withColumn(name, F.col("_shift") + F.col("_at"))
    return located.select(*df.columns, name, *([total] if total else []))
