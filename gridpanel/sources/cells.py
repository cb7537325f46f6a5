"""Scan of exported report cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridpanel import schemas
from gridpanel.sources.facts import write_table


def scan_cells(spark: SparkSession, path: str) -> DataFrame:
    """Exported cells, one row per cell, partitioned on disk by ``period``.

    The export holds every cell of a sheet's used rectangle (blank: ``v`` NULL),
    so a melt keeps unreported values as NULL facts.
    """
    return spark.read.schema(schemas.CELLS).parquet(path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Write cells by period, sorted by file, sheet and row.

    A file's sheets lie together, so scans of one sheet or of header rows skip the rest, and
    the number of files is bounded by periods plus the size of the data.
    """
    write_table(cells, path, partition_by=["period"], order=["file_id", "sheet", "r", "c"])
