"""Readers and writers for fact tables."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One suffix per reporting era.
ERA_SUFFIXES = {"early": "", "middle": "_mid", "hybrid": "_2018", "late": "_new", "latest": "_2025"}
_AT_ONCE = 16  # headers read at the same time


class MissingColumns(ValueError):
    """A file that lacks a column it must have, or names one twice."""


@dataclass(frozen=True)
class Header:
    """The column names of one file, in its order; None for a file without any line."""

    file: str
    names: tuple[str, ...] | None


def _files(spark: SparkSession, path: str) -> list[str]:
    """Data files at ``path`` (a file, a folder or a pattern), as Spark would read them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], list(system.globStatus(hadoop.Path(path)) or [])
    while todo:
        status = todo.pop()
        if status.isDirectory():
            todo += [s for s in system.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
        else:
            out.append(status.getPath().toString())
    return sorted(out)


def _first_line(spark: SparkSession, file: str) -> str | None:
    hadoop, java = spark._jvm.org.apache.hadoop, spark._jvm.java.io
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        plain = codec.createInputStream(stream) if codec else stream
        return java.BufferedReader(java.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()


def csv_headers(spark: SparkSession, paths: Sequence[str]) -> list[Header]:
    """The header of every CSV file. Like listing files, this costs the driver one short read
    per file, whatever the files' size; no data line is read."""
    files = [f for path in paths for f in _files(spark, path)]

    def read(file: str) -> Header:
        line = _first_line(spark, file)
        if line is None:
            return Header(file, None)
        names = next(csv.reader([line.removeprefix("\ufeff")]), [])
        return Header(file, tuple(n.strip() for n in names))

    with ThreadPoolExecutor(_AT_ONCE) as pool:
        return list(pool.map(read, files))


def csv_columns(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """(file, column, position, status): what each file has of the wanted columns and what else.

    ``status`` is "present", "absent" (position NULL), "unknown" or "empty" (a file without
    any line, column NULL).
    """
    rows = []
    for header in csv_headers(spark, [path] if isinstance(path, str) else path):
        if header.names is None:
            rows.append((header.file, None, None, "empty"))
            continue
        rows += [(header.file, n, i, "present" if n in schema.names else "unknown") for i, n in enumerate(header.names)]
        rows += [(header.file, n, None, "absent") for n in schema.names if n not in header.names]
    return spark.createDataFrame(rows, "file string, column string, position int, status string")


def scan_fact_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, required: Sequence[str] = (), source: str | None = None
) -> DataFrame:
    """Header CSV files with a declared schema, columns bound by their names.

    Files may order their columns differently, lack some (NULL) and have others (left out;
    ``csv_columns`` reports both). A file without one of the ``required`` columns, or with a
    name twice, raises ``MissingColumns`` naming the file. Files with the same header are one
    scan, without an inference pass; ``source`` adds each row's file under that name.
    """
    layouts: dict[tuple[str, ...], list[str]] = {}
    for header in csv_headers(spark, [path] if isinstance(path, str) else path):
        if header.names is not None:
            lacking = [n for n in required if n not in header.names]
            twice = sorted({n for n in header.names if n in schema.names and header.names.count(n) > 1})
            if lacking or twice:
                raise MissingColumns(f"{header.file}: " + " ".join([*(f"no column {n}" for n in lacking), *(f"column {n} twice" for n in twice)]))
            layouts.setdefault(header.names, []).append(header.file)
    kinds = {f.name: f.dataType for f in schema.fields}
    out = None
    for names, files in layouts.items():
        own = T.StructType([T.StructField(n if n in kinds else f"_unknown{i}", kinds.get(n, T.StringType())) for i, n in enumerate(names)])
        rows = spark.read.schema(own).option("header", True).option("escape", '"').csv(files)
        columns = [F.col(n) if n in names else F.lit(None).cast(kinds[n]).alias(n) for n in schema.names]
        rows = rows.select(*columns, *([F.col("_metadata.file_path").alias(source)] if source else []))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = empty_typed(spark, schema)
        out = out.withColumn(source, F.lit(None).cast("string")) if source else out
    return out


def scan_mapping(spark: SparkSession, path: str, raw: str = "host_raw", canonical: str = "host_canonical_draft") -> DataFrame:
    """(host_raw, host_canonical, position) of a mapping file, whatever else it has.

    ``position`` orders the entries as the file does (by file name, then by line), so that of
    several entries for one spelling the last can win: see ``resolve.lookup_table``.
    """
    schema = T.StructType([T.StructField(raw, T.StringType()), T.StructField(canonical, T.StringType())])
    headers = csv_headers(spark, [path])
    frames = None
    for header in headers:
        if header.names is None:
            continue
        lacking = [n for n in (raw, canonical) if n not in header.names]
        if lacking:
            raise MissingColumns(f"{header.file}: no column {' '.join(lacking)}")
        own = T.StructType([T.StructField(n if n in schema.names else f"_unknown{i}", T.StringType()) for i, n in enumerate(header.names)])
        rows = spark.read.schema(own).option("header", True).option("escape", '"').csv(header.file)
        # within a block of a file, rows keep their order in one task
        place = F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
        )
        rows = rows.select(F.col(raw).alias("host_raw"), F.col(canonical).alias("host_canonical"), place.alias("position"))
        frames = rows if frames is None else frames.unionByName(rows)
    if frames is None:
        raise MissingColumns(f"{path}: no mapping file")
    return frames


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def scan_many_eras(
    spark: SparkSession, folder: str, table: str, schema: T.StructType, fmt: str = "csv", required: Sequence[str] = ()
) -> DataFrame:
    """Every existing ``<table><suffix>``, with the era it came from.

    Missing eras are ignored; no era at all gives an empty table of the right shape. CSV
    columns are bound by name (see ``scan_fact_csv``), so eras may order and name theirs
    differently. The era is read off the path, so it is no column of the files.
    """
    found = {
        era: f"{folder}/{table}{suffix}"
        for era, suffix in ERA_SUFFIXES.items()
        if _exists(spark, f"{folder}/{table}{suffix}")
    }
    if not found:
        return empty_typed(spark, schema).withColumn("era", F.lit(None).cast("string"))
    if fmt == "csv":
        rows = scan_fact_csv(spark, list(found.values()), schema, required, source="_file")
    else:
        rows = spark.read.schema(schema).parquet(*found.values()).select("*", F.col("_metadata.file_path").alias("_file"))
    era = F.lit(None).cast("string")
    for name in found:
        owner = f"/{table}{ERA_SUFFIXES[name]}/"
        era = F.when(F.contains(F.col("_file"), F.lit(owner)), name).otherwise(era)
    return rows.withColumn("era", era).drop("_file")


def clustered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and sorted inside them.

    Tasks get as much as the advisory partition size, so the number of files follows from
    the size of the data plus one per partition value, not from tasks times values; and
    each file, and each row group in it, holds a narrow range that filters can skip.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("year",), fmt: str = "parquet", order: Sequence[str] = ()
) -> None:
    """Write a result table, partitioned so that period filters prune files.

    Rows are clustered by ``partition_by`` and ``order`` first (see ``clustered``); without either
    they are written as they come.
    """
    if partition_by or order:
        df = clustered(df, [*partition_by, *order])
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
        # names are matched untrimmed, so blanks around them are part of the data
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(fmt).save(path)


def empty_typed(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An absent table: no rows, right columns."""
    return spark.createDataFrame([], schema)
