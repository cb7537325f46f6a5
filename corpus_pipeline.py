"""A training corpus from ``documents``: filter, deduplicate, decontaminate, mix, shard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.llm import decontaminate, mixing, quality, sharding, simhash
from gridpanel.llm.common import read
from gridpanel.session import materialize

PLACE = "mix_place"  # ascends in the order in which the mix serves the documents
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages worth a twentieth of their words."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in serving order: at the sources' target weights while these last."""
    return mixing.to_targets(docs)


def file_order(docs: DataFrame) -> Column:
    """The order in which rows were written to their files, for tables that carry no place."""
    order = F.struct("_metadata.file_name", "_metadata.row_index")  # file names ascend with the partitions written
    try:
        docs.select(order)
    except AnalysisException:  # not read from files
        return F.monotonically_increasing_id()
    return order


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, the slot inside it, and their turn there in the order of the mix."""
    if PLACE in docs.columns:
        return sharding.shard(docs, serve_by=PLACE)
    return sharding.shard(docs.withColumn(PLACE, file_order(docs)), keep=docs.columns, serve_by=PLACE)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_filter),
    ("mix", mix),
    ("shard", shard),
]

#: fitted models and string hashes have no SQL counterpart; see tests/llm/test_learned.py
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input.

    Files don't keep the order of rows, so the mix's order is written as a column: the
    shards serve their documents by it.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        if stage is mix:
            docs = docs.withColumn(PLACE, F.monotonically_increasing_id())  # rows come range-partitioned and sorted
        docs = materialize(docs, name)
    return STAGES[-1][1](spark, docs, sf_dir)
