"""Sharding: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.common import dense_index
from gridpanel.session import materialize

SHARDS = 24
ROW_BYTES = 8  # added to each document's text
_GRAIN = 1000  # a group over total / (shards * _GRAIN) is placed one by one: at most shards * _GRAIN of them
_LEVEL = 8  # one group in so many is held back to level the shards at the end


def longest_first(loads: Sequence[float], sizes: Iterable[float]) -> list[int]:
    """The shard of each size (given in descending order): always the least loaded one."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append(shard)
    return out


def _placed(groups: DataFrame, loads: Sequence[float]) -> DataFrame:
    """(key, bytes, task, bin): every task places its groups, longest first, from ``loads``."""

    def run(batches):
        now, task = list(loads), TaskContext.get().partitionId()
        for batch in batches:
            sizes = batch.column("bytes").to_pylist()
            bins = longest_first(now, sizes)
            for size, shard in zip(sizes, bins, strict=True):
                now[shard] += size
            arrays = [batch.column("key"), batch.column("bytes"), pa.array([task] * len(bins), pa.int32()), pa.array(bins, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "bytes", "task", "bin"])

    return groups.mapInArrow(run, "key bigint, bytes bigint, task int, bin int")


def assign(groups: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Shards of groups (key, bytes): a bounded table of the large ones, and all others.

    One heap over all groups would be one task. Instead large groups (their number is
    bounded by their share of the total) and *bins* share the top heap: each task packs
    its part of the other groups longest first into ``shards`` bins, and a bin is placed
    like one group (tasks x shards rows reach the driver). An eighth of the groups is
    held back; each task then levels its part of the remaining difference, again longest
    first, so shards end within a few small groups of each other.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") > total // (shards * _GRAIN)
    giants = groups.where(large).collect()  # at most shards * _GRAIN rows
    turn = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(_LEVEL))
    order = [F.desc("bytes"), F.col("key")]
    head = groups.where(~large & (turn != 0)).repartition("key").sortWithinPartitions(*order)
    head = materialize(_placed(head, [0] * shards), "bins")
    bins = head.groupBy("task", "bin").agg(F.sum("bytes").alias("bytes")).collect()
    items = sorted(
        [(-g["bytes"], 0, g["key"], 0) for g in giants] + [(-b["bytes"], 1, b["task"], b["bin"]) for b in bins]
    )
    loads = [0] * shards
    shard_of = longest_first(loads, (-item[0] for item in items))
    for item, shard in zip(items, shard_of, strict=True):
        loads[shard] -= item[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = min(loads)
    rest = groups.where(~large & (turn == 0)).repartition(tasks, "key").sortWithinPartitions(*order)
    rest = materialize(_placed(rest, [(load - low) / tasks for load in loads]), "level")
    placed = list(zip(items, shard_of, strict=True))
    named = spark.createDataFrame([(i[2], s) for i, s in placed if i[1] == 0], "key bigint, shard int")
    moved = spark.createDataFrame([(i[2], i[3], s) for i, s in placed if i[1] == 1], "task int, bin int, shard int")
    others = head.join(F.broadcast(moved), ["task", "bin"]).select("key", "shard")  # tasks x shards rows
    return named, others.union(rest.select("key", F.col("bin").alias("shard")))


def shard(docs: DataFrame, shards: int = SHARDS, keep: Sequence[str] | None = None, serve_by: str | None = None) -> DataFrame:
    """Columns ``keep`` of every row (all by default), size, text_crc32, shard and slot.

    With ``serve_by``, a column of ``docs``, also served: the row's place in its shard, from
    0 without gaps, ascending that column.

    Size: UTF-8 bytes of the text plus ``ROW_BYTES``; a null text counts as empty. Rows
    with equal texts form a group and share a shard; shards get nearly equal sizes.
    ``slot`` numbers a shard's rows from 0 without gaps, ascending doc_id (null first).
    Repeated rows each get a slot. An empty table gives an empty result. Columns of
    ``docs`` named like a result column are replaced.

    Shards and slots are found from ids and sizes alone; other columns are written once
    under a row number and meet their slot in one join on it, so no key is hot there.
    """
    keep = list(docs.columns if keep is None else keep)
    made = ("size", "text_crc32", "shard", "slot", "_key", "_row", *(["served", "_serve"] if serve_by else []))
    own = [c for c in keep if c not in made]
    turn = [F.col(serve_by).alias("_serve")] if serve_by else []
    ids = [c for c in own if c == "doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        *own,
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),
        *turn,
    )
    sized = materialize(sized, "sized")  # fixes the row numbers
    rows = sized.select("_row", *ids, "size", "text_crc32", "_key", *(["_serve"] if serve_by else []))
    groups = materialize(rows.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("bytes")), "groups")
    large, others = assign(groups, shards)
    near = F.broadcast(large)  # at most shards * _GRAIN rows; holds every group with many rows
    hot = rows.join(near, F.col("_key") == F.col("key")).drop("key")
    cold = rows.join(near, F.col("_key") == F.col("key"), "left_anti").join(others, F.col("_key") == F.col("key"))
    placed = hot.unionByName(cold.drop("key")).drop("_key")
    order = [F.col(c).asc_nulls_first() for c in ids]
    slots = dense_index(placed, ["shard"], [*order, F.col("text_crc32"), F.col("size")], "slot")
    found = ["shard", "slot"]
    if serve_by:
        slots = dense_index(slots, ["shard"], [F.col("_serve").asc_nulls_first(), F.col("_row")], "served").drop("_serve")
        found.append("served")
    if own == ids:
        return slots.drop("_row")
    return sized.drop("_key", "_serve").join(slots.select("_row", *found), "_row").drop("_row")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; files are cut by slot range, not by task."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
