"""SimHash near-duplicates: meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.llm.components import components
from gridpanel.session import materialize

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
_BITS = 64
_PIECE = 1 << 16  # shingles counted at once
_HOT = 1000  # a fingerprint with more than a thousandth of the rows is looked up by broadcast


def simhash(text: bytes, words: int) -> int:
    """64-bit fingerprint: a bit is set if it is in over half of the shingles' hashes."""
    tokens = text.lower().split()  # bytes: A-Z and ASCII white space only
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(len(tokens) - words + 1, min(len(tokens), 1)))]
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, len(shingles), _PIECE):
        hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles[at : at + _PIECE]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    set_bits = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; null and blank texts have fingerprint 0."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.array([simhash(t.as_py() or b"", words) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _ball(radius: int) -> list[int]:
    """All masks of at most ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(_BITS), r)]
    return [m - (1 << _BITS) if m >> (_BITS - 1) else m for m in masks]


def _variants(prints: DataFrame, radius: int) -> DataFrame:
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(radius)])
    return prints.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("variant"))


def links(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): links that connect all of ``prints`` (distinct fp) within ``distance`` bits.

    Two fingerprints at up to 2r bits share a variant at up to r bits of either.
    For an even distance all fingerprints around a variant are within the distance
    of each other, so linking each to the smallest keeps every component without
    emitting all pairs; a variant has at most as many fingerprints as the ball.
    For an odd one the balls of radius r and r+1 meet and every pair is checked.
    """
    near = distance // 2
    if distance % 2:
        small, large = _variants(prints, near), _variants(prints, near + 1)
        met = small.select(F.col("fp").alias("a"), "variant").join(large.select(F.col("fp").alias("b"), "variant"), "variant")
    else:
        around = _variants(prints, near).groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        met = around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return met.where((F.col("a") != F.col("b")) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Fingerprints within ``distance`` bits are linked; ``component_id`` is the smallest
    doc_id reachable. Equal fingerprints are one node, so a group of copies holding a
    third of all rows is one fingerprint. Null doc_ids are carried along and never
    name a component unless it has no other (then null). Repeated rows are all
    returned. An empty table gives an empty result. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    # dealt anew: each of these few bytes becomes a whole ball of variants
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = materialize(components(links(nodes.select("fp").repartition(tasks, "fp"), distance)), "roots")
    members = roots.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "first")
    smallest = members.groupBy("root").agg(F.min("first").alias("least"))
    grouped = members.join(smallest, "root").select(F.col("fp").alias("member"), "least")
    classes = nodes.join(grouped, F.col("fp") == F.col("member"), "left").select(
        F.col("fp").alias("class"),
        F.when(F.col("member").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"),
        (F.col("n") * _HOT > F.lit(prints.count())).alias("hot"),
    )
    classes = materialize(classes, "classes")
    same = F.col("fp") == F.col("class")
    hot = F.broadcast(classes.where("hot"))  # fewer than _HOT rows
    many = prints.join(hot, same)
    few = prints.join(hot, same, "left_anti").join(classes.where("not hot"), same)
    return many.unionByName(few).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each group stays.

    It is the one with the smallest doc_id (null last); of several rows with that id, the
    one with the smallest hash over all columns. Rows are told apart by id and hash, not
    by id alone, so texts that share an id are decided one by one; rows equal in every
    column count once.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("hash"))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"), words, distance)
    chosen = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_chosen")).distinct()
    kept = docs.withColumn("_row", key).join(chosen, F.col("_row") == F.col("_chosen"), "left_semi")
    # joined rows are already dealt and sorted by the key, so dropping repeats costs no exchange
    return kept.dropDuplicates(["_row"]).drop("_row")
