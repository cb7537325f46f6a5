"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.llm import (
    chat,
    decontaminate,
    merkle_case,
    mixing,
    packing_case,
    quality,
    sharding,
    simhash,
    sketches,
    spelling_case,
    suffixes,
    token_counts,
    toxicity,
)
from gridpanel.llm.common import read
from gridpanel.llm.labels import fold
from gridpanel.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "merkle_case", "packing_case", "spelling_case"]


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


_OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT DISTINCT n FROM win),
places AS MATERIALIZED (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS start FROM d, sizes WHERE len(w) >= n),
grams AS MATERIALIZED (SELECT doc_id, start, n, array_to_string(w[start:start + n - 1], ' ') AS g FROM places),
hits AS MATERIALIZED (SELECT doc_id, start, grams.n, item_id FROM grams JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT start + j) AS n_hit FROM hits, unnest(range(0, n)) AS o(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op9_decontamination", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def _held_out(folds: int, at: int):
    return F.coalesce(fold(folds) == at, F.lit(False)).alias("held_out")


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.classify(docs, read(spark, sf_dir, "labels"))
    return found.select("doc_id", _held_out(quality.FOLDS, 0), "score", "predicted")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.classify(docs, read(spark, sf_dir, "labels"))
    return found.select("doc_id", _held_out(toxicity.FOLDS, toxicity.HELD_OUT), "score", "predicted")


@query("op2_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sketches.edited_pairs(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return pairs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.encoded(F.col("sketch")).alias("fingerprint"),
        sketches.encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


_OP7_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
s AS (
  SELECT conv_id, turn, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
p AS (
  SELECT conv_id, pos, n_turns, turn, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chat FROM s),
begun AS (SELECT DISTINCT pos, md5(chat) AS h FROM p WHERE pos < n_turns),
full_ AS (SELECT min(conv_id) AS conv_id, n_turns, chat, count(*) AS copies FROM p WHERE pos = n_turns GROUP BY n_turns, chat)
SELECT f.conv_id, 0 AS part, (SELECT min(turn) FROM t WHERE t.conv_id = f.conv_id) AS first_turn,
  f.n_turns, f.copies, f.chat
FROM full_ f ANTI JOIN begun b ON b.pos = f.n_turns AND b.h = md5(f.chat)
"""


@query("op7_chat", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


@query("op3_suffixes")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(read(spark, sf_dir, "documents"))
    # cuts fall between bytes, so a character may be left in part
    return found.withColumn("kept", F.make_valid_utf8(F.col("kept").cast("string")))
