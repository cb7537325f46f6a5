"""The manifest's query and its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.llm import merkle
from gridpanel.llm import sql as S
from gridpanel.llm.common import read
from gridpanel.llm.registry import query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAMPERED = 5  # rows whose id's crc32 it divides


def _enc(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _levels(p: str, key: str, depth: int) -> list[str]:
    """CTEs of one tree over {p}0 ({key}, at, n, h): sides {p}side<k>, next nodes, and {p}tops."""
    out = []
    for k in range(depth):
        run = f"PARTITION BY {key}, pos // 16 ORDER BY pos ROWS BETWEEN"
        out += [
            f"{p}side{k} AS (SELECT {key}, pos, n, h, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {p}{k} WHERE n > 1)",
            f"{p}{k + 1} AS (SELECT {key}, pos // 16 AS pos, (n + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {p}{k} WHERE n > 1 GROUP BY ALL)",
        ]
    tops = " UNION ALL ".join(f"SELECT {key}, h FROM {p}{k} WHERE n = 1" for k in range(depth + 1))
    return [*out, f"{p}tops AS ({tops})"]


def _fold(p: str, key: str, start: str, depth: int) -> list[str]:
    """CTEs that carry (f, sib) of ``start`` up the levels of tree ``p``; the last is {start}_{depth}."""
    return [
        f"{start}_{k + 1} AS (SELECT d.* EXCLUDE (f, sib), CASE WHEN s.h IS NULL THEN f ELSE sha256(s.l || f || s.r) END AS f, "
        f"sib || coalesce(s.l || s.r, '') AS sib FROM {start}_{k} d LEFT JOIN {p}side{k} s "
        f"ON s.{key} IS NOT DISTINCT FROM d.{key} AND s.pos = d.{p}pos // {16**k})"
        for k in range(depth)
    ]


def _sql(depth: int = 6, top_depth: int = 4) -> str:
    fields = [_enc(f) for f in merkle.FIELDS]
    changed = [*fields[:-1], _enc(S.LOWER.format("text"))]
    id_crc = S.crc(S.ascii_codes("CAST(doc_id AS VARCHAR)"))
    parts = [
        S.CRC_TABLE,
        f"leaves AS MATERIALIZED (SELECT doc_id, source, sha256({' || '.join(fields)}) AS leaf, "
        f"CASE WHEN {id_crc} % {TAMPERED} = 0 THEN sha256({' || '.join(changed)}) END AS changed FROM documents, crc_table)",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS apos, "
        "count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        "a0 AS (SELECT source, apos AS pos, n, leaf AS h FROM placed)",
        *_levels("a", "source", depth),
        "b0 AS MATERIALIZED (SELECT 0 AS z, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM atops)",
        *_levels("b", "z", top_depth),
        "d_0 AS (SELECT p.*, b.h AS subroot, b.pos AS bpos, 0 AS z, coalesce(changed, leaf) AS f, '' AS sib "
        "FROM placed p JOIN b0 b ON b.source IS NOT DISTINCT FROM p.source)",
        *_fold("a", "source", "d", depth),
        f"e_0 AS (SELECT * FROM d_{depth})",
        *_fold("b", "z", "e", top_depth),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, t.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = t.h AS verified "
        f"FROM e_{top_depth}, btops t"
    )


@query("op11_merkle", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    lower = F.translate("text", UPPER, LOWER)
    changed = F.when(hit, merkle.leaf(*[lower if f == "text" else F.col(f) for f in merkle.FIELDS])).alias("changed")
    found = merkle.manifest(docs, extra=[changed])
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
