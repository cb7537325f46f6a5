"""The spelling query and its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridpanel.llm import spelling
from gridpanel.llm import sql as S
from gridpanel.llm.common import read
from gridpanel.llm.registry import query

# ids and A-Z are one byte, U+00C0 to U+00FF are 0xC3 and the code point less 0x40
_CODES = (
    "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), "
    "lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END))"
)

_SQL = rf"""
WITH RECURSIVE {S.CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({S.LOWER.format("text")}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
own AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, k, {S.crc(_CODES)} AS h FROM own, crc_table),
spelt AS (SELECT k, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
dels AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM dels a JOIN dels b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM dels a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, b.n, a.word, a.n FROM dels a JOIN words b ON a.rest = b.word)),
ranked AS (
  SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM near),
found AS MATERIALIZED (
  SELECT w.word, w.n, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n,
    coalesce(n_near, 0) AS n_near FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
chain(word, at_, nxt) AS (
  SELECT word, word, form FROM found
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN found f ON f.word = c.nxt)
SELECT f.word, f.form, c.at_ AS root, f.n, f.n_near, f.form_n FROM found f JOIN chain c ON c.word = f.word AND c.nxt IS NULL
"""


@query("op13_spelling", _SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))
