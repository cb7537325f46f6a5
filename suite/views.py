"""Analog inputs in the shapes the operators expect, derived from the given tables.

Each view exists twice: as a DataFrame (below) and as SQL for the oracle (``SQL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.operators.resolve import resolve_mean
from gridpanel.session import materialize
from suite.tables import table

# --- SQL of the views, in dependency order; CTEs of the oracles -------------------

SQL: dict[str, str] = {}

SQL["facts_raw"] = """
SELECT CAST(year(l.l_shipdate) AS INT) AS year,
 CASE l.l_orderkey % 4 WHEN 0 THEN s.s_name WHEN 1 THEN concat(s.s_name, ' ')
  WHEN 2 THEN upper(s.s_name) ELSE concat('GP ', s.s_name) END AS host,
 p.p_type AS species,
 CASE l.l_returnflag WHEN 'R' THEN 'count' WHEN 'A' THEN 'shot_heads' ELSE 'found_dead' END AS metric,
 CASE WHEN l.l_quantity >= 48 THEN NULL ELSE l.l_quantity END AS value
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey"""

SQL["host_map"] = """
SELECT v.host AS host_raw, CASE WHEN v.k % 10 = 0 THEN 'SKIP' ELSE v.s_name END AS host_canonical
FROM (SELECT s_suppkey AS k, s_name, s_name AS host FROM supplier
 UNION ALL SELECT s_suppkey, s_name, concat(s_name, ' ') FROM supplier
 UNION ALL SELECT s_suppkey, s_name, upper(s_name) FROM supplier
 UNION ALL SELECT s_suppkey, s_name, concat('GP ', s_name) FROM supplier) v WHERE v.k % 17 <> 3"""

SQL["panel"] = """
SELECT f.year, m.host_canonical AS host, f.species, f.metric, avg(f.value) AS value
FROM facts_raw f JOIN host_map m ON f.host = m.host_raw WHERE m.host_canonical <> 'SKIP'
GROUP BY f.year, m.host_canonical, f.species, f.metric"""

SQL["fin_raw"] = """
SELECT CAST(year(l.l_shipdate) AS INT) AS year, s.s_name AS host,
 CASE WHEN s.s_suppkey % 5 = 1 AND year(l.l_shipdate) = 1995 THEN 'gov_funding' ELSE CASE l.l_orderkey % 4 WHEN 0 THEN 'total_expenses' WHEN 1 THEN 'expense_protection'
  WHEN 2 THEN 'expense_breeding' ELSE 'expense_feeding' END END AS metric,
 CASE WHEN l.l_discount >= 0.095 THEN NULL ELSE l.l_extendedprice END AS value
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey"""

SQL["series"] = """
SELECT user_id AS entity, CAST(day(ts) AS INT) AS period, sum(value) AS value
FROM events GROUP BY user_id, day(ts)"""

SQL["names"] = """
SELECT p_partkey AS id, CASE p_partkey % 10
  WHEN 0 THEN concat('  ', p_name, '**') WHEN 1 THEN concat(p_name, '- ', lower(p_type))
  WHEN 2 THEN concat('Всього ', p_name) WHEN 3 THEN concat(p_name, '-усього') WHEN 4 THEN 'Інші'
  WHEN 5 THEN concat(p_name, ' в тому числі ', p_brand) WHEN 6 THEN concat(p_name, '  "', p_brand, '"')
  WHEN 7 THEN 'байбак' WHEN 8 THEN concat('РАЗОМ по області ', p_brand)
  ELSE concat(p_name, ' - загальна кількість') END AS s
FROM part"""

SQL["row_labels"] = """
SELECT p_partkey AS id,
 CASE p_partkey % 8 WHEN 0 THEN concat('Добуто ', p_name) WHEN 1 THEN 'добуто' WHEN 2 THEN concat(p_name, ' - загальна кількість')
  WHEN 3 THEN 'Розселено' WHEN 4 THEN 'Відловлено ' WHEN 5 THEN 'виявлено загиблими' WHEN 6 THEN p_name END AS name,
 CASE WHEN p_size % 3 = 0 THEN 'ТОНН' WHEN p_size % 3 = 1 THEN 'голів' END AS unit,
 CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN 'Код тварини' WHEN 3 THEN NULL
  ELSE CAST(p_size * 20 AS VARCHAR(20)) END AS code
FROM part"""

SQL["number_texts"] = """
SELECT l_orderkey AS id, l_linenumber AS line,
 CASE l_orderkey % 7 WHEN 0 THEN CASE l_orderkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN '10d' WHEN 2 THEN '10f' ELSE '0x1p3' END WHEN 1 THEN '' WHEN 2 THEN 'nan' WHEN 3 THEN '1 234' WHEN 4 THEN NULL
  WHEN 5 THEN concat(' ', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)), ' ')
  ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20)) END AS s
FROM lineitem"""

SQL["sheets"] = """
SELECT DISTINCT concat('F', year(o_orderdate)) AS file_id, CAST(year(o_orderdate) AS INT) AS period,
 o_orderpriority AS sheet, CAST(substr(o_orderpriority, 1, 1) AS INT) AS sheet_ord
FROM orders"""

# numeric cells of a sheet with hosts down the rows (transitional-era layout)
SQL["grid_num"] = """
SELECT CAST(year(l_shipdate) AS INT) AS period, l_suppkey AS k, s_name, CAST(substr(p_brand, 7) AS INT) AS b,
 CASE l_returnflag WHEN 'R' THEN 16 + CAST(substr(p_brand, 7) AS INT) WHEN 'A' THEN 41 + CAST(substr(p_brand, 7) AS INT)
  ELSE 1 + CAST(substr(p_brand, 7) AS INT) % 16 END AS c,
 CAST(sum(l_quantity) AS BIGINT) AS q
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4, 5"""

SQL["cells"] = """
SELECT DISTINCT concat('F', period) AS file_id, period, '2-тп 1' AS sheet, 0 AS sheet_ord, CAST(r AS BIGINT) AS r, CAST(c AS INT) AS c, v FROM (
 SELECT period, 4 + k AS r, c, CASE WHEN sum(q) % 11 = 0 THEN NULL ELSE CAST(CAST(sum(q) AS BIGINT) AS VARCHAR(20)) END AS v FROM grid_num GROUP BY period, k, c
 UNION ALL SELECT period, 4 + k, 0, concat(' ', s_name) FROM grid_num
 UNION ALL SELECT period, 2, c, concat('brand#', CAST(b AS VARCHAR(4)), ' *') FROM grid_num WHERE c > 16
 UNION ALL SELECT period, 3, c, CASE WHEN b % 2 = 0 THEN 'в неволі' ELSE 'Чисельність всього' END FROM grid_num WHERE c > 16
 UNION ALL SELECT period, 0, 17, 'Чисельність копитних' FROM grid_num
 UNION ALL SELECT period, 0, 42, 'Кількість добутих (вилучених) копитних' FROM grid_num
 UNION ALL SELECT period, 3, 0, 'Користувач' FROM grid_num
 UNION ALL SELECT period, 9999999999, 0, 'Усього по області' FROM grid_num) q"""

# numeric cells of a sheet with hosts across the columns (early-era layout)
SQL["early_num"] = """
SELECT CAST(year(l_shipdate) AS INT) AS period, l_suppkey AS k, s_name, CAST(substr(p_brand, 7) AS INT) AS b,
 CASE WHEN l_returnflag = 'N' THEN CASE l_orderkey % 13 WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 9 WHEN 3 THEN 10 WHEN 4 THEN 11
   WHEN 5 THEN 12 WHEN 6 THEN 16 WHEN 7 THEN 17 WHEN 8 THEN 18 WHEN 9 THEN 21 WHEN 10 THEN 22 WHEN 11 THEN 27 ELSE 30 END
  WHEN l_returnflag = 'R' THEN 34 + 5 * (CAST(substr(p_brand, 7) AS INT) - 1)
  ELSE 35 + 5 * (CAST(substr(p_brand, 7) AS INT) - 1) + l_orderkey % 2 END AS r,
 CAST(sum(l_quantity) AS BIGINT) AS q
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4, 5"""

SQL["cells_early"] = """
SELECT DISTINCT concat('F', period) AS file_id, period, 'S' AS sheet, 0 AS sheet_ord, CAST(r AS BIGINT) AS r, CAST(c AS INT) AS c, v FROM (
 SELECT period, r, 3 + k AS c, CAST(CAST(sum(q) AS BIGINT) AS VARCHAR(20)) AS v FROM early_num GROUP BY period, r, k
 UNION ALL SELECT period, 5, 3 + k, s_name FROM early_num
 UNION ALL SELECT period, 5, 1, 'Найменування' FROM early_num
 UNION ALL SELECT period, 5, 2000000000, 'Всього' FROM early_num
 UNION ALL SELECT period, 162, 0, 'Розділ ІV' FROM early_num
 UNION ALL SELECT period, r, 0, CAST(b * 20 AS VARCHAR(20)) FROM early_num WHERE r >= 34 AND (r - 34) % 5 = 0
 UNION ALL SELECT period, r, 1, CASE WHEN b % 3 = 0 THEN concat('brand ', CAST(b AS VARCHAR(4)), ' - загальна кількість')
   ELSE concat('brand ', CAST(b AS VARCHAR(4))) END FROM early_num WHERE r >= 34 AND (r - 34) % 5 = 0
 UNION ALL SELECT period, r, 1, 'Добуто' FROM early_num WHERE r >= 34 AND (r - 34) % 5 > 0
 UNION ALL SELECT period, r, 2, CASE WHEN (r - 34) % 5 = 2 THEN 'тонн' ELSE 'голів' END FROM early_num WHERE r >= 34 AND (r - 34) % 5 > 0
 UNION ALL SELECT period, r + 4, 0, 'Код тварини' FROM early_num WHERE r >= 34 AND (r - 34) % 5 = 0 AND b % 7 = 0) q"""

# a long species section: four rows per part and year
SQL["state_rows"] = """
SELECT concat('F', period) AS file_id, 'S' AS sheet, period, r, max(code) AS code, max(name) AS name, max(unit) AS unit FROM (
 SELECT CAST(year(l_shipdate) AS INT) AS period, 4 * l_partkey + CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS r,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey * 20 AS VARCHAR(20)) WHEN l_returnflag = 'N' AND l_partkey % 11 = 0 THEN 'Код тварини' END AS code,
  CASE WHEN l_returnflag = 'R' THEN concat('part ', CAST(l_partkey AS VARCHAR(20)), CASE WHEN l_partkey % 3 = 0 THEN ' - загальна кількість' ELSE '' END)
   WHEN l_returnflag = 'A' THEN 'Добуто' WHEN l_partkey % 4 = 0 THEN NULL ELSE 'розселено' END AS name,
  CASE WHEN l_partkey % 2 = 0 THEN 'тонн' ELSE 'голів' END AS unit
 FROM lineitem) q GROUP BY period, r"""

# event log with merged host cells: only an order's first line names the host
SQL["event_rows"] = """
SELECT concat('F', period) AS file_id, 'Розселення' AS sheet, period, r,
 CASE WHEN line = 1 AND k % 13 = 0 THEN 'Разом' WHEN line = 1 AND k % 17 = 0 THEN '0501234567' WHEN line = 1 THEN concat(s_name, ' ') END AS host,
 CASE WHEN q % 9 = 0 THEN NULL ELSE p_type END AS species, CASE WHEN q % 5 = 0 THEN 'x' ELSE CAST(q AS VARCHAR(20)) END AS count,
 concat(' ', p_brand) AS location, CASE WHEN q % 2 = 0 THEN p_name END AS origin
FROM (SELECT CAST(year(l_shipdate) AS INT) AS period, 2 + l_orderkey * 8 + l_linenumber AS r, l_linenumber AS line,
  min(l_suppkey) AS k, min(l_partkey) AS p, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2, 3) e
JOIN supplier ON k = s_suppkey JOIN part ON p = p_partkey"""

SQL["harvest"] = """
SELECT p.host, p.year, p.value AS population, h.value AS shot_heads, h.value / p.value AS harvest_rate,
 CASE WHEN h.value / p.value >= 1.15 THEN 1 ELSE 0 END AS label
FROM panel p JOIN panel h ON p.year = h.year AND p.host = h.host
WHERE p.metric = 'count' AND p.species = 'SMALL' AND p.value > 0
 AND h.metric = 'shot_heads' AND h.species = 'SMALL' AND h.value IS NOT NULL AND h.year <= 2001"""

SQL["harvest_f"] = """
SELECT * FROM (SELECT h.*,
  CASE WHEN count(*) OVER (PARTITION BY host) >= 3 THEN regr_slope(population, year) OVER (PARTITION BY host) ELSE 0.0 END AS pop_trend,
  lag(harvest_rate) OVER (PARTITION BY host ORDER BY year) AS harvest_rate_lag
 FROM harvest h) t WHERE harvest_rate_lag IS NOT NULL"""

def exact_sum_sql(value: str) -> str:
    """DuckDB: the sum from exact integer sums of whole parts and fractions (in units of 2^-62)."""
    unit = "4611686018427387904.0"
    whole = f"CAST(sum(CAST(trunc({value}) AS HUGEINT)) AS DOUBLE)"
    fraction = f"CAST(sum(CAST(trunc(({value} - trunc({value})) * {unit}::DOUBLE) AS HUGEINT)) AS DOUBLE)"
    return f"({whole} + {fraction} / {unit}::DOUBLE)"


def exact_mean_sql(value: str) -> str:
    return f"{exact_sum_sql(value)} / nullif(count({value}), 0)"


def _metric(name: str) -> str:
    return exact_mean_sql(f"CASE WHEN metric = '{name}' THEN value END")


SQL["fin_wide"] = f"""
SELECT year, host, {_metric('total_expenses')} AS total_expenses,
 {_metric('expense_protection')} AS expense_protection,
 {_metric('expense_breeding')} AS expense_breeding,
 {_metric('expense_feeding')} AS expense_feeding
FROM fin_raw GROUP BY year, host HAVING count(value) > 0"""


def _rolling(name: str) -> str:
    """Mean of three rows, added oldest first."""
    back = [f"coalesce(lag({name}, {k}) OVER w, 0)" for k in (2, 1)]
    return f"({back[0]} + {back[1]} + coalesce({name}, 0)) / nullif(count({name}) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS {name}"


SQL["lag_f"] = f"""
SELECT host, year, population_t, population_t1, total_expenses, expense_protection, expense_breeding,
 coalesce(expense_feeding, 0) AS expense_feeding, population_t1 - population_t AS delta
FROM (SELECT p.host, p.year, p.value AS population_t,
  lead(p.value) OVER w AS population_t1, lead(p.year) OVER w AS next_year,
  {_rolling('total_expenses')}, {_rolling('expense_protection')},
  {_rolling('expense_breeding')}, {_rolling('expense_feeding')}
 FROM (SELECT * FROM panel WHERE metric = 'count' AND species = 'SMALL') p JOIN fin_wide f ON p.year = f.year AND p.host = f.host
 WINDOW w AS (PARTITION BY p.host ORDER BY p.year)) t
WHERE next_year - year = 1 AND population_t IS NOT NULL AND population_t1 IS NOT NULL AND total_expenses IS NOT NULL
 AND expense_protection IS NOT NULL AND expense_breeding IS NOT NULL"""

SQL["anomaly_f"] = """
SELECT host, year, value, change_pct, deviation FROM (
 SELECT host, year, value, count(*) OVER (PARTITION BY host) AS n,
  CASE WHEN lag(year) OVER (PARTITION BY host ORDER BY year) = year - 1
   THEN (value - lag(value) OVER (PARTITION BY host ORDER BY year)) / nullif(lag(value) OVER (PARTITION BY host ORDER BY year), 0) * 100 END AS change_pct,
  CASE WHEN stddev_samp(value) OVER (PARTITION BY host) > 0
   THEN (value - avg(value) OVER (PARTITION BY host)) / stddev_samp(value) OVER (PARTITION BY host) ELSE 0.0 END AS deviation
 FROM panel WHERE metric = 'count' AND species = 'SMALL' AND value IS NOT NULL) t
WHERE n >= 6 AND change_pct IS NOT NULL AND deviation IS NOT NULL"""

SQL["host_f"] = """
SELECT a.host, coalesce(mean_small, 0) AS mean_small, coalesce(mean_large, 0) AS mean_large, coalesce(mean_promo, 0) AS mean_promo,
 n_years, trend, coalesce(expenses, 0) AS expenses
FROM (SELECT host, avg(value) FILTER (species = 'SMALL') AS mean_small, avg(value) FILTER (species = 'LARGE') AS mean_large,
  avg(value) FILTER (species = 'PROMO') AS mean_promo, count(DISTINCT year) AS n_years,
  CASE WHEN count(value) FILTER (species = 'SMALL') >= 3 THEN coalesce(regr_slope(CASE WHEN species = 'SMALL' THEN value END, year), 0) ELSE 0 END AS trend
 FROM panel WHERE metric = 'count' GROUP BY host) a
LEFT JOIN (SELECT host, avg(value) AS expenses FROM fin_raw WHERE metric = 'total_expenses' GROUP BY host) e ON a.host = e.host
WHERE a.host NOT IN (SELECT s_name FROM supplier WHERE s_suppkey % 50 = 7)"""

NEEDS = {
    "panel": ("facts_raw", "host_map"), "cells": ("grid_num",), "cells_early": ("early_num",),
    "harvest": ("panel",), "harvest_f": ("harvest",), "fin_wide": ("fin_raw",), "lag_f": ("panel", "fin_wide"),
    "anomaly_f": ("panel",), "host_f": ("panel", "fin_raw"),
}


def oracle(query: str, *views: str) -> str:
    """The query with the views it names as CTEs."""
    wanted: list[str] = []

    def need(view: str) -> None:
        for other in NEEDS.get(view, ()):
            need(other)
        if view not in wanted:
            wanted.append(view)

    for view in views:
        need(view)
    ctes = ",\n".join(f"{v} AS ({SQL[v].strip()})" for v in wanted)
    if not ctes:
        return query.strip()
    body = query.strip()
    return f"WITH {ctes},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {ctes}\n{body}"


# --- the same views as DataFrames -------------------------------------------------


def _run(name: str, tables: tuple[str, ...]):
    """A view whose SQL reads base tables only: the text is shared with the oracle."""

    def view(spark: SparkSession, folder: str) -> DataFrame:
        text = SQL[name]
        for t in tables:
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {t}", f"{word} {{{t}}}")
        return spark.sql(text, **{t: table(spark, folder, t) for t in tables})

    return view


facts_raw = _run("facts_raw", ("lineitem", "supplier", "part"))
fin_raw = _run("fin_raw", ("lineitem", "supplier"))
series = _run("series", ("events",))
names = _run("names", ("part",))
row_labels = _run("row_labels", ("part",))
number_texts = _run("number_texts", ("lineitem",))
sheets = _run("sheets", ("orders",))
grid_num = _run("grid_num", ("lineitem", "part", "supplier"))
early_num = _run("early_num", ("lineitem", "part", "supplier"))
event_rows = _run("event_rows", ("lineitem", "supplier", "part"))


STATE_TASK_ROWS = 200_000  # lines whose labels one task sorts


def state_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines are dealt by their sheet row while they are narrow; labels are made after that.

    The largest label of a row needs a sort, so the number of tasks follows the number of lines.
    """
    lines = table(spark, folder, "lineitem").select(
        F.expr("CAST(year(l_shipdate) AS INT)").alias("period"),
        F.expr("4 * l_partkey + CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END").alias("r"),
        "l_partkey", "l_returnflag",
    )
    tasks = max(1, -(-lines.count() // STATE_TASK_ROWS))
    code = """CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey * 20 AS VARCHAR(20))
      WHEN l_returnflag = 'N' AND l_partkey % 11 = 0 THEN 'Код тварини' END"""
    name = """CASE WHEN l_returnflag = 'R' THEN concat('part ', CAST(l_partkey AS VARCHAR(20)),
       CASE WHEN l_partkey % 3 = 0 THEN ' - загальна кількість' ELSE '' END)
      WHEN l_returnflag = 'A' THEN 'Добуто' WHEN l_partkey % 4 = 0 THEN NULL ELSE 'розселено' END"""
    unit = "CASE WHEN l_partkey % 2 = 0 THEN 'тонн' ELSE 'голів' END"
    top = lines.repartition(tasks, "period", "r").groupBy("period", "r").agg(
        *[F.expr(f"max({text})").alias(n) for n, text in (("code", code), ("name", name), ("unit", unit))]
    )
    file_id = F.concat(F.lit("F"), F.col("period").cast("string"))
    return top.select(file_id.alias("file_id"), F.lit("S").alias("sheet"), "period", "r", "code", "name", "unit")


def host_map(spark: SparkSession, folder: str) -> DataFrame:
    """Four spellings per supplier, from one scan."""
    s = table(spark, folder, "supplier").filter("s_suppkey % 17 <> 3")
    name = F.col("s_name")
    spellings = F.array(name, F.concat(name, F.lit(" ")), F.upper(name), F.concat(F.lit("GP "), name))
    return s.select(
        F.explode(spellings).alias("host_raw"),
        F.when(F.col("s_suppkey") % 10 == 0, "SKIP").otherwise(name).alias("host_canonical"),
    )


def panel(spark: SparkSession, folder: str) -> DataFrame:
    means = resolve_mean(facts_raw(spark, folder), host_map(spark, folder), ["year", "species", "metric"])
    return means.select("year", "host", "species", "metric", "value")


def _label(r, c, v, when=None):
    r = F.lit(r).cast("bigint") if isinstance(r, int) else r.cast("bigint")
    return F.struct(
        (r if when is None else F.when(when, r)).alias("r"),
        (F.lit(c) if isinstance(c, int) else c).cast("int").alias("c"),
        (F.lit(v) if isinstance(v, str) else v.cast("string")).alias("v"),
        F.lit(None).cast("bigint").alias("q"),
    )


def _number(r, c):
    return F.struct(
        r.cast("bigint").alias("r"), c.cast("int").alias("c"), F.lit(None).cast("string").alias("v"), F.col("q").alias("q")
    )


def _grid(num: DataFrame, sheet: str, emitted: list, blank) -> DataFrame:
    """Every numeric cell also emits the labels around it; cells are merged by position,
    so the numeric cells are computed once and duplicates vanish map-side. A label's
    text is a grouping key, not a ``max``: that keeps the aggregation hash-based."""
    placed = num.select("period", F.explode(F.filter(F.array(*emitted), lambda x: x["r"].isNotNull())).alias("x"))
    merged = placed.groupBy(
        "period", F.col("x.r").alias("r"), F.col("x.c").alias("c"), F.col("x.v").alias("v")
    ).agg(F.sum("x.q").alias("q"))
    number = F.when(~blank(F.col("q")), F.col("q").cast("string"))
    grid = merged.select(
        F.concat(F.lit("F"), F.col("period").cast("string")).alias("file_id"), "period", F.lit(sheet).alias("sheet"),
        F.lit(0).alias("sheet_ord"), "r", "c", F.when(F.col("q").isNull(), F.col("v")).otherwise(number).alias("v"),
    )
    return materialize(grid, "cells")  # reports are a stored table; operators scan it several times


def _as_grid(placed: DataFrame, sheet: str) -> DataFrame:
    return placed.select(
        F.concat(F.lit("F"), F.col("period").cast("string")).alias("file_id"), "period", F.lit(sheet).alias("sheet"),
        F.lit(0).alias("sheet_ord"), "r", "c", "v",
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Labels are made once per host, header column or year, not once per number."""
    num = materialize(grid_num(spark, folder), "numbers")
    c, b, r, q = F.col("c"), F.col("b"), F.col("k") + 4, F.col("q")
    numbers = num.groupBy("period", "k", "c").agg(F.sum("q").alias("q"))
    hosts = num.select("period", "k", "s_name").distinct()
    heads = num.filter(c > 16).select("period", "c", "b").distinct()
    titles = [
        _label(0, 17, "Чисельність копитних"),
        _label(0, 42, "Кількість добутих (вилучених) копитних"),
        _label(3, 0, "Користувач"),
        _label(9999999999, 0, "Усього по області"),
    ]
    above = [
        _label(2, c, F.concat(F.lit("brand#"), b.cast("string"), F.lit(" *"))),
        _label(3, c, F.when(b % 2 == 0, "в неволі").otherwise("Чисельність всього")),
    ]
    labels = num.select("period").distinct().select("period", F.inline(F.array(*titles)))
    labels = labels.unionByName(heads.select("period", F.inline(F.array(*above))))
    labels = labels.unionByName(hosts.select("period", F.inline(F.array(_label(r, 0, F.concat(F.lit(" "), "s_name"))))))
    labels = labels.select("period", "r", "c", "v").filter("r IS NOT NULL").distinct()
    placed = numbers.select("period", r.cast("bigint").alias("r"), c.cast("int").alias("c"), F.when(q % 11 != 0, q.cast("string")).alias("v"))
    return materialize(_as_grid(placed.filter("r IS NOT NULL").unionByName(labels), "2-тп 1"), "cells")


def cells_early(spark: SparkSession, folder: str) -> DataFrame:
    r, b = F.col("r"), F.col("b")
    head = (r >= 34) & ((r - 34) % 5 == 0)
    detail = (r >= 34) & ((r - 34) % 5 > 0)
    title = F.concat(F.lit("brand "), b.cast("string"))
    emitted = [
        _number(r, F.col("k") + 3),
        _label(5, F.col("k") + 3, F.col("s_name")),
        _label(5, 1, "Найменування"),
        _label(5, 2000000000, "Всього"),
        _label(162, 0, "Розділ ІV"),
        _label(r, 0, (b * 20).cast("string"), head),
        _label(r, 1, F.when(b % 3 == 0, F.concat(title, F.lit(" - загальна кількість"))).otherwise(title), head),
        _label(r, 1, "Добуто", detail),
        _label(r, 2, F.when((r - 34) % 5 == 2, "тонн").otherwise("голів"), detail),
        _label(r + 4, 0, "Код тварини", head & (b % 7 == 0)),
    ]
    return _grid(early_num(spark, folder), "S", emitted, lambda q: F.lit(False))
