"""Scans, layout discovery, reshaping and ordered scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel import schemas
from gridpanel.functions.text import is_aggregate, is_species_header, norm_species_v1
from gridpanel.operators import layout, reshape, scan
from gridpanel.operators.joins import pin
from gridpanel.plans import ingest, layouts as L
from gridpanel.session import materialize, shared_path
from gridpanel.sources import cells as cell_source
from gridpanel.sources import facts as fact_source
from suite import views as V
from suite.registry import case
from suite.tables import table

# --- scans, sources, sinks ---------------------------------------------------------


@case(
    "scan_cells",
    """SELECT file_id, period, sheet, count(*) AS n_cells, count(v) AS n_filled, max(c) AS last_c FROM cells
       GROUP BY file_id, period, sheet""",
    ["cells"],
)
def _scan_cells(spark, d):
    path = shared_path(spark, "cells")
    cell_source.write_cells(V.cells(spark, d), path)
    cells = cell_source.scan_cells(spark, path)
    return cells.groupBy("file_id", "period", "sheet").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count("v").alias("n_filled"), F.max("c").alias("last_c")
    )


@case("scan_fact_csv", "SELECT year, host, species, metric, value FROM panel", ["panel"], ["value"])
def _scan_fact_csv(spark, d):
    path = shared_path(spark, "facts")
    fact_source.write_table(V.panel(spark, d), path, partition_by=(), fmt="csv")
    return fact_source.scan_fact_csv(spark, path, schemas.SPECIES_FACT)


@case(
    "scan_many_eras",
    """SELECT CASE WHEN year <= 1997 THEN 'early' WHEN year <= 1999 THEN 'middle' ELSE 'late' END AS era,
       year, count(*) AS n, sum(value) AS total FROM panel GROUP BY 1, 2""",
    ["panel"],
    ["total"],
)
def _scan_many_eras(spark, d):
    folder = shared_path(spark, "eras")
    facts = materialize(V.panel(spark, d), "panel")
    for suffix, span in (("", "year <= 1997"), ("_mid", "year IN (1998, 1999)"), ("_new", "year >= 2000")):
        fact_source.write_table(facts.filter(span), f"{folder}/populations{suffix}", partition_by=(), fmt="csv")
    rows = fact_source.scan_many_eras(spark, folder, "populations", schemas.SPECIES_FACT)
    return rows.groupBy("era", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# The panel in three files: the usual columns, other ones in another order, one column less.
REORDERED = (("value", "note", "species", "metric", "host", "year"), ("host", "metric", "year", "value"))


def _reordered_files(spark, d) -> str:
    folder = shared_path(spark, "reordered")
    facts = materialize(V.panel(spark, d).withColumn("note", F.concat(F.lit("n"), F.col("year").cast("string"))), "panel")
    for i, (columns, rows) in enumerate(
        ((schemas.SPECIES_FACT.names, "year <= 1997"), (REORDERED[0], "year IN (1998, 1999)"), (REORDERED[1], "year >= 2000"))
    ):
        fact_source.write_table(facts.filter(rows).select(*columns).coalesce(1), f"{folder}/part{i}", partition_by=(), fmt="csv")
    return folder


@case(
    "scan_reordered_csv",
    "SELECT year, host, CASE WHEN year < 2000 THEN species END AS species, metric, value FROM panel",
    ["panel"],
    ["value"],
)
def _scan_reordered_csv(spark, d):
    return fact_source.scan_fact_csv(spark, f"{_reordered_files(spark, d)}/*", schemas.SPECIES_FACT, required=["year", "host"])


@case(
    "csv_columns",
    """SELECT part, "column", CAST(position AS INT) AS position, status FROM (VALUES
       ('part0', 'year', 0, 'present'), ('part0', 'host', 1, 'present'), ('part0', 'species', 2, 'present'),
       ('part0', 'metric', 3, 'present'), ('part0', 'value', 4, 'present'),
       ('part1', 'value', 0, 'present'), ('part1', 'note', 1, 'unknown'), ('part1', 'species', 2, 'present'),
       ('part1', 'metric', 3, 'present'), ('part1', 'host', 4, 'present'), ('part1', 'year', 5, 'present'),
       ('part2', 'host', 0, 'present'), ('part2', 'metric', 1, 'present'), ('part2', 'year', 2, 'present'),
       ('part2', 'value', 3, 'present'), ('part2', 'species', NULL, 'absent')) v(part, "column", position, status)
       WHERE part IN (SELECT CASE WHEN year <= 1997 THEN 'part0' WHEN year <= 1999 THEN 'part1' ELSE 'part2' END FROM panel)""",
    ["panel"],
)
def _csv_columns(spark, d):
    found = fact_source.csv_columns(spark, f"{_reordered_files(spark, d)}/*", schemas.SPECIES_FACT)
    return found.select(F.regexp_extract("file", "(part[0-9])/", 1).alias("part"), "column", "position", "status")


@case("write_table", "SELECT host, species, metric, value, year FROM panel", ["panel"], ["value"])
def _write_table(spark, d):
    path = shared_path(spark, "panel")
    fact_source.write_table(V.panel(spark, d), path)
    return spark.read.schema(schemas.SPECIES_FACT).parquet(path)


@case("empty_typed", "SELECT year, host, species, metric, value FROM facts_raw", ["facts_raw"])
def _empty_typed(spark, d):
    absent = fact_source.empty_typed(spark, schemas.SPECIES_FACT)
    return absent.unionByName(V.facts_raw(spark, d))


# --- layout discovery --------------------------------------------------------------


@case(
    "header_row_fixed_col",
    "SELECT file_id, sheet, min(r) AS hdr_r FROM cells WHERE c = 0 AND r < 20 AND contains(v, 'Користувач') GROUP BY 1, 2",
    ["cells"],
)
def _header_row_fixed_col(spark, d):
    return layout.header_row(V.cells(spark, d), L.USER_WORD, col=0, required=True)


@case(
    "header_row_any_col",
    "SELECT file_id, sheet, min(r) AS hdr_r FROM cells WHERE contains(v, 'Кількість добутих') GROUP BY 1, 2",
    ["cells"],
)
def _header_row_any_col(spark, d):
    return layout.header_row(V.cells(spark, d), "Кількість добутих")


@case(
    "sheet_by_keyword",
    "SELECT file_id, min_by(sheet, sheet_ord) AS sheet FROM sheets WHERE contains(lower(sheet), 'um') OR contains(lower(sheet), 'medi') GROUP BY 1",
    ["sheets"],
)
def _sheet_by_keyword(spark, d):
    return layout.sheet_by_keyword(V.sheets(spark, d), "UM")


@case(
    "sheet_by_priority",
    """SELECT file_id, min_by(sheet, CASE sheet WHEN '6-NONE' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END) AS sheet FROM sheets
       WHERE sheet IN ('5-LOW', '1-URGENT') GROUP BY 1""",
    ["sheets"],
)
def _sheet_by_priority(spark, d):
    return layout.sheet_by_priority(V.sheets(spark, d), ["6-NONE", "5-LOW", "1-URGENT"])


SECTION_WORDS = {"count": L.COUNT_SECTIONS["ungulates"], "shot": L.HARVEST_SECTIONS["ungulates"]}
SECTIONS_SQL = """SELECT h.file_id, h.sheet, CASE WHEN contains(h.v, 'Чисельність копитних') THEN 'count' ELSE 'shot' END AS section,
 h.c AS c0, CAST(coalesce((SELECT min(n.c) - 1 FROM cells n WHERE n.file_id = h.file_id AND n.r = 0 AND n.c > h.c AND n.v IS NOT NULL),
  (SELECT max(m.c) FROM cells m WHERE m.file_id = h.file_id)) AS INT) AS c1
FROM cells h WHERE h.r = 0 AND h.v IS NOT NULL"""


def _section_ranges(cells: DataFrame) -> DataFrame:
    hdr = pin(layout.header_row(cells, SECTION_WORDS["count"]))
    return pin(layout.sections(cells, hdr, SECTION_WORDS))


@case("section_ranges", SECTIONS_SQL, ["cells"])
def _sections(spark, d):
    return _section_ranges(V.cells(spark, d))


SPECIES_COLS_SQL = f"""WITH ranges AS ({SECTIONS_SQL})
SELECT s.file_id, s.sheet, g.section, s.c, concat('B', substr(regexp_replace(s.v, ' *[*]+$', ''), 2)) AS species
FROM cells s JOIN ranges g ON s.file_id = g.file_id AND s.c BETWEEN g.c0 AND g.c1 WHERE s.r = 2 AND s.v IS NOT NULL"""


@case("section_species_cols", SPECIES_COLS_SQL, ["cells"])
def _section_species_cols(spark, d):
    cells = V.cells(spark, d)
    return layout.section_species(cells, _section_ranges(cells), layout.fixed_row(cells, 2))


@case(
    "first_data_row",
    """SELECT x.file_id, x.sheet, min(x.r) AS first_r FROM cells x JOIN (SELECT file_id, min(r) AS h FROM cells
       WHERE c = 0 AND r < 20 AND contains(v, 'Користувач') GROUP BY 1) y ON x.file_id = y.file_id
       WHERE x.c = 0 AND x.v IS NOT NULL AND x.r > y.h GROUP BY 1, 2""",
    ["cells"],
)
def _first_data_row(spark, d):
    cells = V.cells(spark, d)
    return layout.first_data_row(cells, layout.header_row(cells, L.USER_WORD, col=0))


@case(
    "row_slice",
    "SELECT file_id, r, c, v FROM cells_early WHERE r >= 5 + 29 AND r < 162",
    ["cells_early"],
)
def _row_slice(spark, d):
    cells = V.cells_early(spark, d)
    start = layout.header_row(cells, L.NAME_WORD, col=1)
    end = layout.header_row(cells, L.SECTION_FOUR_WORDS, col=0, name="end_r")
    return layout.row_slice(cells, start, end, L.EARLY_SPECIES_OFFSET).select("file_id", "r", "c", "v")


def _cases(position: str, names: dict[int, str]) -> str:
    return f"CASE {position} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " END"


def _listed(names: dict[int, str]) -> str:
    return ", ".join(str(k) for k in names)


@case(
    "layout_by_column",
    f"SELECT file_id, r, c, v, {_cases('c', L.HYBRID_FINANCE_COLS)} AS metric FROM cells WHERE c IN ({_listed(L.HYBRID_FINANCE_COLS)})",
    ["cells"],
)
def _layout_by_column(spark, d):
    out = layout.layout_by_column(V.cells(spark, d), L.HYBRID_FINANCE_COLS)
    return out.select("file_id", "r", "c", "v", "metric")


@case(
    "layout_by_row_offset",
    f"SELECT file_id, r, c, v, {_cases('r - 5', L.EARLY_ENTITY_ROWS)} AS metric FROM cells_early WHERE r - 5 IN ({_listed(L.EARLY_ENTITY_ROWS)})",
    ["cells_early"],
)
def _layout_by_row_offset(spark, d):
    cells = V.cells_early(spark, d)
    out = layout.layout_by_row_offset(cells, layout.header_row(cells, L.NAME_WORD, col=1), L.EARLY_ENTITY_ROWS)
    return out.select("file_id", "r", "c", "v", "metric")


COL_RANGES = ((17, 42, "count"), (42, 67, "shot_heads"))


@case(
    "layout_by_col_range",
    """SELECT x.file_id, x.r, x.c, x.v, CASE WHEN x.c < 42 THEN 'count' ELSE 'shot_heads' END AS metric, regexp_replace(s.v, ' *[*]+$', '') AS species
       FROM cells x JOIN cells s ON x.file_id = s.file_id AND x.c = s.c AND s.r = 2 WHERE x.c >= 17 AND x.c < 67 AND x.r >= 4""",
    ["cells"],
)
def _layout_by_col_range(spark, d):
    cells = V.cells(spark, d)
    ranged = layout.layout_by_col_range(cells, COL_RANGES)
    keys = layout.header_names(ranged, layout.fixed_row(cells, 2), norm_species_v1, keep=["metric"])
    out = cells.filter("r >= 4").join(keys, ["file_id", "sheet", "c"])
    return out.select("file_id", "r", "c", "v", "metric", "species")


@case(
    "two_row_header",
    """SELECT a.file_id, a.sheet, a.c, concat('B', substr(regexp_replace(a.v, ' *[*]+$', ''), 2)) AS species
       FROM cells a JOIN cells b ON a.file_id = b.file_id AND a.c = b.c AND a.r = 2 AND b.r = 3 WHERE contains(b.v, 'Чисельність всього')""",
    ["cells"],
)
def _two_row_header(spark, d):
    return layout.two_row_header(V.cells(spark, d), L.COUNT_TOTAL_WORD, species_row=2, sub_row=3)


# --- reshape -----------------------------------------------------------------------

MELT_ROWS_SQL = f"""WITH keys AS ({SPECIES_COLS_SQL.replace('WITH ranges', 'WITH RECURSIVE ranges')})
SELECT x.period AS year, trim(h.v) AS host, k.species, CASE k.section WHEN 'count' THEN 'count' ELSE 'shot_heads' END AS metric,
 try_cast(x.v AS DOUBLE) AS value
FROM cells x JOIN keys k ON x.file_id = k.file_id AND x.c = k.c
JOIN cells h ON h.file_id = x.file_id AND h.r = x.r AND h.c = 0
WHERE h.r > 3 AND NOT contains(lower(h.v), 'усього')"""


@case("melt_hosts_rows", MELT_ROWS_SQL, ["cells"])
def _melt_hosts_rows(spark, d):
    cells = V.cells(spark, d)
    hdr = pin(layout.header_row(cells, L.USER_WORD, col=0))
    first = hdr.select("file_id", "sheet", (F.col("hdr_r") + 1).alias("first_r"))
    hosts = reshape.row_hosts(cells, first, lambda v: ~is_aggregate(v, True))
    keys = layout.section_species(cells, _section_ranges(cells), layout.fixed_row(cells, 2))
    metric = F.when(F.col("section") == "count", "count").otherwise("shot_heads")
    return reshape.melt_rows(cells, keys.withColumn("metric", metric).drop("section"), hosts)


EARLY_META = {**L.EARLY_ENTITY_ROWS, **L.EARLY_FINANCE_ROWS}


@case(
    "melt_hosts_cols",
    f"""SELECT x.period AS year, h.v AS host, {_cases('x.r - 5', EARLY_META)} AS metric, try_cast(x.v AS DOUBLE) AS value
        FROM cells_early x JOIN cells_early h ON x.file_id = h.file_id AND x.c = h.c AND h.r = 5
        WHERE x.c >= 3 AND x.r - 5 IN ({_listed(EARLY_META)}) AND NOT contains(lower(h.v), 'всього')""",
    ["cells_early"],
)
def _melt_hosts_cols(spark, d):
    cells = V.cells_early(spark, d)
    hdr = pin(layout.header_row(cells, L.NAME_WORD, col=1))
    hosts = reshape.column_hosts(cells, hdr, lambda v: ~is_aggregate(v))
    return reshape.melt_layout_cols(layout.layout_by_row_offset(cells, hdr, EARLY_META), hosts)


FIN_METRICS = ("total_expenses", "expense_protection", "expense_breeding", "expense_feeding")


@case("pivot_metrics", "SELECT * FROM fin_wide", ["fin_wide"], exact=True)
def _pivot_metrics(spark, d):
    return reshape.pivot_metrics(V.fin_raw(spark, d), ["year", "host"], [*FIN_METRICS, "gov_funding"]).drop("gov_funding")


@case(
    "unpivot_metrics",
    "SELECT year, host, metric, value FROM (SELECT * FROM fin_wide) UNPIVOT INCLUDE NULLS (value FOR metric IN (total_expenses, expense_protection, expense_breeding, expense_feeding))",
    ["fin_wide"],
    exact=True,
)
def _unpivot_metrics(spark, d):
    wide = reshape.pivot_metrics(V.fin_raw(spark, d), ["year", "host"], [*FIN_METRICS, "gov_funding"]).drop("gov_funding")
    return reshape.unpivot_metrics(wide, ["year", "host"], FIN_METRICS)


@case(
    "route_by_metric",
    """SELECT CASE metric WHEN 'count' THEN 'populations' ELSE 'harvest' END AS target, metric, count(*) AS n, sum(value) AS total
       FROM facts_raw GROUP BY 1, 2""",
    ["facts_raw"],
    ["total"],
)
def _route_by_metric(spark, d):
    facts = V.facts_raw(spark, d).withColumn("target", reshape.route_column(F.col("metric")))
    return facts.groupBy("target", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# --- ordered scans -----------------------------------------------------------------


def _as_cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """Named row columns back to cells, column position = place in the list."""
    stack = F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("string").alias("v")) for i, n in enumerate(names)])
    flat = rows.select("file_id", "period", "sheet", F.lit(0).alias("sheet_ord"), "r", F.explode(stack).alias("x"))
    return flat.select("file_id", "period", "sheet", "sheet_ord", "r", "x.c", "x.v")


STATE_SQL = """WITH nx AS (
 SELECT s.*, n.code AS next_code, n.name AS next_name FROM state_rows s
 LEFT JOIN state_rows n ON s.file_id = n.file_id AND n.r = s.r + 1),
f AS (SELECT *, coalesce(code = 'Код тварини', false) AS clr,
  name IS NOT NULL AND coalesce(trim(code) NOT IN ('', 'Код тварини'), false) AS hdr,
  coalesce(CAST(try_cast(code AS DOUBLE) AS BIGINT) % 100 = 0, false) AS hundred FROM nx),
g AS (SELECT *, CASE WHEN clr OR (hdr AND hundred) THEN '' WHEN hdr THEN
   trim(CASE WHEN contains(name, ' - ') THEN split_part(name, ' - ', 1) ELSE split_part(name, ' -', 1) END) END AS ev FROM f),
s AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS species FROM g),
m AS (SELECT *, CASE WHEN contains(lower(name), 'добуто') THEN CASE WHEN contains(lower(unit), 'тонн') THEN 'shot_tons' ELSE 'shot_heads' END
  WHEN contains(lower(name), 'загальна кількість') THEN 'count' WHEN contains(lower(name), 'розселено') THEN 'relocated' END AS found,
  contains(name, ' -') OR coalesce(trim(next_code) <> '', false) OR next_name IS NULL AS own FROM s)
"""


def _state_input(spark, d) -> DataFrame:
    cells = _as_cells(V.state_rows(spark, d), ["code", "name", "unit"])
    return scan.grid_rows(cells, {0: "code", 1: "name", 2: "unit"}, {0: "next_code", 1: "next_name"})


@case(
    "species_state",
    STATE_SQL + """SELECT file_id, r, species, CASE WHEN hdr THEN coalesce(found, 'count') ELSE found END AS metric FROM m
    WHERE species <> '' AND ((hdr AND own AND NOT hundred) OR (NOT hdr AND name IS NOT NULL AND NOT clr AND found IS NOT NULL))""",
    ["state_rows"],
)
def _species_state(spark, d):
    return scan.species_state(_state_input(spark, d)).select("file_id", "r", "species", "metric")


@case(
    "header_value_lookahead",
    STATE_SQL + "SELECT file_id, r, own AS has_value FROM m WHERE hdr",
    ["state_rows"],
)
def _header_value_lookahead(spark, d):
    rows = _state_input(spark, d)
    headers = rows.filter(is_species_header(F.col("code")) & F.col("name").isNotNull())
    has = scan.header_has_value(F.col("name"), F.col("next_code"), F.col("next_name"))
    return headers.select("file_id", "r", has.alias("has_value"))


FFILL = "last_value(host IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@case("ffill_entity", f"SELECT file_id, r, {FFILL} AS host FROM event_rows", ["event_rows"])
def _ffill_entity(spark, d):
    return scan.ffill_entity(V.event_rows(spark, d).select("file_id", "sheet", "r", "host")).select("file_id", "r", "host")


EVENT_COLS = ["host", "species", "count", "location", "origin"]


def _event_cells(spark, d) -> DataFrame:
    log = _as_cells(V.event_rows(spark, d), EVENT_COLS)
    years = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("period")).distinct()
    head = years.select(
        F.concat(F.lit("F"), F.col("period").cast("string")).alias("file_id"), "period",
        F.lit("Розселення").alias("sheet"), F.lit(0).alias("sheet_ord"),
        F.lit(1).cast("bigint").alias("r"), F.lit(0).alias("c"), F.lit(L.USER_WORD).alias("v"),
    )
    return materialize(log.unionByName(head), "cells")


EVENTS_SQL = f"""SELECT year, trim(host) AS host, concat(upper(substr(species, 1, 1)), substr(species, 2)) AS species,
 try_cast(count AS DOUBLE) AS count, trim(location) AS location, trim(origin) AS origin
FROM (SELECT period AS year, coalesce({FFILL}, 'Користувач') AS host, species, count, location, origin FROM event_rows) t
WHERE host IS NOT NULL AND species IS NOT NULL AND NOT contains(lower(host), 'разом') AND NOT regexp_matches(host, '[0-9]{{10}}')"""


@case("relocation_events", EVENTS_SQL, ["event_rows"])
def _relocation_events(spark, d):
    cells = _event_cells(spark, d)
    return scan.relocation_events(cells, layout.header_row(cells, L.USER_WORD))


# --- whole eras --------------------------------------------------------------------


def _tagged(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        if "count" in df.columns:
            df = df.select("year", "host", "species", F.lit("event").alias("metric"), F.col("count").alias("value"))
        if "species" not in df.columns:
            df = df.withColumn("species", F.lit(None).cast("string"))
        part = df.select(F.lit(name).alias("tbl"), "year", "host", "species", "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


ENTITY_NAMES, FINANCE_NAMES = L.MIDDLE_ENTITY_COLS, L.HYBRID_FINANCE_COLS


@case(
    "era_hybrid",
    f"""WITH melted AS ({MELT_ROWS_SQL.replace('WITH keys', 'WITH RECURSIVE keys')}), hosts AS (
  SELECT file_id, r, trim(v) AS host FROM cells WHERE c = 0 AND r > 3 AND NOT contains(lower(v), 'усього'))
SELECT 'hosts_meta' AS tbl, x.period AS year, h.host, CAST(NULL AS VARCHAR) AS species, {_cases('x.c', ENTITY_NAMES)} AS metric, try_cast(x.v AS DOUBLE) AS value
FROM cells x JOIN hosts h ON x.file_id = h.file_id AND x.r = h.r WHERE x.c IN ({_listed(ENTITY_NAMES)})
UNION ALL SELECT 'finances', x.period, h.host, NULL, {_cases('x.c', FINANCE_NAMES)}, try_cast(x.v AS DOUBLE)
FROM cells x JOIN hosts h ON x.file_id = h.file_id AND x.r = h.r WHERE x.c IN ({_listed(FINANCE_NAMES)})
UNION ALL SELECT CASE metric WHEN 'count' THEN 'populations' ELSE 'harvest' END, year, host, species, metric, value FROM melted
UNION ALL SELECT 'relocation', year, host, species, 'event', count FROM ({EVENTS_SQL}) ev""",
    ["cells", "event_rows"],
)
def _era_hybrid(spark, d):
    cells = V.cells(spark, d).unionByName(_event_cells(spark, d))
    # the analog reports only have sections of one group
    return _tagged(ingest.ingest_hybrid(cells, missing="skip"))


# Reports with a renamed sheet (1996), a blank header cell (1998) and a blank section cell (1999).
DAMAGED = {
    "sheet": "CASE WHEN period = 1996 AND sheet = '2-тп 1' THEN 'інший' ELSE sheet END",
    "v": "CASE WHEN sheet = '2-тп 1' AND ((period = 1998 AND v = 'Користувач') OR (period = 1999 AND v LIKE 'Кількість добутих%')) THEN NULL ELSE v END",
}
_ON_MAIN = "EXISTS (SELECT 1 FROM m WHERE m.file_id = f.file_id AND m.sheet = '2-тп 1'{0})"
_SECTION = "main AND header AND " + _ON_MAIN.format(" AND m.r = 0 AND contains(m.v, '{0}')")
PARTS_SQL = {
    "main sheet": "main",
    "main header row": "main AND header",
    **{f"populations section {k}": _SECTION.format(w) for k, w in L.COUNT_SECTIONS.items()},
    **{f"harvest section {k}": _SECTION.format(w) for k, w in L.HARVEST_SECTIONS.items()},
    "relocation sheet": "log",
    "relocation header row": "log",
}


@case(
    "missing_parts",
    f"""WITH m AS (SELECT file_id, period, {DAMAGED['sheet']} AS sheet, r, c, {DAMAGED['v']} AS v FROM cells),
    f AS (SELECT file_id, min(period) AS period FROM (SELECT file_id, period FROM m UNION ALL SELECT file_id, period FROM event_rows) a GROUP BY 1),
    t AS (SELECT f.*, {_ON_MAIN.format('')} AS main, {_ON_MAIN.format(" AND m.c = 0 AND contains(m.v, 'Користувач')")} AS header,
      EXISTS (SELECT 1 FROM event_rows e WHERE e.file_id = f.file_id) AS log FROM f)
    {' UNION ALL '.join(f"SELECT file_id, period, '{part}' AS part FROM t f WHERE NOT ({found})" for part, found in PARTS_SQL.items())}""",
    ["cells", "event_rows"],
)
def _missing_parts(spark, d):
    cells = V.cells(spark, d).withColumns({name: F.expr(sql) for name, sql in DAMAGED.items()})
    return ingest.missing_parts(cells.unionByName(_event_cells(spark, d)), "hybrid")


@case("era_early", """WITH names AS (SELECT file_id, r, max(CASE WHEN c = 0 THEN v END) AS code, max(CASE WHEN c = 1 THEN v END) AS name,
  max(CASE WHEN c = 2 THEN v END) AS unit FROM cells_early WHERE c < 3 AND r >= 34 AND r < 162 GROUP BY 1, 2),
state_rows AS (SELECT * FROM names), """ + STATE_SQL[5:] + f"""SELECT CASE WHEN x.r - 5 IN ({_listed(L.EARLY_ENTITY_ROWS)}) THEN 'hosts_meta' ELSE 'finances' END AS tbl,
 x.period AS year, h.v AS host, CAST(NULL AS VARCHAR) AS species, {_cases('x.r - 5', EARLY_META)} AS metric, try_cast(x.v AS DOUBLE) AS value
FROM cells_early x JOIN cells_early h ON x.file_id = h.file_id AND x.c = h.c AND h.r = 5
WHERE x.c >= 3 AND x.r - 5 IN ({_listed(EARLY_META)}) AND NOT contains(lower(h.v), 'всього')
UNION ALL SELECT CASE WHEN t.metric = 'count' THEN 'populations' ELSE 'harvest' END, x.period, h.v, t.species, t.metric, try_cast(x.v AS DOUBLE)
FROM cells_early x JOIN cells_early h ON x.file_id = h.file_id AND x.c = h.c AND h.r = 5
JOIN (SELECT file_id, r, species, CASE WHEN hdr THEN coalesce(found, 'count') ELSE found END AS metric FROM m
 WHERE species <> '' AND ((hdr AND own AND NOT hundred) OR (NOT hdr AND name IS NOT NULL AND NOT clr AND found IS NOT NULL))) t
 ON x.file_id = t.file_id AND x.r = t.r
WHERE x.c >= 3 AND NOT contains(lower(h.v), 'всього')""", ["cells_early"])
def _era_early(spark, d):
    cells = V.cells_early(spark, d)
    return _tagged(ingest.ingest_early(cells))
