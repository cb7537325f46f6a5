"""The five report eras, from cells to long tables.

Each era is discovered first: one pass over the cells surveys every sheet, another one fetches
the header rows. What was found is compared with what the era's files must hold, so that a
renamed sheet or an absent section is an error (or a row of ``missing_parts``), not a silent
loss. Column and row keys of all tables then form one key table, and one pass over the cells
melts them all, written once and routed by table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel import schemas
from gridpanel.functions.numbers import to_number
from gridpanel.functions.text import is_aggregate, is_contaminant, norm_species_v1, norm_species_v2
from gridpanel.operators import layout, reshape, scan
from gridpanel.operators.filters import rescale_units
from gridpanel.operators.joins import join_dim, pin
from gridpanel.operators.layout import SHEET
from gridpanel.plans import layouts as L
from gridpanel.session import materialize
from gridpanel.sources.facts import empty_typed

Tables = dict[str, DataFrame]
ENTITY_TABLES = ("hosts_meta", "finances")
_NAMED = 20  # missing parts named in an error


class MissingParts(ValueError):
    """Files that lack a sheet, header row, section or data row of their era."""


def sheets_of(cells: DataFrame) -> DataFrame:
    return cells.select("file_id", "period", "sheet", "sheet_ord").distinct()


def _of_sheets(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cells of the sheets so named: a filter that file statistics can answer. No names: all cells."""
    return cells.filter(F.col("sheet").isin(list(names))) if names else cells


def _is_entity(extended: bool, denylist: Sequence[str] = ()) -> Callable[[Column], Column]:
    def keep(name: Column) -> Column:
        good = ~is_aggregate(name, extended)
        return good & ~is_contaminant(name, denylist) if extended else good

    return keep


class Discovery:
    """What was found of one era's files: the survey of their sheets and, per part, its place.

    A part is looked for only in files that have what it lies in, and a file without it
    has no row in ``found[part]`` (file_id, ...).
    """

    def __init__(self, cells: DataFrame, headers: Mapping[str, tuple[str | Sequence[str], int | None]], key_cols: Sequence[int] = (0,)):
        self.cells = cells
        self.survey = pin(layout.survey(cells, headers, key_cols), "survey")
        self.found: dict[str, DataFrame] = {}

    def sheet(self, part: str, order: Column) -> DataFrame:
        """Each file's first sheet by ``order``, with its survey."""
        row = F.struct(order.alias("_order"), *self.survey.columns)
        first = self.survey.filter(order.isNotNull()).groupBy("file_id").agg(F.min(row).alias("s"))
        self.found[part] = first.select("s.*").drop("_order")
        return self.found[part]

    def having(self, part: str, sheets: DataFrame, condition: Column) -> DataFrame:
        """The sheets that meet a condition on their survey."""
        self.found[part] = sheets.filter(condition)
        return self.found[part]

    def header_cells(self, *rows: tuple[DataFrame, Column], names: Sequence[str] = ()) -> DataFrame:
        """Filled cells of the given rows of the given sheets, all in one pass.

        ``names`` are the only names these sheets can have: others' cells are not read.
        """
        wanted = None
        for sheets, r in rows:
            part = sheets.select(*SHEET, r.cast("bigint").alias("r"))
            wanted = part if wanted is None else wanted.unionByName(part)
        return pin(layout.cells_at(_of_sheets(self.cells, names), wanted), "headers")

    def sections(self, table: str, header: DataFrame, sheets: DataFrame, hdr: DataFrame, words: Mapping[str, str]) -> DataFrame:
        """Column ranges of a table's sections; each section is a part."""
        ranges = layout.sections(header, hdr, words, width=sheets)
        for section in words:
            self.found[f"{table} section {section}"] = ranges.filter(F.col("section") == section)
        return ranges

    def missing(self) -> DataFrame:
        """(file_id, period, part): the parts that files lack."""
        have = None
        for part, found in self.found.items():
            rows = found.select("file_id", F.lit(part).alias("part"))
            have = rows if have is None else have.unionByName(rows)
        wanted = self.survey.groupBy("file_id").agg(F.min("period").alias("period"))
        wanted = wanted.withColumn("part", F.explode(F.array(*[F.lit(p) for p in self.found])))
        return wanted.join(have, ["file_id", "part"], "left_anti").select("file_id", "period", "part")

    def settle(self, missing: str) -> None:
        """Raise ``MissingParts`` unless ``missing`` is "skip"."""
        if missing not in ("error", "skip"):
            raise ValueError(f"missing must be 'error' or 'skip', not {missing!r}")
        if missing == "error":
            gaps = self.missing().orderBy("file_id", "part").limit(_NAMED).collect()
            if gaps:
                raise MissingParts("; ".join(f"no {g['part']} in {g['file_id']}" for g in gaps))




def _fixed(sheets: DataFrame, first_r: Column, tables: Mapping[str, Mapping[int, str]], host_col: int = 0) -> DataFrame:
    """Column keys that a layout fixes, and the column of the hosts."""
    rows = [F.struct(F.lit(host_col).alias("c"), F.lit(None).cast("string").alias("table"), F.lit(None).cast("string").alias("metric"))]
    rows += [
        F.struct(F.lit(c).alias("c"), F.lit(table).alias("table"), F.lit(metric).alias("metric"))
        for table, columns in tables.items()
        for c, metric in columns.items()
    ]
    keyed = sheets.select(*SHEET, first_r.cast("bigint").alias("first_r"), F.inline(F.array(*rows)))
    return keyed.select(*SHEET, "c", "first_r", "table", "metric", F.lit(None).cast("string").alias("species"))


def _species(columns: DataFrame, sheets: DataFrame, first_r: Column, table: Column, metric: Column) -> DataFrame:
    """Column keys from header cells (file_id, sheet, c, species)."""
    starts = sheets.select(*SHEET, first_r.cast("bigint").alias("first_r"))
    return columns.join(starts, SHEET).select(*SHEET, "c", "first_r", table.alias("table"), metric.alias("metric"), "species")


def _route(facts: DataFrame, tables: Sequence[str]) -> Tables:
    """The facts written once, by table; each table reads its own files."""
    stored = materialize(facts.select("table", "year", "host", "species", "metric", "value"), "era", partition_by=["table"])
    out = {}
    for name in tables:
        own = stored.filter(F.col("table") == name)
        out[name] = own.select("year", "host", *([] if name in ENTITY_TABLES else ["species"]), "metric", "value")
    return out


def _events(found: Discovery, denylist: Sequence[str]) -> Callable[[], DataFrame]:
    """The relocation sheet's event log, as a plan to be made once nothing is missing."""
    log = found.sheet("relocation sheet", layout.named_like(L.RELOCATION_SHEET_WORD))
    log = found.having("relocation header row", log, F.col("user").isNotNull())

    def read() -> DataFrame:
        hdr = pin(log.select(*SHEET, F.col("user").alias("hdr_r")), "header")
        return scan.relocation_events(join_dim(found.cells, hdr.select(*SHEET), SHEET, how="left_semi"), hdr, denylist)

    return read


def _main(found: Discovery, order: Column, data_row: bool) -> DataFrame:
    """The main sheet with its header row and, where the era asks for it, a data row."""
    main = found.sheet("main sheet", order)
    main = found.having("main header row", main, F.col("user_first").isNotNull())
    return found.having("main data row", main, F.col("last_r0") > F.col("user_first")) if data_row else main


def _discover_early(cells: DataFrame) -> tuple[Discovery, DataFrame]:
    found = Discovery(cells, {"hdr_r": (L.NAME_WORD, 1), "end_r": (L.SECTION_FOUR_WORDS, 0)})
    sheets = found.sheet("sheet", F.col("sheet_ord"))
    sheets = found.having("header row", sheets, F.col("hdr_r").isNotNull())
    return found, found.having("section four", sheets, F.col("end_r").isNotNull())


def ingest_early(cells: DataFrame, missing: str = "error") -> Tables:
    """Hosts across the columns, species blocks down the rows (state machine).

    Row labels and the header row are fetched in one pass and the numbers in another; a
    row's table, metric and species come from its distance to the header or from the state.
    """
    found, sheets = _discover_early(cells)
    found.settle(missing)
    bounds = pin(sheets.select(*SHEET, "hdr_r", "end_r"), "bounds")
    first = L.EARLY_FIRST_HOST_COL
    labels = join_dim(cells.filter("v IS NOT NULL"), bounds, SHEET).filter((F.col("c") < first) | (F.col("r") == F.col("hdr_r")))
    labels = pin(labels, "labels")
    header = labels.filter((F.col("r") == F.col("hdr_r")) & (F.col("c") >= first))
    hosts = header.filter(_is_entity(False)(F.col("v"))).select(*SHEET, "c", F.col("v").alias("host"))
    species = labels.filter((F.col("c") < first) & (F.col("r") >= F.col("hdr_r") + L.EARLY_SPECIES_OFFSET) & (F.col("r") < F.col("end_r")))
    rows = scan.grid_rows(species, {0: "code", 1: "name", 2: "unit"}, {0: "next_code", 1: "next_name"}, scan.BLOCK_ROWS)
    states = scan.species_state(rows).withColumn("table", reshape.route_column(F.col("metric")))
    offsets = [
        F.struct((F.col("hdr_r") + off).alias("r"), F.lit(table).alias("table"), F.lit(metric).alias("metric"))
        for table, layout_rows in (("hosts_meta", L.EARLY_ENTITY_ROWS), ("finances", L.EARLY_FINANCE_ROWS))
        for off, metric in layout_rows.items()
    ]
    fixed = bounds.select(*SHEET, F.inline(F.array(*offsets))).withColumn("species", F.lit(None).cast("string"))
    keys = fixed.unionByName(states.select(*SHEET, "r", "table", "metric", "species").filter("table IS NOT NULL"))
    body = join_dim(cells.filter(F.col("c") >= first), hosts, [*SHEET, "c"])
    facts = join_dim(body, keys, [*SHEET, "r"])
    return _route(
        facts.select("table", F.col("period").alias("year"), "host", "species", "metric", to_number(F.col("v")).alias("value")),
        [*ENTITY_TABLES, "populations", "harvest", "relocation"],
    )


def _discover_middle(cells: DataFrame) -> tuple[Discovery, DataFrame, DataFrame]:
    found = Discovery(cells, {"user_first": (L.USER_WORD, 0)})
    main = _main(found, layout.named_as([L.MIDDLE_MAIN_SHEET]), data_row=False)
    counted = found.sheet("count sheet", layout.named_as(L.MIDDLE_COUNT_SHEETS))
    return found, main, found.having("count header row", counted, F.col("user_first").isNotNull())


def ingest_middle(cells: DataFrame, missing: str = "error") -> Tables:
    """Hosts down the rows, fixed column ranges, counts on a sheet of their own."""
    found, main, counted = _discover_middle(cells)
    found.settle(missing)
    header = found.header_cells((main, F.lit(L.MIDDLE_SPECIES_ROW)), (counted, F.col("user_first")))
    start = F.col("user_first") + 1
    on_main = header.join(main.select(*SHEET), SHEET, "left_semi").filter(F.col("r") == L.MIDDLE_SPECIES_ROW)
    ranged = layout.layout_by_col_range(on_main, L.MIDDLE_COL_RANGES)
    ranged = ranged.select(*SHEET, "c", "metric", norm_species_v1(F.col("v")).alias("species")).filter("species IS NOT NULL")
    names = layout.header_names(header, counted.select(*SHEET, F.col("user_first").alias("hdr_r")), norm_species_v1).filter("c >= 2")
    keys = _fixed(main, start, {"hosts_meta": L.MIDDLE_ENTITY_COLS, "finances": L.MIDDLE_FINANCE_COLS})
    keys = keys.unionByName(_species(ranged, main, start, reshape.route_column(F.col("metric")), F.col("metric")))
    keys = keys.unionByName(_fixed(counted, start, {})).unionByName(_species(names, counted, start, F.lit("populations"), F.lit("count")))
    facts = reshape.melt_keyed(cells, keys, _is_entity(False))
    return _route(facts, [*ENTITY_TABLES, "populations", "harvest", "relocation"])


def _sectioned(
    found: Discovery, sheets: DataFrame, section_r: Column, species_r: Column, start: Column, names: Sequence[str] = ()
) -> DataFrame:
    """Column keys of the count and harvest sections; the header rows are fetched in one pass."""
    header = found.header_cells((sheets, section_r), (sheets, species_r), names=names)
    at = lambda r: sheets.select(*SHEET, r.cast("bigint").alias("hdr_r"))
    columns_named = layout.header_names(header, at(species_r), norm_species_v2)
    keys = None
    for table, metric, words in (("populations", "count", L.COUNT_SECTIONS), ("harvest", "shot_heads", L.HARVEST_SECTIONS)):
        ranges = found.sections(table, header, sheets, at(section_r), words)
        columns = layout.in_section(columns_named, ranges).select(*SHEET, "c", "species")
        part = _species(columns, sheets, start, F.lit(table), F.lit(metric))
        keys = part if keys is None else keys.unionByName(part)
    return keys


def _discover_hybrid(cells: DataFrame, denylist: Sequence[str] = ()):
    found = Discovery(cells, {"user_first": (L.USER_WORD, 0), "user": (L.USER_WORD, None)})
    main = _main(found, layout.named_as([L.MIDDLE_MAIN_SHEET]), data_row=False)
    start = F.col("user_first") + 1
    keys = _fixed(main, start, {"hosts_meta": L.MIDDLE_ENTITY_COLS, "finances": L.HYBRID_FINANCE_COLS})
    sections = _sectioned(found, main, F.lit(L.HYBRID_SECTION_ROW), F.lit(L.HYBRID_SPECIES_ROW), start, [L.MIDDLE_MAIN_SHEET])
    keys = keys.unionByName(sections)
    return found, keys, _events(found, denylist)


def ingest_hybrid(cells: DataFrame, denylist: Sequence[str] = (), missing: str = "error") -> Tables:
    """Transitional year: everything on the main sheet, sections found by keyword."""
    found, keys, events = _discover_hybrid(cells, denylist)
    found.settle(missing)
    facts = reshape.melt_keyed(_of_sheets(cells, [L.MIDDLE_MAIN_SHEET]), keys, _is_entity(True, denylist))
    return {**_route(facts, [*ENTITY_TABLES, "populations", "harvest"]), "relocation": events()}


def _late_main(found: Discovery) -> tuple[DataFrame, DataFrame]:
    names = [F.replace(F.lit(n), F.lit("{year}"), F.col("period").cast("string")) for n in L.LATE_MAIN_SHEETS]
    main = _main(found, layout.named_as(names), data_row=True)
    return main, _fixed(main, F.col("user_first") + 1, {"hosts_meta": L.LATE_ENTITY_COLS, "finances": L.LATE_FINANCE_COLS})


def _discover_late(cells: DataFrame, denylist: Sequence[str] = ()):
    headers = {"user_first": (L.USER_WORD, 0), "user": (L.USER_WORD, None), "section_r": (L.COUNT_SECTIONS["ungulates"], None)}
    found = Discovery(cells, headers)
    _, keys = _late_main(found)
    counted = found.sheet("count sheet", layout.named_like(L.COUNT_SHEET_WORD))
    counted = found.having("count section row", counted, F.col("section_r").isNotNull())
    counted = found.having("count header row", counted, F.col("user").isNotNull())
    start = F.col("user") + 1
    keys = keys.unionByName(_fixed(counted, start, {}))
    keys = keys.unionByName(_sectioned(found, counted, F.col("section_r"), F.col("user") - 1, start))
    return found, keys, _events(found, denylist)


def ingest_late(cells: DataFrame, denylist: Sequence[str] = (), missing: str = "error") -> Tables:
    """Sections by keyword on the count sheet, species one row above the user header."""
    found, keys, events = _discover_late(cells, denylist)
    found.settle(missing)
    facts = reshape.melt_keyed(cells, keys, _is_entity(True, denylist))
    return {**_route(facts, [*ENTITY_TABLES, "populations", "harvest"]), "relocation": events()}


def _discover_latest(cells: DataFrame, denylist: Sequence[str] = ()):
    found = Discovery(cells, {"user_first": (L.USER_WORD, 0), "user": (L.USER_WORD, None)}, key_cols=(0, L.LATEST_HOST_COL))
    _, keys = _late_main(found)
    counted = found.sheet("count sheet", layout.named_as([L.LATEST_COUNT_SHEET]))
    return found, keys, counted, _events(found, denylist)


def ingest_latest(cells: DataFrame, denylist: Sequence[str] = (), missing: str = "error") -> Tables:
    """Two-row species header, hosts in the second column, no harvest, areas mislabelled."""
    found, keys, counted, events = _discover_latest(cells, denylist)
    found.settle(missing)
    header = found.header_cells((counted, F.lit(L.LATEST_SPECIES_ROW)), (counted, F.lit(L.LATEST_SUB_ROW)))
    columns = layout.two_row_header(header, L.COUNT_TOTAL_WORD, L.LATEST_SPECIES_ROW, L.LATEST_SUB_ROW)
    start = F.lit(L.LATEST_FIRST_ROW)
    keys = keys.unionByName(_fixed(counted, start, {}, L.LATEST_HOST_COL))
    keys = keys.unionByName(_species(columns, counted, start, F.lit("populations"), F.lit("count")))
    tables = _route(reshape.melt_keyed(cells, keys, _is_entity(True, denylist)), [*ENTITY_TABLES, "populations"])
    return {
        **tables,
        "hosts_meta": rescale_units(tables["hosts_meta"], L.AREA_RULES),
        "harvest": empty_typed(cells.sparkSession, schemas.SPECIES_FACT),
        "relocation": events(),
    }


DISCOVERIES: dict[str, Callable] = {
    "early": _discover_early,
    "middle": _discover_middle,
    "hybrid": _discover_hybrid,
    "late": _discover_late,
    "latest": _discover_latest,
}


def missing_parts(cells: DataFrame, era: str) -> DataFrame:
    """(file_id, period, part): every sheet, header row, section and data row that files of an era lack.

    A part inside another one that is missing is missing as well.
    """
    return DISCOVERIES[era](cells)[0].missing()
