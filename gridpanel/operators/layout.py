"""Discovery of headers, sections and keys in cell grids.

A sheet's position is data (``r``, ``c``), so finding a header is a filter and a
``min`` that Spark combines map-side, however many rows one sheet has.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.text import norm_species_v2
from gridpanel.operators.joins import join_dim, pin

SHEET = ["file_id", "sheet"]


def insist(found: DataFrame, expected: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """``found`` (one row per ``on``), with every row of ``expected``: one that wasn't found
    raises an error naming it when the result is computed."""
    values = [c for c in found.columns if c not in on]
    packed = F.struct(*values).alias("_value")
    none = F.lit(None).cast(found.select(packed).schema["_value"].dataType).alias("_value")
    both = found.select(*on, packed).unionByName(expected.select(*on, none))
    message = F.concat_ws(" ", F.lit(f"no {what} in"), *[F.col(c).cast("string") for c in on])
    whole = both.groupBy(*on).agg(F.min("_value").alias("_value"))
    return whole.select(*on, F.coalesce("_value", F.raise_error(message)).alias("_value")).select(*on, "_value.*")


def _holds(words: str | Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in [words] if isinstance(words, str) else words:
        hit = hit | F.contains("v", F.lit(word))
    return hit


def header_row(
    cells: DataFrame,
    keyword: str | Sequence[str],
    col: int | None = None,
    name: str = "hdr_r",
    required: bool = False,
) -> DataFrame:
    """First row of the whole sheet with a cell containing a keyword, per sheet.

    ``col=None`` looks at every column. ``required`` makes a sheet without such a row an
    error when the result is computed, also a sheet without any cell in the column;
    otherwise the sheet is left out.
    """
    found = cells if col is None else cells.filter(F.col("c") == col)
    first = found.filter(_holds(keyword)).groupBy(*SHEET).agg(F.min("r").alias(name))
    return insist(first, cells.select(*SHEET).distinct(), SHEET, "header row") if required else first


def survey(cells: DataFrame, headers: Mapping[str, tuple[str | Sequence[str], int | None]], key_cols: Sequence[int] = (0,)) -> DataFrame:
    """One row per sheet, from one pass: what its headers, width and keys are.

    (file_id, period, sheet, sheet_ord, last_c, last_r<k> of each key column: its last
    filled row, and per entry of ``headers`` the first row with its keyword, in its column
    or anywhere).
    """
    rows = []
    for name, (words, col) in headers.items():
        hit = _holds(words) if col is None else _holds(words) & (F.col("c") == col)
        rows.append(F.min(F.when(hit, F.col("r"))).alias(name))
    keys = [F.max(F.when((F.col("c") == k) & F.col("v").isNotNull(), F.col("r"))).alias(f"last_r{k}") for k in key_cols]
    return cells.groupBy("file_id", "period", "sheet", "sheet_ord").agg(F.max("c").alias("last_c"), *keys, *rows)


def cells_at(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Filled cells of the given rows (file_id, sheet, r): header rows, as wide as a sheet."""
    return join_dim(cells.filter("v IS NOT NULL"), rows.select(*SHEET, "r").distinct(), [*SHEET, "r"])


def fixed_row(cells: DataFrame, r: int, name: str = "hdr_r") -> DataFrame:
    """A header whose row number is part of the layout."""
    return cells.select(*SHEET).distinct().withColumn(name, F.lit(r).cast("bigint"))


def _first_sheet(sheets: DataFrame, order: Column, required: bool) -> DataFrame:
    """The sheet of each file with the smallest ``order``; null marks a sheet that doesn't qualify."""
    found = sheets.groupBy("file_id").agg(F.min(F.when(order.isNotNull(), F.struct(order.alias("o"), "sheet"))).alias("_s"))
    if not required:
        return found.filter("_s IS NOT NULL").select("file_id", "_s.sheet")
    message = F.concat(F.lit("no such sheet in "), F.col("file_id").cast("string"))
    return found.select("file_id", F.coalesce("_s.sheet", F.raise_error(message).cast("string")).alias("sheet"))


def named_like(keyword: str) -> Column:
    """Order of the sheets whose name contains the keyword, ignoring case; null for others."""
    return F.when(F.contains(F.lower("sheet"), F.lit(keyword.lower())), F.col("sheet_ord"))


def named_as(candidates: Sequence[str | Column]) -> Column:
    """Place of the sheet's name in the list, null if not listed; names may depend on the period."""
    names = F.array(*[F.lit(c) if isinstance(c, str) else c for c in candidates])
    place = F.array_position(names, F.col("sheet"))
    return F.when(place > 0, place)


def sheet_by_keyword(sheets: DataFrame, keyword: str, required: bool = False) -> DataFrame:
    """First sheet of a file whose name contains the keyword, ignoring case.

    A file without one is left out, or an error naming it if ``required``.
    """
    return _first_sheet(sheets, named_like(keyword), required)


def sheet_by_priority(sheets: DataFrame, candidates: Sequence[str | Column], required: bool = False) -> DataFrame:
    """First hit of an ordered list of sheet names; ``required`` as for ``sheet_by_keyword``."""
    return _first_sheet(sheets, named_as(candidates), required)


def pick_sheet(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cells of the chosen sheet of each file."""
    return join_dim(cells, chosen, SHEET, how="left_semi")


def sections(
    cells: DataFrame, hdr: DataFrame, keywords: Mapping[str, str], width: DataFrame | None = None, required: bool = False
) -> DataFrame:
    """Column range of each section: from the header cell holding its keyword to just
    before the next filled header cell, or to the last column of the sheet.

    ``width`` (file_id, sheet, last_c) saves a pass over ``cells``, which may then be the
    header rows only. A section that a header row lacks is left out, or an error naming
    sheet and section if ``required``.
    """
    header = join_dim(cells.filter("v IS NOT NULL"), hdr, SHEET).filter("r = hdr_r")
    width = cells.groupBy(*SHEET).agg(F.max("c").alias("last_c")) if width is None else width.select(*SHEET, "last_c")
    # one row per filled header cell: bounded by the width of a sheet
    by_col = Window.partitionBy(*SHEET).orderBy("c")
    spans = header.select(*SHEET, "v", "c", (F.lead("c").over(by_col) - 1).alias("_end"))
    known = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("kw")) for s, k in keywords.items()])
    opened = spans.withColumn("_hit", F.explode(F.filter(known, lambda k: F.contains(F.col("v"), k["kw"]))))
    first = opened.groupBy(*SHEET, F.col("_hit.section").alias("section")).agg(
        F.min("c").alias("c0"), F.min_by("_end", "c").alias("_end")
    )
    ranges = first.join(width, SHEET).select(*SHEET, "section", "c0", F.coalesce("_end", "last_c").alias("c1"))
    if not required:
        return ranges
    wanted = hdr.select(*SHEET, F.explode(F.array(*[F.lit(s) for s in keywords])).alias("section"))
    return insist(ranges, wanted, [*SHEET, "section"], "section")


def header_names(
    cells: DataFrame,
    hdr: DataFrame,
    normalize: Callable[[Column], Column] = norm_species_v2,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Columns of a header row with their normalised species; unnamed ones are dropped."""
    # pinned before the names are cleaned: the cleaning must not be pushed down to all cells
    header = pin(join_dim(cells.filter("v IS NOT NULL"), hdr, SHEET).filter("r = hdr_r"))
    named = header.select(*SHEET, "c", *keep, normalize(F.col("v")).alias("species"))
    return named.filter("species IS NOT NULL")


def section_species(
    cells: DataFrame,
    ranges: DataFrame,
    species_row: DataFrame,
    normalize: Callable[[Column], Column] = norm_species_v2,
) -> DataFrame:
    """Columns inside the section ranges with their normalised species."""
    names = header_names(cells, species_row, normalize)
    return in_section(names, ranges).select(*SHEET, "section", "c", "species")


def in_section(columns: DataFrame, ranges: DataFrame) -> DataFrame:
    """Range join: columns whose position lies in a section of the same sheet."""
    return join_dim(columns, ranges, SHEET).filter("c BETWEEN c0 AND c1")


def first_data_row(cells: DataFrame, hdr: DataFrame, required: bool = False) -> DataFrame:
    """First row below the header with a filled first column.

    A sheet without one is left out, or an error naming it if ``required``.
    """
    keys = cells.filter("c = 0 AND v IS NOT NULL").select(*SHEET, "r")
    below = join_dim(keys, hdr, SHEET).filter("r > hdr_r")
    first = below.groupBy(*SHEET).agg(F.min("r").alias("first_r"))
    return insist(first, hdr, SHEET, "data row") if required else first


def row_slice(
    cells: DataFrame, start: DataFrame, end: DataFrame, start_offset: int = 0
) -> DataFrame:
    """Rows from ``hdr_r + start_offset`` up to, not including, ``end_r``."""
    bounds = start.join(end, SHEET)
    inside = (F.col("r") >= F.col("hdr_r") + start_offset) & (F.col("r") < F.col("end_r"))
    return join_dim(cells, bounds, SHEET).filter(inside)


def layout_by_column(cells: DataFrame, layout: Mapping[int, str]) -> DataFrame:
    """Metric of each cell from its column position; other columns are dropped."""
    return cells.filter(F.col("c").isin(list(layout))).withColumn("metric", _lookup(layout, F.col("c")))


def layout_by_row_offset(cells: DataFrame, hdr: DataFrame, layout: Mapping[int, str]) -> DataFrame:
    """Metric of each cell from its distance below the header row."""
    placed = join_dim(cells, hdr, SHEET).withColumn("_off", F.col("r") - F.col("hdr_r"))
    named = placed.filter(F.col("_off").isin(list(layout)))
    return named.withColumn("metric", _lookup(layout, F.col("_off"))).drop("_off", "hdr_r")


def layout_by_col_range(cells: DataFrame, ranges: Sequence[tuple[int, int, str]]) -> DataFrame:
    """Metric of each cell from half-open column ranges."""
    metric = F.lit(None).cast("string")
    for low, high, name in ranges:
        metric = F.when((F.col("c") >= low) & (F.col("c") < high), name).otherwise(metric)
    return cells.withColumn("metric", metric).filter("metric IS NOT NULL")


def two_row_header(
    cells: DataFrame,
    keyword: str,
    species_row: int = 3,
    sub_row: int = 4,
    normalize: Callable[[Column], Column] = norm_species_v2,
) -> DataFrame:
    """Columns whose sub-header holds the keyword, named by the row above it."""
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("v")))
    pairs = (
        cells.filter(F.col("r").isin(species_row, sub_row))
        .groupBy(*SHEET, "c")
        .agg(at(species_row).alias("_name"), at(sub_row).alias("_sub"))
    )
    named = pairs.filter(F.contains("_sub", F.lit(keyword)))
    return named.select(*SHEET, "c", normalize(F.col("_name")).alias("species")).filter("species IS NOT NULL")


def _lookup(layout: Mapping[int, str], position: Column) -> Column:
    metric = F.lit(None).cast("string")
    for pos, name in layout.items():
        metric = F.when(position == pos, name).otherwise(metric)
    return metric
