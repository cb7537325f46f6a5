"""Order-dependent scans down a sheet.

A sheet may hold a large share of all rows, so nothing here sorts a whole sheet
in one task: rows are cut into blocks of consecutive row numbers, each block is
scanned on its own, and only one summary row per block travels between blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.numbers import to_number
from gridpanel.functions.text import (
    SUBHEADER_LITERAL,
    detect_metric,
    is_aggregate,
    is_contaminant,
    is_group_code,
    is_species_header,
    norm_species_v2,
    species_from_label,
    strip_text,
)
from gridpanel.operators.joins import join_dim, pin
from gridpanel.operators.layout import SHEET
from gridpanel.session import materialize

BLOCK_ROWS = 65_536


def carry_forward(
    df: DataFrame, value: str, part: Sequence[str] = tuple(SHEET), order: str = "r", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Replace ``value`` by its last non-null value at or before the row.

    ``order`` is a unique row number within ``part``. Rows that ``grid_rows`` has dealt by
    blocks are filled without another exchange. Filled blocks are written once; a block's
    last row says what the next one starts with.
    """
    part = list(part)
    blocked = df if "_blk" in df.columns else df.withColumn("_blk", F.floor(F.col(order) / block_rows))
    # the block comes first: sorts compare their first key quickest, and sheets' names hardly differ
    inside = Window.partitionBy("_blk", *part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = materialize(blocked.withColumn(value, F.last(value, ignorenulls=True).over(inside)), "filled")
    # one row per block: at most (largest row number / block_rows) rows per sheet
    ends = local.groupBy(*part, "_blk").agg(F.max_by(value, order).alias("_last"))
    earlier = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*part, "_blk", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    joined = join_dim(local, carried, [*part, "_blk"], "left")
    return joined.withColumn(value, F.coalesce(value, "_before")).drop("_blk", "_before")


def grid_rows(
    cells: DataFrame, columns: Mapping[int, str], lookahead: Mapping[int, str] | None = None, block_rows: int | None = None
) -> DataFrame:
    """One row per sheet row with named columns, optionally with cells of the row below.

    Looking ahead means the next row *number*, so a cell simply also reports to
    the row above it and one aggregation yields both. With ``block_rows`` cells are dealt
    by block of rows, and the same exchange serves ``carry_forward``.
    """
    wanted = cells.filter(F.col("c").isin(list(columns))).select(*SHEET, "period", "c", "v", "r")
    if lookahead:
        ups = F.when(F.col("c").isin(list(lookahead)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        wanted = wanted.withColumn("_up", F.explode(ups)).withColumn("r", F.col("r") - F.col("_up"))
    keys = [*SHEET, "period", "r"]
    if block_rows:
        wanted = wanted.withColumn("_blk", F.floor(F.col("r") / block_rows)).repartition(*SHEET, "_blk")
        keys.append("_blk")
    # the largest text needs a sort; by row number first, as sheets' names hardly differ
    by = ["r", *[k for k in keys if k != "r"]]
    if not lookahead:
        named = [F.max(F.when(F.col("c") == c, F.col("v"))).alias(name) for c, name in columns.items()]
        return wanted.groupBy(*by).agg(*named).select(*keys, *columns.values())
    at = lambda c, up: F.max(F.when((F.col("c") == c) & (F.col("_up") == up), F.col("v")))
    aggs = [at(c, 0).alias(name) for c, name in columns.items()]
    aggs += [at(c, 1).alias(name) for c, name in lookahead.items()]
    rows = wanted.groupBy(*by).agg(*aggs, F.max(F.when(F.col("_up") == 0, F.lit(True))).alias("_own"))
    return rows.filter("_own").select(*keys, *columns.values(), *lookahead.values())


def header_has_value(name: Column, next_code: Column, next_name: Column) -> Column:
    """Does a species header row also carry a number of its own?

    It does if its label has a dash part, or if no detail row follows it: the
    next row opens another block, has no name, or does not exist.
    """
    opens_next = F.coalesce(strip_text(next_code) != "", F.lit(False))
    return F.contains(name, F.lit(" -")) | opens_next | next_name.isNull()


def species_state(rows: DataFrame, literal: str = SUBHEADER_LITERAL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Species and metric of every row of the species section.

    ``rows`` has ``code, name, unit, next_code, next_name``. A species header sets
    the current species; a group total or the sub-header literal clears it; rows
    without a name change nothing; detail rows inherit. Only rows that carry a
    value are returned.
    """
    code, name = F.col("code"), F.col("name")
    clears = F.coalesce(strip_text(code) == literal, F.lit(False))
    header = ~clears & name.isNotNull() & is_species_header(code)
    group = header & is_group_code(code)
    event = F.when(clears | group, F.struct(F.lit(None).cast("string").alias("species"))).when(
        header, F.struct(species_from_label(name).alias("species"))
    )
    flagged = rows.withColumn("_event", event).withColumn("_header", header).withColumn("_group", group)
    state = carry_forward(flagged, "_event", block_rows=block_rows).withColumn("species", F.col("_event.species"))
    metric = detect_metric(name, F.col("unit"))
    metric = F.when(F.col("_header"), F.coalesce(metric, F.lit("count"))).otherwise(metric)
    has_value = F.when(
        F.col("_header"), header_has_value(name, F.col("next_code"), F.col("next_name")) & ~F.col("_group")
    ).otherwise(name.isNotNull() & ~clears)
    return (
        state.withColumn("metric", metric)
        .filter(has_value & F.col("species").isNotNull() & F.col("metric").isNotNull())
        .select(*SHEET, "period", "r", "species", "metric")
    )


def ffill_entity(rows: DataFrame, col: str = "host", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fill merged entity cells down the sheet, before any row is filtered out."""
    return carry_forward(rows, col, block_rows=block_rows)


def relocation_events(
    cells: DataFrame, hdr: DataFrame, denylist: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Event log of a relocation sheet: host, species, count, location, origin.

    Names are cleaned once each: a host before the fill, in the cells that name it, and a
    species per spelling, which is then joined to the rows. Blank cells don't travel: a row
    needs a species to be an event, and only filled cells change the fill.
    """
    names = {0: "host", 1: "species", 2: "count", 3: "location", 4: "origin"}
    host = F.col("host")
    good = ~is_aggregate(host, extended=True) & ~is_contaminant(host, denylist)
    rows = grid_rows(cells.filter("v IS NOT NULL"), names, block_rows=block_rows)
    rows = rows.withColumn("_host", F.when(host.isNotNull(), F.struct(strip_text(host).alias("name"), good.alias("good"))))
    filled = carry_forward(rows.drop("host"), "_host", block_rows=block_rows)
    below = join_dim(filled.filter("species IS NOT NULL"), hdr, SHEET).filter("r > hdr_r AND _host.good")
    # pinned before they are cleaned: the cleaning must not be pushed down to all rows
    spellings = pin(below.select("species").distinct())
    named = spellings.withColumn("_named", norm_species_v2(F.col("species"))).filter("_named IS NOT NULL")
    kept = join_dim(below, named, ["species"])
    return kept.select(
        F.col("period").alias("year"),
        F.col("_host.name").alias("host"),
        F.col("_named").alias("species"),
        to_number(F.col("count")).alias("count"),
        strip_text(F.col("location")).alias("location"),
        strip_text(F.col("origin")).alias("origin"),
    )
