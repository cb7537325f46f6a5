"""Melts, pivots and routing between grid and long form."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.functions.exact import exact_mean
from gridpanel.functions.numbers import to_number
from gridpanel.functions.text import strip_text
from gridpanel.operators.joins import join_dim
from gridpanel.operators.layout import SHEET

# Metrics of the three tables a mixed frame is split into.
ROUTES = {
    "populations": ("count",),
    "harvest": ("shot_heads", "shot_tons", "found_dead", "illegal_shot"),
    "relocation": ("relocated", "caught"),
}


def row_hosts(
    cells: DataFrame, first_row: DataFrame, keep: Callable[[Column], Column], key_col: int = 0
) -> DataFrame:
    """Entity of each data row; rows ``keep`` rejects (totals, contaminants) are left out."""
    keys = cells.filter((F.col("c") == key_col) & F.col("v").isNotNull()).filter(keep(F.col("v")))
    below = join_dim(keys, first_row, SHEET).filter("r >= first_r")
    return below.select(*SHEET, "r", strip_text(F.col("v")).alias("host"))


def melt_rows(cells: DataFrame, col_keys: DataFrame, hosts: DataFrame) -> DataFrame:
    """Hosts down the rows, species or metrics across the columns -> long facts.

    Column keys prune the cells first; the host is joined on (sheet, row), a key
    no single value of which can be large.
    """
    keys = [c for c in col_keys.columns if c not in (*SHEET, "c")]
    data = join_dim(cells, col_keys, [*SHEET, "c"])
    facts = data.join(hosts, [*SHEET, "r"])
    return facts.select(F.col("period").alias("year"), "host", *keys, to_number(F.col("v")).alias("value"))


def melt_keyed(
    cells: DataFrame, keys: DataFrame, keep: Callable[[Column], Column], names: Sequence[str] = ("table", "metric", "species")
) -> DataFrame:
    """Hosts down the rows: all tables of an era from one pass and one exchange.

    ``keys`` (file_id, sheet, c, first_r, names...) says what each column of a sheet holds; a
    column may have several entries, and the one with the first name NULL holds the hosts. A
    row's cells meet by (sheet, row), a key of at most one row's width, and take the host
    from each other. Rows above ``first_r``, without host or with one that ``keep`` rejects
    are left out. A host is judged and cleaned once, in the cell that names it.
    """
    v = F.col("v")
    data = join_dim(cells, keys, [*SHEET, "c"]).filter("r >= first_r")
    is_host = F.col(names[0]).isNull()
    named = F.when(is_host & v.isNotNull(), F.struct(v.alias("raw"), keep(v).alias("good"), strip_text(v).alias("name")))
    host = F.max("_named").over(Window.partitionBy("r", *SHEET))  # row numbers differ soonest, sheets' names hardly
    facts = data.withColumn("_named", named).withColumn("_host", host).filter(~is_host & F.col("_host.good"))
    return facts.select(*names, F.col("period").alias("year"), F.col("_host.name").alias("host"), to_number(v).alias("value"))


def melt_layout(cells: DataFrame, hosts: DataFrame) -> DataFrame:
    """Melt of cells whose metric is already known from their position."""
    facts = cells.join(hosts, [*SHEET, "r"])
    return facts.select(F.col("period").alias("year"), "host", "metric", to_number(F.col("v")).alias("value"))


def column_hosts(
    cells: DataFrame, hdr: DataFrame, keep: Callable[[Column], Column], first_col: int = 3
) -> DataFrame:
    """Entity of each column, read from the header row."""
    header = join_dim(cells.filter(F.col("c") >= first_col), hdr, SHEET).filter("r = hdr_r")
    named = header.filter(F.col("v").isNotNull()).filter(keep(F.col("v")))
    return named.select(*SHEET, "c", F.col("v").alias("host"))


def melt_cols(cells: DataFrame, row_keys: DataFrame, hosts: DataFrame) -> DataFrame:
    """Hosts across the columns, species or metrics down the rows -> long facts."""
    keys = [c for c in row_keys.columns if c not in (*SHEET, "r")]
    data = cells.join(row_keys, [*SHEET, "r"])
    facts = join_dim(data, hosts, [*SHEET, "c"])
    return facts.select(F.col("period").alias("year"), "host", *keys, to_number(F.col("v")).alias("value"))


def melt_layout_cols(cells: DataFrame, hosts: DataFrame) -> DataFrame:
    """As ``melt_cols`` for cells whose metric is already known."""
    facts = join_dim(cells, hosts, [*SHEET, "c"])
    return facts.select(F.col("period").alias("year"), "host", "metric", to_number(F.col("v")).alias("value"))


def pivot_metrics(facts: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long metrics to columns, mean per cell. Metrics are listed, so no extra pass
    collects them; rows with no value at all vanish."""
    wide = facts.groupBy(*keys).agg(
        *[exact_mean(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    )
    return wide.na.drop("all", subset=list(metrics))


def unpivot_metrics(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Columns to long metrics."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def route_by_metric(facts: DataFrame, routes: Mapping[str, Sequence[str]] = ROUTES) -> dict[str, DataFrame]:
    """Split one mixed frame into its tables."""
    return {table: facts.filter(F.col("metric").isin(list(metrics))) for table, metrics in routes.items()}


def route_column(metric: Column, routes: Mapping[str, Sequence[str]] = ROUTES) -> Column:
    """Table name of a metric: lets one partitioned write produce all tables."""
    table = F.lit(None).cast("string")
    for name, metrics in routes.items():
        table = F.when(metric.isin(list(metrics)), name).otherwise(table)
    return table
