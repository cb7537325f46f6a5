"""Small literal sheets."""

from __future__ import annotations

from gridpanel import schemas


def sheet(file_id: str, period: int, name: str, order: int, rows: list[list], width: int | None = None):
    """Every cell of the used rectangle; blanks are None."""
    width = width or max(len(r) for r in rows)
    return [
        (file_id, period, name, order, r, c, None if c >= len(row) or row[c] is None else str(row[c]))
        for r, row in enumerate(rows)
        for c in range(width)
    ]


def cells(spark, *sheets):
    return spark.createDataFrame([row for s in sheets for row in s], schemas.CELLS)


def rows_of(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=lambda t: tuple((x is None, str(x)) for x in t))
