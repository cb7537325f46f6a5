"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suite.views import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def settle(df: DataFrame) -> DataFrame:
    """Round doubles to six digits: the engines sum in different orders."""
    fixed = {
        f.name: F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)
        for f in df.schema.fields
        if isinstance(f.dataType, T.DoubleType)
    }
    return df.withColumns(fixed) if fixed else df


def case(name: str, sql: str | None = None, views: Sequence[str] = (), doubles: Sequence[str] = (), exact: bool = False):
    """Register a query; ``doubles`` are the oracle's columns to round alike, ``exact``
    compares doubles as they are."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn if exact else lambda spark, folder: settle(fn(spark, folder))
        if sql is not None:
            text = oracle(sql, *views)
            if doubles:
                rounded = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles)
                text = f"SELECT * REPLACE ({rounded}) FROM ({text}) AS settled"
            ORACLES[name] = text
        return fn

    return add
