"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridpanel.session import materialize


def pin(df: DataFrame, name: str = "pinned") -> DataFrame:
    """Compute a table that several plans use once: it is written to the shared folder.

    Its size is then known from its files, so Spark broadcasts it where it is small, and
    neither the driver nor a plan holds its rows.
    """
    return materialize(df, name)


def join_dim(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a dimension whose size depends on the data.

    The dimension is computed first, so that its size decides: below Spark's threshold it
    is broadcast and the facts aren't shuffled. Above, both sides are dealt by key and
    adaptive execution splits partitions that hot keys make large.
    """
    return fact.join(pin(dim, "dimension"), list(on), how)


def same_period(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inner equi-join of two frames on (year, host) and ``by``."""
    return left.join(right, ["year", "host", *by], "inner")


def attach(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of per-entity values onto a panel; ``right`` has one row per key.

    For a mapping, which may list a key several times, see ``resolve.lookup_table``.
    """
    return left.join(right, list(on), "left")


def keep_entities(df: DataFrame, entities: DataFrame, on: Sequence[str] = ("host",)) -> DataFrame:
    """Rows whose entity is in the set."""
    return df.join(entities.select(*on), list(on), "left_semi")


def drop_entities(df: DataFrame, entities: DataFrame, on: Sequence[str] = ("host",)) -> DataFrame:
    """Rows whose entity is not in the set."""
    return df.join(entities.select(*on), list(on), "left_anti")
