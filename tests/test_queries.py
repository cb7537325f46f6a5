"""Every registered query against its oracle on the smallest data."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# model fits that take longest; their parts are covered by test_models
SLOW = {"leak_inflation", "delta_model_boosted", "delta_model_scaled_boosted", "kmeans_sweep", "importance", "forest_balanced"}


def canonical(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = df[sorted(df.columns)].astype(object)
    return sorted(repr([plain(v) for v in row]) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def con(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, data, con, name):
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_flagship(spark, data):
    assert entry_points.entry(spark).columns[:2] == ["species", "n_hosts"]
