"""Sums that don't depend on the order, and models built from them."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpanel.functions.exact import exact_mean, exact_sum
from gridpanel.operators.resolve import resolve_mean
from gridpanel.plans import gram


def test_sums_are_exact_in_any_order(spark):
    rng = np.random.default_rng(1)
    # cents, large values that cancel, and full fractions
    values = [*np.round(rng.uniform(0, 1e5, 500), 2), *(rng.uniform(1, 2, 200) * 2.0**40), *(-rng.uniform(1, 2, 200) * 2.0**40), 2.0**52, -(2.0**52), 0.1, -0.0]
    want = float(sum(map(Fraction, values)))
    for seed in range(4):
        order = np.random.default_rng(seed).permutation(len(values))
        df = spark.createDataFrame([(float(values[i]),) for i in order], "v double").repartition(1 + 3 * seed)
        got = df.agg(exact_sum(F.col("v")).alias("s"), exact_mean(F.col("v")).alias("m")).first()
        assert got.s == want == math.fsum(values)
        assert got.m == want / len(values)


def test_special_values(spark):
    def sums(*values):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        return tuple(df.agg(exact_sum(F.col("v")), exact_mean(F.col("v"))).first())

    assert sums() == (None, None) and sums(None, None) == (None, None)
    assert sums(None, 1.5, 2.0) == (3.5, 1.75)
    assert sums(math.inf, 1.0) == (math.inf, math.inf) and sums(1e300, 1.0) == (1e300, 5e299)
    assert all(math.isnan(x) for x in sums(math.nan, 1.0)) and all(math.isnan(x) for x in sums(math.inf, -math.inf, 2.0))
    assert sums(0.1, 0.2, 0.3, -0.1, -0.2, -0.3) == (0.0, 0.0)


def test_means_over_merged_parts(spark):
    rows = [("a" if i % 3 else "b", 1, round(0.01 * i * i, 2)) for i in range(400)]
    facts = spark.createDataFrame(rows, "host string, year int, value double")
    mapping = spark.createDataFrame([("a", "X"), ("b", "X")], "host_raw string, host_canonical string")
    got = resolve_mean(facts.repartition(7), mapping, ["year"]).first().value
    assert got == float(sum(Fraction(v) for *_, v in rows)) / 400


def test_whole_report_means_keep_every_metric(spark):
    """An entity-year with a value in any metric counts as reported, also one that isn't spending."""
    from gridpanel.plans.panel import SPENDING, lag_regression_features

    pop = [(y, "h", "S", "count", float(y)) for y in (1, 2, 3)]
    fin = [(y, "h", m, 8.0 * y) for y in (1, 2, 3) for m in SPENDING[:3]] + [(2, "h", "gov_funding", 1.0)]
    only_other = [(y, "g", "gov_funding", 1.0) for y in (1, 2)]
    populations = spark.createDataFrame(pop + [(y, "g", "S", "count", 1.0) for y in (1, 2)], "year int, host string, species string, metric string, value double")
    finances = spark.createDataFrame(fin + only_other, "year int, host string, metric string, value double")
    got = lag_regression_features(populations, finances, "S").orderBy("year").collect()
    assert [(r.host, r.year, r.population_t1, r.total_expenses, r.expense_feeding) for r in got] == [("h", 1, 2.0, 8.0, 0.0), ("h", 2, 3.0, 12.0, 0.0)]


def least_squares(x, y):
    a = np.column_stack([np.ones(len(x)), x])
    return np.linalg.lstsq(a, y, rcond=None)[0]


@pytest.mark.parametrize("parts", [1, 5])
def test_expanding_folds(spark, parts):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(5e4, 3e3, 120), rng.normal(0, 1, 120), rng.uniform(0, 1e6, 120)])
    y = x @ [0.002, -3.0, 1e-5] + rng.normal(0, 0.1, 120) + 7
    fold = np.repeat([-1, 0, 1, 2], [40, 20, 25, 35])
    rows = [(i, int(f), *map(float, r), float(t)) for i, (f, r, t) in enumerate(zip(fold, x, y, strict=True))]
    df = spark.createDataFrame(rows, "id int, fold int, a double, b double, c double, t double").repartition(parts)
    got = gram.expanding_coefficients(df, ["a", "b", "c"], "t")
    assert sorted(got) == [0, 1, 2]
    for k, found in got.items():
        assert np.allclose(found, least_squares(x[fold < k], y[fold < k]), rtol=1e-9, atol=1e-9)
    predicted = {r.id: r.prediction for r in gram.expanding_predictions(df, ["a", "b", "c"], "t").collect()}
    assert sorted(predicted) == list(range(40, 120))
    for i, value in predicted.items():
        assert value == pytest.approx(np.concatenate([[1], x[i]]) @ got[fold[i]], rel=1e-12)


def test_degenerate_columns(spark):
    """A constant column has no slope, dependent ones share it, and a first fold without training rows is left out."""
    rows = [(k, float(i), 2.0 * i, 5.0, 3.0 * i + 1) for k, span in ((0, range(3)), (1, range(3, 9)), (2, range(9, 12))) for i in span]
    df = spark.createDataFrame(rows, "fold int, a double, twice double, same double, t double")
    got = gram.expanding_predictions(df, ["a", "twice", "same"], "t").collect()
    assert {r.fold for r in got} == {1, 2}
    assert all(r.prediction == pytest.approx(r.t) for r in got)
    assert gram.expanding_predictions(df.filter("fold < 0"), ["a"], "t").count() == 0
