from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpanel.operators import aggregates as A
from gridpanel.operators import filters, joins, ranking, resolve, sets, windows
from gridpanel.plans import panel as P
from tests.grids import rows_of

FACT = "year int, host string, species string, metric string, value double"


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT)


def counts(spark, rows):
    return facts(spark, [(y, h, "S", "count", v) for h, y, v in rows])


def test_resolution_is_exact_and_audited(spark):
    mapping = spark.createDataFrame([("A ", "a"), ("B", "b"), ("Z", "SKIP"), ("AA", "a")], "host_raw string, host_canonical string")
    rows = facts(spark, [(2000, h, "S", "count", 1.0) for h in ["A ", "A", "B", "Z", "AA", "Q", "Q"]])
    kept = resolve.drop_unresolved(resolve.resolve_entity(rows, mapping))
    assert rows_of(kept, "host", "host_canonical") == [("A ", "a"), ("AA", "a"), ("B", "b")]
    audit = resolve.audit_resolution(rows, mapping).first()
    lost = {r["host"]: r["n"] for r in resolve.audit_unresolved(rows, mapping).collect()}
    assert (audit["before"], audit["after"], audit["removed"]) == (7, 3, 4) and lost == {"A": 1, "Q": 2}
    retried = resolve.drop_unresolved(resolve.resolve_entity(rows, mapping, trim_fallback=True))
    assert retried.count() == 4
    assert resolve.mapping_cardinality(mapping).first().asDict() == {"n_raw": 4, "n_canonical": 3}


def test_canonical_pairs_of_the_event_log(spark):
    """A hand-written sample in the shape of the published event log."""
    mapping = spark.createDataFrame(
        [('ДП "Горохівське ЛМГ"', "Горохівське ЛМГ"), ('ДП "Ратнівське ЛГ"', "Ратнівське ЛМГ")], "host_raw string, host_canonical string"
    )
    log = spark.createDataFrame(
        [('ДП "Горохівське ЛМГ"', "Фазани"), ('ДП "Ратнівське ЛГ"', " Крижень "), ('ДП "Ратнівське ЛГ"', None)], "host string, species string"
    )
    out = resolve.map_species(resolve.resolve_entity(log, mapping))
    assert rows_of(out, "host_canonical", "species_canonical") == [
        ("Горохівське ЛМГ", "Фазан"), ("Ратнівське ЛМГ", "Качки"), ("Ратнівське ЛМГ", None)
    ]
    table = spark.createDataFrame([("Фазани", "Птах")], "raw string, canonical string")
    assert "Птах" in [r[0] for r in resolve.map_species(log, table).select("species_canonical").collect()]
    assert resolve.map_species(mapping) is mapping


def test_means_survive_pre_aggregation(spark):
    mapping = spark.createDataFrame([("A", "x"), ("B", "x")], "host_raw string, host_canonical string")
    rows = facts(spark, [(1, "A", "S", "count", 1.0), (1, "A", "S", "count", 2.0), (1, "B", "S", "count", 9.0), (1, "B", "S", "count", None), (2, "B", "S", "count", None)])
    assert rows_of(resolve.resolve_mean(rows, mapping, ["year"]), "host", "year", "value") == [("x", 1, 4.0), ("x", 2, None)]


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_dimension_joins(spark, threshold):
    """Broadcast or dealt by key, a hot key among them: the same rows."""
    fact = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = [(7 if i % 3 == 0 else i % 50, i) for i in range(2000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = [tuple(r) for r in joins.join_dim(fact, dim, ["k"]).select("k", "id", "v").collect()]
        assert sorted(got) == sorted((k, i, 2 * k) for k, i in want if k < 40)
        assert joins.join_dim(fact, dim, ["k"], how="left").count() == 2000
        assert joins.join_dim(fact, dim, ["k"], how="left_semi").count() == len(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = {g: np.round(rng.normal(size=n), 1) for g in "ab"}
    values["a"][: n // 3] = 0.0  # a hot value
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    probs = [0.0, 0.02, 0.5, 0.977, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in ranking.exact_quantiles(df, "v", probs, by=["g"]).collect()}
    for g, vs in values.items():
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(vs, p))


def test_global_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = ranking.global_index(df, ["k"]).collect()
    assert all(r["idx"] == r["k"] for r in got)
    inside = ranking.global_index(df, ["k"], by=["g"]).groupBy("g").agg(F.min("idx"), F.max("idx"), F.countDistinct("idx"), F.count("idx"))
    assert all(r[1] == 0 and r[2] == r[3] - 1 == r[4] - 1 for r in inside.collect())


def test_windows_respect_gaps(spark):
    df = counts(spark, [("a", 2000, 10.0), ("a", 2001, 20.0), ("a", 2003, 5.0), ("b", 2000, 0.0), ("b", 2001, 4.0), ("c", 2000, 3.0), ("c", 2001, 3.0)])
    v = F.col("value")
    out = df.select("host", "year", windows.previous_row(v).alias("row"), windows.previous_year(v).alias("cal"),
                    windows.change_pct(v).alias("pct"), windows.zscore(v).alias("z"), windows.rolling_mean3(v).alias("m"))
    got = {(r["host"], r["year"]): r for r in out.collect()}
    assert got["a", 2003]["row"] == 20.0 and got["a", 2003]["cal"] is None and got["a", 2001]["pct"] == 100.0
    assert got["b", 2001]["pct"] is None and got["c", 2001]["z"] == 0.0
    assert got["a", 2003]["m"] == pytest.approx(35 / 3)
    paired = windows.next_consecutive(df, "value", "ahead")
    assert rows_of(paired.filter("host = 'a'"), "year", "ahead") == [(2000, 20.0)]


def test_slope_needs_three_points(spark):
    df = counts(spark, [("a", 2000, 1.0), ("a", 2001, 3.0), ("a", 2002, 5.0), ("b", 2000, 1.0), ("b", 2001, 9.0), ("c", 2000, None)])
    assert rows_of(A.ols_slope(df), "host", "slope") == [("a", 2.0), ("b", 0.0), ("c", 0.0)]


def test_recovery_needs_every_year(spark):
    years = [2019, 2020, 2021, 2022, 2025]
    full = [("a", y, v) for y, v in zip(years, [10.0, 20.0, 30.0, 25.0, 40.0])]
    twice = [("a", 2022, 35.0)]  # a second spelling of the same entity: averaged, not added
    partial = [("b", y, 100.0) for y in years[:4]] + [("b", 2019, 100.0)]
    panel = counts(spark, full + twice + partial)
    hosts = sets.distinct_entities(panel)
    row = P.recovery(panel, hosts, "S", [2019, 2020, 2021], (2022, 2025)).first()
    assert (row["n_hosts"], row["before"], row["after_1"], row["after_2"]) == (1, 20.0, 30.0, 40.0)
    assert (row["change_1"], row["change_pct_1"], row["change_pct_2"]) == (10.0, 50.0, 100.0)
    assert P.recovery(panel, hosts, "none", [2019, 2020, 2021], (2022, 2025)).count() == 0


def test_trend_uses_the_same_hosts(spark):
    panel = counts(spark, [("a", 2022, 10.0), ("a", 2025, 13.0), ("b", 2022, 50.0), ("c", 2025, 70.0)])
    ahead = P.trend_forecast(panel, "S", (2022, 2025), [2026, 2027])
    assert rows_of(ahead, "year", "forecast") == [(2026, pytest.approx(14.0)), (2027, pytest.approx(15.0))]
    assert P.trend_forecast(panel, "S", (2022, 2030), [2031]).count() == 0
    loose = P.trend_forecast(panel, "S", (2022, 2025), [2026], same_composition=False).first()
    assert loose["forecast"] == pytest.approx(83 + 23 / 3)


def test_anomaly_features_by_hand(spark):
    values = [10, 12, 11, 13, 12, 14, 13, 15, 14, 60]
    rows = [("a", 2000 + i, float(v)) for i, v in enumerate(values)] + [("b", 2000 + i, 1.0) for i in range(9)]
    got = {r["year"]: r for r in P.anomaly_features(counts(spark, rows), "S").collect()}
    assert set(got) == set(range(2001, 2010))
    assert got[2009]["change_pct"] == pytest.approx((60 - 14) / 14 * 100)
    assert got[2009]["deviation"] == pytest.approx((60 - np.mean(values)) / np.std(values, ddof=1))


def test_harvest_features_by_hand(spark):
    pop = counts(spark, [("a", y, v) for y, v in [(2000, 10.0), (2001, 20.0), (2003, 30.0), (2004, 0.0)]])
    shot = facts(spark, [(y, "a", "S", "shot_heads", v) for y, v in [(2000, 1.0), (2001, 4.0), (2003, 3.0), (2004, 1.0)]])
    got = rows_of(P.harvest_features(pop, shot, "S", 2021, 0.15), "year", "harvest_rate", "label", "harvest_rate_lag")
    assert got == [(2001, 0.2, 1, 0.1), (2003, 0.1, 0, 0.2)]
    early = P.harvest_features(pop, shot, "S", 2001, 0.15)
    assert rows_of(early, "year", "pop_trend") == [(2001, 0.0)]


def test_regression_features_by_hand(spark):
    pop = counts(spark, [("a", 2000, 1.0), ("a", 2001, 2.0), ("a", 2003, 3.0), ("a", 2004, 5.0)])
    fin = spark.createDataFrame(
        [(y, "a", m, float(y - 1999)) for y in (2000, 2001, 2003, 2004) for m in P.SPENDING[:3]] + [(2003, "a", "expense_feeding", 8.0)],
        "year int, host string, metric string, value double",
    )
    got = rows_of(P.lag_regression_features(pop, fin, "S"), "year", "total_expenses", "expense_feeding", "delta")
    assert got == [(2000, 1.0, 0.0, 1.0), (2003, pytest.approx(7 / 3), 8.0, 2.0)]


def test_entity_features_by_hand(spark):
    pop = facts(spark, [
        (2000, "a", "S", "count", 1.0), (2001, "a", "S", "count", 3.0), (2002, "a", "S", "count", 5.0),
        (2003, "a", "T", "count", None), (2000, "b", "T", "count", 4.0), (2000, "x", "S", "count", 4.0),
    ])
    fin = spark.createDataFrame([(2000, "a", "total_expenses", 2.0), (2001, "a", "total_expenses", 4.0)], "year int, host string, metric string, value double")
    gone = spark.createDataFrame([("x",)], "host string")
    got = P.entity_features(pop, fin, ["S", "T"], "S", gone)
    assert rows_of(got, "host", "mean_s", "mean_t", "n_years", "trend", "expenses") == [("a", 3.0, 0.0, 4, 2.0, 3.0), ("b", 0.0, 4.0, 1, 0.0, 0.0)]


def test_units_pivot_and_nulls(spark):
    fin = spark.createDataFrame([(2024, "a", "area", 5.0), (2025, "a", "area", 5000.0), (2025, "a", "m", None)], "year int, host string, metric string, value double")
    scaled = filters.rescale_units(fin, [("area", 2025, 2025, 1000.0)])
    assert rows_of(scaled.filter("metric = 'area'"), "year", "value") == [(2024, 5.0), (2025, 5.0)]
    profile = {r["metric"]: r["null_pct"] for r in resolve.null_profile(fin).collect()}
    assert profile == {"area": 0.0, "m": 100.0}
    from gridpanel.operators.reshape import pivot_metrics, unpivot_metrics

    wide = pivot_metrics(fin, ["year", "host"], ["area", "m"])
    back = unpivot_metrics(wide, ["year", "host"], ["area", "m"]).filter("value IS NOT NULL")
    assert rows_of(back, "year", "metric", "value") == rows_of(fin.filter("value IS NOT NULL"), "year", "metric", "value")


def test_histogram_counts_everything(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 2.5, 5, 10]] + [(None,)], "x double")
    assert rows_of(A.histogram(df, "x", 4), "bin", "n") == [(0, 3), (1, 1), (2, 1), (3, 1)]


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([(4, 0.5), (2, 0.5), (3, 0.1)], "k int, s double")
    assert ranking.argmax_first(df, "k", "s").first()["k"] == 2
