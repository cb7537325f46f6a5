"""Joins, aggregates, windows, ranking, sets and panel analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.operators import aggregates as A
from gridpanel.operators import joins, layout, ranking, sets, windows
from gridpanel.operators.filters import filter_panel
from gridpanel.operators.reshape import pivot_metrics
from gridpanel.operators.resolve import SKIP, drop_unresolved, lookup_table, resolve_entity
from gridpanel.plans import anomaly, folds, panel as P, regress, scaling, validation
from gridpanel.session import materialize
from suite import views as V
from suite.clean_cases import excluded_hosts
from suite.grid_cases import SPECIES_COLS_SQL, _section_ranges
from suite.registry import case

SPECIES = "SMALL"
TRIO = ("SMALL", "LARGE", "PROMO")
SMALL = "SELECT * FROM panel WHERE metric = 'count' AND species = 'SMALL'"


# a whole panel is analysed at once: every host's every species and metric is a series
SERIES = ["host", "species", "metric"]
KINDS = ["species", "metric"]
OF_SERIES = "(PARTITION BY host, species, metric ORDER BY year)"


def of_metric(spark, d, metric: str):
    """One metric of all species, one row per (year, host, species)."""
    panel = V.panel(spark, d).filter(F.col("metric") == metric)
    return A.dedupe(panel, ["year", "host", "species"])


def stored_species(spark, d):
    """The panel of one species, written once: analyses that use it twice scan the facts once."""
    return materialize(V.panel(spark, d).filter(F.col("species") == SPECIES), "panel")


def harvest_features(spark, d, expanding: bool = False):
    panel = stored_species(spark, d)
    return P.harvest_features(panel, panel, SPECIES, 2001, 1.15, expanding)


def lag_features(spark, d):
    return P.lag_regression_features(V.panel(spark, d), V.fin_raw(spark, d), SPECIES)


# --- joins -------------------------------------------------------------------------


@case(
    "join_pop_harvest",
    """SELECT p.year, p.host, p.species, p.value AS population, h.value AS shot_heads
       FROM panel p JOIN panel h ON p.year = h.year AND p.host = h.host AND p.species = h.species
       WHERE p.metric = 'count' AND h.metric = 'shot_heads'""",
    ["panel"],
    ["population", "shot_heads"],
)
def _join_pop_harvest(spark, d):
    pop = of_metric(spark, d, "count").withColumnRenamed("value", "population")
    shot = of_metric(spark, d, "shot_heads").withColumnRenamed("value", "shot_heads")
    return joins.same_period(pop, shot, ["species"])


@case(
    "join_pop_finance",
    """SELECT p.year, p.host, p.species, p.value AS population, f.total_expenses
       FROM panel p JOIN fin_wide f ON p.year = f.year AND p.host = f.host WHERE p.metric = 'count'""",
    ["panel", "fin_wide"],
    ["population", "total_expenses"],
)
def _join_pop_finance(spark, d):
    pop = of_metric(spark, d, "count").withColumnRenamed("value", "population")
    fin = pivot_metrics(V.fin_raw(spark, d), ["year", "host"], [*P.SPENDING, "gov_funding"]).drop("gov_funding")
    return joins.same_period(pop, fin).select("year", "host", "species", "population", "total_expenses")


@case(
    "join_trend",
    """SELECT s.year, s.host, s.species, s.metric, s.value, t.slope FROM panel s
       LEFT JOIN (SELECT host, species, metric, CASE WHEN count(value) >= 3 THEN regr_slope(value, year) ELSE 0 END AS slope
        FROM panel x GROUP BY ALL HAVING count(value) >= 5) t ON s.host = t.host AND s.species = t.species AND s.metric = t.metric""",
    ["panel"],
    ["value", "slope"],
)
def _join_trend(spark, d):
    rows = A.dedupe(V.panel(spark, d), ["year", *SERIES])
    trend = A.ols_slope(rows, series=SERIES).filter("n >= 5").select(*SERIES, "slope")
    return joins.attach(rows, trend, SERIES).select("year", *SERIES, "value", "slope")


@case(
    "map_lookup",
    "SELECT f.host, f.n, m.host_canonical FROM (SELECT host, count(*) AS n FROM facts_raw GROUP BY 1) f LEFT JOIN host_map m ON f.host = m.host_raw",
    ["facts_raw", "host_map"],
)
def _map_lookup(spark, d):
    counts = V.facts_raw(spark, d).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    keys = lookup_table(V.host_map(spark, d), "host_raw", "host_canonical")
    return joins.attach(counts, keys.withColumnRenamed("host_raw", "host"), ["host"])


STABLE = """SELECT host FROM panel WHERE metric = 'count' AND species = 'SMALL' AND year BETWEEN 1995 AND 2001 AND value IS NOT NULL
 GROUP BY host HAVING count(DISTINCT year) >= 7"""


def stable(panel):
    return P.stable_entities(panel, SPECIES, 1995, 2001, 7)


@case("semi_stable", f"SELECT * FROM panel WHERE host IN ({STABLE})", ["panel"], ["value"])
def _semi_stable(spark, d):
    panel = materialize(V.panel(spark, d), "panel")
    return joins.keep_entities(panel, stable(panel))


@case("anti_exclude", f"SELECT * FROM panel WHERE host NOT IN ({STABLE})", ["panel"], ["value"])
def _anti_exclude(spark, d):
    panel = materialize(V.panel(spark, d), "panel")
    return joins.drop_entities(panel, stable(panel))


@case(
    "range_section",
    f"SELECT file_id, section, count(*) AS n_cols, min(c) AS first_c, max(c) AS last_c FROM ({SPECIES_COLS_SQL}) q GROUP BY 1, 2",
    ["cells"],
)
def _range_section(spark, d):
    cells = V.cells(spark, d)
    named = cells.filter("r = 2 AND v IS NOT NULL").select("file_id", "sheet", "c")
    found = layout.in_section(named, _section_ranges(cells))
    return found.groupBy("file_id", "section").agg(
        F.count(F.lit(1)).alias("n_cols"), F.min("c").alias("first_c"), F.max("c").alias("last_c")
    )


@case(
    "self_prior_period",
    """SELECT a.host, a.species, a.metric, a.year, a.value, b.value AS before FROM panel a
       LEFT JOIN panel b ON a.host = b.host AND a.species = b.species AND a.metric = b.metric AND b.year = a.year - 1""",
    ["panel"],
    ["value", "before"],
)
def _self_prior_period(spark, d):
    return V.panel(spark, d).select(*SERIES, "year", "value", windows.previous_year(F.col("value"), SERIES).alias("before"))


# --- aggregates --------------------------------------------------------------------


@case(
    "dedupe_mean",
    "SELECT year, host, species, metric, value FROM panel",
    ["panel"],
    ["value"],
)
def _dedupe_mean(spark, d):
    known = drop_unresolved(resolve_entity(V.facts_raw(spark, d), V.host_map(spark, d)), SKIP)
    return A.dedupe(known.select("year", F.col("host_canonical").alias("host"), *KINDS, "value"), ["year", *SERIES])


@case(
    "metric_mean",
    f"SELECT year, host, metric, {V.exact_mean_sql('value')} AS value FROM fin_raw GROUP BY 1, 2, 3",
    ["fin_raw"],
    exact=True,
)
def _metric_mean(spark, d):
    return A.dedupe(V.fin_raw(spark, d), ["year", "host", "metric"])


@case("yearly_sum", "SELECT species, metric, year, coalesce(sum(value), 0) AS total FROM panel GROUP BY ALL", ["panel"], ["total"])
def _yearly_sum(spark, d):
    return A.yearly_sum(V.panel(spark, d), KINDS)


@case(
    "mean_of_sums",
    """SELECT species, metric, avg(t) AS mean_total FROM (SELECT species, metric, year, coalesce(sum(v), 0) AS t
       FROM (SELECT species, metric, year, host, avg(value) AS v FROM panel GROUP BY ALL) x GROUP BY ALL) y GROUP BY ALL""",
    ["panel"],
    ["mean_total"],
)
def _mean_of_sums(spark, d):
    return A.mean_of_sums(V.panel(spark, d), KINDS)


@case("distinct_years", "SELECT host, count(DISTINCT year) AS n_years FROM facts_raw GROUP BY 1", ["facts_raw"])
def _distinct_years(spark, d):
    return A.distinct_years(V.facts_raw(spark, d))


@case(
    "coverage_filter",
    "SELECT host, count(DISTINCT year) AS n_years FROM facts_raw WHERE metric = 'count' AND value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT year) >= 7",
    ["facts_raw"],
)
def _coverage_filter(spark, d):
    return A.coverage_filter(filter_panel(V.facts_raw(spark, d), "count", with_value=True), 7)


@case(
    "cond_means",
    """SELECT host, avg(value) FILTER (species = 'SMALL') AS mean_small, avg(value) FILTER (species = 'LARGE') AS mean_large,
       avg(value) FILTER (species = 'PROMO') AS mean_promo FROM facts_raw WHERE metric = 'count' GROUP BY host""",
    ["facts_raw"],
    ["mean_small", "mean_large", "mean_promo"],
)
def _cond_means(spark, d):
    return A.cond_means(filter_panel(V.facts_raw(spark, d), "count"), TRIO)


@case(
    "ols_slope",
    """SELECT host, species, metric, CASE WHEN count(value) >= 3 THEN coalesce(regr_slope(value, year), 0) ELSE 0 END AS slope,
        regr_intercept(value, year) AS intercept, count(value) AS n FROM panel GROUP BY ALL""",
    ["panel"],
    ["slope", "intercept"],
)
def _ols_slope(spark, d):
    return A.ols_slope(V.panel(spark, d), series=SERIES)


MEDIANS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, median({f}) AS median_all, median({f}) FILTER (delta >= 0) AS median_subset FROM lag_f" for f in P.SPENDING
)


@case("median_split", MEDIANS, ["lag_f"], ["median_all", "median_subset"])
def _median_split(spark, d):
    return A.median_split(lag_features(spark, d), P.SPENDING, F.col("delta") >= 0)


@case("mean_std", "SELECT host, species, metric, avg(value) AS mean, stddev_samp(value) AS std FROM panel GROUP BY ALL", ["panel"], ["mean", "std"])
def _mean_std(spark, d):
    return A.mean_std(V.panel(spark, d), SERIES)


@case("value_counts", "SELECT host, count(*) AS n FROM facts_raw GROUP BY host", ["facts_raw"])
def _value_counts(spark, d):
    return A.value_counts(V.facts_raw(spark, d), "host")


@case("share_by_year", "SELECT year, avg(label) * 100 AS positive_pct FROM harvest_f GROUP BY year", ["harvest_f"], ["positive_pct"])
def _share_by_year(spark, d):
    return A.share_by_year(harvest_features(spark, d))


@case(
    "actual_vs_pred_by_year",
    "SELECT year, avg(population_t1) AS actual, avg(population_t) AS predicted FROM lag_f GROUP BY year",
    ["lag_f"],
    ["actual", "predicted"],
)
def _actual_vs_pred_by_year(spark, d):
    return A.actual_vs_pred_by_year(lag_features(spark, d), "population_t1", "population_t")


@case(
    "mae_summary",
    "SELECT avg(mae) AS mean, count(mae) AS n FROM (SELECT host, avg(abs(population_t1 - population_t)) AS mae FROM lag_f GROUP BY host) q",
    ["lag_f"],
    ["mean"],
)
def _mae_summary(spark, d):
    per_host = lag_features(spark, d).groupBy("host").agg(F.avg(F.abs(F.col("population_t1") - F.col("population_t"))).alias("mae"))
    return A.mean_of_present(per_host, "mae")


@case(
    "fold_mean_std",
    """SELECT species, metric, avg(s) AS mean, stddev_pop(s) AS std, count(s) AS folds
       FROM (SELECT species, metric, year, avg(value) AS s FROM panel GROUP BY ALL) q GROUP BY ALL""",
    ["panel"],
    ["mean", "std"],
)
def _fold_mean_std(spark, d):
    return A.fold_mean_std(V.panel(spark, d).groupBy(*KINDS, "year").agg(F.avg("value").alias("score")), by=KINDS)


@case(
    "histogram",
    """SELECT label, CAST(least(floor((harvest_rate - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n
       FROM (SELECT label, harvest_rate, min(harvest_rate) OVER (PARTITION BY label) AS lo, max(harvest_rate) OVER (PARTITION BY label) AS hi FROM harvest_f) q
       GROUP BY 1, 2""",
    ["harvest_f"],
)
def _histogram(spark, d):
    return A.histogram(harvest_features(spark, d), "harvest_rate", 20, by=["label"])


@case(
    "percentile_cut",
    "SELECT unnest([2.0, 5.0, 10.0]) AS pct, unnest([quantile_cont(deviation, 0.02), quantile_cont(deviation, 0.05), quantile_cont(deviation, 0.10)]) AS cut FROM anomaly_f",
    ["anomaly_f"],
    ["pct", "cut"],
)
def _percentile_cut(spark, d):
    return A.percentile_cut(anomaly_features(spark, d), "deviation", [2, 5, 10])


# --- windows -----------------------------------------------------------------------


def windowed(name: str, sql_expr: str, column, doubles=("value", "x")):
    @case(name, f"SELECT host, species, metric, year, value, {sql_expr} AS x FROM panel WINDOW w AS {OF_SERIES}", ["panel"], doubles)
    def _query(spark, d):
        return V.panel(spark, d).select(*SERIES, "year", "value", column().alias("x"))


value = lambda: F.col("value")
windowed("lag_feature", "lag(value) OVER w", lambda: windows.previous_row(value(), SERIES))
windowed("rolling_mean3", "avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", lambda: windows.rolling_mean3(value(), SERIES))
windowed(
    "pct_change_calendar",
    "CASE WHEN lag(year) OVER w = year - 1 THEN (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) * 100 END",
    lambda: windows.change_pct(value(), SERIES),
)
windowed(
    "zscore_entity",
    "CASE WHEN stddev_samp(value) OVER (PARTITION BY host, species, metric) > 0 THEN (value - avg(value) OVER (PARTITION BY host, species, metric)) / stddev_samp(value) OVER (PARTITION BY host, species, metric) ELSE 0 END",
    lambda: windows.zscore(value(), SERIES),
)


@case(
    "next_consecutive",
    f"""SELECT host, species, metric, year, value, ahead FROM (SELECT *, lead(value) OVER w AS ahead, lead(year) OVER w AS ny
        FROM panel WINDOW w AS {OF_SERIES}) q WHERE ny - year = 1""",
    ["panel"],
    ["value", "ahead"],
)
def _next_consecutive(spark, d):
    return windows.next_consecutive(V.panel(spark, d).select(*SERIES, "year", "value"), "value", "ahead", SERIES)


@case(
    "time_order_index",
    "SELECT year, host, species, metric, row_number() OVER (ORDER BY year, host, species, metric) - 1 AS idx FROM panel",
    ["panel"],
)
def _time_order_index(spark, d):
    keys = ["year", "host", "species", "metric"]
    return folds.time_order_index(V.panel(spark, d).select(*keys), keys)


# --- sorts and top-k ---------------------------------------------------------------


@case("sort_multi", "SELECT * FROM panel ORDER BY host, year, species, metric", ["panel"], ["value"])
def _sort_multi(spark, d):
    return ranking.sort_multi(V.panel(spark, d), ["host", "year", *KINDS])


@case("sort_nulls_last", "SELECT * FROM panel ORDER BY value NULLS LAST, host", ["panel"], ["value"])
def _sort_nulls_last(spark, d):
    return ranking.sort_nulls_last(V.panel(spark, d), "value", "host")


@case(
    "topk_anomalies",
    "SELECT host, year, change_pct FROM anomaly_f ORDER BY round(change_pct, 9), host, year LIMIT 5",
    ["anomaly_f"],
    ["change_pct"],
)
def _topk_anomalies(spark, d):
    scored = anomaly_features(spark, d).select("host", "year", "change_pct", F.round("change_pct", 9).alias("score"))
    return anomaly.topk_anomalies(scored, 5).drop("score")


@case(
    "topk_entities",
    "SELECT host, count(*) AS n FROM anomaly_f WHERE abs(deviation) > 1.2 GROUP BY host ORDER BY n DESC, host LIMIT 6",
    ["anomaly_f"],
)
def _topk_entities(spark, d):
    return ranking.most_frequent(anomaly_features(spark, d).filter("abs(deviation) > 1.2"), "host", 6)


@case(
    "argmax_k",
    "SELECT min(year) AS year FROM (SELECT year, count(*) AS n, max(count(*)) OVER () AS top FROM panel GROUP BY year) q WHERE n = top",
    ["panel"],
)
def _argmax_k(spark, d):
    return ranking.argmax_first(V.panel(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n")), "year", "n")


@case(
    "rank_impact",
    "SELECT metric AS feature, avg(abs(value)) AS impact FROM fin_raw GROUP BY metric ORDER BY impact DESC, feature",
    ["fin_raw"],
    ["impact"],
)
def _rank_impact(spark, d):
    means = V.fin_raw(spark, d).groupBy(F.col("metric").alias("feature")).agg(F.avg(F.abs("value")).alias("impact"))
    return ranking.rank_by(means, "impact", "feature")


# --- sets --------------------------------------------------------------------------


@case("union_all", "SELECT year, host, metric, value FROM fin_raw UNION ALL SELECT year, host, metric, value FROM facts_raw", ["fin_raw", "facts_raw"])
def _union_all(spark, d):
    return V.fin_raw(spark, d).unionByName(V.facts_raw(spark, d).drop("species"))


@case(
    "intersect_entities",
    """SELECT host, species, metric FROM panel a WHERE year = 1998 AND value IS NOT NULL
       INTERSECT SELECT host, species, metric FROM panel b WHERE year = 2000 AND value IS NOT NULL""",
    ["panel"],
)
def _intersect_entities(spark, d):
    return sets.intersect_entities(V.panel(spark, d), [1998, 2000], SERIES)


@case("distinct_entities", "SELECT DISTINCT host FROM facts_raw", ["facts_raw"])
def _distinct_entities(spark, d):
    return sets.distinct_entities(V.facts_raw(spark, d))


@case(
    "overlap_pct",
    """SELECT 100.0 * count(b.host) / count(*) AS overlap_pct FROM (SELECT host, year FROM anomaly_f WHERE abs(deviation) > 1.5) a
       LEFT JOIN (SELECT host, year FROM anomaly_f WHERE abs(change_pct) > 20) b ON a.host = b.host AND a.year = b.year""",
    ["anomaly_f"],
    ["overlap_pct"],
)
def _overlap_pct(spark, d):
    features = anomaly_features(spark, d)
    return sets.overlap_pct(features.filter("abs(deviation) > 1.5"), features.filter("abs(change_pct) > 20"))


# --- panel analyses ----------------------------------------------------------------


@case("stable_entities", STABLE, ["panel"])
def _stable_entities(spark, d):
    return stable(V.panel(spark, d))


RECOVERY = f"""SELECT 'SMALL' AS species, n_hosts, round_even(b, 1) AS before, p AS after_1, q AS after_2, round_even(p - b, 1) AS change_1,
 round_even((p - b) / b * 100, 1) AS change_pct_1, round_even(q - b, 1) AS change_2, round_even((q - b) / b * 100, 1) AS change_pct_2
FROM (SELECT count(DISTINCT host) AS n_hosts, sum(value) FILTER (year IN (1996, 1997, 1998)) / 3 AS b,
  sum(value) FILTER (year = 1999) AS p, sum(value) FILTER (year = 2000) AS q
 FROM ({SMALL}) s WHERE year BETWEEN 1996 AND 2000 AND value IS NOT NULL AND host IN ({STABLE})
 AND host IN (SELECT host FROM ({SMALL}) c WHERE year BETWEEN 1996 AND 2000 AND value IS NOT NULL GROUP BY host HAVING count(DISTINCT year) = 5)) t
WHERE n_hosts > 0"""


@case("recovery", RECOVERY, ["panel"], ["after_1", "after_2"])
def _recovery(spark, d):
    panel = stored_species(spark, d)
    return P.recovery(panel, stable(panel), SPECIES, [1996, 1997, 1998], (1999, 2000))


TREND = """SELECT unnest([2001, 2002, 2003]) AS year, b + (b - a) / 2.0 * unnest([1, 2, 3]) AS forecast
FROM (SELECT sum(value) FILTER (year = 1998) AS a, sum(value) FILTER (year = 2000) AS b FROM ({rows}) s WHERE year IN (1998, 2000) {both}) t
WHERE a IS NOT NULL AND b IS NOT NULL"""
BOTH = f"AND host IN (SELECT host FROM ({SMALL}) x WHERE year IN (1998, 2000) AND value IS NOT NULL GROUP BY host HAVING count(DISTINCT year) = 2)"


@case("trend_forecast", TREND.format(rows=SMALL, both=BOTH), ["panel"], ["forecast"])
def _trend_forecast(spark, d):
    return P.trend_forecast(stored_species(spark, d), SPECIES, (1998, 2000), [2001, 2002, 2003])


@case("trend_forecast_totals", TREND.format(rows=SMALL, both=""), ["panel"], ["forecast"])
def _trend_forecast_totals(spark, d):
    return P.trend_forecast(V.panel(spark, d), SPECIES, (1998, 2000), [2001, 2002, 2003], same_composition=False)


@case(
    "scenario_band",
    f"""SELECT a.year, least(a.forecast, b.forecast) AS lower, greatest(a.forecast, b.forecast) AS upper
        FROM ({TREND.format(rows=SMALL, both=BOTH)}) a JOIN ({TREND.format(rows=SMALL, both="")}) b ON a.year = b.year""",
    ["panel"],
    ["lower", "upper"],
)
def _scenario_band(spark, d):
    return P.scenario_band(_trend_forecast(spark, d), _trend_forecast_totals(spark, d))


@case(
    "split_gap_years",
    f"SELECT year, coalesce(sum(value), 0) AS total, year IN (1999, 2000) AS incomplete FROM ({SMALL}) s GROUP BY year",
    ["panel"],
    ["total"],
)
def _split_gap_years(spark, d):
    return P.split_gap_years(V.panel(spark, d), SPECIES, [1999, 2000])


@case("suppress_forecast", "SELECT * FROM panel WHERE species NOT IN ('PROMO')", ["panel"], ["value"])
def _suppress_forecast(spark, d):
    return P.suppress_forecast(V.panel(spark, d), ["PROMO"])


def anomaly_features(spark, d):
    return P.anomaly_features(V.panel(spark, d), SPECIES, min_points=6)


@case("anomaly_features", "SELECT * FROM anomaly_f", ["anomaly_f"], ["value", "change_pct", "deviation"])
def _anomaly_features(spark, d):
    return anomaly_features(spark, d)


@case(
    "flag_anomalies",
    """SELECT host, year, deviation, CASE WHEN round(deviation, 9) < (SELECT quantile_cont(round(deviation, 9), 0.05) FROM anomaly_f) THEN -1 ELSE 1 END AS anomaly
       FROM anomaly_f""",
    ["anomaly_f"],
    ["deviation"],
)
def _flag_anomalies(spark, d):
    given = materialize(anomaly_features(spark, d).withColumn("score", F.round("deviation", 9)), "scores")
    return anomaly.flag_anomalies(given, 0.05).select("host", "year", "deviation", "anomaly")


HARVEST_DOUBLES = ["population", "shot_heads", "harvest_rate", "pop_trend", "harvest_rate_lag"]


@case(
    "harvest_features",
    "SELECT host, year, population, shot_heads, harvest_rate, label, pop_trend, harvest_rate_lag FROM harvest_f",
    ["harvest_f"],
    HARVEST_DOUBLES,
)
def _harvest_features(spark, d):
    return harvest_features(spark, d)


@case(
    "harvest_features_expanding",
    """SELECT * FROM (SELECT h.*, CASE WHEN count(*) OVER w >= 3 THEN regr_slope(population, year) OVER w ELSE 0.0 END AS pop_trend,
        lag(harvest_rate) OVER (PARTITION BY host ORDER BY year) AS harvest_rate_lag
       FROM harvest h WINDOW w AS (PARTITION BY host ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t WHERE harvest_rate_lag IS NOT NULL""",
    ["harvest"],
    HARVEST_DOUBLES,
)
def _harvest_features_expanding(spark, d):
    return harvest_features(spark, d, expanding=True)


FOLD_SQL = """SELECT year, host, idx, CAST(CASE WHEN idx >= n - 5 * (n // 6) THEN floor((idx - (n - 5 * (n // 6))) / (n // 6)) ELSE -1 END AS INT) AS fold
FROM (SELECT year, host, row_number() OVER (ORDER BY year, host) - 1 AS idx, count(*) OVER () AS n FROM harvest_f) t"""


@case("temporal_folds", FOLD_SQL, ["harvest_f"])
def _temporal_folds(spark, d):
    return folds.temporal_folds(harvest_features(spark, d).select("year", "host"))


@case(
    "temporal_folds_by_period",
    """SELECT h.year, h.host, CAST(CASE WHEN s >= n - 5 * (n // 6) THEN floor((s - (n - 5 * (n // 6))) / (n // 6)) ELSE -1 END AS INT) AS fold
       FROM harvest_f h JOIN (SELECT year, sum(count(*)) OVER (ORDER BY year) - count(*) AS s, sum(count(*)) OVER () AS n FROM harvest_f GROUP BY year) y ON h.year = y.year""",
    ["harvest_f"],
)
def _temporal_folds_by_period(spark, d):
    rows = harvest_features(spark, d).select("year", "host")
    return folds.temporal_folds(rows, by="period").select("year", "host", "fold")


REPORT = """WITH p AS (SELECT label AS y, CASE WHEN harvest_rate_lag >= 1.1 THEN 1 ELSE 0 END AS p FROM harvest_f),
c AS (SELECT count(*) FILTER (y = 0 AND p = 0) AS a, count(*) FILTER (p = 0) AS s0, count(*) FILTER (y = 0) AS n0,
 count(*) FILTER (y = 1 AND p = 1) AS b, count(*) FILTER (p = 1) AS s1, count(*) FILTER (y = 1) AS n1 FROM p)
SELECT '0' AS class, a / s0 AS precision, a / n0 AS recall, 2 * a / (s0 + n0) AS f1, n0 AS support FROM c
UNION ALL SELECT '1', b / s1, b / n1, 2 * b / (s1 + n1), n1 FROM c
UNION ALL SELECT 'accuracy', (a + b) / (n0 + n1), (a + b) / (n0 + n1), (a + b) / (n0 + n1), n0 + n1 FROM c
UNION ALL SELECT 'macro avg', (a / s0 + b / s1) / 2, (a / n0 + b / n1) / 2, (2 * a / (s0 + n0) + 2 * b / (s1 + n1)) / 2, n0 + n1 FROM c
UNION ALL SELECT 'weighted avg', (a / s0 * n0 + b / s1 * n1) / (n0 + n1), (a + b) / (n0 + n1), (2 * a / (s0 + n0) * n0 + 2 * b / (s1 + n1) * n1) / (n0 + n1), n0 + n1 FROM c"""


@case("classification_report", REPORT, ["harvest_f"], ["precision", "recall", "f1"])
def _classification_report(spark, d):
    rows = harvest_features(spark, d).withColumn("prediction", (F.col("harvest_rate_lag") >= 1.1).cast("int"))
    return validation.report(rows)


LAG_COLS = ["population_t", "population_t1", *P.SPENDING, "delta"]


@case("lag_regression_features", f"SELECT host, year, {', '.join(LAG_COLS)} FROM lag_f", ["lag_f"], exact=True)
def _lag_regression_features(spark, d):
    return lag_features(spark, d)


@case("delta_target", "SELECT host, year, population_t1 - population_t AS delta FROM lag_f", ["lag_f"], ["delta"])
def _delta_target(spark, d):
    rows = lag_features(spark, d)
    return rows.select("host", "year", P.delta_target(F.col("population_t1"), F.col("population_t")).alias("delta"))


@case(
    "cv_mae",
    """WITH f AS (SELECT *, row_number() OVER (ORDER BY year, host) - 1 AS idx, count(*) OVER () AS n FROM lag_f)
SELECT round_even(avg(m), 1) AS mae, round_even(stddev_pop(m), 1) AS mae_std, count(m) AS folds FROM (
 SELECT floor((idx - (n - 5 * (n // 6))) / (n // 6)) AS fold, avg(abs(population_t1 - population_t)) AS m FROM f WHERE idx >= n - 5 * (n // 6) GROUP BY 1) q""",
    ["lag_f"],
)
def _cv_mae(spark, d):
    rows = folds.temporal_folds(lag_features(spark, d)).filter("fold >= 0").withColumn("prediction", F.col("population_t"))
    return regress.cv_mae(rows, "population_t1")


@case(
    "attribution_linear",
    """SELECT host, year, 0.5 * (total_expenses - avg(total_expenses) OVER ()) AS phi_total_expenses,
       -0.25 * (expense_feeding - avg(expense_feeding) OVER ()) AS phi_expense_feeding FROM lag_f""",
    ["lag_f"],
    ["phi_total_expenses", "phi_expense_feeding"],
)
def _attribution_linear(spark, d):
    out = regress.attribution_linear(lag_features(spark, d), {"total_expenses": 0.5, "expense_feeding": -0.25})
    return out.select("host", "year", "phi_total_expenses", "phi_expense_feeding")


THRESHOLD = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round_even(median({f}), 1) AS median_all, round_even(median({f}) FILTER (delta >= 0), 1) AS median_stable FROM lag_f"
    for f in P.SPENDING
)


@case("stability_threshold", THRESHOLD, ["lag_f"])
def _stability_threshold(spark, d):
    return P.stability_threshold(lag_features(spark, d))


HOST_COLS = ["mean_small", "mean_large", "mean_promo", "n_years", "trend", "expenses"]


def entity_features(spark, d):
    return P.entity_features(V.panel(spark, d), V.fin_raw(spark, d), TRIO, SPECIES, excluded_hosts(spark, d))


@case("entity_features", f"SELECT host, {', '.join(HOST_COLS)} FROM host_f", ["host_f"], [c for c in HOST_COLS if c != "n_years"])
def _entity_features(spark, d):
    return entity_features(spark, d)


@case(
    "standardize",
    "SELECT host, " + ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}" for c in HOST_COLS) + " FROM host_f",
    ["host_f"],
    HOST_COLS,
)
def _standardize(spark, d):
    return scaling.standardize(materialize(entity_features(spark, d), "hosts"), HOST_COLS)
