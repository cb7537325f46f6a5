"""Forecasts, anomaly scores, classifiers, regressions and clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from gridpanel.plans import anomaly, centres, classify, cluster, folds, forecast as fc, panel as P, regress
from gridpanel.session import materialize
from suite import views as V
from suite.panel_cases import HOST_COLS, anomaly_features, entity_features, harvest_features, lag_features
from suite.registry import case

# --- forecasting -------------------------------------------------------------------

AR_SQL = """SELECT entity, p, d, q, aic FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY aic, d, p) AS rn FROM (
 SELECT entity, n, unnest([0, 1, 0, 1]) AS p, unnest([0, 0, 1, 1]) AS d, 0 AS q,
  unnest([n * ln(greatest(e00, 1e-12) / n) + 4, n * ln(greatest(e10, 1e-12) / n) + 6, n * ln(greatest(e01, 1e-12) / n) + 4, n * ln(greatest(e11, 1e-12) / n) + 6]) AS aic
 FROM (SELECT entity, count(*) AS n, regr_syy(y0, x0) AS e00, regr_syy(y1, x1) AS e01,
   regr_syy(y0, x0) - coalesce(regr_sxy(y0, x0) ^ 2 / nullif(regr_sxx(y0, x0), 0), 0) AS e10,
   regr_syy(y1, x1) - coalesce(regr_sxy(y1, x1) ^ 2 / nullif(regr_sxx(y1, x1), 0), 0) AS e11
  FROM (SELECT entity, value AS y0, lag(value) OVER w AS x0, value - lag(value) OVER w AS y1, lag(value) OVER w - lag(value, 2) OVER w AS x1, lag(value, 2) OVER w AS l2
   FROM series WINDOW w AS (PARTITION BY entity ORDER BY period)) a WHERE l2 IS NOT NULL GROUP BY entity HAVING count(*) >= 3) b) c) r WHERE rn = 1"""


@case("order_search_ar", AR_SQL, ["series"], ["aic"])
def _order_search_ar(spark, d):
    return fc.order_search_ar(V.series(spark, d))


@case("forecast_order_search")
def _order_search(spark, d):
    return fc.order_search(V.series(spark, d))


@case("forecast_backtest")
def _backtest(spark, d):
    series = V.series(spark, d)
    return fc.backtest(series, series.select("entity").distinct(), 24, 25, 27)


@case("forecast_future")
def _forecast(spark, d):
    return fc.forecast(V.series(spark, d))


@case("forecast_totals")
def _forecast_totals(spark, d):
    return P.forecast_totals(fc.forecast(V.series(spark, d), first_period=31))


# --- anomalies ---------------------------------------------------------------------

SCORE_COLS = ("value", "change_pct", "deviation")


@case("isolation_scores")
def _isolation_scores(spark, d):
    return anomaly.isolation_scores(anomaly_features(spark, d), SCORE_COLS)


# Two small trees over (value, change_pct, deviation), given as data.
TREES = [
    (0, 0, 2, -0.5, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 1.5), (0, 2, 0, 30.0, 3, 4, 0.0), (0, 3, -1, 0.0, -1, -1, 3.25), (0, 4, -1, 0.0, -1, -1, 2.0),
    (1, 0, 1, 10.0, 1, 2, 0.0), (1, 1, 1, -20.0, 3, 4, 0.0), (1, 2, -1, 0.0, -1, -1, 1.0), (1, 3, -1, 0.0, -1, -1, 2.5), (1, 4, -1, 0.0, -1, -1, 4.0),
]
_NODES = ", ".join(f"({t}, {n}, {f}, {c}::DOUBLE, {a}, {b}, {e}::DOUBLE)" for t, n, f, c, a, b, e in TREES)
_EXPECTED = 2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256
FOREST_SQL = f"""SELECT * FROM (WITH RECURSIVE nodes(tree, node, feature, cut, l, r, depth) AS (VALUES {_NODES}),
walk AS (
  SELECT a.host, a.year, n.* FROM anomaly_f a, nodes n WHERE n.node = 0
  UNION ALL
  SELECT w.host, w.year, n.* FROM walk w JOIN anomaly_f a ON a.host = w.host AND a.year = w.year
   JOIN nodes n ON n.tree = w.tree AND n.node = CASE WHEN (CASE w.feature WHEN 0 THEN a.value WHEN 1 THEN a.change_pct ELSE a.deviation END) <= w.cut THEN w.l ELSE w.r END
   WHERE w.feature >= 0)
SELECT host, year, -power(2, -avg(depth) / {_EXPECTED!r}) AS score FROM walk WHERE feature < 0 GROUP BY 1, 2) scored"""


@case("given_forest_scores", FOREST_SQL, ["anomaly_f"], ["score"])
def _given_forest_scores(spark, d):
    nodes = spark.createDataFrame(TREES, "tree int, node int, feature int, cut double, left int, right int, depth double")
    return anomaly.given_scores(anomaly_features(spark, d), SCORE_COLS, nodes).select("host", "year", "score")


@case("contamination_sweep")
def _contamination_sweep(spark, d):
    scored = materialize(anomaly.isolation_scores(anomaly_features(spark, d), SCORE_COLS), "scores")
    return anomaly.contamination_sweep(scored)


SWEEP_SQL = """WITH s AS (SELECT round(deviation, 9) AS score FROM anomaly_f),
c AS (SELECT unnest([0.02, 0.05, 0.1]) AS contamination, unnest([quantile_cont(score, 0.02), quantile_cont(score, 0.05), quantile_cont(score, 0.1)]) AS cut FROM s)
SELECT CAST(c.contamination AS DOUBLE) AS contamination, c.cut, count(*) FILTER (s.score < c.cut) AS n_anomalies,
 100.0 * count(*) FILTER (s.score < c.cut AND s.score < (SELECT min(cut) FROM c)) / count(*) FILTER (s.score < (SELECT min(cut) FROM c)) AS strict_overlap_pct
FROM c, s GROUP BY 1, 2"""


@case("contamination_sweep_given", SWEEP_SQL, ["anomaly_f"], ["cut", "strict_overlap_pct"])
def _contamination_sweep_given(spark, d):
    given = anomaly_features(spark, d).select(F.round("deviation", 9).alias("score"))
    return anomaly.contamination_sweep(materialize(given, "scores"))


# --- classification ----------------------------------------------------------------


def _classified(spark, d):
    return classify.prepared(harvest_features(spark, d))


@case(
    "shuffled_folds",
    """SELECT host, year, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', host, year, '42')), host, year) - 1) % 5 AS INT) AS fold
       FROM harvest_f""",
    ["harvest_f"],
)
def _shuffled_folds(spark, d):
    return folds.shuffled_folds(_classified(spark, d), "label", ["host", "year"]).select("host", "year", "label", "fold")


@case(
    "shuffled_fold_sizes",
    """SELECT label, CAST(i % 5 AS INT) AS fold, count(*) AS n FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY host, year) - 1 AS i FROM harvest_f) t
       GROUP BY 1, 2""",
    ["harvest_f"],
)
def _shuffled_fold_sizes(spark, d):
    return _shuffled_folds(spark, d).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@case("logit_balanced")
def _logit_balanced(spark, d):
    return classify.temporal_predictions(_classified(spark, d), classify.logit_balanced())


@case("forest_balanced")
def _forest_balanced(spark, d):
    return classify.temporal_predictions(_classified(spark, d), classify.forest_balanced())


@case("temporal_cv")
def _temporal_cv(spark, d):
    return classify.temporal_cv(_classified(spark, d), classify.logit_balanced())


@case("leak_inflation")
def _leak_inflation(spark, d):
    fits = {"logit": classify.logit_balanced(), "forest": classify.forest_balanced()}
    return classify.leak_inflation(_classified(spark, d), fits)


@case("importance")
def _importance(spark, d):
    return classify.importance(_classified(spark, d))


# --- regression --------------------------------------------------------------------


def _regressed(spark, d):
    return regress.prepared(lag_features(spark, d))


def linear_folds_sql(cols, target: str) -> str:
    """CTEs ending in ``predicted``: normal equations of five expanding folds, by elimination.

    Columns are standardised, so the equations need no exchange of rows.
    """
    names, k = [*cols, target], len(cols)
    sums = [f"{V.exact_sum_sql(c)} AS s{i}" for i, c in enumerate(names)]
    products = [f"{V.exact_sum_sql(f'({names[i]} * {names[j]})')} AS p{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)]
    spread = [f"p{i}_{j} - s{i} * s{j} / n AS c{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)]
    unit = [f"c{i}_{j} / sqrt(c{i}_{i} * c{j}_{j}) AS a{i}_{j}" for i in range(k) for j in range(i, k + 1)]
    steps, before = [], "unit"
    for t in range(k - 1):
        rest = [f"a{i}_{j} - a{t}_{i} * a{t}_{j} / a{t}_{t} AS a{i}_{j}" for i in range(t + 1, k) for j in range(i, k + 1)]
        steps.append(f"e{t} AS (SELECT * REPLACE ({', '.join(rest)}) FROM {before})")
        before = f"e{t}"
    for i in reversed(range(k)):
        known = "".join(f" - a{i}_{j} * x{j}" for j in range(i + 1, k))
        steps.append(f"x_{i} AS (SELECT *, (a{i}_{k}{known}) / a{i}_{i} AS x{i} FROM {before})")
        before = f"x_{i}"
    slopes = ", ".join(f"x{i} * sqrt(c{k}_{k} / c{i}_{i}) AS b{i}" for i in range(k))
    base = f"s{k} / n" + "".join(f" - b{i} * s{i} / n" for i in range(k))
    fitted = " + ".join([f"({base})", *(f"b{i} * {c}" for i, c in enumerate(cols))])
    return f"""f AS (SELECT *, CASE WHEN idx >= m - 5 * (m // 6) THEN CAST(floor((idx - (m - 5 * (m // 6))) / (m // 6)) AS INT) ELSE -1 END AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY year, host) - 1 AS idx, count(*) OVER () AS m FROM lag_f) q),
moments AS (SELECT k.fold, count(*) AS n, {', '.join(sums + products)} FROM (SELECT unnest(range(5)) AS fold) k JOIN f ON f.fold < k.fold GROUP BY 1),
spread AS (SELECT *, {', '.join(spread)} FROM moments),
unit AS (SELECT *, {', '.join(unit)} FROM spread),
{', '.join(steps)},
slopes AS (SELECT *, {slopes} FROM {before}),
predicted AS (SELECT f.host, f.year, f.fold, f.{target} AS actual, {fitted} AS prediction FROM f JOIN slopes s ON f.fold = s.fold)"""


def _predicted(rows):
    return rows.select("host", "year", "fold", "prediction")


LEVEL_SQL = f"WITH {linear_folds_sql(regress.LEVEL_FEATURES, 'population_t1')} SELECT host, year, fold, prediction FROM predicted"
LEVEL_MAE_SQL = f"""WITH {linear_folds_sql(regress.LEVEL_FEATURES, 'population_t1')}
SELECT round_even(avg(m), 1) AS mae, round_even(stddev_pop(m), 1) AS mae_std, count(m) AS folds
FROM (SELECT fold, avg(abs(actual - prediction)) AS m FROM predicted GROUP BY 1) q"""
DELTA_SQL = f"WITH {linear_folds_sql(P.SPENDING, 'delta')} SELECT host, year, fold, prediction FROM predicted"


@case("forecast_linear", LEVEL_SQL, ["lag_f"], ["prediction"])
def _forecast_linear(spark, d):
    return _predicted(regress.forecast_linear(_regressed(spark, d)))


@case("forecast_linear_mae", LEVEL_MAE_SQL, ["lag_f"])
def _forecast_linear_mae(spark, d):
    return regress.cv_mae(regress.forecast_linear(_regressed(spark, d)), "population_t1")


@case("delta_model_linear", DELTA_SQL, ["lag_f"], ["prediction"])
def _delta_linear(spark, d):
    return _predicted(regress.delta_model(_regressed(spark, d), "linear"))


@case("delta_model_boosted")
def _delta_boosted(spark, d):
    return regress.delta_model(_regressed(spark, d), "boosted")


@case("delta_model_scaled_boosted")
def _delta_scaled(spark, d):
    return regress.delta_model(_regressed(spark, d), "scaled_boosted")


@case("attribution_coalition")
def _attribution_coalition(spark, d):
    rows = _regressed(spark, d)
    predict, _ = regress.train_model("scaled_boosted", rows, P.SPENDING, "delta")
    return regress.attribution_coalition(rows, predict, P.SPENDING, background=50).drop("n_background")


# a linear predictor: contributions are coefficient times distance from the background's mean
LINE = dict(zip(P.SPENDING, (0.002, -0.01, 0.03, -0.0005), strict=True))
COALITION_SQL = f"""WITH b AS (SELECT * FROM lag_f ORDER BY md5(concat_ws('|', host, year, '42')), host, year LIMIT 20)
SELECT host, year, {', '.join(f"{w} * ({c} - (SELECT avg({c}) FROM b)) AS phi_{c}" for c, w in LINE.items())},
 CAST((SELECT count(*) FROM b) AS INT) AS n_background FROM lag_f"""


@case("attribution_coalition_line", COALITION_SQL, ["lag_f"], [f"phi_{c}" for c in LINE])
def _attribution_coalition_line(spark, d):
    value = F.lit(5.0)
    for c, w in LINE.items():
        value = value + F.col(c) * w
    return regress.attribution_coalition(_regressed(spark, d), lambda rows: rows.withColumn("prediction", value), list(LINE), background=20)


IMPACT = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(abs(phi)) AS impact, avg(phi) AS direction FROM (SELECT {b} * ({c} - avg({c}) OVER ()) AS phi FROM lag_f) t"
    for c, b in (("total_expenses", 0.5), ("expense_feeding", -0.25))
)


@case("impact_summary", IMPACT, ["lag_f"], ["impact", "direction"])
def _impact_summary(spark, d):
    coefficients = {"total_expenses": 0.5, "expense_feeding": -0.25}
    rows = materialize(lag_features(spark, d), "features")
    return regress.impact_summary(regress.attribution_linear(rows, coefficients), list(coefficients))


# --- clustering --------------------------------------------------------------------


def _hosts(spark, d):
    return materialize(entity_features(spark, d), "hosts")


GIVEN = "CASE WHEN n_years < 7 OR mean_small > 27 THEN 0 WHEN expenses > 51000 THEN 1 ELSE 2 END"
STD = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}" for c in HOST_COLS)
FAR = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) ^ 2" for c in HOST_COLS) + ")"
SILHOUETTE = f"""WITH z AS (SELECT host, {GIVEN} AS g, {STD} FROM host_f),
m AS (SELECT a.host, a.g AS own, b.g AS other, sum({FAR}) AS s, count(*) AS n FROM z a, z b GROUP BY 1, 2, 3),
p AS (SELECT host, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a, max(CASE WHEN own = other THEN n END) AS n, min(CASE WHEN own <> other THEN s / n END) AS b
 FROM m GROUP BY host)
SELECT 'g' AS labels, avg(CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS silhouette, count(*) AS n FROM p"""


def _given(spark, d):
    hosts = _hosts(spark, d)
    g = F.when((F.col("n_years") < 7) | (F.col("mean_small") > 27), 0).when(F.col("expenses") > 51000, 1).otherwise(2)
    return hosts.withColumn("g", g)


@case("silhouette", SILHOUETTE, ["host_f"], ["silhouette"])
def _silhouette(spark, d):
    data = cluster.vectors(_given(spark, d), HOST_COLS)
    return cluster.silhouette(data, "host", HOST_COLS, ["g"], block=256)


@case("kmeans_sweep")
def _kmeans_sweep(spark, d):
    return cluster.kmeans_sweep(_hosts(spark, d), HOST_COLS)


# Given sets of centres over the standardised features.
GIVEN_CENTRES = {
    "two": [[0.5, 0.2, -0.1, 0.3, 0.0, 0.4], [-0.6, -0.3, 0.2, -0.5, 0.1, -0.2]],
    "three": [[1.0, 0.0, 0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, -1.0, 0.5, 0.0], [0.0, 0.0, -1.0, 0.5, 0.0, 1.0]],
}
_SETS = " UNION ALL ".join(
    f"SELECT '{name}' AS \"set\", {i} AS centre, z.host, {' + '.join(f'(z.{c} - ({v})) ^ 2' for c, v in zip(HOST_COLS, xs, strict=True))} AS dist FROM z"
    for name, sets in GIVEN_CENTRES.items()
    for i, xs in enumerate(sets)
)
NEAREST_SQL = f"""WITH z AS (SELECT host, {STD} FROM host_f), far AS ({_SETS})
SELECT host, "set", CAST(min_by(centre, dist) AS INT) AS centre, min(dist) AS dist FROM far GROUP BY 1, 2"""


def _centres():
    return {name: np.array(sets) for name, sets in GIVEN_CENTRES.items()}


@case("nearest_centres", NEAREST_SQL, ["host_f"], ["dist"])
def _nearest_centres(spark, d):
    return centres.nearest_centres(cluster.standardised(_hosts(spark, d), HOST_COLS), HOST_COLS, _centres())


@case("centre_inertia", f'SELECT "set", sum(dist) AS inertia, count(*) AS n FROM ({NEAREST_SQL}) q GROUP BY 1', ["host_f"], ["inertia"])
def _centre_inertia(spark, d):
    return centres.inertia(cluster.standardised(_hosts(spark, d), HOST_COLS), HOST_COLS, _centres())


@case("assign_clusters")
def _assign_clusters(spark, d):
    return cluster.assign_clusters(_hosts(spark, d), HOST_COLS, 3)


PROFILE = f"""SELECT cluster, count(*) AS n, avg(mean_small) AS mean_mean_small, avg(expenses) AS mean_expenses,
 array_to_string(list_sort(list(host))[1:5], ', ') AS members FROM (SELECT *, {GIVEN} AS cluster FROM host_f) t GROUP BY cluster"""


@case("cluster_profile", PROFILE, ["host_f"], ["mean_mean_small", "mean_expenses"])
def _cluster_profile(spark, d):
    return cluster.cluster_profile(_given(spark, d).withColumnRenamed("g", "cluster"), ["mean_small", "expenses"])


# the eigenvectors of [[1, r], [r, 1]] are the diagonals
PCA_TWO_SQL = f"""WITH z AS (SELECT host, {STD} FROM host_f), m AS (SELECT corr(mean_small, expenses) AS r FROM z)
SELECT host, (mean_small + CASE WHEN r >= 0 THEN expenses ELSE -expenses END) / sqrt(2) AS pc1,
 (mean_small - CASE WHEN r >= 0 THEN expenses ELSE -expenses END) / sqrt(2) AS pc2,
 50 * (1 + abs(r)) AS explained_1, 50 * (1 - abs(r)) AS explained_2 FROM z, m"""

# three columns: eigenvalues by angles, an eigenvector as the cross product of two rows
_TRIO = ("mean_small", "mean_large", "expenses")


def _axis(k: int) -> str:
    ev = f"l{k}"
    rows = [(f"1 - {ev}", "ab", "ac"), ("ab", f"1 - {ev}", "bc")]
    (a, b, c), (d, e, f) = rows
    x, y, z = f"({b}) * ({f}) - ({c}) * ({e})", f"({c}) * ({d}) - ({a}) * ({f})", f"({a}) * ({e}) - ({b}) * ({d})"
    return f"{x} AS x{k}, {y} AS y{k}, {z} AS z{k}"


def _projected(k: int) -> str:
    lead = f"CASE WHEN abs(x{k}) >= abs(y{k}) AND abs(x{k}) >= abs(z{k}) THEN x{k} WHEN abs(y{k}) >= abs(z{k}) THEN y{k} ELSE z{k} END"
    return f"sign({lead}) * (x{k} * {_TRIO[0]} + y{k} * {_TRIO[1]} + z{k} * {_TRIO[2]}) / sqrt(x{k} ^ 2 + y{k} ^ 2 + z{k} ^ 2) AS pc{k}"


PCA_THREE_SQL = f"""WITH z AS (SELECT host, {STD} FROM host_f),
m AS (SELECT avg({_TRIO[0]} * {_TRIO[1]}) AS ab, avg({_TRIO[0]} * {_TRIO[2]}) AS ac, avg({_TRIO[1]} * {_TRIO[2]}) AS bc FROM z),
p AS (SELECT *, sqrt((ab ^ 2 + ac ^ 2 + bc ^ 2) / 3) AS p FROM m),
t AS (SELECT *, acos(greatest(-1, least(1, ab * ac * bc / p ^ 3))) / 3 AS t FROM p),
l AS (SELECT *, 1 + 2 * p * cos(t) AS l1, 1 + 2 * p * cos(t + 4 * pi() / 3) AS l2 FROM t),
v AS (SELECT *, {_axis(1)}, {_axis(2)} FROM l)
SELECT host, {_projected(1)}, {_projected(2)}, l1 / 3 * 100 AS explained_1, l2 / 3 * 100 AS explained_2 FROM z, v"""
PCA_COLS = ["pc1", "pc2", "explained_1", "explained_2"]


@case("pca2_two_columns", PCA_TWO_SQL, ["host_f"], PCA_COLS)
def _pca2_two(spark, d):
    return cluster.pca2(_hosts(spark, d).select("host", "mean_small", "expenses"), ["mean_small", "expenses"])


@case("pca2_three_columns", PCA_THREE_SQL, ["host_f"], PCA_COLS)
def _pca2_three(spark, d):
    return cluster.pca2(_hosts(spark, d).select("host", *_TRIO), _TRIO)


@case("pca2")
def _pca2(spark, d):
    return cluster.pca2(_hosts(spark, d), HOST_COLS)
