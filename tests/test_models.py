from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpanel.plans import anomaly, classify, cluster, folds, forecast as fc, forest, regress, validation
from gridpanel.session import materialize
from tests.grids import rows_of

# --- folds -------------------------------------------------------------------------


def labelled(spark, n=61):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0.3).astype(int)
    rows = [(f"h{i % 7}", 2000 + i // 7, 0.1, int(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "host string, year int, harvest_rate double, label int, harvest_rate_lag double, population double, pop_trend double")


def test_temporal_folds_are_ordered(spark):
    df = labelled(spark)
    got = folds.temporal_folds(df).orderBy("year", "host").select("fold").collect()
    seq = [r["fold"] for r in got]
    assert seq == sorted(seq) and seq == [-1] * 11 + sum(([k] * 10 for k in range(5)), [])
    whole = folds.temporal_folds(df, by="period").groupBy("year").agg(F.countDistinct("fold").alias("n"))
    assert all(r["n"] == 1 for r in whole.collect())


def test_shuffled_folds_are_stratified(spark):
    df = folds.shuffled_folds(labelled(spark), "label", ["host", "year"])
    sizes = df.groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"), F.count("fold").alias("k"))
    assert df.count() == 61 and all(r["d"] <= 1 and r["k"] == 5 for r in sizes.collect())


def test_one_class_training_folds_are_skipped(spark):
    df = labelled(spark).withColumn("label", F.when(F.col("year") < 2003, 0).otherwise(F.col("label")))
    used = {r["fold"] for r in classify.temporal_predictions(classify.prepared(df), classify.logit_balanced()).select("fold").distinct().collect()}
    assert 0 not in used and 4 in used


def test_logistic_solution_is_stationary(spark):
    """The fit minimises C * weighted log loss + half the squared norm: its gradient vanishes."""
    df = labelled(spark)
    model, stats = classify.train_logistic(df, classify.FEATURES)
    pdf = df.toPandas()
    z = np.column_stack([(pdf[c] - stats[c][0]) / stats[c][1] for c in classify.FEATURES])
    assert np.allclose(z.std(axis=0), 1)
    y, b, b0 = pdf["label"].to_numpy(), model.coefficients.toArray(), model.intercept
    counts = np.bincount(y)
    w = len(y) / (2 * counts[y])
    r = w * (1 / (1 + np.exp(-(z @ b + b0))) - y)
    assert np.abs(z.T @ r + b).max() < 1e-3 and abs(r.sum()) < 1e-3


def test_report_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0), (0, None)], "label int, prediction int")
    got = {r["class"]: r for r in validation.report(df).collect()}
    assert got["1"]["precision"] == pytest.approx(2 / 3) and got["1"]["recall"] == pytest.approx(2 / 3) and got["0"]["support"] == 2
    assert got["accuracy"]["f1"] == pytest.approx(3 / 5) and got["macro avg"]["f1"] == pytest.approx((0.5 + 2 / 3) / 2)
    empty = {r["class"]: r["f1"] for r in validation.report(df.filter("label = 1 AND prediction = 0")).collect()}
    assert empty["1"] == 0.0


# --- forecasts ---------------------------------------------------------------------


def test_fit_matches_a_grid_search():
    rng = np.random.default_rng(5)
    z = rng.normal(size=80)
    z[1:] += 0.5 * z[:-1]
    theta, sse = fc._fit(z, 1, 1, True)
    grid = min(
        (float((e := fc._errors(z, np.array([a, m, c]), 1, 1)) @ e), a, m, c)
        for a in np.linspace(-0.9, 0.9, 25) for m in np.linspace(-0.9, 0.9, 25) for c in np.linspace(-0.5, 0.5, 9)
    )
    assert sse <= grid[0] + 1e-9


@pytest.mark.parametrize("n", [40, 150])
def test_moving_average_recursion(n):
    rng = np.random.default_rng(0)
    column, ma = rng.normal(size=n), np.array([0.4, -0.2, 0.1])
    want = np.zeros(n)
    for t in range(n):
        want[t] = column[t] - sum(ma[j] * want[t - 1 - j] for j in range(min(3, t)))
    assert np.allclose(fc._unwind(ma, column[:, None])[:, 0], want)


@pytest.mark.parametrize("c", [[0.5], [1.2, -0.5], [0.9, 0.2], [0.3, 0.2, 0.3], [0.5, 0.1, 0.6], [1.5, -0.9, 0.2]])
def test_stationarity_check(c):
    assert fc._stable(c) == bool(np.abs(np.roots(np.r_[1.0, -np.array(c)])).max() < 0.99)


def test_stepwise_order_is_near_the_best_of_the_grid():
    rng = np.random.default_rng(8)
    for _ in range(10):
        y = rng.normal(size=60)
        y[1:] += 0.6 * y[:-1]
        near, whole = fc.best_order(y), fc.best_order(y, stepwise=False)
        assert near[0][1] == whole[0][1] and whole[2] <= near[2] + 1e-6 and near[2] - whole[2] < 8


def test_series_fitted_together_are_fitted_as_alone():
    rng = np.random.default_rng(5)
    series = [np.cumsum(rng.normal(size=n)) if n % 2 else rng.normal(10, 3, n) for n in (*range(5, 34), 120, 121)]
    series += [np.ones(9), np.arange(8.0), np.array([1.0, 2, 4, 8, 16, 32]), np.full(6, np.nan), np.r_[np.zeros(6), 1e6]]
    for stepwise in (True, False):
        for y, got in zip(series, fc.best_orders(series, stepwise=stepwise), strict=True):
            order, theta, aic = fc.best_order(y, stepwise=stepwise)
            assert got[0] == order
            assert np.allclose(got[1], theta, rtol=1e-4, atol=1e-6, equal_nan=True) and np.isclose(got[2], aic, equal_nan=True)


def test_a_series_that_fails_leaves_the_others(monkeypatch):
    def together(*_):
        raise np.linalg.LinAlgError("singular")

    def alone(y, *_):
        if y[0] < 0:
            raise ValueError("bad series")
        return (0, 0, 0), y, 0.0

    monkeypatch.setattr(fc, "_best_together", together)
    monkeypatch.setattr(fc, "best_order", alone)
    bad, good = fc.best_orders([np.r_[-1.0, np.ones(7)], np.ones(8)])
    assert str(bad) == "bad series" and good[0] == (0, 0, 0)


def test_straight_lines_are_continued():
    y = np.arange(12.0) * 3 + 1
    order, theta, _ = fc.best_order(y)
    assert order == (0, 1, 0) and np.allclose(fc.predict(y, order, theta, 3), [37, 40, 43])
    quadratic = np.arange(15.0) ** 2
    ahead = fc.predict(quadratic, (0, 2, 0), np.array([2.0]), 2)
    assert np.allclose(ahead, [225, 256])


def test_backtest_keeps_every_entity(spark):
    line = [("a", t, 2.0 * t) for t in range(1, 13)]
    rows = line + [("short", 1, 1.0), ("short", 11, 1.0)] + [("notest", t, float(t % 3)) for t in range(1, 9)]
    series = spark.createDataFrame(rows, "entity string, period int, value double")
    entities = spark.createDataFrame([("a",), ("short",), ("notest",), ("absent",)], "entity string")
    got = {r["entity"]: r for r in fc.backtest(series, entities, 9, 10, 12).collect()}
    assert got["a"]["status"] == "ok" and got["a"]["mae"] == 0.0 and got["a"]["order"] == "(0, 1, 0)"
    assert all(got[e]["status"] == fc.TOO_SHORT and got[e]["mae"] is None for e in ("short", "notest", "absent"))


def test_forecast_labels(spark):
    rows = [("a", t, 2.0 * t) for t in range(1, 9)] + [("b", t, 1.0) for t in range(1, 4)]
    series = spark.createDataFrame(rows, "entity string, period int, value double")
    assert rows_of(fc.forecast(series), "entity", "period", "forecast") == [("a", 10, 20.0), ("a", 11, 22.0), ("a", 9, 18.0)]
    assert {r["period"] for r in fc.forecast(series, first_period=2026).collect()} == {2026, 2027, 2028}


# --- anomalies ---------------------------------------------------------------------


def test_isolation_finds_the_outlier_and_sets_are_nested(spark):
    rng = np.random.default_rng(1)
    rows = [(f"h{i}", 2000, *map(float, rng.normal(size=2))) for i in range(400)] + [("odd", 2000, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "host string, year int, a double, b double")
    scored = materialize(anomaly.isolation_scores(df, ["a", "b"], trees=50), "scores")
    assert scored.count() == 401 and anomaly.topk_anomalies(scored, 1).first()["host"] == "odd"
    assert scored.filter("score < -1 OR score >= 0").count() == 0
    sweep = anomaly.contamination_sweep(scored).orderBy("contamination").collect()
    assert [r["n_anomalies"] for r in sweep] == sorted(r["n_anomalies"] for r in sweep)
    assert all(r["strict_overlap_pct"] == 100.0 for r in sweep)
    values = np.array([r["score"] for r in scored.select("score").collect()])
    assert anomaly.flag_anomalies(scored, 0.05).filter("anomaly = -1").count() == (values < np.percentile(values, 5)).sum()
    again = anomaly.isolation_scores(df.repartition(3), ["a", "b"], trees=50)
    assert scored.join(again.withColumnRenamed("score", "s2"), ["host"]).filter("score <> s2").count() == 0


def test_tree_samples_are_full_and_distinct(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("host"))
    drawn = anomaly.tree_samples(df, ["host"], 7, 64, 1, 5000).groupBy("tree").agg(F.count("host").alias("n"), F.countDistinct("host").alias("d"))
    assert [(r["n"], r["d"]) for r in drawn.collect()] == [(64, 64)] * 7


# --- regression --------------------------------------------------------------------


def spending(spark, n=40):
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(n, 4))
    y = 3 * x[:, 0] - 2 * x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=n)
    rows = [(f"h{i}", 2000, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, f"host string, year int, {', '.join(c + ' double' for c in regress.SPENDING)}, delta double")


def test_linear_model_is_least_squares(spark):
    df = spending(spark)
    predict, model = regress.train_model("linear", df, regress.SPENDING, "delta")
    pdf = df.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[list(regress.SPENDING)]])
    want = np.linalg.lstsq(x, pdf["delta"], rcond=None)[0]
    assert np.allclose([model.intercept, *model.coefficients], want)


@pytest.mark.parametrize("family", ["linear", "scaled_boosted"])
def test_contributions_add_up(spark, family):
    df = spending(spark)
    cols = list(regress.SPENDING)
    predict, model = regress.train_model(family, df, cols, "delta")
    phi = regress.attribution_coalition(df, predict, cols, background=10)
    base = [r for r in regress.background_rows(df, cols, ["host", "year"], 10)]
    reference = predict(spark.createDataFrame(base, df.select(*cols).schema)).agg(F.avg("prediction")).first()[0]
    both = phi.join(predict(df), ["host", "year"]).toPandas()
    total = sum(both[f"phi_{c}"] for c in cols)
    assert np.allclose(total, both["prediction"] - reference)
    if family == "linear":
        mean = np.mean([r["total_expenses"] for r in base])
        assert np.allclose(both["phi_total_expenses"], model.coefficients[0] * (both["total_expenses"] - mean))


def test_contributions_are_dealt_by_work(spark, monkeypatch):
    """Few bytes, much work: tasks follow the number of predictions, sums stay the same."""
    df = spending(spark).coalesce(1)
    cols = list(regress.SPENDING)
    value = F.col(cols[0]) * F.col(cols[1]) + F.col(cols[2])
    predict = lambda rows: rows.withColumn("prediction", value).withColumn("task", F.spark_partition_id())
    tasks = set()

    def watched(rows):
        tasks.update(r["task"] for r in predict(rows).select("task").distinct().collect())
        return predict(rows).drop("task")

    want = {r["host"]: r for r in regress.attribution_coalition(df, watched, cols, background=5).collect()}
    assert len(tasks) == 1
    monkeypatch.setattr(regress, "TASK_PREDICTIONS", 1000)
    got = {r["host"]: r for r in regress.attribution_coalition(df, watched, cols, background=5).collect()}
    assert len(tasks) > 2
    assert got == want


def test_boosted_rows_are_dealt_by_number(spark, monkeypatch):
    """Every task of a boosted fit is started at each level of each tree: files don't decide on them."""
    df = spending(spark).repartition(7)
    seen = []

    class Watched(regress.GBTRegressor):
        def fit(self, train):
            seen.append([len(p) for p in train.rdd.glom().collect()])
            return super().fit(train)

    monkeypatch.setattr(regress, "GBTRegressor", Watched)
    monkeypatch.setitem(regress.FAMILIES, "boosted", regress.FAMILIES["boosted"] | {"maxIter": 2})
    n = df.count()
    regress.train_model("boosted", df, regress.SPENDING, "delta")
    assert seen == [[n]]
    monkeypatch.setattr(regress, "TASK_ROWS", -(-n // 3))
    predict, _ = regress.train_model("boosted", df.coalesce(1), regress.SPENDING, "delta")
    assert len(seen[1]) == 3 and sum(seen[1]) == n and max(seen[1]) < n / 2
    assert predict(df).columns == [*df.columns, "prediction"] and predict(df).count() == n


# --- clustering --------------------------------------------------------------------


def groups(spark):
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(0, 0.2, (15, 2)), rng.normal(5, 0.2, (15, 2)), [[20.0, 0.0]]])
    rows = [(f"h{i}", float(p[0]), float(p[1]), min(i // 15, 2), i % 2) for i, p in enumerate(points)]
    return points, spark.createDataFrame(rows, "host string, x1 double, x2 double, g int, m int")


def plain_silhouette(points, labels):
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = far[i, same].sum() / (same.sum() - 1)
        b = min(far[i, labels == c].mean() for c in set(labels) if c != own)
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


@pytest.mark.parametrize("block", [4, 1024])
def test_silhouette_matches_brute_force(spark, block):
    points, df = groups(spark)
    got = {r["labels"]: r["silhouette"] for r in cluster.silhouette(df, "host", ["x1", "x2"], ["g", "m"], block).collect()}
    labels = df.select("g", "m").toPandas()
    assert got["g"] == pytest.approx(plain_silhouette(points, labels["g"].to_numpy()))
    assert got["m"] == pytest.approx(plain_silhouette(points, labels["m"].to_numpy()))


def test_sweep_picks_the_groups(spark):
    _, df = groups(spark)
    df = df.filter("g < 2")
    sweep = materialize(cluster.kmeans_sweep(df, ["x1", "x2"], ks=(2, 3, 4), restarts=3), "sweep")
    rows = sweep.orderBy("k").collect()
    assert all(a["inertia"] >= b["inertia"] - 1e-9 for a, b in zip(rows, rows[1:]))
    assert all(-1 <= r["silhouette"] <= 1 for r in rows) and cluster.best_k(sweep).first()["k"] == 2
    labelled_hosts = cluster.assign_clusters(df, ["x1", "x2"], 2, restarts=2)
    assert labelled_hosts.groupBy("g").agg(F.countDistinct("cluster").alias("n")).filter("n > 1").count() == 0
    profile = {r["n"]: r for r in cluster.cluster_profile(labelled_hosts, ["x1"], members=2).collect()}
    assert set(profile) == {15} and len(profile[15]["members"].split(", ")) == 2


def test_projection_keeps_the_variance(spark):
    _, df = groups(spark)
    got = cluster.pca2(df, ["x1", "x2"]).toPandas()
    assert got["explained_1"].iat[0] + got["explained_2"].iat[0] == pytest.approx(100.0)
    assert got["pc1"].var() >= got["pc2"].var()


# --- forests -----------------------------------------------------------------------


def test_forest_against_the_library(spark):
    """Same classes and importances as the library's forest, up to the draws."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=1200) > 0.5).astype(int)
    rows = [(f"h{i}", 2000, int(y[i]), *map(float, x[i])) for i in range(1200)]
    df = materialize(spark.createDataFrame(rows, "host string, year int, label int, a double, b double, c double"), "rows")
    train, test = df.filter("host < 'h7'"), df.filter("host >= 'h7'")
    weight, _ = classify.balanced_weight(train, "label")
    vector = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x")
    theirs = RandomForestClassifier(
        featuresCol="x", labelCol="label", weightCol="w", numTrees=40, maxDepth=30, featureSubsetStrategy="sqrt", seed=42
    ).fit(vector.transform(train.withColumn("w", weight)))
    model = classify.train_forest(train, ["a", "b", "c"], trees=40)
    got = {r["host"]: (r["label"], r["prediction"]) for r in forest.predict(model, test).collect()}
    want = {r["host"]: r["prediction"] for r in theirs.transform(vector.transform(test)).collect()}
    assert len(got) == len(want) > 300 and np.mean([got[h][1] == p for h, p in want.items()]) > 0.95
    right = np.mean([a == want[h] for h, (a, _) in got.items()])
    assert np.mean([a == b for a, b in got.values()]) > right - 0.02
    assert np.abs(np.array(forest.importances(model)) - theirs.featureImportances.toArray()).max() < 0.04
    again = classify.train_forest(train.repartition(3), ["a", "b", "c"], trees=40)
    assert forest.importances(again) == forest.importances(model)


def test_forest_is_a_table(spark):
    """The driver holds no node: a fitted model is thresholds and a stored table."""
    model = classify.train_forest(classify.prepared(labelled(spark)), classify.FEATURES, trees=7)
    nodes = model.nodes
    assert nodes.inputFiles() and nodes.select("tree").distinct().count() == 7
    assert nodes.filter("node = 0").groupBy().agg(F.min("weight").alias("w")).first()["w"] > 0


def test_grown_tree_separates_all_cells():
    x = np.array([[a, b] for a in range(9) for b in range(7)])
    w = np.zeros((63, 2))
    w[np.arange(63), (x[:, 0] * 3 + x[:, 1]) % 2] = 2.0
    nodes = forest.grow(x, w, 30, 2, np.random.default_rng(1))
    leaf = forest.walk(pd.DataFrame({k: v for k, v in nodes.items() if k != "share"}), x)
    assert (nodes["share"][leaf].argmax(axis=1) == w.argmax(axis=1)).all() and (nodes["share"][leaf].max(axis=1) == 1).all()
    assert len(forest.grow(x, w, 0, 2, np.random.default_rng(1))["feature"]) == 1


def test_silhouette_of_many_groups_matches_brute_force(spark, monkeypatch):
    """Pairs of different groups serve both sides."""
    monkeypatch.setattr(cluster, "GROUP", 2)
    rng = np.random.default_rng(11)
    points, labels = rng.normal(size=(60, 2)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(f"h{i}", float(a), float(b), int(labels[i])) for i, (a, b) in enumerate(points)], "host string, x1 double, x2 double, g int")
    got = cluster.silhouette(df, "host", ["x1", "x2"], ["g"], 5).first()
    assert got["n"] == 60 and got["silhouette"] == pytest.approx(plain_silhouette(points, labels))
