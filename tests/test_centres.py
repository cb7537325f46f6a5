"""Sets of centres, axes, given forests and reproducible folds against plain computations."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpanel.plans import anomaly, centres, cluster, folds

COLS = ["a", "b", "c"]


def frame(spark, points, parts=3):
    rows = [(f"h{i}", *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "host string, a double, b double, c double").repartition(parts)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    return np.vstack([rng.normal(m, 0.5, (25, 3)) for m in ([0, 0, 0], [6, 0, 1], [0, 7, 2], [5, 6, -4])])


def test_nearest_and_inertia(spark, points):
    sets = {"one": points[:1], "three": points[[3, 40, 80]], "same": points[[5, 5]]}
    df = frame(spark, points)
    got = {(r.host, r.set): (r.centre, r.dist) for r in centres.nearest_centres(df, COLS, sets).collect()}
    assert len(got) == len(points) * 3
    for name, xs in sets.items():
        far = ((points[:, None] - xs[None]) ** 2).sum(axis=2)
        for i, row in enumerate(far):
            assert got[f"h{i}", name] == (int(row.argmin()), pytest.approx(row.min()))
    sums = {r.set: (r.inertia, r.n) for r in centres.inertia(df, COLS, sets).collect()}
    assert sums["three"] == (pytest.approx(((points[:, None] - sets["three"][None]) ** 2).sum(axis=2).min(axis=1).sum()), 100)


def lloyd(points, xs, rounds):
    for _ in range(rounds):
        best = ((points[:, None] - xs[None]) ** 2).sum(axis=2).argmin(axis=1)
        xs = np.array([points[best == i].mean(axis=0) if (best == i).any() else x for i, x in enumerate(xs)])
    return xs


def test_settled_sets_equal_a_plain_search(spark, points):
    df = frame(spark, points)
    starts = centres.starting_centres(df, COLS, [2, 4], 3, 42)
    assert sorted(starts) == ["k2_0", "k2_1", "k2_2", "k4_0", "k4_1", "k4_2"]
    assert centres.starting_centres(frame(spark, points, 7), COLS, [2, 4], 3, 42).keys() == starts.keys()
    far = np.full((1, 3), 1e6)
    starts["lost"] = np.vstack([points[:1], far])  # a centre without points stays where it is
    settled = centres.settle(df, COLS, starts)
    assert settled.keys() == starts.keys() and (settled["lost"][1] == far).all()
    for name, xs in starts.items():
        assert np.allclose(settled[name], lloyd(points, xs, 100), atol=1e-3)


def test_best_of_all_restarts(spark, points):
    best = centres.best_per_k(frame(spark, points), COLS, [1, 4, 6], 4, 42)
    assert best[1][0] == pytest.approx(((points - points.mean(axis=0)) ** 2).sum())
    assert best[4][0] < 100 and best[6][0] <= best[4][0] < best[1][0]


@pytest.mark.parametrize("dims", [2, 3])
def test_axes_are_eigenvectors(spark, points, dims):
    cols = COLS[:dims]
    got = cluster.pca2(frame(spark, points).select("host", *cols), cols).toPandas().set_index("host")
    z = (points[:, :dims] - points[:, :dims].mean(axis=0)) / points[:, :dims].std(axis=0)
    values, axes = np.linalg.eigh(np.cov(z.T, bias=True))
    for rank in (1, 2):
        size = np.abs(axes[:, -rank])
        axis = axes[:, -rank] * np.sign(axes[np.flatnonzero(size > size.max() - 1e-9)[0], -rank])
        assert np.allclose(got.loc[[f"h{i}" for i in range(100)], f"pc{rank}"], z @ axis)
        assert got[f"explained_{rank}"].iat[0] == pytest.approx(values[-rank] / values.sum() * 100)


def test_axes_of_nothing_and_of_constants(spark, points):
    assert cluster.pca2(frame(spark, points).filter("false"), COLS).count() == 0
    same = cluster.pca2(frame(spark, np.ones((4, 3))), COLS).toPandas()
    assert (same[["pc1", "pc2", "explained_1", "explained_2"]] == 0).all().all()


def test_a_stored_forest_scores_like_the_grown_one(spark, points):
    df = frame(spark, points).withColumn("year", F.lit(1))
    drawn = anomaly.tree_samples(df, ["host", "year"], 5, 32, 42, 100)
    forest = anomaly.grow_trees(drawn, COLS, ["host", "year"], 32, 42)
    whole = {r.host: r.score for r in anomaly.isolation_scores(df, COLS, trees=5, sample=32).collect()}
    assert {r.host: r.score for r in anomaly.given_scores(df, COLS, forest, 32).collect()} == whole


def test_folds_by_a_hash_that_others_have(spark):
    rows = [(f"h{i}", i % 7, i % 3) for i in range(60)]
    got = folds.shuffled_folds(spark.createDataFrame(rows, "host string, year int, label int"), "label", ["host", "year"], n=4, seed=9)
    want = {}
    for label in range(3):
        own = sorted(((hashlib.md5(f"{h}|{y}|9".encode()).hexdigest(), h, y) for h, y, k in rows if k == label))
        want.update({(h, y, label): i % 4 for i, (_, h, y) in enumerate(own)})
    assert {(r.host, r.year, r.label): r.fold for r in got.collect()} == want
