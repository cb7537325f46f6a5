"""Over-harvest classification with time-honest validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.operators.aggregates import fold_mean_std
from gridpanel.plans import forest
from gridpanel.plans.folds import shuffled_folds, temporal_folds
from gridpanel.plans.scaling import scaled, scaler
from gridpanel.plans.validation import Fit, fold_f1, out_of_fold
from gridpanel.session import materialize

FEATURES = ("harvest_rate_lag", "population", "pop_trend")
FOLDS = 5
MAX_DEPTH = 30


def class_weights(train: DataFrame, label: str) -> tuple[dict[int, float], int]:
    """Weight n / (classes * n_class) of each class, and n."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}  # one row per class
    n = sum(counts.values())
    return {value: n / (len(counts) * count) for value, count in counts.items()}, n


def balanced_weight(train: DataFrame, label: str) -> tuple[Column, int]:
    """The class weight as an expression, and n."""
    weights, n = class_weights(train, label)
    weight = F.lit(None).cast("double")
    for value, share in weights.items():
        weight = F.when(F.col(label) == value, F.lit(share)).otherwise(weight)
    return weight, n


def _vector(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="_x").transform(df)


def train_logistic(train: DataFrame, cols: Sequence[str], label: str = "label", c: float = 1.0):
    """Scaled, balanced logistic regression; ``c`` is the inverse penalty on the summed loss."""
    stats = scaler(train, cols)
    weight, n = balanced_weight(train, label)
    data = _vector(scaled(train, stats, prefix="_z_"), [f"_z_{x}" for x in cols]).withColumn("_w", weight)
    model = LogisticRegression(
        featuresCol="_x", labelCol=label, weightCol="_w", maxIter=1000, tol=1e-8,
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
    ).fit(data)
    return model, stats


def logit_balanced(cols: Sequence[str] = FEATURES, label: str = "label") -> Fit:
    def fit(train: DataFrame):
        model, stats = train_logistic(train, cols, label)

        def score(test: DataFrame) -> DataFrame:
            data = _vector(scaled(test, stats, prefix="_z_"), [f"_z_{x}" for x in cols])
            return model.transform(data).select(*test.columns, "prediction")

        return score

    return fit


def train_forest(
    train: DataFrame, cols: Sequence[str], label: str = "label", trees: int = 100, max_depth: int = MAX_DEPTH, seed: int = 42
):
    """Balanced random forest. Scaling is left out: splits don't depend on it.

    Trees grow until their leaves are pure or ``max_depth`` deep; the library allows no more
    than ``MAX_DEPTH``.
    """
    weights, _ = class_weights(train, label)
    return forest.train(train, cols, label, weights, trees, max_depth, seed)


def forest_balanced(cols: Sequence[str] = FEATURES, label: str = "label", **options) -> Fit:
    def fit(train: DataFrame):
        model = train_forest(train, cols, label, **options)
        return lambda test: forest.predict(model, test)

    return fit


def prepared(features: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """The feature frame with gaps filled, computed once for all fits."""
    keep = features.select("host", "year", "harvest_rate", "label", *cols)
    return materialize(keep.na.fill(0.0, list(cols)), "features")


def temporal_predictions(features: DataFrame, fit: Fit, n: int = FOLDS, by: str = "row") -> DataFrame:
    """Out-of-sample predictions of expanding folds."""
    folded = materialize(temporal_folds(features, n=n, by=by), "folds")
    return out_of_fold(folded, fit, range(n), expanding=True, label="label")


def shuffled_predictions(features: DataFrame, fit: Fit, n: int = FOLDS, seed: int = 42) -> DataFrame:
    """Predictions of shuffled folds: the leaky baseline."""
    folded = materialize(shuffled_folds(features, "label", ["host", "year"], n, seed), "folds")
    return out_of_fold(folded, fit, range(n), expanding=False, label="label")


def temporal_cv(features: DataFrame, fit: Fit, n: int = FOLDS, by: str = "row") -> DataFrame:
    """Mean and population standard deviation of F1 over the usable folds."""
    return fold_mean_std(fold_f1(temporal_predictions(features, fit, n, by)))


def leak_inflation(features: DataFrame, fits: dict[str, Fit], n: int = FOLDS, seed: int = 42) -> DataFrame:
    """Per model: honest F1, shuffled F1, and by how much shuffling flatters."""
    timed = materialize(temporal_folds(features, n=n), "folds")
    mixed = materialize(shuffled_folds(features, "label", ["host", "year"], n, seed), "folds")
    rows = None
    for name, fit in fits.items():
        honest = fold_mean_std(fold_f1(out_of_fold(timed, fit, range(n), True, "label")))
        leaky = fold_mean_std(fold_f1(out_of_fold(mixed, fit, range(n), False, "label")))
        part = honest.select(F.lit(name).alias("model"), F.lit("temporal").alias("kind"), "mean", "std").unionByName(
            leaky.select(F.lit(name).alias("model"), F.lit("shuffled").alias("kind"), "mean", "std")
        )
        rows = part if rows is None else rows.unionByName(part)
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = rows.groupBy("model").agg(
        at("temporal", "mean").alias("f1"), at("temporal", "std").alias("f1_std"), at("shuffled", "mean").alias("leaky_f1")
    )
    return wide.withColumn("inflation", F.col("leaky_f1") - F.col("f1"))


def importance(features: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Feature weights of both models on all rows; coefficients are scaled to the forest's maximum."""
    trained = train_forest(features, cols)
    logit, _ = train_logistic(features, cols)
    by_forest = forest.importances(trained)
    sizes = [abs(float(v)) for v in logit.coefficients.toArray()]
    top = max(sizes)
    by_logit = [v / top * max(by_forest) if top > 0 else v for v in sizes]
    rows = [("forest", f, v) for f, v in zip(cols, by_forest)] + [("logit", f, v) for f, v in zip(cols, by_logit)]
    return features.sparkSession.createDataFrame(rows, "model string, feature string, importance double")
