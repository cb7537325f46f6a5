"""Population and spending models with attribution."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import factorial

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.operators.aggregates import fold_mean_std
from gridpanel.operators.ranking import rank_by
from gridpanel.plans.folds import temporal_folds
from gridpanel.plans.gram import expanding_predictions
from gridpanel.plans.panel import SPENDING
from gridpanel.plans.scaling import scaled, scaler
from gridpanel.plans.validation import Fit, fold_mae, out_of_fold
from gridpanel.session import materialize

LEVEL_FEATURES = ("population_t", *SPENDING)
FOLDS = 5
TASK_PREDICTIONS = 1_000_000  # predictions that one task makes for attributions
TASK_ROWS = 500_000  # training rows of a boosted fit in one task

# Boosting parameters tuned for the first family; the second one
# stands in where the tuned model was a small neural network.
FAMILIES = {
    "boosted": {"maxIter": 71, "maxDepth": 6, "stepSize": 0.01147, "subsamplingRate": 0.966, "seed": 42},
    "scaled_boosted": {"maxIter": 40, "maxDepth": 4, "stepSize": 0.1, "seed": 42},
    "linear": {},
}


def _vector(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="_x").transform(df)


def _by_rows(train: DataFrame) -> DataFrame:
    """Training rows dealt evenly to as many tasks as their number asks for, not one per file.

    A boosted fit runs two small stages per level of every tree, so each further task is started
    hundreds of times.
    """
    tasks = -(-train.count() // TASK_ROWS)
    return train.repartition(tasks) if tasks > 1 else train.coalesce(1)


def train_model(family: str, train: DataFrame, cols: Sequence[str], target: str):
    """Fit one family; returns a function that adds ``prediction``, and the fitted model."""
    cols = list(cols)
    stats = scaler(train, cols) if family == "scaled_boosted" else {}
    used = [f"_z_{c}" for c in cols] if stats else cols
    prepare = lambda df: _vector(scaled(df, stats, prefix="_z_"), used) if stats else _vector(df, used)
    if family == "linear":
        estimator = LinearRegression(featuresCol="_x", labelCol=target, regParam=0.0, solver="normal")
    else:
        estimator = GBTRegressor(featuresCol="_x", labelCol=target, **FAMILIES[family])
        train = _by_rows(train.select(*cols, target))
    model = estimator.fit(prepare(train))
    return (lambda df: model.transform(prepare(df)).select(*df.columns, "prediction")), model


def fit_family(family: str, cols: Sequence[str], target: str) -> Fit:
    return lambda train: train_model(family, train, cols, target)[0]


def prepared(features: DataFrame) -> DataFrame:
    keep = features.select("host", "year", *LEVEL_FEATURES, "population_t1", "delta")
    return materialize(keep.na.fill(0.0, list(LEVEL_FEATURES)), "features")


def temporal_predictions(features: DataFrame, family: str, cols: Sequence[str], target: str, n: int = FOLDS) -> DataFrame:
    folded = materialize(temporal_folds(features, n=n), "folds")
    if family == "linear":
        return expanding_predictions(folded, cols, target)
    return out_of_fold(folded, fit_family(family, cols, target), range(n))


def cv_mae(predicted: DataFrame, actual: str) -> DataFrame:
    """Mean and population standard deviation of the MAE over folds, one decimal."""
    stats = fold_mean_std(fold_mae(predicted, actual))
    return stats.select(F.bround("mean", 1).alias("mae"), F.bround("std", 1).alias("mae_std"), "folds")


def forecast_linear(features: DataFrame, n: int = FOLDS) -> DataFrame:
    """Next year's level from this year's and the spending: predictions of expanding folds."""
    return temporal_predictions(features, "linear", LEVEL_FEATURES, "population_t1", n)


def delta_model(features: DataFrame, family: str, cols: Sequence[str] = SPENDING, n: int = FOLDS) -> DataFrame:
    """Change of the population from spending alone: predictions of expanding folds."""
    return temporal_predictions(features, family, cols, "delta", n)


def attribution_linear(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Contribution of each feature of a linear model: coefficient times distance from the mean."""
    means = scaler(df, list(coefficients))
    return df.withColumns({
        f"phi_{c}": F.lit(float(b)) * (F.col(c) - F.lit(means[c][0])) for c, b in coefficients.items()
    })


def background_rows(df: DataFrame, cols: Sequence[str], key: Sequence[str], n: int, seed: int = 42) -> list:
    """At most ``n`` reference rows, chosen by hash of the key (the md5 of key and seed as text)."""
    mix = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary"))
    return df.orderBy(mix, *key).limit(n).select(*cols).collect()


def attribution_coalition(
    df: DataFrame, predict, cols: Sequence[str], background: int, key: Sequence[str] = ("host", "year"), seed: int = 42
) -> DataFrame:
    """Exact Shapley contributions against a background sample: (key..., phi_<c>..., n_background).

    ``background`` is the number of reference rows and has no default: values depend on it
    and the work grows with it. ``n_background`` tells how many there were.

    For each row every subset of features is taken from the row and the rest from
    each background row. The Shapley value is a weighted sum of those
    predictions, so all weights are applied while aggregating: one sum per row
    and feature. Their number, 2^features * background, is fixed, so rows are dealt by
    key while they are narrow, to as many tasks as the predictions ask for, and summed up there.
    """
    cols, key = list(cols), list(key)
    m = len(cols)
    reference = background_rows(df, cols, key, background, seed)
    subsets = [s for size in range(m + 1) for s in combinations(range(m), size)]
    weight = lambda size: factorial(size) * factorial(m - size - 1) / factorial(m)

    # background and subsets are literals of fixed size: an expansion of each row, no join
    points = F.array(*[F.struct(*[F.lit(float(r[c])).alias(c) for c in cols]) for r in reference])
    masks = F.array(*[
        F.struct(
            *[F.lit(i in s).alias(f"_in{i}") for i in range(m)],
            *[F.lit(weight(len(s) - 1) if i in s else -weight(len(s))).alias(f"_w{i}") for i in range(m)],
        )
        for s in subsets
    ])
    tasks = -(-df.count() * len(subsets) * len(reference) // TASK_PREDICTIONS)
    dealt = df.repartition(tasks, *key) if tasks > 1 else df
    wide = dealt.select(*key, *[F.col(c).alias(f"_own_{c}") for c in cols], F.explode(points).alias("_b"))
    wide = wide.select("*", F.explode(masks).alias("_m"))
    mixed = wide.select(
        *key,
        *[F.when(F.col(f"_m._in{i}"), F.col(f"_own_{c}")).otherwise(F.col(f"_b.{c}")).alias(c) for i, c in enumerate(cols)],
        *[F.col(f"_m._w{i}").alias(f"_w{i}") for i in range(m)],
    )
    sums = predict(mixed).groupBy(*key).agg(
        *[(F.sum(F.col(f"_w{i}") * F.col("prediction")) / len(reference)).alias(f"phi_{c}") for i, c in enumerate(cols)]
    ).withColumn("n_background", F.lit(len(reference)))
    return sums


def impact_summary(contributions: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean absolute and mean signed contribution per feature, strongest first."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.abs(f"phi_{c}")).alias(f"_a_{c}"), F.avg(f"phi_{c}").alias(f"_s_{c}")]
    table = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_a_{c}").alias("impact"), F.col(f"_s_{c}").alias("direction"))
        for c in cols
    ])
    return rank_by(contributions.agg(*aggs).select(F.inline(table)), "impact", "feature")
