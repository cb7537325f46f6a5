"""Linear models of all folds from one pass: mergeable sums of products.

A fold's rows are reduced to their count, sums and products (exact sums, so they merge in any
order). An expanding fold trains on everything before it, so its normal equations come from
adding up the rows of earlier folds: one small row per fold, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.functions.exact import exact_sum


def moments(df: DataFrame, cols: Sequence[str], by: str = "fold") -> DataFrame:
    """(by, n, s<i>, p<i>_<j>): count, sums and sums of products of the columns, per group."""
    sums = [exact_sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]
    products = [
        exact_sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in combinations_with_replacement(range(len(cols)), 2)
    ]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def spread(n: float, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Centred products: n times the covariances."""
    return products - np.outer(sums, sums) / n


def coefficients(n: float, sums: np.ndarray, products: np.ndarray) -> np.ndarray | None:
    """(intercept, slopes) of the last column on the others; None without rows.

    The equations are solved for standardised columns. A column that never varies has no slope;
    where columns depend on each other the solution is the one of smallest length.
    """
    if n < 1:
        return None
    centred = spread(n, sums, products)
    scale = np.sqrt(np.maximum(np.diag(centred), 0))
    varies = scale > 1e-12 * np.maximum(np.sqrt(np.diag(products)), 1e-300)
    used = np.flatnonzero(varies[:-1])
    slopes = np.zeros(len(sums) - 1)
    if len(used) and varies[-1]:
        unit = centred / np.outer(np.where(varies, scale, 1), np.where(varies, scale, 1))
        solved = np.linalg.lstsq(unit[np.ix_(used, used)], unit[used, -1], rcond=1e-12)[0]
        slopes[used] = solved * scale[-1] / scale[used]
    return np.concatenate([[(sums[-1] - slopes @ sums[:-1]) / n], slopes])


def expanding_coefficients(df: DataFrame, cols: Sequence[str], target: str, fold: str = "fold") -> dict[int, np.ndarray]:
    """(intercept, slopes) of every fold from 0 on, trained on all earlier folds; one pass."""
    names = [*cols, target]
    k = len(names)
    rows = sorted(moments(df, names, fold).collect(), key=lambda r: r[fold])  # one row per fold
    n, sums, products, out = 0, np.zeros(k), np.zeros((k, k)), {}
    for r in rows:
        if r[fold] >= 0 and (found := coefficients(n, sums, products)) is not None:
            out[r[fold]] = found
        n += r["n"]
        sums = sums + [r[f"s{i}"] for i in range(k)]
        for i, j in combinations_with_replacement(range(k), 2):
            products[i, j] += r[f"p{i}_{j}"]
            products[j, i] = products[i, j]
    return out


def expanding_predictions(df: DataFrame, cols: Sequence[str], target: str, fold: str = "fold") -> DataFrame:
    """Rows of the folds that can be trained, with ``prediction``.

    Columns and target must not be NULL. The coefficients, one row per fold, join by fold.
    """
    found = expanding_coefficients(df, cols, target, fold)
    names = [f"_b{i}" for i in range(len(cols) + 1)]
    schema = ", ".join([f"`{fold}` int", *(f"{n} double" for n in names)])
    table = df.sparkSession.createDataFrame([(int(k), *map(float, b)) for k, b in found.items()], schema)
    prediction = F.col("_b0")
    for name, c in zip(names[1:], cols, strict=True):
        prediction = prediction + F.col(name) * F.col(c)
    return df.join(F.broadcast(table), fold).withColumn("prediction", prediction).drop(*names)  # one row per fold
