"""Clustering of entities: choice of k, labels, silhouette, projection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.operators.ranking import argmax_first
from gridpanel.plans import centres, gram
from gridpanel.plans.scaling import standardize
from gridpanel.session import materialize

SEED, RESTARTS, KS = 42, 10, tuple(range(2, 9))
BLOCK = 1024
GROUP = 16  # blocks that one side of a pair brings to a task


def standardised(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Gaps filled and columns standardised, written once for all passes."""
    return materialize(standardize(df.na.fill(0.0, list(cols)), cols), "points")


def vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardised columns plus their vector."""
    return VectorAssembler(inputCols=list(cols), outputCol="x").transform(standardised(df, cols))


def _far(xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``xa`` to all of ``xb``, one coordinate at a time."""
    out = np.zeros((len(xa), len(xb)))
    for i in range(xa.shape[1]):
        gap = xa[:, i, None] - xb[None, :, i]
        gap *= gap
        out += gap
    return np.sqrt(out, out=out)


def _near_and_far(same: bool, a: tuple, b: tuple, block: int) -> Iterator[pd.DataFrame]:
    """Sums of distances of every point of two groups to each cluster of the other one."""
    (ka, xa, la), (kb, xb, lb) = a, b
    clusters = [(np.unique(la[:, i]), np.unique(lb[:, i])) for i in range(la.shape[1])]
    member = lambda l, i, names: (l[:, i, None] == names[None, :]).astype(float)
    of_a = [member(la, i, names) for i, (names, _) in enumerate(clusters)]
    of_b = [member(lb, i, names) for i, (_, names) in enumerate(clusters)]
    to_b = [np.zeros((len(xa), m.shape[1])) for m in of_b]
    to_a = [np.zeros((len(xb), m.shape[1])) for m in of_a]
    for p in range(0, len(xa), block):
        for q in range(0, len(xb), block):
            far = _far(xa[p : p + block], xb[q : q + block])
            for i in range(len(clusters)):
                to_b[i][p : p + block] += far @ of_b[i][q : q + block]
                if not same:
                    to_a[i][q : q + block] += far.T @ of_a[i][p : p + block]
    for i, (names_a, names_b) in enumerate(clusters):
        sides = [(ka, la, names_b, of_b[i], to_b[i])] + ([] if same else [(kb, lb, names_a, of_a[i], to_a[i])])
        for keys, own, names, members, total in sides:
            for j, c in enumerate(names):
                yield pd.DataFrame({
                    "k": keys, "which": i, "own": own[:, i], "cluster": int(c), "dist": total[:, j], "n": int(members[:, j].sum()),
                })


def silhouette(df: DataFrame, key: str, cols: Sequence[str], labels: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Mean Euclidean silhouette for each label column: (labels, silhouette, n).

    Needs every distance: points are dealt into groups of up to ``GROUP`` blocks of ``block``
    rows, and every unordered pair of groups is one row of a join, dealt evenly. Inside a
    pair distances live in one block-by-block matrix at a time, each serves both of its
    points, and a pair sends one row per point and cluster. Points x groups rows meet.
    """
    cols, labels = list(cols), list(labels)
    groups = max(1, -(-df.count() // (block * GROUP)))
    # a pair of groups costs about as much as any other, so their number deals the work
    parallel = df.sparkSession.sparkContext.defaultParallelism
    packed = materialize(
        df.withColumn("_g", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
        .groupBy("_g")
        .agg(F.collect_list(F.struct(
            F.col(key).alias("k"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"),
            F.array(*[F.col(c).cast("int") for c in labels]).alias("l"),
        )).alias("p")), "groups",
    )
    side = lambda n: packed.select(F.col("_g").alias(f"g{n}"), F.col("p").alias(f"p{n}"))
    met = df.sparkSession.range(groups * groups).select(
        (F.col("id") / groups).cast("int").alias("ga"), (F.col("id") % groups).cast("int").alias("gb")
    ).filter("ga <= gb")
    pairs = met.join(side("a"), "ga").join(side("b"), "gb").repartition(max(1, min(groups * (groups + 1) // 2, 16 * parallel)))
    pairs = pairs.select(
        (F.col("ga") == F.col("gb")).alias("same"), F.col("pa.k").alias("ka"), F.flatten("pa.x").alias("xa"), F.flatten("pa.l").alias("la"),
        F.col("pb.k").alias("kb"), F.flatten("pb.x").alias("xb"), F.flatten("pb.l").alias("lb"),
    )
    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, which int, own int, cluster int, dist double, n bigint"

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = lambda values, width: np.reshape(values, (-1, width))
        for pdf in batches:
            for same, ka, xa, la, kb, xb, lb in pdf.itertuples(index=False):
                xa, la, xb, lb = shape(xa, len(cols)), shape(la, len(labels)), shape(xb, len(cols)), shape(lb, len(labels))
                yield from _near_and_far(same, (ka, xa, la), (kb, xb, lb), block)

    per = pairs.mapInPandas(sums, schema).groupBy("k", "which", "own", "cluster").agg(
        F.sum("dist").alias("dist"), F.sum("n").alias("n")
    )
    mine = F.col("own") == F.col("cluster")
    point = per.groupBy("k", "which").agg(
        F.max(F.when(mine, F.try_divide(F.col("dist"), F.col("n") - 1))).alias("_a"),
        F.max(F.when(mine, F.col("n"))).alias("_own"),
        F.min(F.when(~mine, F.col("dist") / F.col("n"))).alias("_b"),
    )
    value = F.when(F.col("_own") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    )
    names = F.array(*[F.lit(c) for c in labels])
    mean = point.groupBy("which").agg(F.avg(value).alias("silhouette"), F.count(F.lit(1)).alias("n"))
    return mean.select(names[F.col("which")].alias("labels"), "silhouette", "n")


def silhouette_squared(data: DataFrame, cluster: str = "cluster") -> float:
    """Silhouette on squared distances, linear in the rows: for populations where
    every pairwise distance is out of reach. A different measure, not an estimate."""
    return ClusteringEvaluator(featuresCol="x", predictionCol=cluster, metricName="silhouette").evaluate(data)


def kmeans_sweep(
    df: DataFrame, cols: Sequence[str], ks: Sequence[int] = KS, restarts: int = RESTARTS,
    seed: int = SEED, key: str = "host", exact: bool = True,
) -> DataFrame:
    """(k, inertia, silhouette) for each k, best of several restarts; all are fitted together."""
    data = standardised(df, cols)
    best = centres.best_per_k(data, cols, ks, restarts, seed, [key])
    spark = df.sparkSession
    costs = spark.createDataFrame([(k, float(cost)) for k, (cost, _) in best.items()], "k int, inertia double")
    near = centres.nearest_centres(data, cols, {f"k{k}": xs for k, (_, xs) in best.items()}, [key])
    names = [f"k{k}" for k in best]
    labels = near.groupBy(key).agg(*[F.max(F.when(F.col("set") == n, F.col("centre"))).alias(n) for n in names])
    labelled = materialize(data.join(labels, key), "labelled")
    if exact:
        scores = silhouette(labelled, key, cols, names)
        scores = scores.select(F.substring("labels", 2, 9).cast("int").alias("k"), "silhouette")
    else:
        flat = VectorAssembler(inputCols=list(cols), outputCol="x").transform(labelled)
        rows = [(k, silhouette_squared(flat, f"k{k}")) for k in best]
        scores = spark.createDataFrame(rows, "k int, silhouette double")
    return costs.join(scores, "k")


def best_k(sweep: DataFrame) -> DataFrame:
    """The smallest k with the highest silhouette."""
    return argmax_first(sweep, "k", "silhouette")


def assign_clusters(
    df: DataFrame, cols: Sequence[str], k: int, restarts: int = RESTARTS, seed: int = SEED, key: str = "host"
) -> DataFrame:
    """The entities with their original features and cluster label."""
    data = standardised(df, cols)
    best = centres.best_per_k(data, cols, [k], restarts, seed, [key])
    label = centres.nearest_centres(data, cols, {"k": best[k][1]}, [key]).select(key, F.col("centre").alias("cluster"))
    return df.join(label, key)


def cluster_profile(clustered: DataFrame, cols: Sequence[str], key: str = "host", members: int = 5) -> DataFrame:
    """Size, feature means and the first members by name of each cluster.

    The row-number filter is pushed below the shuffle, so a task sends at most
    ``members`` names per cluster.
    """
    first = Window.partitionBy("cluster").orderBy(key)
    names = (
        clustered.select("cluster", key, F.row_number().over(first).alias("_n"))
        .filter(F.col("_n") <= members)
        .groupBy("cluster")
        .agg(F.array_join(F.array_sort(F.collect_list(key)), ", ").alias("members"))
    )
    stats = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols]
    )
    return stats.join(names, "cluster")


def pca2(df: DataFrame, cols: Sequence[str], key: str = "host") -> DataFrame:
    """Two-dimensional projection with the explained share of variance, in percent.

    The products of the standardised columns are summed in one pass; the axes are the leading
    eigenvectors of that small matrix. Each axis is turned so that its largest loading (the
    first of equal ones) is positive.
    """
    cols = list(cols)
    data = standardised(df, cols)
    row = gram.moments(data.withColumn("_all", F.lit(0)), cols, "_all").first()
    n, k = (row["n"], len(cols)) if row else (0, len(cols))
    if n < 1:
        none = F.lit(None).cast("double")
        return data.select(key, *[none.alias(c) for c in ("pc1", "pc2", "explained_1", "explained_2")])
    products = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            products[i, j] = products[j, i] = row[f"p{i}_{j}"]
    values, axes = np.linalg.eigh(gram.spread(n, np.array([row[f"s{i}"] for i in range(k)]), products) / n)
    total = values.sum()
    out = []
    for rank in (1, 2):
        axis = axes[:, -rank]
        size = np.abs(axis)
        lead = int(np.flatnonzero(size > size.max() - 1e-9)[0])
        axis = axis if axis[lead] >= 0 else -axis
        projected = F.lit(0.0)
        for c, weight in zip(cols, axis, strict=True):
            projected = projected + F.col(c) * F.lit(float(weight))
        out.append(projected.alias(f"pc{rank}"))
    share = [F.lit(float(values[-rank] / total * 100) if total > 0 else 0.0).alias(f"explained_{rank}") for rank in (1, 2)]
    return data.select(key, *out, *share)
