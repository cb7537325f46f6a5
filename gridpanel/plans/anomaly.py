"""Isolation scores and contamination thresholds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel.operators.ranking import exact_quantiles, lowest
from gridpanel.session import materialize

TREES, SAMPLE, SEED = 100, 256, 42
GRID = (0.02, 0.05, 0.10)
_EULER = 0.5772156649015329
_NODE = "tree int, node int, feature int, cut double, left int, right int, depth double"


def _expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    m = np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + _EULER) - 2 * (m - 1) / m))


def tree_samples(df: DataFrame, key: Sequence[str], trees: int, sample: int, seed: int, rows: int) -> DataFrame:
    """Up to ``sample`` rows per tree, drawn by hash of the key.

    A row is copied only to trees whose hash falls under a threshold that lets
    about twice the sample through, so what is shuffled is ~2 * sample rows per
    tree, however large the input; the smallest hashes then make the sample.
    """
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.cast("int").alias("tree"), F.pmod(F.xxhash64(*key, t, F.lit(seed)), F.lit(1 << 53)).alias("h")),
    )
    share = min(1.0, (2.0 * sample + 64) / max(rows, 1))
    limit = int(share * (1 << 53))
    picked = df.withColumn("_d", F.explode(F.filter(draws, lambda d: d["h"] < limit)))
    nth = Window.partitionBy("_d.tree").orderBy("_d.h", *key)
    return (
        picked.withColumn("_n", F.row_number().over(nth))
        .filter(F.col("_n") <= sample)
        .withColumn("tree", F.col("_d.tree"))
        .drop("_d", "_n")
    )


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Random splits of one sample until isolated or ``limit`` deep."""
    nodes: list[tuple] = []
    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        rows, depth, parent, is_right = stack.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][3 if is_right else 2] = here
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + float(_expected_depth(len(rows)))])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append([f, cut, -1, -1, 0.0])
        goes_left = part[:, f] <= cut
        stack.append((rows[~goes_left], depth + 1, here, True))
        stack.append((rows[goes_left], depth + 1, here, False))
    return nodes


def grow_trees(samples: DataFrame, cols: Sequence[str], key: Sequence[str], sample: int, seed: int) -> DataFrame:
    """One tree per group of at most ``sample`` rows."""
    cols, key = list(cols), list(key)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iat[0])
        x = pdf.sort_values(key)[cols].to_numpy(float)
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes = _grow(x, limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        return out

    return samples.groupBy("tree").applyInPandas(build, _NODE)


def isolation_scores(
    df: DataFrame, cols: Sequence[str], key: Sequence[str] = ("host", "year"),
    trees: int = TREES, sample: int = SAMPLE, seed: int = SEED,
) -> DataFrame:
    """Add ``score``: the lower, the more easily isolated and hence anomalous.

    The forest has at most ``trees * (2 * sample - 1)`` nodes, a bound that does
    not depend on the data, so it is shipped to the tasks that score the rows.
    """
    cols = list(cols)
    df = materialize(df, "features")  # counted, sampled and scored: computed once
    rows = df.count()
    if rows == 0:
        return df.withColumn("score", F.lit(None).cast("double"))
    drawn = tree_samples(df.select(*key, *cols), key, trees, sample, seed, rows)
    forest = grow_trees(drawn, cols, key, sample, seed).toPandas()
    packed = [t.sort_values("node")[["feature", "cut", "left", "right", "depth"]].to_numpy(float) for _, t in forest.groupby("tree")]
    return _scored(df, cols, packed, float(_expected_depth(min(sample, rows))))


def given_scores(df: DataFrame, cols: Sequence[str], forest: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Add ``score`` from a stored forest: a node table (tree, node, feature, cut, left, right, depth).

    ``node`` counts from 0, the root, in each tree; ``feature`` numbers ``cols``, -1 marks a leaf
    with its ``depth``; values up to ``cut`` go left. ``sample`` is the size the trees were
    grown on. A forest grown by ``grow_trees`` can be stored and used again. Its size is that of
    the trees, whatever the data; NULL features go right.
    """
    nodes = forest.toPandas()
    packed = [t.sort_values("node")[["feature", "cut", "left", "right", "depth"]].to_numpy(float) for _, t in nodes.groupby("tree")]
    return _scored(df, list(cols), packed, float(_expected_depth(sample)))


def _scored(df: DataFrame, cols: Sequence[str], packed: list[np.ndarray], scale: float) -> DataFrame:
    """``score`` from the mean depth in all trees, which are shipped to the tasks."""
    shipped = df.sparkSession.sparkContext.broadcast(packed)
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            total = np.zeros(len(x))
            for t in shipped.value:
                at = np.zeros(len(x), int)
                while True:
                    f = t[at, 0].astype(int)
                    inner = np.flatnonzero(f >= 0)
                    if len(inner) == 0:
                        break
                    node = t[at[inner]]
                    left = x[inner, f[inner]] <= node[:, 1]
                    at[inner] = np.where(left, node[:, 2], node[:, 3]).astype(int)
                total += t[at, 4]
            mean = total / len(shipped.value)
            yield pdf[names].assign(score=-np.exp2(-mean / scale) if scale > 0 else -0.5)

    return df.mapInPandas(score, schema)


def cuts(scored: DataFrame, contaminations: Sequence[float], score: str = "score") -> list[tuple[float, float]]:
    """(contamination, score threshold), a handful of numbers."""
    found = {round(r["q"], 12): r["value"] for r in exact_quantiles(scored, score, list(contaminations)).collect()}
    return [(c, found[round(c, 12)]) for c in contaminations if round(c, 12) in found]


def flag_anomalies(scored: DataFrame, contamination: float = 0.05, score: str = "score") -> DataFrame:
    """Add ``anomaly``: -1 below the percentile of the score, else 1."""
    threshold = dict(cuts(scored, [contamination], score)).get(contamination)
    low = F.col(score) < F.lit(threshold).cast("double")
    return scored.withColumn("anomaly", F.when(low, -1).otherwise(1))


def contamination_sweep(scored: DataFrame, grid: Sequence[float] = GRID, score: str = "score") -> DataFrame:
    """Per contamination: threshold, how many rows are flagged, and the share of the
    strictest set also flagged here. Rows are scored once; the sweep is one pass."""
    limits = cuts(scored, grid, score)
    strict = F.col(score) < F.lit(limits[0][1] if limits else None).cast("double")
    counts = []
    for i, (_, cut) in enumerate(limits):
        flagged = F.col(score) < F.lit(cut)
        counts.append(F.count(F.when(flagged, F.lit(1))).alias(f"_n{i}"))
        counts.append(F.count(F.when(flagged & strict, F.lit(1))).alias(f"_s{i}"))
    counts.append(F.count(F.when(strict, F.lit(1))).alias("_strict"))
    row = F.array(*[
        F.struct(
            F.lit(c).alias("contamination"), F.lit(cut).alias("cut"), F.col(f"_n{i}").alias("n_anomalies"),
            (F.try_divide(F.col(f"_s{i}"), F.col("_strict")) * 100).alias("strict_overlap_pct"),
        )
        for i, (c, cut) in enumerate(limits)
    ])
    return scored.agg(*counts).select(F.inline(row))


def topk_anomalies(scored: DataFrame, k: int = 5, key: Sequence[str] = ("host", "year"), score: str = "score") -> DataFrame:
    return lowest(scored, score, k, list(key))
