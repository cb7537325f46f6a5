"""Random forests grown from counts of binned rows; the trees are a table, not driver objects.

Features are cut into at most ``MAX_BINS`` bins, so rows with equal bins are one cell with a
count per class. A tree sees a cell's rows Poisson(count) times, which is the same draw as one
Poisson(1) per row. Every tree is grown by one task from the cells, level by level, and its
nodes go to the shared folder: the driver holds thresholds and class counts only. The cells of
a tree number at most MAX_BINS^features (32,768 for three) and at most the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.session import materialize

MAX_BINS = 32
SPLIT_ROWS = 10_000  # rows, drawn by hash, that thresholds are taken from
NODE_CHUNK = 4096  # nodes whose histograms are held at once
NODES = "tree int, node int, feature int, bin int, lft int, rgt int, gain double, weight double, share array<double>"


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees, and what is needed to bin new rows."""

    nodes: DataFrame
    cols: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    trees: int


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int = MAX_BINS) -> list[float]:
    """At most ``bins`` - 1 cuts between distinct values, near equal weights apart."""
    distinct, place = np.unique(values, return_inverse=True)
    weight = np.bincount(place, weights)
    if len(distinct) <= bins:
        return [float(v) for v in (distinct[:-1] + distinct[1:]) / 2]
    stride = weight.sum() / bins
    out, target, so_far = [], stride, weight[0]
    for i in range(1, len(distinct)):
        before, so_far = so_far, so_far + weight[i]
        if abs(before - target) < abs(so_far - target):
            out.append(float((distinct[i - 1] + distinct[i]) / 2))
            target += stride
    return out[: bins - 1]


def _bin(col: str, cuts: Sequence[float]) -> Column:
    """The number of cuts below the value. A missing value is an error."""
    value = F.coalesce(F.col(col).cast("double"), F.raise_error(F.lit(f"no value of {col}")).cast("double"))
    if not cuts:
        return F.when(value.isNotNull(), 0)
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda cut: cut < value))


def _bins(cols: Sequence[str], cuts: Sequence[Sequence[float]]) -> list[Column]:
    return [_bin(c, at).alias(f"_b{i}") for i, (c, at) in enumerate(zip(cols, cuts, strict=True))]


def _prune(left: np.ndarray, right: np.ndarray, feature: np.ndarray, best: np.ndarray) -> None:
    """Two leaves of the same class become one; children have larger numbers than their parent."""
    for node in range(len(feature) - 1, -1, -1):
        if feature[node] >= 0:
            a, b = left[node], right[node]
            if feature[a] < 0 and feature[b] < 0 and best[a] == best[b]:
                feature[node] = -1


def _best_splits(x, w, node, n, features, rng):
    """(gain, feature, bin) of ``n`` nodes: greatest loss of Gini impurity over a random subset of features."""
    dims, classes = x.shape[1], w.shape[1]
    gain, feature, cut = np.zeros(n), np.full(n, -1), np.zeros(n, int)
    allowed = rng.random((n, dims)).argsort(axis=1).argsort(axis=1) < features
    order = np.argsort(node, kind="stable")
    x, w, node = x[order], w[order], node[order]
    for first in range(0, n, NODE_CHUNK):
        last = min(n, first + NODE_CHUNK)
        rows = slice(*np.searchsorted(node, [first, last]))
        here, many = node[rows] - first, last - first
        for f in range(dims):
            at = here * MAX_BINS + x[rows, f]
            filled = np.bincount(at, minlength=many * MAX_BINS).reshape(many, MAX_BINS).cumsum(axis=1)
            low = np.stack([np.bincount(at, w[rows, k], many * MAX_BINS) for k in range(classes)], axis=1)
            low = low.reshape(many, MAX_BINS, classes).cumsum(axis=1)
            all_ = low[:, -1:, :]
            high = all_ - low
            size = all_.sum(axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                kept = (low**2).sum(axis=2) / low.sum(axis=2) + (high**2).sum(axis=2) / high.sum(axis=2)
                lost = kept / size - (all_**2).sum(axis=2) / size**2
            lost[(filled == 0) | (filled == filled[:, -1:])] = 0.0
            lost[~allowed[first:last, f]] = 0.0
            b = lost.argmax(axis=1)
            top = lost[np.arange(many), b]
            better = top > np.maximum(gain[first:last], 1e-12)
            span = np.flatnonzero(better) + first
            gain[span], feature[span], cut[span] = top[better], f, b[better]
    return gain, feature, cut


def grow(x: np.ndarray, w: np.ndarray, max_depth: int, features: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree over cells with bins ``x`` (cells, features) and weights ``w`` (cells, classes).

    A node is split by its best cut among ``features`` random features, until none lowers
    the impurity or it lies ``max_depth`` deep.
    """
    node, active = np.zeros(len(x), int), np.ones(len(x), bool)
    stats = [w.sum(axis=0, keepdims=True)]
    parts: list[tuple] = []
    first, n = 0, 1
    for depth in range(max_depth + 1):
        if depth < max_depth:
            gain, feature, cut = _best_splits(x[active], w[active], node[active] - first, n, features, rng)
        else:
            gain, feature, cut = np.zeros(n), np.full(n, -1), np.zeros(n, int)
        split = feature >= 0
        left = np.where(split, first + n + 2 * (np.cumsum(split) - 1), -1)
        parts.append((feature, cut, left, gain))
        local = node - first
        active &= split[np.where(active, local, 0)]
        local = local[active]
        node[active] = left[local] + (x[active, feature[local]] > cut[local])
        first, n = first + n, 2 * int(split.sum())
        if not n:
            break
        stats.append(np.stack([np.bincount(node[active] - first, w[active, k], n) for k in range(w.shape[1])], axis=1))
    feature, cut, left, gain = (np.concatenate(c) for c in zip(*parts, strict=True))
    totals = np.concatenate(stats)
    right = np.where(left >= 0, left + 1, -1)
    _prune(left, right, feature, totals.argmax(axis=1))
    weight = totals.sum(axis=1)
    share = totals / np.where(weight > 0, weight, 1)[:, None]
    return {"feature": feature, "bin": cut, "lft": left, "rgt": right, "gain": gain, "weight": weight, "share": share}


def walk(nodes: pd.DataFrame, x: np.ndarray) -> np.ndarray:
    """The leaf of every cell."""
    feature, cut, left, right = (nodes[c].to_numpy() for c in ("feature", "bin", "lft", "rgt"))
    at = np.zeros(len(x), int)
    while True:
        moving = np.flatnonzero(feature[at] >= 0)
        if not len(moving):
            return at
        here = at[moving]
        at[moving] = np.where(x[moving, feature[here]] > cut[here], right[here], left[here])


def _reachable(nodes: dict[str, np.ndarray]) -> np.ndarray:
    """Nodes that pruning has left."""
    keep = np.zeros(len(nodes["feature"]), bool)
    keep[0] = True
    level = np.array([0])
    while len(level):
        inner = level[nodes["feature"][level] >= 0]
        level = np.concatenate([nodes["lft"][inner], nodes["rgt"][inner]])
        keep[level] = True
    return keep


def train(
    rows: DataFrame, cols: Sequence[str], label: str, class_weights: dict[int, float],
    trees: int = 100, max_depth: int = 30, seed: int = 42,
) -> Forest:
    """A forest for the classes 0, 1, ... in ``label``, each class with its weight."""
    cols, dims = tuple(cols), len(cols)
    classes = max(class_weights) + 1
    per_class = np.array([class_weights.get(k, 0.0) for k in range(classes)])
    features = math.ceil(math.sqrt(dims))
    values = rows.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)], F.col(label).cast("int").alias("_y"), F.xxhash64(*rows.columns, F.lit(seed)).alias("_h"))
    drawn = values.orderBy("_h", *[f"_v{i}" for i in range(dims)]).limit(SPLIT_ROWS).toPandas()
    weight = per_class[drawn["_y"].to_numpy()]
    cuts = tuple(tuple(thresholds(drawn[f"_v{i}"].to_numpy(), weight)) for i in range(dims))

    names = [f"_b{i}" for i in range(dims)]
    hits = [F.count(F.when(F.col("_y") == k, F.lit(1))).alias(f"_n{k}") for k in range(classes)]
    cells = materialize(rows.select(*_bins(cols, cuts), F.col(label).cast("int").alias("_y")).groupBy(*names).agg(*hits), "cells")
    counts = [f"_n{k}" for k in range(classes)]

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        group = group.sort_values(names)  # draws don't depend on how rows arrive
        w = rng.poisson(group[counts].to_numpy()) * per_class
        x, used = group[names].to_numpy(), w.sum(axis=1) > 0
        if not used.any():
            w, used = group[counts].to_numpy() * per_class, np.ones(len(x), bool)
        nodes = grow(x[used], w[used], max_depth, features, rng)
        keep = _reachable(nodes)
        nodes["share"] = list(nodes["share"])
        table = pd.DataFrame({"tree": key[0], "node": np.arange(len(keep)), **nodes})
        return table[keep]

    dealt = _per_tree(cells, trees)
    return Forest(materialize(dealt.groupBy("tree").applyInPandas(one, NODES), "forest"), cols, cuts, trees)


def _per_tree(cells: DataFrame, trees: int) -> DataFrame:
    """Every cell once for every tree, a task taking a few whole trees."""
    dealt = cells.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    parallel = cells.sparkSession.sparkContext.defaultParallelism
    return dealt.repartition(min(trees, 2 * parallel), "tree")


def predict(forest: Forest, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction``: the class with the greatest sum of leaf shares, the smaller of equal ones.

    Rows of one cell end in the same leaves, so every cell is sent down the trees once.
    """
    names = [f"_b{i}" for i in range(len(forest.cols))]
    binned = rows.withColumns(dict(zip(names, _bins(forest.cols, forest.cuts), strict=True)))
    cells = materialize(binned.select(*names).distinct(), "cells")
    kinds = ", ".join(f"{n} int" for n in names)

    def vote(nodes: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        numbers = nodes["node"].to_numpy()  # pruned nodes leave gaps
        for side in ("lft", "rgt"):
            nodes[side] = np.searchsorted(numbers, nodes[side].to_numpy())
        leaf = walk(nodes, group[names].to_numpy())
        share = np.stack(nodes["share"].to_numpy())[leaf]
        best = [{**{n: group[n].to_numpy() for n in names}, "k": k, "s": share[:, k]} for k in range(share.shape[1])]
        return pd.concat([pd.DataFrame(b) for b in best])

    dealt = _per_tree(cells, forest.trees)
    votes = forest.nodes.groupBy("tree").cogroup(dealt.groupBy("tree")).applyInPandas(vote, f"{kinds}, k int, s double")
    # shares are added as whole numbers, so the order of the trees doesn't matter
    unit = F.round(F.col("s") * F.lit(float(1 << 40))).cast("bigint")
    sums = votes.groupBy(*names, "k").agg(F.sum(unit).alias("_s"))
    chosen = sums.groupBy(*names).agg(F.max_by("k", F.struct("_s", -F.col("k"))).cast("double").alias("prediction"))
    chosen = materialize(chosen, "votes")
    own = [c for c in rows.columns if c != "prediction"]
    return binned.join(chosen, names).select(*own, "prediction")


def importances(forest: Forest) -> list[float]:
    """Loss of impurity by feature, each tree's made to add up to one, then their mean."""
    per = forest.nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("v"))
    totals = np.zeros((forest.trees, len(forest.cols)))
    for r in per.collect():  # one row per tree and feature
        totals[r["tree"], r["feature"]] = r["v"]
    sums = totals.sum(axis=1, keepdims=True)
    mean = np.divide(totals, sums, out=np.zeros_like(totals), where=sums > 0).sum(axis=0)
    return [float(v) for v in (mean / mean.sum() if mean.sum() > 0 else mean)]
