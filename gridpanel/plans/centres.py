"""Many clusterings per pass: sets of centres as one bounded table.

All candidates (every k, every restart) are sets of centres. One pass over the points finds
the nearest centre in every set, and one aggregate moves all centres, so a sweep costs as many
passes as its slowest candidate needs rounds, not that times the number of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Centres = Mapping[str, np.ndarray]  # name of the set -> (k, dimensions)
ROUNDS = 300
START_ROWS = 4096  # rows that starting centres are drawn from


def _distances(points: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every centre, one coordinate at a time."""
    out = np.zeros((len(points), len(xs)))
    for i in range(points.shape[1]):
        gap = points[:, i, None] - xs[None, :, i]
        gap *= gap
        out += gap
    return out


def _points(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def nearest_centres(df: DataFrame, cols: Sequence[str], centres: Centres, key: Sequence[str] = ("host",)) -> DataFrame:
    """(key..., set, centre, dist): every row's nearest centre in every set, squared distance.

    Ties go to the first centre. Columns must not be NULL. The centres are bounded by the number
    of candidates and go to the tasks with the function.
    """
    keys, dims = list(key), len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch, dims)
            for name, xs in centres.items():
                far = _distances(points, xs)
                best = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in keys), pa.array([name] * len(best)), pa.array(best.astype(np.int32)), pa.array(far[np.arange(len(best)), best])],
                    [*keys, "set", "centre", "dist"],
                )

    fields = [df.schema[k] for k in keys] + [T.StructField("set", T.StringType()), T.StructField("centre", T.IntegerType()), T.StructField("dist", T.DoubleType())]
    return _points(df, cols, keys).mapInArrow(run, T.StructType(fields))


def _totals(df: DataFrame, cols: Sequence[str], centres: Centres) -> DataFrame:
    """(set, centre, n, dist, m0...): points, squared distances and coordinate sums per centre.

    A task adds up all its points first and sends one row per centre.
    """
    dims = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: np.zeros((len(xs), dims + 2)) for name, xs in centres.items()}
        for batch in batches:
            points = _matrix(batch, dims)
            for name, xs in centres.items():
                far = _distances(points, xs)
                best = far.argmin(axis=1)
                values = [None, far[np.arange(len(best)), best], *points.T]
                sums[name] += np.column_stack([np.bincount(best, v, len(xs)) for v in values])
        names = [name for name, xs in centres.items() for _ in xs]
        places = [i for xs in centres.values() for i in range(len(xs))]
        flat = np.concatenate(list(sums.values()))
        columns = [pa.array(names), pa.array(places, pa.int32()), *(pa.array(flat[:, i]) for i in range(dims + 2))]
        yield pa.RecordBatch.from_arrays(columns, ["set", "centre", "n", "dist", *(f"m{i}" for i in range(dims))])

    kind = ", ".join(["`set` string, centre int, n double, dist double", *(f"m{i} double" for i in range(dims))])
    parts = _points(df, cols).mapInArrow(run, kind)
    return parts.groupBy("set", "centre").agg(*[F.sum(c).alias(c) for c in ("n", "dist", *(f"m{i}" for i in range(dims)))])


def inertia(df: DataFrame, cols: Sequence[str], centres: Centres) -> DataFrame:
    """(set, inertia, n): sum of the squared distances to the nearest centres."""
    return _totals(df, cols, centres).groupBy("set").agg(F.sum("dist").alias("inertia"), F.sum("n").cast("bigint").alias("n"))


def starting_centres(df: DataFrame, cols: Sequence[str], ks: Sequence[int], restarts: int, seed: int, key: Sequence[str] = ("host",)) -> Centres:
    """Sets named ``k<k>_<restart>``, spread out over ``START_ROWS`` rows chosen by hash of the key.

    Each next centre is drawn with a chance that grows with the squared distance to the
    nearest one so far. Only where the search starts depends on this sample.
    """
    rows = df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(START_ROWS).select(*cols).collect()
    points = np.array([[float(v) for v in r] for r in rows]).reshape(-1, len(cols))
    out = {}
    for k in ks:
        for restart in range(restarts):
            rng = np.random.default_rng([seed, k, restart])
            chosen = [points[rng.integers(len(points))]]
            while len(chosen) < min(k, len(points)):
                near = np.min([((points - c) ** 2).sum(axis=1) for c in chosen], axis=0)
                total = near.sum()
                chosen.append(points[rng.choice(len(points), p=near / total) if total > 0 else rng.integers(len(points))])
            out[f"k{k}_{restart}"] = np.array(chosen)
    return out


def settle(df: DataFrame, cols: Sequence[str], centres: Centres, rounds: int = ROUNDS, tolerance: float = 1e-4) -> Centres:
    """Every set after moving its centres to their points' means until none moves far.

    A set that has settled takes no part in further passes; a centre without points stays.
    """
    done: dict[str, np.ndarray] = {}
    moving = dict(centres)
    for _ in range(rounds):
        if not moving:
            break
        moved = {name: xs.copy() for name, xs in moving.items()}
        for r in _totals(df, cols, moving).collect():  # one row per centre
            if r["n"]:
                moved[r["set"]][r["centre"]] = [r[f"m{i}"] / r["n"] for i in range(len(cols))]
        for name, xs in moved.items():
            if ((xs - moving[name]) ** 2).sum(axis=1).max() <= tolerance**2:
                done[name] = xs
        moving = {name: xs for name, xs in moved.items() if name not in done}
    return {**done, **moving}


def best_per_k(df: DataFrame, cols: Sequence[str], ks: Sequence[int], restarts: int, seed: int, key: Sequence[str] = ("host",)) -> dict[int, tuple[float, np.ndarray]]:
    """k -> (inertia, centres) of the best restart, all found together."""
    settled = settle(df, cols, starting_centres(df, cols, ks, restarts, seed, key))
    best: dict[int, tuple[float, str]] = {}
    for r in inertia(df, cols, settled).collect():  # one row per set
        k = int(r["set"][1:].split("_")[0])
        best[k] = min(best.get(k, (np.inf, "")), (r["inertia"], r["set"]))
    return {k: (cost, settled[name]) for k, (cost, name) in sorted(best.items())}
