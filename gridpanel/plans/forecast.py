"""Per-series forecasting.

A series has one value per period, so a group handed to Python is bounded by the
number of periods; Spark spreads the series over the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_POINTS = 5
TOO_SHORT = "too little data"
_ALIKE = 8  # series whose lengths fall into one step of so many are fitted together
_TOGETHER = 500_000  # values fitted together


def series_of(df: DataFrame) -> DataFrame:
    """One mean value per (entity, period); periods without a value are left out."""
    return df.filter(F.col("value").isNotNull()).groupBy("entity", "period").agg(F.avg("value").alias("value"))


def _by_entity(df: DataFrame, run, schema: str) -> DataFrame:
    """``run(entities, periods, values)`` over batches of whole series, their points in order of the period.

    Fitting is heavy per byte, so the partition count is stated: merged by size, small series
    would all end up in a few tasks."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    point = F.struct(F.col("period").isNull().alias("late"), "period", F.col("value").cast("double").alias("value"))
    whole = df.repartition(parts, "entity").groupBy("entity").agg(F.array_sort(F.collect_list(point)).alias("points"))

    def batches(found):
        for batch in found:
            points = batch.column("points")
            at = points.offsets.to_numpy() - points.offsets[0].as_py()
            flat = points.flatten()
            value = flat.field("value").to_numpy(zero_copy_only=False).astype(float)
            period = flat.field("period").to_numpy(zero_copy_only=False)
            cut = lambda x: [x[i:j] for i, j in zip(at, at[1:], strict=False)]
            yield from run(batch.column("entity"), cut(period), cut(value))

    return whole.mapInArrow(batches, schema)


def _found(result):
    if isinstance(result, Exception):
        raise result
    return result


# --- closed form: autoregressive order 0 or 1 on levels or differences -------------


def order_search_ar(series: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Pick (p, d, q) with p, d <= 1 and q = 0 per entity by AIC, in aggregates only.

    All orders are scored on the same targets (the third value onwards), which
    makes their one-step errors comparable.
    """
    w = Window.partitionBy("entity").orderBy("period")
    lagged = series.select(
        "entity", "value", F.lag("value", 1).over(w).alias("_l1"), F.lag("value", 2).over(w).alias("_l2")
    ).filter("_l2 IS NOT NULL")
    y0, x0 = F.col("value"), F.col("_l1")
    y1, x1 = F.col("value") - F.col("_l1"), F.col("_l1") - F.col("_l2")
    rss = lambda y, x: F.regr_syy(y, x) - F.coalesce(
        F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x)), F.lit(0.0)
    )
    fits = lagged.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_syy(y0, x0).alias("_e00"), rss(y0, x0).alias("_e10"),
        F.regr_syy(y1, x1).alias("_e01"), rss(y1, x1).alias("_e11"),
    ).filter(F.col("n") >= min_points - 2)
    options = [(0, 0), (1, 0), (0, 1), (1, 1)]
    aic = lambda p, d: F.col("n") * F.ln(F.greatest(F.col(f"_e{p}{d}"), F.lit(1e-12)) / F.col("n")) + 2 * (p + 2)
    scored = F.array(*[
        F.struct(aic(p, d).alias("aic"), F.lit(d).alias("d"), F.lit(p).alias("p")) for p, d in options
    ])
    best = fits.select("entity", F.array_min(scored).alias("_b"))
    return best.select("entity", F.col("_b.p").alias("p"), F.col("_b.d").alias("d"), F.lit(0).alias("q"), F.col("_b.aic").alias("aic"))


# --- order grid per series ---------------------------------------------------------


def _differences_needed(y: np.ndarray, max_d: int) -> int:
    """Differences until the level-stationarity statistic falls below its 5% value."""
    for d in range(max_d):
        x = np.diff(y, d)
        n = len(x)
        if n < 4 or np.allclose(x, x[0]):
            return d
        e = x - x.mean()
        lags = int(3 * np.sqrt(n) / 13)
        s2 = e @ e / n + 2 / n * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
        if s2 <= 0 or (np.cumsum(e) ** 2).sum() / n**2 / s2 < 0.463:
            return d
    return max_d


def _lag(x: np.ndarray, k: int) -> np.ndarray:
    """Series shifted by k steps, the unseen past being 0."""
    out = np.zeros(len(x))
    out[k:] = x[: max(len(x) - k, 0)]
    return out


def _unwind(ma: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Solve e[t] + ma[0] e[t-1] + ... = column[t] for each column."""
    n, q = len(columns), len(ma)
    if q == 0:
        return columns
    if n <= 96:
        system = np.eye(n)
        for j in range(q):
            system[np.arange(j + 1, n), np.arange(n - j - 1)] = ma[j]
        return np.linalg.solve(system, columns)
    out = columns.copy()
    for t in range(1, n):
        k = min(q, t)
        out[t] -= ma[:k] @ out[t - k : t][::-1]
    return out


def _errors(z: np.ndarray, theta: np.ndarray, p: int, q: int) -> np.ndarray:
    """One-step errors; the unseen past is at the mean."""
    w = z - theta[-1]
    driven = w - sum(theta[i] * _lag(w, i + 1) for i in range(p))
    return _unwind(theta[p : p + q], driven[:, None])[:, 0]


def _slopes(z: np.ndarray, theta: np.ndarray, e: np.ndarray, p: int, q: int, with_mean: bool) -> np.ndarray:
    """Derivatives of the errors by the parameters, one column each."""
    w = z - theta[-1]
    columns = [-_lag(w, i + 1) for i in range(p)] + [-_lag(e, j + 1) for j in range(q)]
    if with_mean:
        ones = np.ones(len(z))
        columns.append(sum(theta[i] * _lag(ones, i + 1) for i in range(p)) - ones)
    return _unwind(theta[p : p + q], np.column_stack(columns))


def _stable(c: list[float]) -> bool:
    """Is the recursion x[t] = c[0] x[t-1] + ... stationary? Its partial autocorrelations
    must all lie inside (-1, 1); a small margin keeps clear of the unit root."""
    c = list(c)
    while c:
        last = c.pop()
        if not abs(last) < 0.985:
            return False
        c = [(c[i] + last * c[-1 - i]) / (1 - last * last) for i in range(len(c))]
    return True


def _fit(z: np.ndarray, p: int, q: int, with_mean: bool) -> tuple[np.ndarray, float]:
    """Least squares on the one-step errors by damped Gauss-Newton steps."""
    theta = np.r_[np.zeros(p + q), z.mean() if with_mean else 0.0]
    free = np.arange(p + q + int(with_mean))
    e = _errors(z, theta, p, q)
    sse, damp = float(e @ e), 1e-2
    for _ in range(15 if p + q else 0):
        jac = _slopes(z, theta, e, p, q, with_mean)
        gram, pull = jac.T @ jac, jac.T @ e
        size = gram.diagonal() + 1e-12
        improved = False
        while damp < 1e4:
            trial = theta.copy()
            trial[free] -= np.linalg.solve(gram + np.diag(damp * size), pull)
            if _stable(trial[:p].tolist()) and _stable((-trial[p : p + q]).tolist()):
                e_new = _errors(z, trial, p, q)
                if (new := float(e_new @ e_new)) < sse:
                    gain, improved = (sse - new) / sse, True
                    theta, e, sse, damp = trial, e_new, new, max(damp / 5, 1e-6)
                    break
            damp *= 6
        if not improved or gain < 1e-5:
            break
    return theta, sse


def best_order(y: np.ndarray, max_p: int = 3, max_q: int = 3, max_d: int = 2, stepwise: bool = True):
    """((p, d, q), parameters, AIC) of the best order of one series.

    ``stepwise`` starts from the smallest orders and moves to a neighbouring order
    as long as that lowers the AIC; otherwise the whole grid is fitted.
    """
    d = _differences_needed(y, max_d)
    z = np.diff(y, d)
    with_mean = d < 2
    tried: dict[tuple[int, int], tuple[float, np.ndarray]] = {}

    def score(p: int, q: int) -> float:
        if not (0 <= p <= max_p and 0 <= q <= max_q and p + q <= max(len(z) - 2, 0)):
            return np.inf
        if (p, q) not in tried:
            theta, sse = _fit(z, p, q, with_mean)
            tried[p, q] = (len(z) * np.log(max(sse, 1e-12) / len(z)) + 2 * (p + q + int(with_mean) + 1), theta)
        return tried[p, q][0]

    rank = lambda pq: (round(score(*pq), 9), sum(pq), pq)
    start = [(0, 0), (1, 0), (0, 1)] if stepwise else [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]
    if score(0, 0) <= len(z) * np.log(1e-12 / len(z)) + 10:  # fits exactly: nothing to search
        start, stepwise = [(0, 0)], False
    best = min(start, key=rank)
    while stepwise:
        p, q = best
        around = [(p + i, q + j) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, 1))]
        step = min([best, *around], key=rank)
        if step == best:
            break
        best = step
    aic, theta = tried[best]
    return (best[0], d, best[1]), theta, float(aic)


# --- many series at once: arrays are (time, series[, column]) --------------------------


def _delayed(x: np.ndarray, k: int) -> np.ndarray:
    """``_lag`` of every series."""
    out = np.zeros_like(x)
    out[k:] = x[: max(len(x) - k, 0)]
    return out


def _unwound(ma: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """``_unwind`` of every series; ``ma`` is (q, series)."""
    out = columns.copy()
    for t in range(1, len(out)):
        for j in range(min(len(ma), t)):
            out[t] -= ma[j, :, None] * out[t - 1 - j]
    return out


def _all_errors(z: np.ndarray, theta: np.ndarray, p: int, q: int) -> np.ndarray:
    w = z - theta[-1]
    driven = w - sum(theta[i] * _delayed(w, i + 1) for i in range(p))
    return _unwound(theta[p : p + q], driven[..., None])[..., 0]


def _all_slopes(z: np.ndarray, theta: np.ndarray, e: np.ndarray, p: int, q: int, with_mean: bool) -> np.ndarray:
    w = z - theta[-1]
    columns = [-_delayed(w, i + 1) for i in range(p)] + [-_delayed(e, j + 1) for j in range(q)]
    if with_mean:
        ones = np.ones_like(z)
        columns.append(sum(theta[i] * _delayed(ones, i + 1) for i in range(p)) - ones)
    return _unwound(theta[p : p + q], np.stack(columns, axis=2))


def _all_stable(c: np.ndarray) -> np.ndarray:
    """``_stable`` of every column of ``c``."""
    good = np.ones(c.shape[1], bool)
    with np.errstate(all="ignore"):
        while len(c):
            c, last = c[:-1], c[-1]
            good &= np.abs(last) < 0.985
            c = (c + last * c[::-1]) / (1 - last * last)
    return good


def _squares(e: np.ndarray) -> np.ndarray:
    return np.einsum("ts,ts->s", e, e)


def _fit_all(z: np.ndarray, n: np.ndarray, p: int, q: int, with_mean: bool) -> tuple[np.ndarray, np.ndarray]:
    """``_fit`` of every series: (parameters, series) and errors' squares. Each has its own damping and end.

    Series end after ``n`` values; what stands below is 0 and its errors don't count.
    """
    many, free = z.shape[1], np.arange(p + q + int(with_mean))
    live = np.arange(len(z))[:, None] < n
    theta = np.zeros((p + q + 1, many))
    if with_mean:
        theta[-1] = z.sum(axis=0) / n
    e = np.where(live, _all_errors(z, theta, p, q), 0.0)
    sse, damp, going = _squares(e), np.full(many, 1e-2), np.arange(many)
    for _ in range(15 if p + q else 0):
        jac = _all_slopes(z[:, going], theta[:, going], e[:, going], p, q, with_mean)
        jac = np.where(live[:, going, None], jac, 0.0)
        gram, pull = np.einsum("tsi,tsj->sij", jac, jac), np.einsum("tsi,ts->si", jac, e[:, going])
        size = np.diagonal(gram, axis1=1, axis2=2) + 1e-12
        gain, left = np.full(len(going), -1.0), np.arange(len(going))
        while len(left := left[damp[going[left]] < 1e4]):
            at = going[left]
            system = gram[left].copy()
            system[:, free, free] += damp[at, None] * size[left]
            trial = theta[:, at]
            trial[free] -= np.linalg.solve(system, pull[left][..., None])[..., 0].T
            good = _all_stable(trial[:p]) & _all_stable(-trial[p : p + q])
            e_new = np.where(live[:, at[good]], _all_errors(z[:, at[good]], trial[:, good], p, q), 0.0)
            new = _squares(e_new)
            less = new < sse[at[good]]
            good[good] = less
            done = at[good]
            gain[left[good]] = (sse[done] - new[less]) / sse[done]
            theta[:, done], e[:, done], sse[done] = trial[:, good], e_new[:, less], new[less]
            damp[done] = np.maximum(damp[done] / 5, 1e-6)
            damp[at[~good]] *= 6
            left = left[~good]
        going = going[gain >= 1e-5]
        if not len(going):
            break
    return theta, sse


def best_orders(series: list[np.ndarray], max_p: int = 3, max_q: int = 3, max_d: int = 2, stepwise: bool = True) -> list:
    """``best_order`` of every series; one that fails has its exception in place of a result.

    Each series walks its own way; the fits that the walks ask for next are done
    together where differences and order agree and lengths are alike.
    """
    out: list = [None] * len(series)
    alike: dict[tuple[int, int], list[list[int]]] = {}
    for i, y in enumerate(series):
        try:
            rows = -(-len(y) // _ALIKE)
            groups = alike.setdefault((rows, _differences_needed(y, max_d)), [[]])
            if len(groups[-1]) * rows * _ALIKE >= _TOGETHER:
                groups.append([])
            groups[-1].append(i)
        except Exception as error:
            out[i] = error
    for d, members in ((d, members) for (_, d), groups in alike.items() for members in groups):
        try:
            parts = [np.diff(series[i], d) for i in members]
            n = np.array([len(x) for x in parts])
            z = np.zeros((max(n), len(parts)))
            for k, x in enumerate(parts):
                z[: len(x), k] = x
            found = _best_together(z, n, d, max_p, max_q, stepwise)
        except np.linalg.LinAlgError:  # one of them can't be solved: each on its own
            found = []
            for i in members:
                try:
                    found.append(best_order(series[i], max_p, max_q, max_d, stepwise))
                except Exception as error:
                    found.append(error)
        for i, result in zip(members, found, strict=True):
            out[i] = result
    return out


def _best_together(z: np.ndarray, n: np.ndarray, d: int, max_p: int, max_q: int, stepwise: bool) -> list:
    many, with_mean = len(n), d < 2
    tried: list[dict] = [{} for _ in range(many)]
    allowed = lambda i, p, q: 0 <= p <= max_p and 0 <= q <= max_q and p + q <= max(n[i] - 2, 0)

    def fit(wanted: dict[tuple[int, int], list[int]]) -> None:
        for (p, q), at in wanted.items():
            theta, sse = _fit_all(z[:, at], n[at], p, q, with_mean)
            for k, i in enumerate(at):
                aic = n[i] * np.log(max(sse[k], 1e-12) / n[i]) + 2 * (p + q + int(with_mean) + 1)
                tried[i][p, q] = (aic, theta[:, k].copy())

    def rank(i: int, pq: tuple[int, int]):
        return round(tried[i][pq][0] if pq in tried[i] else np.inf, 9), sum(pq), pq

    fit({(0, 0): list(range(many))})
    exact = n * np.log(1e-12 / n) + 10  # fits exactly: nothing to search
    walking = [i for i in range(many) if not tried[i][0, 0][0] <= exact[i]]
    start = [(0, 0), (1, 0), (0, 1)] if stepwise else [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]
    first = {pq: [i for i in walking if allowed(i, *pq)] for pq in start if pq != (0, 0)}
    fit({pq: at for pq, at in first.items() if at})
    best = [(0, 0)] * many
    for i in walking:
        best[i] = min(start, key=lambda pq: rank(i, pq))
    while stepwise and walking:
        around = {i: [(best[i][0] + a, best[i][1] + b) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, 1))] for i in walking}
        wanted: dict[tuple[int, int], list[int]] = {}
        for i in walking:
            for pq in around[i]:
                if allowed(i, *pq) and pq not in tried[i]:
                    wanted.setdefault(pq, []).append(i)
        fit(wanted)
        moved = []
        for i in walking:
            step = min([best[i], *around[i]], key=lambda pq: rank(i, pq))
            if step != best[i]:
                best[i] = step
                moved.append(i)
        walking = moved
    return [((best[i][0], d, best[i][1]), tried[i][best[i]][1], float(tried[i][best[i]][0])) for i in range(many)]


def predict(y: np.ndarray, order: tuple[int, int, int], theta: np.ndarray, steps: int) -> np.ndarray:
    """Continue a series for a number of steps."""
    p, d, q = order
    z = np.diff(y, d)
    e = list(_errors(z, theta, p, q))
    w = list(z - theta[-1])
    for _ in range(steps):
        past = [theta[i] * w[-1 - i] for i in range(min(p, len(w)))]
        shocks = [theta[p + j] * e[-1 - j] for j in range(min(q, len(e)))]
        w.append(sum(past) + sum(shocks))
        e.append(0.0)
    ahead = np.array(w[-steps:]) + theta[-1]
    for k in range(d - 1, -1, -1):
        ahead = np.diff(y, k)[-1] + np.cumsum(ahead)
    return ahead


def _text(order: tuple[int, int, int]) -> str:
    return "({}, {}, {})".format(*order)


def order_search(
    series: DataFrame, max_p: int = 3, max_q: int = 3, max_d: int = 2, min_points: int = MIN_POINTS, stepwise: bool = True
) -> DataFrame:
    """Best (p, d, q) per entity by AIC."""

    def search(entities, periods, values):
        long = np.flatnonzero([len(y) >= min_points for y in values])
        found = [_found(r) for r in best_orders([values[i] for i in long], max_p, max_q, max_d, stepwise)]
        orders = [pa.array([r[0][k] for r in found], pa.int32()) for k in range(3)]
        aic = pa.array([r[2] for r in found], pa.float64(), from_pandas=True)
        yield pa.RecordBatch.from_arrays([entities.take(pa.array(long)), *orders, aic], ["entity", "p", "d", "q", "aic"])

    kind = series.schema["entity"].dataType.simpleString()
    return _by_entity(series_of(series), search, f"entity {kind}, p int, d int, q int, aic double")


def backtest(
    series: DataFrame, entities: DataFrame, train_end: int, test_start: int, test_end: int,
    min_points: int = MIN_POINTS,
) -> DataFrame:
    """Fit up to ``train_end``, predict as many steps as there are test values, report the MAE.

    Every entity is kept: one that can't be fitted says why.
    """

    def run(entities, periods, values):
        train = [y[p <= train_end] for p, y in zip(periods, values, strict=True)]
        test = [y[(p >= test_start) & (p <= test_end)] for p, y in zip(periods, values, strict=True)]
        usable = [i for i in range(len(values)) if len(train[i]) >= min_points and len(test[i])]
        rows = [(None, None, TOO_SHORT)] * len(values)
        for i, result in zip(usable, best_orders([train[i] for i in usable]), strict=True):
            try:
                best, theta, _ = _found(result)
                mae = float(np.abs(predict(train[i], best, theta, len(test[i])) - test[i]).mean())
                rows[i] = (_text(best), mae, "ok")
            except Exception as error:  # the report keeps the entity with the reason
                rows[i] = (None, None, str(error)[:50])
        order, mae, status = (pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string())))
        # as a frame would have it, an error that is no number is no value
        yield pa.RecordBatch.from_arrays([entities, order, pc.if_else(pc.is_nan(mae), None, mae), status], ["entity", "order", "mae", "status"])

    kind = series.schema["entity"].dataType.simpleString()
    used = series_of(series.filter(F.col("period") <= test_end))
    fitted = _by_entity(used, run, f"entity {kind}, order string, mae double, status string")
    kept = entities.select("entity").join(fitted, "entity", "left")
    return kept.select(
        "entity", "order", F.bround("mae", 1).alias("mae"), F.coalesce("status", F.lit(TOO_SHORT)).alias("status")
    )


def forecast(
    series: DataFrame, horizon: int = 3, min_points: int = MIN_POINTS, first_period: int | None = None
) -> DataFrame:
    """Forecast each entity's next periods: (entity, period, forecast, order).

    Steps follow the entity's own last period, unless ``first_period`` labels all
    of them alike.
    """

    def run(entities, periods, values):
        long = [i for i, y in enumerate(values) if len(y) >= min_points]
        starts, ahead, orders = [], [], []
        for i, result in zip(long, best_orders([values[i] for i in long]), strict=True):
            best, theta, _ = _found(result)
            starts.append(int(periods[i][-1]) + 1 if first_period is None else first_period)
            ahead.append(predict(values[i], best, theta, horizon))
            orders.append(_text(best))
        steps = np.add.outer(np.array(starts, np.int32), np.arange(horizon, dtype=np.int32)).ravel()
        order = pa.array(orders, pa.string()).take(pa.array(np.repeat(np.arange(len(long)), horizon)))
        value = np.concatenate(ahead) if ahead else np.zeros(0)
        yield pa.RecordBatch.from_arrays(
            [entities.take(pa.array(np.repeat(np.array(long, np.int64), horizon))), pa.array(steps), pa.array(value, from_pandas=True), order],
            ["entity", "period", "forecast", "order"],
        )

    kind = series.schema["entity"].dataType.simpleString()
    rows = _by_entity(series_of(series), run, f"entity {kind}, period int, forecast double, order string")
    return rows.withColumn("forecast", F.bround("forecast", 1))
