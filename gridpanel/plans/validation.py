"""Cross-validation on a fold column, and reports on stored predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fit(train) -> score(test) -> test with a "prediction" column
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]

PARALLEL_FITS = 5


def in_parallel(tasks: Sequence[Callable[[], object]], workers: int = PARALLEL_FITS) -> list:
    """Submit independent Spark jobs side by side, as MLlib's own tuning does."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPool(min(workers, max(len(tasks), 1))) as pool:
        return pool.map(lambda task: task(), [inherit(task) for task in tasks])


def train_classes(df: DataFrame, folds: Sequence[int], label: str, expanding: bool) -> dict[int, set]:
    """Classes present in the training rows of each fold, from one small count table."""
    seen = [(r["fold"], r[label]) for r in df.groupBy("fold", label).count().collect()]
    uses = (lambda f, k: f < k) if expanding else (lambda f, k: f != k)
    return {k: {y for f, y in seen if uses(f, k)} for k in folds}


def out_of_fold(
    df: DataFrame, fit: Fit, folds: Sequence[int], expanding: bool = True, label: str | None = None
) -> DataFrame:
    """Predictions for every fold from a model that has not seen it.

    Expanding folds train on all earlier folds, otherwise on all others. With a
    ``label``, folds whose training rows hold one class only are skipped.
    """
    usable = list(folds)
    if label is not None:
        classes = train_classes(df, usable, label, expanding)
        usable = [k for k in usable if len(classes[k]) > 1]

    def one(k: int) -> DataFrame:
        train = df.filter(F.col("fold") < k) if expanding else df.filter(F.col("fold") != k)
        return fit(train)(df.filter(F.col("fold") == k))

    parts = in_parallel([lambda k=k: one(k) for k in usable])
    if not parts:
        return df.filter(F.lit(False)).withColumn("prediction", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, parts)


def fold_f1(predicted: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """F1 of the positive class per fold; 0 where it is undefined."""
    hit = lambda y, p: F.count(F.when((F.col(label) == y) & (F.col(pred) == p), F.lit(1)))
    counts = predicted.groupBy("fold").agg(hit(1, 1).alias("_tp"), hit(0, 1).alias("_fp"), hit(1, 0).alias("_fn"))
    f1 = F.try_divide(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn"))
    return counts.select("fold", F.coalesce(f1, F.lit(0.0)).alias("score"))


def fold_mae(predicted: DataFrame, actual: str, pred: str = "prediction") -> DataFrame:
    """Mean absolute error per fold."""
    return predicted.groupBy("fold").agg(F.avg(F.abs(F.col(actual) - F.col(pred))).alias("score"))


def report(predicted: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class with their macro and weighted means.

    Undefined ratios are 0.
    """
    covered = predicted.filter(F.col(pred).isNotNull() & F.col(label).isNotNull())
    cells = covered.groupBy(F.col(label).cast("int").alias("_y"), F.col(pred).cast("int").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    sums = []
    for k in (0, 1):
        sums.append(total((F.col("_y") == k) & (F.col("_p") == k)).alias(f"_tp{k}"))
        sums.append(total(F.col("_p") == k).alias(f"_said{k}"))
        sums.append(total(F.col("_y") == k).alias(f"_is{k}"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    one = cells.agg(*sums)
    rows = []
    for k in (0, 1):
        tp, said, real = F.col(f"_tp{k}"), F.col(f"_said{k}"), F.col(f"_is{k}")
        rows.append((str(k), share(tp, said), share(tp, real), share(2 * tp, said + real), real))
    support = F.col("_is0") + F.col("_is1")
    weight = [share(F.col("_is0"), support), share(F.col("_is1"), support)]
    accuracy = share(F.col("_tp0") + F.col("_tp1"), support)
    rows.append(("accuracy", accuracy, accuracy, accuracy, support))
    rows.append(("macro avg", *[(rows[0][i] + rows[1][i]) / 2 for i in (1, 2, 3)], support))
    rows.append(("weighted avg", *[rows[0][i] * weight[0] + rows[1][i] * weight[1] for i in (1, 2, 3)], support))
    names = ("class", "precision", "recall", "f1", "support")
    table = F.array(*[
        F.struct(F.lit(r[0]).alias(names[0]), *[c.alias(n) for c, n in zip(r[1:], names[1:])]) for r in rows
    ])
    return one.select(F.inline(table))
