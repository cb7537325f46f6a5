"""Bounded labelled samples for fitting the text classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null ids have none."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def sample(
    docs: DataFrame, labels: DataFrame, target: str, learn: Callable[[], Column], per_class: int, max_bytes: int
) -> tuple[list[bytes], np.ndarray, float]:
    """(texts, labels, share of label 1 among all labelled documents that may be learnt from).

    At most ``per_class`` documents of each label, chosen by a hash of their id, each of
    at most ``max_bytes`` bytes (longer ones aren't learnt from; they are scored whole).
    A document labelled both ways isn't used. These bounds hold whatever the corpus.
    """
    known = (
        labels.where(learn() & F.col(target).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(target).alias("y"), F.max(target).alias("y1"))
        .where("y = y1")
    )
    share = known.agg(F.avg("y")).first()[0]
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class) for y in (0, 1)]
    wanted = drawn[0].union(drawn[1]).select(F.col("doc_id").alias("_id"), "y")
    fits = F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes
    found = docs.select("doc_id", "text").where(fits).join(F.broadcast(wanted), F.col("doc_id") == F.col("_id"))  # 4 x per_class rows
    rows = found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    texts: list[bytes] = []
    classes: list[int] = []
    for y in (0, 1):
        own = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
        texts += [(r["text"] or "").encode() for r in own]
        classes += [y] * len(own)
    return texts, np.array(classes, np.float32), 0.5 if share is None else float(share)


def prior_shift(classes: np.ndarray, share: float) -> float:
    """What to add to a logit fitted on the sample so that it speaks for the corpus."""
    held = float(np.clip(classes.mean(), 0.01, 0.99)) if len(classes) else 0.5
    share = float(np.clip(share, 0.001, 0.999))
    return float(np.log(share / (1 - share)) - np.log(held / (1 - held)))
