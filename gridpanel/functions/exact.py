"""Sums of doubles that don't depend on the order of the rows.

A double is split into its whole part and its fraction in units of 2^-62. Both are
integers, which decimals add without error, so partial sums may be merged in any order and
only the final value is rounded. That is the exact sum for values below 2^53 in size whose
fraction is a multiple of 2^-62 (any value of at least 2^-9, for instance); other values
are rounded once each, by less than 2^-62, alike in any order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = float(1 << 62)
LIMIT = float(1 << 63)  # larger values are added as they are
_TOTAL = "decimal(38,0)"


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < LIMIT, value)


def parts(value: Column) -> tuple[Column, Column]:
    """(whole, fraction): integers whose sums, by ``whole + fraction / 2^62``, give the sum."""
    kept = _finite(value.cast("double"))
    whole = kept.cast("bigint")
    fraction = (kept - whole.cast("double")) * UNIT
    return whole.cast(_TOTAL), fraction.cast("bigint").cast(_TOTAL)


def joined(whole: Column, fraction: Column) -> Column:
    """The double nearest to two summed parts."""
    return whole.cast("double") + fraction.cast("double") / UNIT


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of the non-null values, NULL if there are none.

    Values that aren't finite, or are too large to split, decide as in a plain sum.
    """
    whole, fraction = parts(value)
    rest = F.sum(F.when(~(F.abs(value) < LIMIT), value))
    exact = joined(F.sum(whole), F.sum(fraction))
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def exact_mean(value: Column) -> Column:
    """Aggregate: the mean of the non-null values, NULL if there are none."""
    return F.try_divide(exact_sum(value), F.count(value))
