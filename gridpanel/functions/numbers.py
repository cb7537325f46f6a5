"""Numeric coercion, ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridpanel.functions.text import strip_text


# a cast alone would also take the suffixes and hexadecimal forms of program literals
_NUMERIC = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"


def to_number(c: Column) -> Column:
    """Text to double; junk and the text ``nan`` become NULL."""
    text = strip_text(c.cast("string"))
    return F.when(text.rlike(_NUMERIC), text.try_cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL, not an error, for a zero denominator."""
    return F.try_divide(numerator, denominator)


def rate_label(rate: Column, threshold: float) -> Column:
    """1 where the rate reaches the threshold, else 0."""
    return (rate >= threshold).cast("int")


def pct_change(current: Column, base: Column) -> Column:
    return F.try_divide(current - base, base) * 100


def round_report(c: Column, digits: int) -> Column:
    """Half-even rounding for report columns."""
    return F.bround(c, digits)
