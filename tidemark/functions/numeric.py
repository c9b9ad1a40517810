"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number_or(value: Column | str, default: float = 0.0) -> Column:
    """Double value of a string column; blank or unparsable gives the default."""
    return F.coalesce(_col(value).try_cast("double"), F.lit(float(default)))


def clamp(value: Column | str, low: float = -1.0, high: float = 1.0) -> Column:
    value = _col(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, null when the divisor is zero or null."""
    return F.when(bottom != 0, top / bottom)


def change(now: Column, before: Column) -> Column:
    return ratio(now, before) - 1.0


def finite(value: Column | str) -> Column:
    """The value, or null when it is NaN or infinite."""
    value = _col(value).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def sigmoid(value: Column, bound: float = 20.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamp(value, -bound, bound)))


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation in [-1, 1], null with under two pairs or no variance.

    The built-in one divides by zero variance, which is an error in ANSI mode.
    """
    x, y = _col(x), _col(y)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    n = F.count(a)
    return F.when((n >= 2) & (sa > 0) & (sb > 0), clamp(F.covar_pop(a, b) / F.when((sa > 0) & (sb > 0), sa * sb)))
