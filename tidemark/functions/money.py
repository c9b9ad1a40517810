"""Exact money: decimals from the first cast to the last sum.

An amount has 8 digits behind the point and 12 before it, a rate 10 and 4; their product fits into a decimal
without a loss.  What is rounded is rounded half away from zero at a stated digit; quantities
are rounded down.  NaN, infinities and values that do not fit are null.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

MONEY = "decimal(20,8)"
RATE = "decimal(14,10)"
TOTAL = "decimal(30,8)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def amount(value: Column | str) -> Column:
    return _col(value).try_cast(MONEY)


def rate(value: Column | str) -> Column:
    return _col(value).try_cast(RATE)


def nil(value: Column, kind: str = MONEY) -> Column:
    """Zero for null, without leaving the decimals."""
    return F.coalesce(value, F.lit(Decimal(0)).cast(kind))


def times(value: Column, factor: Column) -> Column:
    """An amount times a rate, as an amount again."""
    return (value * factor).try_cast(MONEY)


def cents(value: Column | str) -> Column:
    """Rounded half away from zero to two digits."""
    return _col(value).cast("decimal(30,2)")


def round_down(quantity: Column | str, step: Column | str) -> Column:
    """The largest multiple of ``step`` that is not above a quantity of zero or more; null for other steps and quantities."""
    q, s = amount(quantity), amount(step)
    return F.when((q >= 0) & (s > 0), (q - q % s).try_cast(MONEY))


def fill_price(price: Column | str, side: Column | str, slippage: Column | str) -> Column:
    """What a BUY pays more and a SELL gets less."""
    p, s = amount(price), rate(slippage)
    up = F.upper(_col(side))
    return F.when(up == "BUY", p + times(p, s)).when(up == "SELL", p - times(p, s)).try_cast(MONEY)


def gross_pnl(side: Column | str, entry: Column | str, exit_price: Column | str, quantity: Column | str) -> Column:
    """The price's way in the position's favour times the quantity; quantities have 10 digits behind the point and 4 before it."""
    way = amount(exit_price) - amount(entry)
    favour = F.when(F.upper(_col(side)) == "SHORT", -way).otherwise(way)
    return times(favour.cast(MONEY), rate(quantity))
