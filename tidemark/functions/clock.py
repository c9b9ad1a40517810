"""Calendar and clock expressions (all times UTC)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tidemark.functions.numeric import clamp
from tidemark.operators.series import micros


def _cyclic(value: Column, period: float, fn) -> Column:
    return fn(value / period * F.lit(2.0 * math.pi))


def clock_features(time: str, whole_hours: bool = False) -> dict[str, Column]:
    """Cyclic hour/day values, weekend flag and trading sessions.

    The sessions compare the fractional hour, or the whole hour of the live
    variant; both give the same flags at whole-hour session bounds.
    """
    t = F.col(time)
    hour = F.hour(t) + F.minute(t) / 60.0
    day = F.weekday(t).cast("double")
    clock = F.hour(t).cast("double") if whole_hours else hour

    def session(start: int, end: int) -> Column:
        return ((clock >= start) & (clock < end)).cast("double")

    return {
        "time_hour_utc_sin": _cyclic(hour, 24.0, F.sin),
        "time_hour_utc_cos": _cyclic(hour, 24.0, F.cos),
        "time_day_of_week_sin": _cyclic(day, 7.0, F.sin),
        "time_day_of_week_cos": _cyclic(day, 7.0, F.cos),
        "time_is_weekend": (day >= 5).cast("double"),
        "session_asia": session(0, 8),
        "session_london": session(7, 16),
        "session_new_york": session(13, 22),
    }


def age_hours(time: Column, now: Column) -> Column:
    # greatest() skips nulls, and an unknown time must stay unknown.
    return F.when(time.isNotNull(), F.greatest((micros(now) - micros(time)) / 3.6e9, F.lit(0.0)))


def recency_weight(time: Column, now: Column, horizon_hours: float = 48.0, floor: float = 0.0) -> Column:
    """Linear fade to ``floor`` over the horizon; unknown times weigh a quarter."""
    return F.coalesce(clamp(1.0 - age_hours(time, now) / horizon_hours, floor, 1.0), F.lit(0.25))


def interval_seconds(text: Column) -> Column:
    """Seconds of texts such as ``15m``, ``1h``, ``7d``, ``2w``; null if malformed."""
    amount = F.regexp_extract(text, r"^\s*(\d+)\s*([smhdwSMHDW])\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*(\d+)\s*([smhdwSMHDW])\s*$", 2))
    scale = (
        F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
        .when(unit == "w", 604800)
    )
    return amount.try_cast("long") * scale
