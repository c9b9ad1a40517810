"""Bars: ticks or finer candles rolled up to a coarser step."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.series import micros


def floor_time(time: Column | str, seconds: int) -> Column:
    """Epoch-aligned floor of a timestamp, returned without a zone."""
    step = seconds * 1_000_000
    return F.timestamp_micros(F.floor(micros(time) / step).cast("long") * step).cast("timestamp_ntz")


def _arrival(time: str, tie: str) -> Column:
    """(time, tie) as one decimal: unlike a struct it stays in the hash aggregate."""
    base = micros(time).cast("decimal(18,0)") * F.lit(Decimal(10) ** 19)
    return (base + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")


def resample_ticks(
    ticks: DataFrame,
    seconds: int,
    keys: Sequence[str] = ("symbol",),
    time: str = "ts",
    price: str = "price",
    quantity: str = "quantity",
    tie: str | None = None,
) -> DataFrame:
    """OHLCV bars of raw ticks; partial aggregates run before the shuffle."""
    order = _arrival(time, tie) if tie else F.col(time)
    return (
        ticks.groupBy(*keys, floor_time(time, seconds).alias("open_time"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum(quantity).alias("volume"),
            F.count(F.lit(1)).alias("trades"),
        )
        .withColumn("close_time", F.col("open_time") + F.expr(f"interval '{seconds - 0.001:.3f}' second"))
    )


def resample_candles(
    candles: DataFrame,
    seconds: int,
    base_seconds: int = 60,
    keys: Sequence[str] = ("symbol",),
    complete_only: bool = False,
) -> DataFrame:
    """Coarser bars from candles; ``complete_only`` keeps full buckets of closed bars."""
    out = candles.groupBy(*keys, floor_time("open_time", seconds).alias("bucket")).agg(
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        F.sum("volume").alias("volume"),
        F.bool_and("is_closed").alias("is_closed"),
        F.count(F.lit(1)).alias("bars"),
    )
    if complete_only:
        out = out.where((F.col("bars") == seconds // base_seconds) & F.col("is_closed"))
    return out.withColumnRenamed("bucket", "open_time")
