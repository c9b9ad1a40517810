"""Forward-looking labels, by time offset and by row offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.numeric import change, clamp, finite, zero
from tidemark.operators.asof import asof_join
from tidemark.operators.series import BLOCK, drop_halo, micros, numbered, row_halo, time_halo

WEEK = 7 * 86400
HORIZON_MINUTES = {"5m": 5, "15m": 15, "1h": 60, "4h": 240}


def future_returns_by_time(
    rows: DataFrame, candles: DataFrame, width_seconds: int = WEEK, minutes: dict[str, int] | None = None
) -> DataFrame:
    """Return from the candle at each row to the first candle at or after t + h.

    All horizons go through one forward as-of pass; rows are unique per
    (symbol, as_of) and already carry the current ``close``.
    """
    minutes = minutes or HORIZON_MINUTES
    ends = rows.select(
        "symbol",
        "as_of",
        "close",
        F.explode(F.array(*[F.struct(F.lit(n).alias("h"), F.lit(m).alias("m")) for n, m in minutes.items()])).alias("e"),
    ).select(
        "symbol", "as_of", "close", F.col("e.h").alias("h"),
        (F.col("as_of") + F.make_dt_interval(mins=F.col("e.m"))).alias("due"),
    )
    hit = asof_join(
        ends, candles, ["symbol"], "due", "as_of", {"future_close": "close"}, direction="forward",
        width_seconds=width_seconds,
    )
    value = F.when(F.col("close") != 0, change(F.col("future_close"), F.col("close")))
    return hit.groupBy("symbol", "as_of").agg(
        *[F.max(F.when(F.col("h") == n, value)).alias(f"target_future_return_{n}") for n in minutes]
    )


def barriers_by_time(
    candles: DataFrame, seconds: int = 3600, stop: float = -0.005, take: float = 0.01, width_seconds: int = WEEK
) -> DataFrame:
    """Best and worst price in (t, t + seconds] and which barrier is hit first.

    On one bar that crosses both, the stop counts.  The frame holds at most one
    candle per step, so the per-row list is bounded by seconds / step.
    """
    spread = time_halo(
        candles.select("symbol", "as_of", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")]),
        "as_of", width_seconds, after_seconds=seconds,
    ).withColumn("__us", micros("as_of"))
    frame = W.partitionBy("symbol", BLOCK).orderBy("__us").rangeBetween(1, seconds * 1_000_000)
    df = spread.select(
        "*",
        F.max("high").over(frame).alias("__hi"),
        F.min("low").over(frame).alias("__lo"),
        F.collect_list(F.struct("low", "high")).over(frame).alias("__bars"),
    )
    price = F.when(F.col("close") != 0, F.col("close"))
    stops = F.transform("__bars", lambda b: b["low"] / price - 1.0 <= stop)
    takes = F.transform("__bars", lambda b: b["high"] / price - 1.0 >= take)
    df = df.withColumn("__s", F.array_position(stops, True)).withColumn("__k", F.array_position(takes, True))
    usable = (F.col("close") != 0) & F.col("__hi").isNotNull()
    stop_first = (F.col("__s") > 0) & ((F.col("__k") == 0) | (F.col("__s") <= F.col("__k")))
    take_first = (F.col("__k") > 0) & ((F.col("__s") == 0) | (F.col("__k") < F.col("__s")))
    return drop_halo(
        df.select(
            "symbol", "as_of", BLOCK, "__halo",
            F.when(usable, change(F.col("__hi"), F.col("close"))).alias("target_max_upside_1h"),
            F.when(usable, change(F.col("__lo"), F.col("close"))).alias("target_max_drawdown_1h"),
            F.when(usable, stop_first.cast("double")).alias("target_stop_loss_hit_first"),
            F.when(usable, take_first.cast("double")).alias("target_take_profit_hit_first"),
        )
    )


def simple_quality(ret_15m: Column, fee_rate: float) -> dict[str, Column]:
    """Direction sign and return after a round trip of fees."""
    return {
        "target_direction_15m": F.signum(ret_15m),
        "target_trade_quality_score": ret_15m - 2.0 * fee_rate,
    }


def labels_by_time(candles: DataFrame, fee_rate: float = 0.0004, width_seconds: int = WEEK) -> DataFrame:
    """All time-offset labels of every candle (the offline variant)."""
    returns = future_returns_by_time(candles.select("symbol", "as_of", "close"), candles, width_seconds)
    out = returns.join(barriers_by_time(candles, width_seconds=width_seconds), ["symbol", "as_of"])
    quality = simple_quality(F.col("target_future_return_15m"), fee_rate)
    return out.select("*", *[expr.alias(name) for name, expr in quality.items()])


def graded_quality(
    ret_15m: Column, upside: Column, drawdown: Column, took: Column, stopped: Column,
    edge: float, take: float, stop: float,
) -> Column:
    """Weighted quality in [-1, 1] of return, reach, risk and the exit that came first."""
    return clamp(
        ret_15m / max(edge * 4.0, 1e-9) * 0.45
        + upside / max(take, 1e-9) * 0.25
        + drawdown / max(stop, 1e-9) * 0.25
        + F.when(took, 0.15).otherwise(0.0)
        - F.when(stopped, 0.20).otherwise(0.0)
    )


def labels_by_row(
    candles: DataFrame,
    step_minutes: int = 1,
    stop: float = 0.01,
    take: float = 0.02,
    fee_rate: float = 0.0004,
    min_edge: float = 0.001,
    width_seconds: int = WEEK,
    need_longest: bool = True,
) -> DataFrame:
    """Labels at row offsets (the online variant): a bar that crosses both barriers counts as a take.

    With ``need_longest`` only rows with the full four hours ahead are labelled;
    otherwise a missing future return is zero.
    """
    offsets = {n: max(1, m // step_minutes) for n, m in HORIZON_MINUTES.items()}
    longest, hour = offsets["4h"], offsets["1h"]
    base = numbered(
        candles.select("symbol", "open_time", "as_of", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")]),
        ["symbol"], ["open_time"], width_seconds, "open_time",
    )
    df = row_halo(base, after=longest, rows=8192)
    ordered = W.partitionBy("symbol", BLOCK).orderBy("pos")
    ahead = ordered.rowsBetween(1, hour)
    df = df.select(
        "*",
        *[F.lead("close", k).over(ordered).alias(f"__f_{n}") for n, k in offsets.items()],
        F.coalesce(F.max("high").over(ahead), F.col("close")).alias("__hi"),
        F.coalesce(F.min("low").over(ahead), F.col("close")).alias("__lo"),
        F.collect_list("low").over(ahead).alias("__lows"),
        F.collect_list("high").over(ahead).alias("__highs"),
    )
    close = F.col("close")
    df = df.withColumn(
        "__s", F.array_position(F.transform("__lows", lambda v: v <= close * (1.0 - stop)), True)
    ).withColumn("__k", F.array_position(F.transform("__highs", lambda v: v >= close * (1.0 + take)), True))
    took = (F.col("__k") > 0) & ((F.col("__s") == 0) | (F.col("__k") <= F.col("__s")))
    stopped = (F.col("__s") > 0) & ~took
    edge = 2.0 * fee_rate + min_edge
    rets = {n: zero(change(F.col(f"__f_{n}"), close)) for n in offsets}
    df = df.select(
        "symbol", "as_of", "pos", BLOCK, "__halo", "close", F.col("__f_4h"),
        *[expr.alias(f"target_future_return_{n}") for n, expr in rets.items()],
        zero(change(F.col("__hi"), close)).alias("target_max_upside_1h"),
        zero(change(F.col("__lo"), close)).alias("target_max_drawdown_1h"),
        stopped.cast("double").alias("target_stop_loss_hit_first"),
        took.cast("double").alias("target_take_profit_hit_first"),
    )
    r15 = F.col("target_future_return_15m")
    df = df.withColumn(
        "target_direction_15m", F.when(r15 > edge, 1.0).when(r15 < -edge, -1.0).otherwise(0.0)
    ).withColumn(
        "target_trade_quality_score",
        graded_quality(
            r15, F.col("target_max_upside_1h"), F.col("target_max_drawdown_1h"),
            F.col("target_take_profit_hit_first") == 1.0, F.col("target_stop_loss_hit_first") == 1.0, edge, take, stop,
        ),
    )
    if need_longest:
        df = df.where(F.col("__f_4h").isNotNull() & (F.col("close") != 0))
    return drop_halo(df).drop("close", "__f_4h")


def next_row_target(rows: DataFrame, value: str, width_seconds: int = WEEK) -> DataFrame:
    """The next row's value of the same symbol, null on the last row."""
    base = numbered(rows, ["symbol"], ["as_of"], width_seconds, "as_of")
    df = row_halo(base, after=1, rows=8192)
    nxt = F.lead(value).over(W.partitionBy("symbol", BLOCK).orderBy("pos"))
    return drop_halo(df.withColumn("target_next", nxt)).drop("pos")


def replay_rewards(
    rows: DataFrame, ret: Column, drawdown: Column, carry: list[str], fee_rate: float = 0.0004
) -> DataFrame:
    """What BUY and HOLD would have earned on each labelled row."""
    buy = ret - 2.0 * fee_rate + F.least(drawdown, F.lit(0.0)) * 0.25
    cells = F.array(
        F.struct(F.lit("BUY").alias("action"), buy.alias("reward")), F.struct(F.lit("HOLD").alias("action"), (-F.abs(ret) * 0.15).alias("reward"))
    )
    return rows.select(*carry, F.explode(cells).alias("c")).select(*carry, "c.*")


def label_inventory(
    rows: DataFrame, keys: list[str], label: str, decision: str, label_time: str | None, horizon_seconds: int, as_of: Column
) -> DataFrame:
    """Counts of finite, available, pending and unusable labels as of a time.

    Without an explicit label time a label is known one horizon after the decision.
    """
    value = finite(F.col(label))
    known = (F.col(label_time) if label_time else F.lit(None).cast("timestamp_ntz"))
    known = F.coalesce(known, F.col(decision) + F.make_dt_interval(secs=F.lit(horizon_seconds).cast("decimal(18,6)")))
    ready = value.isNotNull() & (known <= as_of)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count(value).alias("finite_label_rows"), F.count(F.when(ready, 1)).alias("available_labeled_rows"),
        F.count(F.when(value.isNotNull() & (known > as_of), 1)).alias("pending_label_rows"), F.count(F.when(value.isNull(), 1)).alias("missing_or_invalid_label_rows"),
        F.max(F.when(ready, known)).alias("newest_available_label_time"),
    )
