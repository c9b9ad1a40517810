"""The regime of a completed hour, and what the path after a decision does to its barriers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.numeric import ratio, zero
from tidemark.operators.series import BLOCK, HALO, drop_halo, ema, micros, numbered, row_halo, time_block

#: Barriers in average true ranges, horizons in minutes, and the directional strength a trend needs.
STOP_RANGES, TARGET_RANGES = 1.5, 2.5
HORIZONS = (15, 60, 240, 720)
LEAST_ADX = 20.0
#: A mean of span 200 fades below double precision in some 3,700 rows.
_HALO_ROWS, _BLOCK_ROWS = 3800, 4000
WEEK = 7 * 86400


def hourly_regimes(bars: DataFrame, width_seconds: int = 52 * WEEK) -> DataFrame:
    """symbol, as_of, close, ema_50, ema_200, ema_50_before, adx_14 (0 to 100), atr_14, regime of completed bars.

    ``bars`` has symbol, open_time, close_time, high, low, close and only bars that are over.  LONG needs
    close > ema_50 > ema_200, an ema_50 above that of three bars ago, and an adx of 20; SHORT is
    its mirror; else NEUTRAL, as for the first three bars.
    """
    base = numbered(
        bars.select("symbol", "open_time", F.col("close_time").alias("as_of"), *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")]),
        ["symbol"], ["open_time"], width_seconds, "open_time",
    )
    here = W.partitionBy("symbol", BLOCK).orderBy("pos")
    trail = here.rowsBetween(-13, 0)
    df = row_halo(base, before=_HALO_ROWS, rows=_BLOCK_ROWS).withColumn("__i", (F.row_number().over(here) - 1).cast("double"))
    df = df.select("*", *[F.lag(c).over(here).alias(f"__p_{c}") for c in ("high", "low", "close")])
    up, down = F.col("high") - F.col("__p_high"), F.col("__p_low") - F.col("low")
    known = F.col("__p_close").isNotNull()
    df = df.withColumns({
        "__tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__p_close")), F.abs(F.col("low") - F.col("__p_close"))),
        "__plus": F.when(known & (up > down) & (up > 0), up).otherwise(0.0), "__minus": F.when(known & (down > up) & (down > 0), down).otherwise(0.0),
        **{f"ema_{n}": ema(F.col("close"), n, here, F.col("__i"), F.col("pos") == 0) for n in (50, 200)},
    })
    plus, minus, spread = (F.sum(c).over(trail) for c in ("__plus", "__minus", "__tr"))
    df = df.withColumns({"__a": zero(ratio(plus, spread)), "__b": zero(ratio(minus, spread)), "atr_14": F.avg("__tr").over(trail), "ema_50_before": F.lag("ema_50", 3).over(here)})
    df = df.withColumn("__dx", zero(ratio(F.abs(F.col("__a") - F.col("__b")), F.col("__a") + F.col("__b"))))
    df = df.withColumn("adx_14", 100.0 * F.avg("__dx").over(trail))
    close, fast, slow, before = (F.col(c) for c in ("close", "ema_50", "ema_200", "ema_50_before"))
    strong = F.col("adx_14") >= LEAST_ADX
    regime = F.when(strong & (close > fast) & (fast > slow) & (fast > before), "LONG").when(strong & (close < fast) & (fast < slow) & (fast < before), "SHORT")
    return drop_halo(df.select("symbol", "as_of", "pos", "close", "ema_50", "ema_200", "ema_50_before", "adx_14", "atr_14", regime.alias("regime"), HALO, BLOCK)).withColumn(
        "regime", F.coalesce("regime", F.lit("NEUTRAL"))
    )


class _Extremes:
    """Least values over any run of an array, from runs of lengths 1, 2, 4 ..."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, step = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least of [begin, end); infinite where that is empty."""
        out = np.full(len(begin), np.inf)
        size = end - begin
        for level, values in enumerate(self.levels):
            here = (size >= 1 << level) & (size < 2 << level)
            out[here] = np.minimum(values[begin[here]], values[end[here] - (1 << level)])
        return out

    def first_at_most(self, begin: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The first place in [begin, end) with a value of at most ``limit``, else ``end``: steps halve from the longest run."""
        at = begin.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            step = 1 << level
            whole = at + step <= end
            free = np.zeros(len(at), bool)
            free[whole] = self.levels[level][at[whole]] > limit[whole]
            at[free] += step
        return at


_LABELS = (
    "symbol {s}, as_of timestamp_ntz, horizon int, side string, bars long, future_return double, favourable double, adverse double, "
    "touch string, touch_seconds double"
)


def _labelled(horizons: Sequence[int], now: int, group: pa.Table) -> pa.Table:
    """Labels of a block's decisions; the block's bars reach the longest horizon beyond it."""
    group = group.sort_by("at")
    bars = group.filter(pa.compute.is_null(group["price"]))
    asked = group.filter(pa.compute.is_valid(group["price"]))
    times, close, high, low = (bars[c].to_numpy() for c in ("at", "close", "high", "low"))
    t, price, atr = (asked[c].to_numpy() for c in ("at", "price", "atr"))
    short = np.array(asked["side"].to_pylist()) == "SHORT"
    sign = np.where(short, -1.0, 1.0)
    # Seen from a short side the path is turned round: its highs are the negative lows.
    worst = {False: _Extremes(low), True: _Extremes(-high)}
    best = {False: _Extremes(-high), True: _Extremes(low)}
    begin = np.searchsorted(times, t, side="right")
    out = []
    stop, target = price - sign * STOP_RANGES * atr, price + sign * TARGET_RANGES * atr
    for minutes in horizons:
        until = t + minutes * 60_000_000
        ready = np.flatnonzero(until <= now)
        b, e = begin[ready], np.searchsorted(times, until[ready], side="right")
        stopped, taken, bad, good = (np.zeros(len(ready), np.int64), np.zeros(len(ready), np.int64), np.zeros(len(ready)), np.zeros(len(ready)))
        for side in (False, True):
            mine = np.flatnonzero(short[ready] == side)
            rows = ready[mine]
            turn = -1.0 if side else 1.0
            stopped[mine] = worst[side].first_at_most(b[mine], e[mine], turn * stop[rows])
            taken[mine] = best[side].first_at_most(b[mine], e[mine], -turn * target[rows])
            seen = np.minimum(np.minimum(stopped[mine], taken[mine]) + 1, e[mine])
            bad[mine] = worst[side].least(b[mine], seen) * turn
            good[mine] = best[side].least(b[mine], seen) * -turn
        n = e - b
        some = n > 0
        touch = np.where(np.minimum(stopped, taken) >= e, "none", np.where(stopped <= taken, "stop", "target"))
        place = np.minimum(np.minimum(stopped, taken), np.maximum(len(times) - 1, 0))
        p, s = price[ready], sign[ready]
        held = lambda values, where: pa.array(values, pa.float64(), mask=~where)
        with np.errstate(invalid="ignore"):
            last = close[np.maximum(e - 1, 0)] if len(close) else np.zeros(len(ready))
            out.append(pa.table({
                "symbol": asked["symbol"].take(pa.array(ready)), "as_of": asked["as_of"].take(pa.array(ready)), "horizon": pa.array(np.full(len(ready), minutes, np.int32)),
                "side": pa.array(np.where(short[ready], "SHORT", "LONG").tolist(), pa.string()), "bars": pa.array(n.astype(np.int64)), "future_return": held(s * (last / p - 1), some),
                "favourable": held(s * (good / p - 1), some), "adverse": held(s * (bad / p - 1), some), "touch": pa.array(touch.tolist(), pa.string()),
                "touch_seconds": held((times[place] - t[ready]) / 1e6 if len(times) else np.zeros(len(ready)), touch != "none"),
            }))
    return pa.concat_tables(out)


def path_labels(decisions: DataFrame, candles: DataFrame, horizons: Sequence[int] = HORIZONS, width_seconds: int = WEEK) -> DataFrame:
    """Per decision and horizon in minutes: what the bars that close in (as_of, as_of + horizon] did.

    ``decisions`` has symbol, as_of, price, atr, side (SHORT or else LONG).  favourable and adverse are the extremes
    of the path up to and with the bar that first touches a barrier, as returns of the side; a bar
    that touches both counts as stop.  A horizon that is not over when the last candle closes gives
    no row; one without a bar has nulls and bars = 0.  Decisions without a positive price
    and range give none.  Work is by blocks of time with a halo of the longest horizon: a touch is found by halving steps,
    extremes by overlapping runs, so nothing is listed per row.
    """
    reach = max(horizons) * 60
    if reach > width_seconds:
        raise ValueError("horizon longer than the block")
    bars = candles.select("symbol", F.col("close_time").alias("as_of"), *[F.col(c).cast("double").alias(c) for c in ("close", "high", "low")]).where(
        "close IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL"
    )
    now = bars.agg(F.max(micros("as_of")).alias("t")).first()["t"]
    kind = decisions.schema["symbol"].dataType.simpleString()
    if now is None:
        return decisions.sparkSession.createDataFrame([], _LABELS.format(s=kind))
    home = time_block("as_of", width_seconds)
    # A bar belongs to its own block, and to the one before if a decision there can reach it.
    near = F.pmod(micros("as_of"), F.lit(width_seconds * 1_000_000)) <= reach * 1_000_000
    spread = bars.withColumn(BLOCK, F.explode(F.when(near, F.array(home - 1, home)).otherwise(F.array(home))))
    none = F.lit(None).cast("double")
    held = spread.select("symbol", BLOCK, "as_of", micros("as_of").alias("at"), "close", "high", "low", none.alias("price"), none.alias("atr"), F.lit(None).cast("string").alias("side"))
    asked = decisions.where("price > 0 AND atr > 0").select(
        "symbol", home.alias(BLOCK), F.col("as_of").cast("timestamp_ntz").alias("as_of"), micros("as_of").alias("at"), none.alias("close"), none.alias("high"), none.alias("low"),
        F.col("price").cast("double").alias("price"), F.col("atr").cast("double").alias("atr"), "side",
    )

    def label(group: pa.Table) -> pa.Table:
        return _labelled(horizons, now, group)

    return held.unionByName(asked).groupBy("symbol", BLOCK).applyInArrow(label, _LABELS.format(s=kind))
