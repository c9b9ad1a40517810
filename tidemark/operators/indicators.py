"""Technical indicators over candle series.

Every indicator is a bounded row frame or an exponential mean, so one shuffle by
(symbol, position block) with a halo serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.numeric import change, clamp, ratio, zero
from tidemark.operators.series import BLOCK, HALO, drop_halo, ema, numbered, row_halo

WEEK = 7 * 86400
# An exponential mean of span 26 fades below double precision in about 510 rows;
# 190 more let the span-9 mean over it forget what lies before the halo.  Block
# plus halo stay below the index where the span-9 scaling leaves double range.
HALO_ROWS = 760
BLOCK_ROWS = 2000
HALO_AND_BLOCK = (HALO, BLOCK)

OFFLINE_COLUMNS = [
    "last_close", "candle_return_1m", "candle_return_5m", "volume_change", "volatility", "trend_score", "rsi_14",
    "macd_pct", "macd_signal_pct", "macd_histogram_pct", "sma_20_distance_pct", "ema_20_distance_pct",
    "bollinger_width_pct", "bollinger_position", "atr_14_pct", "vwap_20_distance_pct", "adx_14",
]


def _series(candles: DataFrame, halo: int, width_seconds: int) -> DataFrame:
    base = numbered(
        candles.select(
            "symbol", "open_time", "close_time", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")]
        ),
        ["symbol"],
        ["open_time"],
        width_seconds,
        "open_time",
    )
    return row_halo(base, before=halo, rows=BLOCK_ROWS).withColumn(
        "as_of", F.coalesce("close_time", "open_time")
    )


def _ordered():
    return W.partitionBy("symbol", BLOCK).orderBy("pos")


def _trail(rows: int):
    return _ordered().rowsBetween(-(rows - 1), 0)


def _moves(df: DataFrame) -> DataFrame:
    """Previous values, true range and directional moves of each candle."""
    prev = {c: F.lag(c).over(_ordered()) for c in ("close", "high", "low")}
    up, down = F.col("high") - F.col("p_high"), F.col("p_low") - F.col("low")
    delta = F.col("close") - F.col("p_close")
    return (
        df.select("*", *[expr.alias(f"p_{c}") for c, expr in prev.items()])
        .withColumn(
            "tr",
            F.greatest(
                F.col("high") - F.col("low"),
                F.abs(F.col("high") - F.col("p_close")),
                F.abs(F.col("low") - F.col("p_close")),
            ),
        )
        .withColumn("gain", F.greatest(delta, F.lit(0.0)))
        .withColumn("loss", F.greatest(-delta, F.lit(0.0)))
        .withColumn("plus_dm", F.when((up > down) & (up > 0), up).otherwise(0.0))
        .withColumn("minus_dm", F.when((down > up) & (down > 0), down).otherwise(0.0))
        .withColumn("ret", change(F.col("close"), F.col("p_close")))
        .withColumn("ret0", F.when(F.col("p_close").isNotNull(), zero(F.col("ret"))))
        .withColumn("idx", F.row_number().over(_ordered()) - 1)
    )


def _fix_gain(df: DataFrame) -> DataFrame:
    # greatest() skips nulls, so the first candle needs its unknown move restored.
    known = F.col("p_close").isNotNull()
    return df.withColumn("gain", F.when(known, F.col("gain"))).withColumn("loss", F.when(known, F.col("loss")))


def _emas(df: DataFrame) -> DataFrame:
    idx, seed = F.col("idx").cast("double"), F.col("pos") == 0
    means = {f"ema_{n}": ema(F.col("close"), n, _ordered(), idx, seed) for n in (12, 20, 26)}
    df = df.select("*", *[expr.alias(name) for name, expr in means.items()])
    df = df.withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    return df.withColumn("macd_signal", ema(F.col("macd"), 9, _ordered(), idx, seed))


def _bands(df: DataFrame) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    volume = F.greatest(F.col("volume"), F.lit(0.0))
    return df.select(
        "*",
        F.avg("close").over(_trail(20)).alias("sma_20"),
        F.coalesce(F.stddev_pop("close").over(_trail(20)), F.lit(0.0)).alias("std_20"),
        ratio(F.sum(typical * volume).over(_trail(20)), F.sum(volume).over(_trail(20))).alias("vwap_20"),
        F.avg("tr").over(_trail(14)).alias("atr_14"),
        F.avg("gain").over(_trail(14)).alias("avg_gain"),
        F.avg("loss").over(_trail(14)).alias("avg_loss"),
    )


def _band_outputs() -> dict[str, Column]:
    close, sma, std = F.col("close"), F.col("sma_20"), F.col("std_20")
    spread = std * 4.0
    return {
        "sma_20_distance_pct": zero(change(close, sma)),
        "bollinger_width_pct": zero(ratio(spread, sma)),
        "bollinger_position": clamp(F.coalesce(ratio(close - (sma - std * 2.0), spread), F.lit(0.5)), 0.0, 1.0),
        "atr_14_pct": zero(ratio(F.col("atr_14"), close)),
        "vwap_20_distance_pct": zero(change(close, F.col("vwap_20"))),
    }


def _ema_outputs() -> dict[str, Column]:
    close = F.col("close")
    return {
        "macd_pct": zero(ratio(F.col("macd"), close)),
        "macd_signal_pct": zero(ratio(F.col("macd_signal"), close)),
        "macd_histogram_pct": zero(ratio(F.col("macd") - F.col("macd_signal"), close)),
        "ema_20_distance_pct": zero(change(close, F.col("ema_20"))),
    }


def _relative_strength(when_no_loss: Column) -> Column:
    gain, loss = F.col("avg_gain"), F.col("avg_loss")
    return clamp(
        F.when(loss > 0, 1.0 - 1.0 / (1.0 + gain / loss)).otherwise(when_no_loss), 0.0, 1.0
    )


def offline_features(candles: DataFrame, width_seconds: int = WEEK) -> DataFrame:
    """Indicators with the whole series as history (the training variant)."""
    df = _bands(_emas(_fix_gain(_moves(_series(candles, HALO_ROWS, width_seconds)))))
    tr_sum = F.sum("tr").over(_trail(14))
    plus = ratio(100.0 * F.sum("plus_dm").over(_trail(14)), tr_sum)
    minus = ratio(100.0 * F.sum("minus_dm").over(_trail(14)), tr_sum)
    df = df.withColumn("plus_di", plus).withColumn("minus_di", minus)
    df = df.withColumn(
        "dx", zero(ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    )
    close = F.col("close")
    earlier = F.coalesce(F.lag("close", 20).over(_ordered()), F.first("close").over(_ordered()))
    outputs = {
        "last_close": close,
        "candle_return_1m": zero(F.col("ret")),
        "candle_return_5m": zero(change(close, F.lag("close", 5).over(_ordered()))),
        "volume_change": zero(change(F.col("volume"), F.lag("volume", 5).over(_ordered()))),
        "volatility": zero(F.stddev_samp("ret").over(_trail(20))),
        "trend_score": F.tanh(zero(change(close, earlier)) * 50.0),
        "rsi_14": _relative_strength(F.lit(0.5)),
        **_ema_outputs(),
        **_band_outputs(),
        "adx_14": clamp(F.avg("dx").over(_trail(14)), 0.0, 1.0),
    }
    return drop_halo(
        df.select("symbol", "as_of", "pos", *HALO_AND_BLOCK,
                  *[outputs[name].alias(name) for name in OFFLINE_COLUMNS])
    )


def warmed_up(features: DataFrame, rows: int = 5) -> DataFrame:
    """Drop each symbol's first rows, whose lags are not filled yet."""
    return features.where(F.col("pos") >= rows)


def live_features(candles: DataFrame, lookback: int = 60, width_seconds: int = WEEK) -> DataFrame:
    """Indicators as seen from a window of ``lookback`` candles (the live variant).

    An exponential mean started inside the window equals the full-history mean
    plus a faded correction at the window's first candle, so no per-row fold over
    the window is needed.
    """
    df = _bands(_emas(_fix_gain(_moves(_series(candles, HALO_ROWS + lookback, width_seconds)))))
    back = lookback - 1
    full = F.col("pos") >= back

    def keep(span: int) -> float:
        return 1.0 - 2.0 / (span + 1.0)

    for n in (12, 20, 26):
        df = df.withColumn(f"d_{n}", F.lag(F.col("close") - F.col(f"ema_{n}"), back).over(_ordered()))
    df = df.withColumn("sig_then", F.lag("macd_signal", back).over(_ordered()))

    def shifted(span: int) -> Column:
        return F.col(f"d_{span}") * (keep(span) ** back)

    def into_signal(span: int) -> Column:
        q, s = keep(span), keep(9)
        return F.col(f"d_{span}") * ((1.0 - s) * q * (q ** back - s ** back) / (q - s))

    for n in (12, 20, 26):
        df = df.withColumn(f"live_{n}", F.when(full, F.col(f"ema_{n}") + shifted(n)).otherwise(F.col(f"ema_{n}")))
    df = df.withColumn(
        "live_signal",
        F.when(
            full,
            F.col("macd_signal") - F.col("sig_then") * (keep(9) ** back) + into_signal(12) - into_signal(26),
        ).otherwise(F.col("macd_signal")),
    )
    tr_sum = F.sum("tr").over(_trail(14))
    df = (
        df.withColumn("tr_sum", tr_sum)
        .withColumn("plus_di", ratio(100.0 * F.sum("plus_dm").over(_trail(13)), F.col("tr_sum")))
        .withColumn("minus_di", ratio(100.0 * F.sum("minus_dm").over(_trail(13)), F.col("tr_sum")))
    )
    total = F.col("plus_di") + F.col("minus_di")
    df = df.withColumn(
        "dx",
        F.when(
            (F.col("pos") >= 14) & (F.col("tr_sum") > 0) & (total > 0),
            F.abs(F.col("plus_di") - F.col("minus_di")) / total,
        ),
    )
    recent_dx = F.collect_list("dx").over(_trail(15))
    df = df.withColumn("dxs", F.slice(recent_dx, F.greatest(F.size(recent_dx) - 13, F.lit(1)), F.lit(14)))
    n = F.least(F.col("pos") + 1, F.lit(lookback))
    half = F.floor(n / 2)
    full_half = lookback // 2
    volume_frame = F.collect_list("volume").over(_ordered().rowsBetween(-back, 0))
    late_rows = lookback - full_half
    early = F.avg("volume").over(_ordered().rowsBetween(-back, -late_rows))
    late = F.avg("volume").over(_ordered().rowsBetween(-late_rows + 1, 0))
    short = F.when(~full, volume_frame)
    df = df.withColumn("n", n).withColumn("half", half).withColumn("vols", short)
    mean_of = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)
    early_short = mean_of(F.slice("vols", F.lit(1), F.col("half").cast("int")))
    late_short = mean_of(
        F.slice("vols", (F.col("half") + 1).cast("int"), (F.col("n") - F.col("half")).cast("int"))
    )
    first_close = F.first("close").over(_ordered().rowsBetween(-back, 0))
    rets_frame = _ordered().rowsBetween(-(back - 1), 0)
    df = (
        df.withColumn("price_change", F.when(F.col("pos") > 0, zero(change(F.col("close"), first_close))).otherwise(0.0))
        .withColumn("volatility", F.when(F.col("pos") >= 2, F.stddev_pop("ret0").over(rets_frame)).otherwise(0.0))
        .withColumn("early", early)
        .withColumn("late", late)
    )
    close = F.col("close")
    macd = F.col("live_12") - F.col("live_26")
    ret5 = F.when(
        F.col("pos") >= 5, zero(change(close, F.lag("close", 5).over(_ordered())))
    ).otherwise(F.col("price_change"))
    df = df.withColumn("candle_return_5m", ret5)
    edge = F.greatest(F.col("volatility") * 0.5, F.lit(0.001))
    dxs = F.col("dxs")
    outputs = {
        "last_close": close,
        "price_change": F.col("price_change"),
        "candle_return_1m": zero(F.col("ret")),
        "candle_return_5m": F.col("candle_return_5m"),
        "volatility": F.col("volatility"),
        "volume_change": F.when(F.col("n") < 4, 0.0).otherwise(
            zero(F.when(full, change(F.col("late"), F.col("early"))).otherwise(change(late_short, early_short)))
        ),
        "trend": F.when(F.col("price_change") > edge, "up").when(F.col("price_change") < -edge, "down").otherwise("sideways"),
        "trend_score": clamp(F.col("candle_return_5m") / F.greatest(F.col("volatility") * 3.0, F.lit(0.001))),
        "rsi_14": F.when(
            F.col("pos") >= 14,
            _relative_strength(F.when(F.col("avg_gain") > 0, 1.0).otherwise(0.5)),
        ).otherwise(0.5),
        "macd_pct": zero(ratio(macd, close)),
        "macd_signal_pct": zero(ratio(F.col("live_signal"), close)),
        "macd_histogram_pct": zero(ratio(macd - F.col("live_signal"), close)),
        "ema_20_distance_pct": zero(change(close, F.col("live_20"))),
        **_band_outputs(),
        "adx_14": F.when(
            F.size(dxs) > 0, clamp(F.aggregate(dxs, F.lit(0.0), lambda a, x: a + x) / F.size(dxs), 0.0, 1.0)
        ).otherwise(0.0),
    }
    return drop_halo(
        df.select("symbol", "as_of", "pos", *HALO_AND_BLOCK, *[expr.alias(name) for name, expr in outputs.items()])
    )
