"""Regimes of completed hours and path labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import paths
from tidemark.plans import bindings as b
from tidemark.plans.registry import common, query, rnd, sql_round

common(
    "hour_bars",
    """SELECT symbol, date_trunc('hour', ts) AS open_time, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, date_trunc('hour', ts) + INTERVAL '3599.999 seconds' AS as_of
    FROM ticks GROUP BY symbol, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL '3599.999 seconds' <= (SELECT max(close_time) FROM candles)""",
)
_REGIME_SQL = f"""
    p AS (SELECT *, row_number() OVER w AS pos, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM hour_bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
    e AS (SELECT symbol, pos, close AS ema_50, close AS ema_200 FROM p WHERE pos = 1
      UNION ALL SELECT p.symbol, p.pos, p.close * 2 / 51 + e.ema_50 * 49 / 51, p.close * 2 / 201 + e.ema_200 * 199 / 201 FROM e JOIN p ON p.symbol = e.symbol AND p.pos = e.pos + 1),
    m AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pdm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS mdm FROM p),
    d AS (SELECT *, coalesce(sum(pdm) OVER w / nullif(sum(tr) OVER w, 0), 0) AS pdi, coalesce(sum(mdm) OVER w / nullif(sum(tr) OVER w, 0), 0) AS mdi, avg(tr) OVER w AS atr_14 FROM m WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS 13 PRECEDING)),
    g AS (SELECT d.*, e.ema_50, e.ema_200, 100 * avg(coalesce(abs(pdi - mdi) / nullif(pdi + mdi, 0), 0)) OVER (PARTITION BY d.symbol ORDER BY d.pos ROWS 13 PRECEDING) AS adx_14, lag(e.ema_50, 3) OVER (PARTITION BY d.symbol ORDER BY d.pos) AS before
      FROM d JOIN e ON e.symbol = d.symbol AND e.pos = d.pos),
    r AS (SELECT *, CASE WHEN adx_14 >= {paths.LEAST_ADX} AND close > ema_50 AND ema_50 > ema_200 AND ema_50 > before THEN 'LONG' WHEN adx_14 >= {paths.LEAST_ADX} AND close < ema_50 AND ema_50 < ema_200 AND ema_50 < before THEN 'SHORT' ELSE 'NEUTRAL' END AS regime FROM g)"""
_SHOWN = ["close", "ema_50", "ema_200", "adx_14", "atr_14"]


def hour_bars(spark, sf) -> DataFrame:
    """Hours that are over when the last minute candle closes."""
    minutes = b.candles(spark, sf).agg(F.max("close_time").alias("__now"))
    return b.candles(spark, sf, 3600).join(F.broadcast(minutes), F.col("close_time") <= F.col("__now")).drop("__now")


def regimes(spark, sf) -> DataFrame:
    return paths.hourly_regimes(hour_bars(spark, sf))


@query("hourly_regimes", f"WITH RECURSIVE {_REGIME_SQL} SELECT symbol, as_of, regime, {sql_round(_SHOWN)} FROM r", uses="ticks candles hour_bars")
def hourly_regimes(spark, sf):
    return regimes(spark, sf).select("symbol", "as_of", "regime", *[rnd(c).alias(c) for c in _SHOWN])


_PATH = ["future_return", "favourable", "adverse"]


@query(
    "path_labels",
    f"""WITH RECURSIVE {_REGIME_SQL},
    q AS (SELECT symbol, as_of, close AS price, atr_14 AS atr, CASE WHEN regime = 'SHORT' THEN 'SHORT' ELSE 'LONG' END AS side, CASE WHEN regime = 'SHORT' THEN -1 ELSE 1 END AS s FROM r WHERE close > 0 AND atr_14 > 0),
    h AS (SELECT q.*, unnest([{", ".join(map(str, paths.HORIZONS))}]) AS horizon FROM q),
    a AS (SELECT * FROM h WHERE as_of + to_minutes(horizon) <= (SELECT max(close_time) FROM candles)),
    j AS (SELECT a.*, c.close_time, c.close, c.high, c.low,
      CASE WHEN s = 1 THEN c.low <= price - {paths.STOP_RANGES} * atr ELSE c.high >= price + {paths.STOP_RANGES} * atr END AS stopped,
      CASE WHEN s = 1 THEN c.high >= price + {paths.TARGET_RANGES} * atr ELSE c.low <= price - {paths.TARGET_RANGES} * atr END AS taken
      FROM a LEFT JOIN candles c ON c.symbol = a.symbol AND c.close_time > a.as_of AND c.close_time <= a.as_of + to_minutes(a.horizon)),
    t AS (SELECT *, min(CASE WHEN stopped OR taken THEN close_time END) OVER (PARTITION BY symbol, as_of, horizon) AS hit FROM j),
    o AS (SELECT symbol, as_of, horizon, any_value(side) AS side, count(close_time) AS bars, any_value(s) * (last(close ORDER BY close_time) / any_value(price) - 1) AS future_return,
      CASE WHEN any_value(s) = 1 THEN max(high) FILTER (WHERE hit IS NULL OR close_time <= hit) / any_value(price) - 1 ELSE 1 - min(low) FILTER (WHERE hit IS NULL OR close_time <= hit) / any_value(price) END AS favourable,
      CASE WHEN any_value(s) = 1 THEN min(low) FILTER (WHERE hit IS NULL OR close_time <= hit) / any_value(price) - 1 ELSE 1 - max(high) FILTER (WHERE hit IS NULL OR close_time <= hit) / any_value(price) END AS adverse,
      coalesce(max(CASE WHEN close_time = hit THEN CASE WHEN stopped THEN 'stop' ELSE 'target' END END), 'none') AS touch, (epoch_us(any_value(hit)) - epoch_us(as_of)) / 1e6 AS touch_seconds
      FROM t GROUP BY symbol, as_of, horizon)
    SELECT symbol, as_of, horizon, side, bars, touch, touch_seconds, {sql_round(_PATH)} FROM o""",
    uses="ticks candles hour_bars",
)
def path_labels(spark, sf):
    decided = regimes(spark, sf).select("symbol", "as_of", F.col("close").alias("price"), F.col("atr_14").alias("atr"), F.when(F.col("regime") == "SHORT", "SHORT").otherwise("LONG").alias("side"))
    out = paths.path_labels(decided, b.candles(spark, sf))
    return out.select("symbol", "as_of", "horizon", "side", "bars", "touch", "touch_seconds", *[rnd(c).alias(c) for c in _PATH])
