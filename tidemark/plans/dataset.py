"""The end-to-end dataset: raw ticks, news and events to labelled feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.clock import clock_features
from tidemark.functions.scores import with_columns
from tidemark.operators import indicators, labels, news, quality
from tidemark.operators.asof import latest_per_key
from tidemark.plans import bindings as b
from tidemark.plans.newsroom import offline_articles
from tidemark.plans.registry import SQL, query, rnd
from tidemark.session import checkpointed


def build_training_rows(
    candles: DataFrame, articles: DataFrame, events: DataFrame, news_hours: float = 6.0, event_hours: float = 24.0, fee_rate: float = 0.0004
) -> DataFrame:
    """Point-in-time features of every closed candle with its forward labels.

    ``candles`` has symbol, open_time, close_time, OHLCV; ``articles`` is scored
    and carries ``event_time``; ``events`` are long metric facts.  All steps share
    the key (symbol, as_of), so the joins meet on equal partitioning.
    """
    features = with_columns(indicators.warmed_up(indicators.offline_features(candles)), clock_features("as_of"))
    targets = labels.labels_by_time(candles.withColumn("as_of", F.col("close_time")), fee_rate)
    keys = candles.select("symbol", F.col("close_time").alias("as_of"))
    read = news.window_means(keys, articles, news_hours)
    seen = news.external_summary(keys, events, event_hours)
    out = features.join(targets, ["symbol", "as_of"], "left").join(read, ["symbol", "as_of"], "left").join(seen, ["symbol", "as_of"], "left")
    return latest_per_key(out, ["symbol", "as_of"], [F.col("pos").desc()])


def _rows(spark, sf) -> DataFrame:
    candles = checkpointed(b.candles(spark, sf).withColumn("symbol", b.market_symbol()))
    articles = offline_articles(spark, sf).withColumn("event_time", F.col("published_at"))
    events = b.external_events(spark, sf).select(
        F.when(F.col("symbol").isNotNull(), b.market_symbol("data_type")).alias("symbol"), "event_time", "numeric_value"
    )
    return build_training_rows(candles, articles, events)


_SHOW = [
    "candle_return_5m", "volatility", "rsi_14", "macd_pct", "adx_14", "sentiment_score", "risk_score", "article_count_used",
    "external_event_count_24h", "target_future_return_15m", "target_max_upside_1h", "target_stop_loss_hit_first", "target_trade_quality_score",
]
_SQL = f"""
WITH m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in b.MARKET.items())}) m(kind, market)),
i AS ({SQL['indicators_offline']}), x AS ({SQL['indicators_exponential']}), l AS ({SQL['labels_time_offsets']}), n AS ({SQL['news_window_means']}),
w AS (SELECT symbol, as_of, row_number() OVER (PARTITION BY symbol ORDER BY as_of) AS pos FROM i),
g AS (SELECT CASE WHEN user_id % 10 <> 0 THEN event_type END AS symbol, ts FROM events),
e AS (SELECT w.symbol, w.as_of, CAST(count(*) AS DOUBLE) AS external_event_count_24h FROM w JOIN g ON (g.symbol IS NULL OR g.symbol = w.symbol) AND g.ts <= w.as_of AND g.ts >= w.as_of - INTERVAL 24 HOURS GROUP BY w.symbol, w.as_of)
SELECT m.market AS symbol, i.as_of, i.candle_return_5m, i.volatility, i.rsi_14, x.macd_pct, i.adx_14, n.sentiment_score, n.risk_score, n.article_count_used, coalesce(e.external_event_count_24h, 0) AS external_event_count_24h,
  l.target_future_return_15m, l.target_max_upside_1h, l.target_stop_loss_hit_first, l.target_trade_quality_score
FROM i JOIN x USING (symbol, as_of) JOIN w USING (symbol, as_of) JOIN m ON m.kind = i.symbol JOIN l ON l.symbol = i.symbol AND l.as_of = i.as_of JOIN n ON n.symbol = m.market AND n.as_of = i.as_of
LEFT JOIN e ON e.symbol = i.symbol AND e.as_of = i.as_of WHERE w.pos > 5
"""


@query("training_rows", _SQL)
def training_rows(spark, sf):
    return _rows(spark, sf).select("symbol", "as_of", *[rnd(c).alias(c) for c in _SHOW])


@query(
    "dataset_quality_report",
    f"""WITH t AS ({_SQL}) SELECT count(*) AS total_rows, count(target_trade_quality_score) AS labeled_rows, count(DISTINCT symbol) AS symbols, count(*) FILTER (WHERE target_future_return_15m > 0) AS rows_up,
      count(*) FILTER (WHERE target_future_return_15m < 0) AS rows_down, round(avg(CAST(article_count_used > 0 AS DOUBLE)) * 100, 6) + 0.0 AS news_coverage_percentage, CAST(0 AS BIGINT) AS duplicate_rows, false AS future_leakage_detected FROM t""",
)
def dataset_quality_report(spark, sf):
    rows = _rows(spark, sf).withColumn("inputs_available_at", F.col("as_of"))
    return quality.dataset_report(rows).select(
        "total_rows", "labeled_rows", "symbols", "rows_up", "rows_down", rnd("news_coverage_percentage").alias("news_coverage_percentage"), "duplicate_rows",
        "future_leakage_detected",
    )


@query(
    "historical_training_rows",
    """WITH c AS (SELECT symbol, close_time AS as_of, close, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n, lag(close, 60) OVER w AS c60, lead(close, 15) OVER w AS f15, lead(close, 240) OVER w AS f240 FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY open_time))
      SELECT symbol, as_of, round(close / c60 - 1, 6) + 0.0 AS price_change, round(f15 / close - 1, 6) + 0.0 AS target_future_return_15m FROM c WHERE pos >= 60 AND pos < n - 241 AND (pos - 60) % 5 = 0""",
    uses="ticks candles",
)
def historical_training_rows(spark, sf):
    """Strided replay rows: 61 candles back, four hours of candles ahead."""
    candles = b.candles(spark, sf)
    live = indicators.live_features(candles, lookback=61)
    ahead = labels.labels_by_row(candles.withColumn("as_of", F.col("close_time")))
    out = live.join(ahead.drop("pos"), ["symbol", "as_of"])
    total = candles.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    picked = out.join(total, "symbol").where((F.col("pos") >= 60) & (F.col("pos") < F.col("n") - 241) & ((F.col("pos") - 60) % 5 == 0))
    return picked.select("symbol", "as_of", rnd("price_change").alias("price_change"), rnd("target_future_return_15m").alias("target_future_return_15m"))


@query(
    "exported_dataset",
    """WITH r AS (SELECT symbol, close_time AS as_of, close, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY open_time) - 1, 0) AS ret, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS pos FROM candles),
      f AS (SELECT r.symbol, r.as_of, lead(r.ret) OVER (PARTITION BY r.symbol ORDER BY r.as_of) AS nxt, q.close / r.close - 1 AS known FROM r ASOF LEFT JOIN r q ON q.symbol = r.symbol AND q.as_of >= r.as_of + INTERVAL 15 MINUTES)
      SELECT symbol, as_of, round(coalesce(known, nxt), 6) + 0.0 AS target_next_price_change FROM f""",
    uses="ticks candles",
)
def exported_dataset(spark, sf):
    candles = b.candles(spark, sf).withColumn("as_of", F.col("close_time"))
    feats = indicators.offline_features(candles).select("symbol", "as_of", "candle_return_1m")
    nxt = labels.next_row_target(feats, "candle_return_1m")
    known = labels.future_returns_by_time(candles.select("symbol", "as_of", "close"), candles, minutes={"15m": 15})
    out = nxt.join(known, ["symbol", "as_of"], "left")
    return out.select("symbol", "as_of", rnd(F.coalesce("target_future_return_15m", "target_next")).alias("target_next_price_change"))
