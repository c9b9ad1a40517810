"""Streaming queries, each run over all available input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import daytable
from tidemark.plans import bindings as b
from tidemark.plans.feeds import force_order_rows, kline_stream_rows
from tidemark.plans.registry import query, rnd
from tidemark.sources import feeds
from tidemark.session import scratch_path
from tidemark.streaming import flows, maturity


def _ticks(spark, sf) -> DataFrame:
    return flows.read_events(spark, sf).select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("quantity"), "event_id"
    )


@query(
    "stream_tumbling_bars",
    """SELECT event_type AS symbol, time_bucket(INTERVAL 5 MINUTES, ts) AS open_time, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
      sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume, count(*) AS trades FROM events GROUP BY event_type, time_bucket(INTERVAL 5 MINUTES, ts)""",
)
def stream_tumbling_bars(spark, sf):
    bars = flows.tumbling_bars(_ticks(spark, sf), "5 minutes", tie="event_id")
    return flows.drain(bars, "update", ["symbol", "open_time"], "bars").withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))


_LIQ = """WITH e AS (SELECT upper(event_type) AS symbol, ts, CASE WHEN event_id % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS side, value * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS n FROM (SELECT *, date_trunc('millisecond', ts) AS t2 FROM events) WHERE event_type IN ('click', 'view')),
      w AS (SELECT e.*, date_trunc('minute', ts) + to_minutes(i) + INTERVAL 1 MINUTE AS window_end FROM e, range(5) r(i)),
      a AS (SELECT symbol, window_end, sum(CASE WHEN side = 'SELL' THEN n ELSE 0 END) AS long_usd, sum(CASE WHEN side = 'BUY' THEN n ELSE 0 END) AS short_usd, count(*) AS events FROM w GROUP BY ALL)"""


def _windows(spark, sf) -> DataFrame:
    orders = feeds.parse_force_orders(force_order_rows(flows.read_events(spark, sf)), ["CLICK", "VIEW"])
    return flows.drain(flows.liquidation_windows(orders), "update", ["symbol", "window_end"], "windows")


@query(
    "stream_liquidation_windows",
    _LIQ + " SELECT symbol, window_end, round(long_usd, 6) + 0.0 AS long_usd, round(short_usd, 6) + 0.0 AS short_usd, round((short_usd - long_usd) / nullif(long_usd + short_usd, 0), 6) + 0.0 AS imbalance, events FROM a WHERE long_usd + short_usd > 0",
)
def stream_liquidation_windows(spark, sf):
    out = _windows(spark, sf).where(F.col("total_usd") > 0)
    return out.select("symbol", F.col("window_end").cast("timestamp_ntz").alias("window_end"), *[rnd(c).alias(c) for c in ("long_usd", "short_usd", "imbalance")], "events")


@query(
    "stream_liquidation_spikes",
    _LIQ + """ SELECT a.symbol, a.window_end, round(greatest(0, least(10, (a.long_usd + a.short_usd) / greatest(coalesce(p.long_usd + p.short_usd, 0), 5000) - 1)), 6) + 0.0 AS spike_score
      FROM a LEFT JOIN a p ON p.symbol = a.symbol AND p.window_end = a.window_end - INTERVAL 1 MINUTE""",
)
def stream_liquidation_spikes(spark, sf):
    out = flows.liquidation_spikes(_windows(spark, sf), floor=5000.0)
    return out.select("symbol", F.col("window_end").cast("timestamp_ntz").alias("window_end"), rnd("spike_score").alias("spike_score"))


@query(
    "stream_unique_articles",
    "SELECT event_type AS source, user_id % 50 AS url, count(*) > 0 AS seen FROM events GROUP BY event_type, user_id % 50",
)
def stream_unique_articles(spark, sf):
    rows = flows.read_events(spark, sf).select(F.col("event_type").alias("source"), (F.col("user_id") % 50).alias("url"), F.col("ts").alias("available_at"))
    kept = flows.drain(flows.unique_articles(rows, "60 days"), "append", [], "articles")
    return kept.select("source", "url", F.lit(True).alias("seen"))


@query(
    "stream_matured_labels",
    """SELECT s.event_id AS signal_id, s.event_type AS symbol, min(c.ts) AS close_time, arg_min(c.event_id, (c.ts, c.event_id)) AS candle_id
      FROM events s JOIN events c ON c.event_type = s.event_type AND c.ts >= s.ts + INTERVAL 1 HOUR AND c.ts <= s.ts + INTERVAL 70 MINUTES
      WHERE epoch_us(s.ts + INTERVAL 1 HOUR) // 600000000 * 600000000 + 1200000000 < (SELECT epoch_us(max(ts) - INTERVAL 10 MINUTES) // 1000 * 1000 FROM events) GROUP BY s.event_id, s.event_type""",
)
def stream_matured_labels(spark, sf):
    """A signal's label is final when the watermark has passed the bucket in which it falls due and the grace period behind it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", maturity.STATE_STORE)
    try:
        signals = flows.read_events(spark, sf).select(F.col("event_id").alias("signal_id"), F.col("event_type").alias("symbol"), F.col("ts").alias("generated_at"))
        candles = flows.read_events(spark, sf).select(F.col("event_type").alias("symbol"), F.col("ts").alias("close_time"), F.col("event_id").alias("close"))
        out = flows.drain(maturity.matured_labels(signals, candles, "1 hour", "10 minutes", "10 minutes"), "append", [], "matured")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out.select("signal_id", "symbol", F.col("close_time").cast("timestamp_ntz").alias("close_time"), F.col("close").cast("long").alias("candle_id"))


@query(
    "stream_kline_upsert",
    """WITH m AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS open_time, event_id % 2 = 0 AS is_closed, date_trunc('millisecond', ts) AS event_time, value AS close FROM events)
      SELECT symbol, open_time, last(close ORDER BY is_closed, event_time, close) AS close, bool_or(is_closed) AS is_closed, count(*) AS updates FROM m GROUP BY symbol, open_time""",
)
def stream_kline_upsert(spark, sf):
    """Three micro-batches whose bars overlap are merged into the table; the second is delivered twice.  A batch is as many files as a third of the cores."""
    parts, base, state = (scratch_path(spark, n) for n in ("kline-parts", "klines", "klines-state"))
    events = b.table(spark, sf, "events")
    files = -(-spark.sparkContext.defaultParallelism // 3)
    events.repartition(3 * files, "event_id").write.parquet(parts)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(parts)
    klines = feeds.parse_klines(kline_stream_rows(stream.withColumn("ts", F.col("ts").cast("timestamp")))).drop("event_id")

    def step(batch: DataFrame, number: int) -> None:
        for _ in range(1 + (number == 1)):
            daytable.merge_batch(base, "open_time", flows.upsert_klines, batch, number)

    klines.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    out = daytable.current(spark, base)
    if out is None:
        out = spark.createDataFrame([], "symbol string, open_time timestamp, close double, is_closed boolean, updates long")
    return out.select(F.lower("symbol").alias("symbol"), F.col("open_time").cast("timestamp_ntz").alias("open_time"), "close", "is_closed", "updates")


@query(
    "late_or_changed_labels",
    "SELECT event_id, event_type FROM events WHERE event_type = 'view' OR event_id % 2 = 1",
)
def late_or_changed_labels(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", "event_type", "value").withColumn("fingerprint", flows.fingerprint(["event_id", "event_type", "value"]))
    old = b.table(spark, sf, "events").where(F.col("event_id") % 2 == 0).select(
        "event_id", "event_type", F.when(F.col("event_type") == "view", F.col("value") + 1).otherwise(F.col("value")).alias("value")
    ).withColumn("fingerprint", flows.fingerprint(["event_id", "event_type", "value"]))
    return flows.late_or_changed(rows, old, "fingerprint").select("event_id", "event_type")
