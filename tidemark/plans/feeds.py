"""Source, payload, scan and schema queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import clock
from tidemark.functions.schema import flatten
from tidemark.operators import lifecycle as lc
from tidemark.operators.labels import label_inventory
from tidemark.plans import bindings as b
from tidemark.plans.registry import query, rnd
from tidemark.session import scratch_path
from tidemark.sources import feeds
from tidemark.streaming.flows import fingerprint

def _k():
    return F.get_json_object("props", "$.k").cast("double")


def _events(spark, sf) -> DataFrame:
    return b.table(spark, sf, "events")


def _millis(column: str = "ts"):
    return (F.unix_seconds(F.col(column).cast("timestamp")) * 1000).cast("string")


def _s(value: Column) -> Column:
    return value.cast("string")


@query(
    "candle_csv_scan",
    """SELECT symbol, open_time, close_time AS as_of, round(open, 6) + 0.0 AS open, CASE WHEN symbol = 'view' THEN 0 ELSE round(close, 6) + 0.0 END AS close FROM
      (SELECT symbol, open_time, date_trunc('second', close_time) AS close_time, open, close FROM candles)""",
    uses="ticks candles",
)
def candle_csv_scan(spark, sf):
    path = scratch_path(spark, "candles")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    b.candles(spark, sf).select(
        "symbol", F.lit("1m").alias("interval"), show("open_time").alias("open_time"), show("close_time").alias("close_time"), "open", "high", "low",
        F.when(F.col("symbol") == "view", "n/a").otherwise(_s(F.col("close"))).alias("close"), "volume", "is_closed",
    ).write.option("header", True).option("compression", "gzip").csv(path)
    return feeds.read_candles(spark, path).select("symbol", "open_time", "as_of", rnd("open").alias("open"), F.when(F.col("symbol") == "view", F.col("close")).otherwise(rnd("close")).alias("close"))


@query("jsonl_scan", "SELECT event_id, event_type, value FROM events WHERE event_id % 10 <> 0")
def jsonl_scan(spark, sf):
    path = scratch_path(spark, "jsonl")
    i = F.col("event_id")
    line = F.when(i % 20 == 0, "").when(i % 10 == 0, "[1, 2]").otherwise(F.to_json(F.struct("event_id", "event_type", "value")))
    _events(spark, sf).select(line.alias("value")).write.option("compression", "gzip").text(path)
    return feeds.read_jsonl(spark, path, "event_id bigint, event_type string, value double")


@query(
    "research_row_scan",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM events",
)
def research_row_scan(spark, sf):
    path = scratch_path(spark, "rows")
    i = F.col("event_id")
    _events(spark, sf).select(
        _s(i).alias("event_id"), F.when(i % 7 == 0, " ").otherwise(_s(F.col("value"))).alias("value"), F.when(i % 3 == 0, "True").when(i % 3 == 1, "false").otherwise("").alias("flag")
    ).write.option("header", True).csv(path)
    return feeds.read_research_rows(spark, path, ["value"], ["flag"])


@query(
    "rss_feed_scan",
    """SELECT 'Story ' || CAST(article_id AS VARCHAR) AS title, 'https://n/' || CAST(article_id AS VARCHAR) AS url, available_at AS published_at FROM articles WHERE article_id % 11 <> 0""",
    uses="articles",
)
def rss_feed_scan(spark, sf):
    path = scratch_path(spark, "feed")
    i = F.col("article_id")
    item = F.concat(
        F.lit("<item><title>"), F.when(i % 11 != 0, F.concat(F.lit("Story "), _s(i))).otherwise(""), F.lit("</title><link>https://n/"), _s(i), F.lit("</link><pubDate>"),
        F.date_format("available_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"),
    )
    # Five hundred items per document, one document per file.
    docs = b.article_rows(spark, sf).groupBy(F.floor(i / 500).alias("file")).agg(
        F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("value")
    )
    docs.write.partitionBy("file").text(path)
    return feeds.read_rss(spark, path).select("title", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


_RATIOS = ["global_long_short_account_ratio", "top_long_short_account_ratio", "top_long_short_position_ratio"]
_DT = ["global_long_short_account_ratio", "taker_buy_sell_volume", "open_interest_hist", "open_interest", "funding_rate"]


@query(
    "derivative_payload_events",
    f"""WITH e AS (SELECT event_id, unnest(CASE WHEN event_id % 5 = 0 THEN [{", ".join(f"'{d}'" for d in _RATIOS)}] ELSE [[{", ".join(f"'{d}'" for d in _DT)}][event_id % 5 + 1]] END) AS data_type,
        k, value, date_trunc('second', ts) AS event_time FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))
      SELECT event_id, data_type, event_time, round(CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN k WHEN 2 THEN CASE WHEN k <> 0 THEN k ELSE value END WHEN 3 THEN value ELSE k / 100000 END, 6) + 0.0 AS numeric_value,
        round(CASE event_id % 5 WHEN 0 THEN greatest(-1, least(1, CASE WHEN k = 0 THEN 0.5 ELSE k / 100 END - CASE WHEN k = 100 THEN 0.5 ELSE 1 - k / 100 END)) WHEN 1 THEN CASE WHEN k + value > 0 THEN k / (k + value) ELSE 0.5 END END, 6) + 0.0 AS lean FROM e""",
)
def derivative_payload_events(spark, sf):
    """Every event as the payload of its type; account ratios come from three endpoints that share one layout."""
    k, val = _k(), F.col("value")
    n = F.col("event_id") % 5
    kinds = F.when(n == 0, F.array(*[F.lit(d) for d in _RATIOS])).otherwise(F.array(F.element_at(F.array(*[F.lit(d) for d in _DT]), (n + 1).cast("int"))))
    raw = (
        F.when(n == 0, F.to_json(F.struct(_s(val).alias("longShortRatio"), _s(k / 100).alias("longAccount"), _s(1 - k / 100).alias("shortAccount"), _millis().alias("timestamp"))))
        .when(n == 1, F.to_json(F.struct(_s(k).alias("buySellRatio"), _s(k).alias("buyVol"), _s(val).alias("sellVol"), _millis().alias("timestamp"))))
        .when(n == 2, F.to_json(F.struct(_s(val).alias("sumOpenInterest"), _s(k).alias("sumOpenInterestValue"), _millis().alias("timestamp"))))
        .when(n == 3, F.to_json(F.struct(_s(val).alias("openInterest"), _millis().alias("time"))))
        .otherwise(F.to_json(F.struct(_s(k / 100000).alias("fundingRate"), F.lit("1").alias("markPrice"), _millis().alias("fundingTime"))))
    )
    rows = _events(spark, sf).select("event_id", F.explode(kinds).alias("data_type"), raw.alias("raw"))
    out = feeds.derivative_events(rows)
    lean = F.coalesce(F.try_element_at("payload", F.lit("long_bias")), F.try_element_at("payload", F.lit("buy_pressure")))
    return out.select("event_id", "data_type", "event_time", rnd("numeric_value").alias("numeric_value"), rnd(lean).alias("lean"))


@query(
    "fear_greed_events",
    """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
      v AS (SELECT event_id, date_trunc('minute', ts) AS event_time, k, value, CASE WHEN k < 20 THEN 0 WHEN k < 40 THEN 25 WHEN k < 60 THEN 50 WHEN k < 80 THEN 75 ELSE 100 END AS s FROM e)
      SELECT event_id, event_time, 'fear_greed_value' AS data_type, k AS numeric_value FROM v UNION ALL SELECT event_id, event_time, 'fear_greed_change_1d', round(k - value, 6) + 0.0 FROM v UNION ALL SELECT event_id, event_time, 'fear_greed_change_24h', round(k - value, 6) + 0.0 FROM v
      UNION ALL SELECT event_id, event_time, 'fear_greed_classification_score', s FROM v UNION ALL SELECT event_id, event_time, 'fear_greed_classification', s FROM v""",
)
def fear_greed_events(spark, sf):
    k = _k()
    name = F.when(k < 20, "Extreme Fear").when(k < 40, "Fear").when(k < 60, "Neutral").when(k < 80, "Greed").otherwise("Extreme Greed")
    secs = _s(F.unix_seconds(F.col("ts").cast("timestamp")))
    raw = F.to_json(F.struct(F.array(
        F.struct(_s(k).alias("value"), name.alias("value_classification"), secs.alias("timestamp")),
        F.struct(_s(F.col("value")).alias("value"), F.lit("Fear").alias("value_classification"), secs.alias("timestamp")),
    ).alias("data")))
    out = feeds.fear_greed_events(_events(spark, sf).select("event_id", raw.alias("raw")), ["event_id"])
    return out.withColumn("numeric_value", rnd("numeric_value"))


@query(
    "global_market_events",
    """WITH v AS (SELECT event_id, value * 1000 AS cap, value AS vol, k / 1000 AS chg, k / 100 AS btc, lag(value) OVER (ORDER BY ts, event_id) AS pv, lag(k / 100) OVER (ORDER BY ts, event_id) AS pb FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)),
      u AS (SELECT event_id, unnest([{'t': 'global_market_cap_usd', 'x': cap}, {'t': 'total_market_cap_usd', 'x': cap}, {'t': 'global_market_cap_change_24h', 'x': chg}, {'t': 'market_cap_change_24h', 'x': chg}, {'t': 'total_volume_usd', 'x': vol},
        {'t': 'total_volume_change_24h', 'x': coalesce(vol / nullif(pv, 0) - 1, 0)}, {'t': 'btc_dominance', 'x': btc}, {'t': 'eth_dominance', 'x': btc / 2}, {'t': 'btc_dominance_change', 'x': coalesce(btc - pb, 0)}, {'t': 'btc_dominance_change_24h', 'x': coalesce(btc - pb, 0)}]) AS c FROM v)
      SELECT event_id, c.t AS data_type, round(c.x, 6) + 0.0 AS numeric_value FROM u""",
)
def global_market_events(spark, sf):
    k, val = _k(), F.col("value")
    raw = F.to_json(F.struct(F.struct(
        F.struct((val * 1000).alias("usd")).alias("total_market_cap"), F.struct(val.alias("usd")).alias("total_volume"), (k / 10).alias("market_cap_change_percentage_24h_usd"),
        F.struct(k.alias("btc"), (k / 2).alias("eth")).alias("market_cap_percentage"),
    ).alias("data")))
    rows = _events(spark, sf).select("event_id", F.col("ts").alias("event_time"), raw.alias("raw"))
    return feeds.global_market_events(rows, []).select("event_id", "data_type", rnd("numeric_value").alias("numeric_value"))


@query(
    "stablecoin_events",
    """WITH v AS (SELECT event_id, k / 10000 - 0.005 AS t, CASE WHEN event_id % 5 <> 0 THEN value / 100000 - 0.001 ELSE 0 END AS c, CASE WHEN event_id % 5 <> 0 THEN 0.0005 ELSE 0 END + 0.001 AS s FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)),
      u AS (SELECT event_id, unnest([{'t': 'usdt_price_deviation', 'x': t}, {'t': 'usdc_price_deviation', 'x': c}, {'t': 'usdt_deviation', 'x': t}, {'t': 'usdc_deviation', 'x': c}, {'t': 'stablecoin_depeg_risk', 'x': least(1, greatest(abs(t), abs(c)) / 0.01)},
        {'t': 'stablecoin_supply_change_1d', 'x': CAST(s AS DOUBLE)}, {'t': 'stablecoin_supply_change_24h', 'x': CAST(s AS DOUBLE)}]) AS q FROM v)
      SELECT event_id, q.t AS data_type, round(q.x + 1e-10, 6) + 0.0 AS numeric_value FROM u""",
)
def stablecoin_events(spark, sf):
    k, val = _k(), F.col("value")
    coin = lambda s, p, c: F.struct(F.lit(s).alias("symbol"), p.alias("price"), F.lit(c).alias("change_1d"))
    usdt, usdc = coin("usdt", k / 10000 + 0.995, 0.001), coin("USDC", val / 100000 + 0.999, 0.0005)
    raw = F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.array(usdt, usdc)).otherwise(F.array(usdt)).alias("peggedAssets")))
    out = feeds.stablecoin_events(_events(spark, sf).select("event_id", raw.alias("raw")), ["event_id"])
    return out.select("event_id", "data_type", rnd(F.col("numeric_value") + 1e-10).alias("numeric_value"))


@query(
    "spot_context_events",
    """WITH v AS (SELECT event_id, value AS p, k, value * 0.999 AS bid, value * 1.001 AS ask, value * 0.999 * k + value * 0.998 * 2 AS db, value * 1.001 * 10 + value * 1.002 * 5 AS da FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)),
      u AS (SELECT event_id, unnest([{'t': 'spot_price_change_24h', 'x': k / 1000}, {'t': 'spot_volume_24h', 'x': p * 2}, {'t': 'spot_quote_volume_24h', 'x': p * 1e6}, {'t': 'spot_trade_count_24h', 'x': k * 1000}, {'t': 'spot_weighted_avg_price', 'x': p},
        {'t': 'spot_bid_ask_spread_pct', 'x': (ask - bid) / ((ask + bid) / 2)}, {'t': 'spot_orderbook_imbalance', 'x': (db - da) / (db + da)}, {'t': 'spot_depth_bid_notional_5', 'x': db}, {'t': 'spot_depth_ask_notional_5', 'x': da},
        {'t': 'spot_intraday_range_pct', 'x': 0.03}, {'t': 'spot_activity_score', 'x': least(3, k / 1000 * 8 + least(p * 1e6 / 1e9, 1) + least(k / 1000, 1))}]) AS q FROM v)
      SELECT event_id, q.t AS data_type, round(q.x + 1e-10, 6) + 0.0 AS numeric_value FROM u""",
)
def spot_context_events(spark, sf):
    k, p = _k(), F.col("value")
    level = lambda price, q: F.array(price, q)
    ticker = F.to_json(F.struct(
        _s(p).alias("lastPrice"), _s(p).alias("openPrice"), _s(p * 1.02).alias("highPrice"), _s(p * 0.99).alias("lowPrice"), _s(p * 2).alias("volume"), _s(p * 1e6).alias("quoteVolume"),
        _s(k * 1000).alias("count"), _s(k / 10).alias("priceChangePercent"), _s(p).alias("weightedAvgPrice"),
    ))
    depth = F.to_json(F.struct(
        F.array(level(p * 0.999, k), level(p * 0.998, F.lit(2.0))).alias("bids"), F.array(level(p * 1.001, F.lit(10.0)), level(p * 1.002, F.lit(5.0))).alias("asks"),
    ))
    rows = _events(spark, sf).select("event_id", ticker.alias("ticker"), depth.alias("depth"))
    return feeds.spot_events(rows, ["event_id"]).select("event_id", "data_type", rnd(F.col("numeric_value") + 1e-10).alias("numeric_value"))


@query(
    "kline_array_rows",
    "SELECT symbol, open_time, open, high, low, close, volume, trades FROM candles",
    uses="ticks candles",
)
def kline_array_rows(spark, sf):
    ms = lambda c: _s(F.unix_millis(F.col(c).cast("timestamp")))
    arr = F.array(ms("open_time"), *[_s(F.col(c)) for c in ("open", "high", "low", "close", "volume")], ms("close_time"), F.lit("0"), _s(F.col("trades")))
    rows = b.candles(spark, sf).select("symbol", arr.alias("kline"))
    return feeds.kline_arrays(rows).select("symbol", "open_time", "open", "high", "low", "close", "volume", "trades")


@query(
    "bounded_table_scan",
    "SELECT symbol, open_time, close FROM candles WHERE open_time >= TIMESTAMP '2024-01-05' AND open_time < TIMESTAMP '2024-01-12' AND upper(symbol) IN ('CLICK', 'VIEW')",
    uses="ticks candles",
)
def bounded_table_scan(spark, sf):
    return feeds.bounded_scan(b.candles(spark, sf), "open_time", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12), ["click", "view"], closed_only=True).select("symbol", "open_time", "close")


@query("day_partitions_written", "SELECT CAST(ts AS DATE) AS day, count(*) AS rows, min(event_id) AS first_id FROM events GROUP BY 1")
def day_partitions_written(spark, sf):
    path = scratch_path(spark, "days")
    lc.write_days(_events(spark, sf).select("event_id", "ts", "value"), path, "ts", keys=["event_id"])
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_id"))


@query("archive_then_trim", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def archive_then_trim(spark, sf):
    rows = _events(spark, sf).select("event_id", "ts")
    kept, _ = lc.archive_then_trim(spark, rows, "ts", F.expr("timestamp_ntz'2024-01-10'"), scratch_path(spark, "archive"))
    return kept


@query(
    "imported_sentiment_scores",
    """WITH a AS (SELECT article_id, 'u' || CAST(article_id AS VARCHAR) AS url FROM articles)
      SELECT article_id, CASE WHEN article_id % 3 = 0 THEN quality + 0.5 WHEN article_id % 3 = 1 THEN CAST(toxic AS DOUBLE) END AS score FROM a LEFT JOIN labels ON doc_id = article_id""",
    uses="articles",
)
def imported_sentiment_scores(spark, sf):
    url = F.concat(F.lit("u"), F.col("article_id").cast("string"))
    articles = b.article_rows(spark, sf).select("article_id", url.alias("url"))
    i = F.col("doc_id")
    scores = b.table(spark, sf, "labels").where(i % 3 != 2).select(
        F.when(i % 3 == 0, i).alias("article_id"), F.when(i % 3 == 1, F.concat(F.lit("u"), i.cast("string"))).alias("url"),
        F.when(i % 3 == 0, F.col("quality") + 0.5).otherwise(F.col("toxic").cast("double")).alias("score"), F.lit(1).alias("seq"),
    )
    return feeds.imported_scores(articles, scores).select("article_id", "score")


@query(
    "series_to_candles",
    """SELECT event_type AS symbol, ts AS close_time, coalesce(lag(value) OVER w, value) AS open, greatest(coalesce(lag(value) OVER w, value), value) AS high, least(coalesce(lag(value) OVER w, value), value) AS low, value AS close,
      round(coalesce(value / nullif(lag(value) OVER w, 0) - 1, 0), 6) + 0.0 AS ret FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
)
def series_to_candles(spark, sf):
    return feeds.series_to_candles(b.ticks(spark, sf)).withColumn("ret", rnd("ret"))


@query(
    "article_payload_rows",
    "SELECT article_id, 'T' || CAST(article_id AS VARCHAR) AS title, 'https://x' AS url, 'T' || CAST(article_id AS VARCHAR) || ' ' || source || ' ' || provider AS raw_text FROM articles",
    uses="articles",
)
def article_payload_rows(spark, sf):
    title = F.concat(F.lit("T"), F.col("article_id").cast("string"))
    item = lambda t: F.struct(t.alias("title"), F.lit("https://x").alias("url"), F.col("source").alias("domain"), F.col("provider").alias("language"))
    raw = F.to_json(F.struct(F.array(item(title), item(F.lit(" "))).alias("articles")))
    return feeds.article_payloads(b.article_rows(spark, sf).select("article_id", raw.alias("value")))


@query(
    "kline_messages",
    "SELECT event_type AS symbol, event_id % 2 = 0 AS is_closed, date_trunc('minute', ts) AS open_time, value AS close, event_id FROM events",
)
def kline_messages(spark, sf):
    return feeds.parse_klines(kline_stream_rows(_events(spark, sf))).select(
        F.lower("symbol").alias("symbol"), "is_closed", F.col("open_time").cast("timestamp_ntz").alias("open_time"), "close", "event_id"
    )


def kline_stream_rows(events: DataFrame) -> DataFrame:
    val = _s(F.col("value"))
    minute = F.unix_millis(F.date_trunc("minute", F.col("ts").cast("timestamp")))
    k = F.struct(
        F.col("event_type").alias("s"), F.lit("1m").alias("i"), minute.alias("t"), val.alias("o"), val.alias("h"), val.alias("l"), val.alias("c"),
        F.lit("1").alias("v"), (F.col("event_id") % 2 == 0).alias("x"),
    )
    raw = F.to_json(F.struct(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("E"), k.alias("k")).alias("data")))
    return events.select("event_id", raw.alias("value"))


def force_order_rows(events: DataFrame) -> DataFrame:
    o = F.struct(
        F.col("event_type").alias("s"), F.when(F.col("event_id") % 2 == 0, "SELL").otherwise("BUY").alias("S"), _s(F.col("value")).alias("ap"), _s(_k()).alias("q"),
    )
    raw = F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("E"), o.alias("o")))
    return events.select("event_id", raw.alias("value"))


@query(
    "force_order_messages",
    "SELECT event_id, upper(event_type) AS symbol, CASE WHEN event_id % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS side, round(value * CAST(json_extract_string(props, '$.k') AS DOUBLE), 6) + 0.0 AS notional FROM events WHERE event_type IN ('click', 'view')",
)
def force_order_messages(spark, sf):
    out = feeds.parse_force_orders(force_order_rows(_events(spark, sf)), ["CLICK", "VIEW"])
    return out.select("event_id", "symbol", "side", rnd("notional").alias("notional"))


@query(
    "map_vector_flatten",
    "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k, value, 0.5 AS rsi_14 FROM (SELECT *, CAST(0.5 AS DOUBLE) AS d FROM events)",
)
def map_vector_flatten(spark, sf):
    i = F.col("event_id")
    full = F.to_json(F.struct(F.struct(_k().alias("k"), F.col("value"), F.lit("text").alias("note")).alias("values")))
    part = F.to_json(F.struct(F.struct(F.col("value")).alias("values")))
    rows = _events(spark, sf).select("event_id", F.lit(None).cast("string").alias("feature_values"), F.when(i % 4 != 0, full).otherwise(part).alias("payload"))
    return flatten(rows, ["k", "value", "rsi_14"], defaults={"rsi_14": 0.5}).select("event_id", "k", "value", F.col("rsi_14").cast("decimal(2,1)").alias("rsi_14"))


@query(
    "clock_floor_keys",
    """SELECT event_id, date_trunc('minute', ts) AS minute, date_trunc('hour', ts) AS hour, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, epoch_us(ts) // 1000 AS ms FROM events""",
)
def clock_floor_keys(spark, sf):
    cut = lambda u: F.date_trunc(u, "ts").cast("timestamp_ntz").alias(u)
    return _events(spark, sf).select(
        "event_id", cut("minute"), cut("hour"), cut("day"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")
    )


@query(
    "interval_text_seconds",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN k WHEN 1 THEN k * 60 WHEN 2 THEN k * 3600 WHEN 3 THEN k * 86400 END AS seconds FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
)
def interval_text_seconds(spark, sf):
    n = F.col("event_id") % 5
    unit = F.when(n == 0, "s").when(n == 1, "m").when(n == 2, "H").when(n == 3, "d").otherwise("x")
    text = F.concat(F.lit(" "), F.get_json_object("props", "$.k"), unit)
    return _events(spark, sf).select("event_id", clock.interval_seconds(text).alias("seconds"))


@query(
    "recency_weights",
    """SELECT event_id, round(CASE WHEN event_id % 9 = 0 THEN 0.25 ELSE greatest(0, least(1, 1 - greatest(0, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 3.6e9 / 48)) END, 6) + 0.0 AS live,
      round(CASE WHEN event_id % 9 = 0 THEN 0.25 ELSE greatest(0.05, least(1, 1 - greatest(0, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 3.6e9 / 48)) END, 6) + 0.0 AS historical FROM events""",
)
def recency_weights(spark, sf):
    now = F.expr("timestamp_ntz'2024-01-20'")
    t = F.when(F.col("event_id") % 9 != 0, F.col("ts"))
    return _events(spark, sf).select("event_id", rnd(clock.recency_weight(t, now)).alias("live"), rnd(clock.recency_weight(t, now, floor=0.05)).alias("historical"))


@query(
    "timeframe_names",
    "SELECT event_id, CASE WHEN value <= 7 THEN '5m' WHEN value <= 90 THEN '1h' WHEN value <= 360 THEN '4h' ELSE '1d' END AS timeframe FROM events",
)
def timeframe_names(spark, sf):
    return _events(spark, sf).select("event_id", feeds.timeframe_name(F.col("value")).alias("timeframe"))


@query(
    "row_fingerprints",
    """SELECT event_id, sha256('{"event_id":' || CAST(event_id AS VARCHAR) || ',"event_type":"' || event_type || '","user_id":' || CAST(user_id AS VARCHAR) || '}') AS fingerprint FROM events""",
)
def row_fingerprints(spark, sf):
    return _events(spark, sf).select("event_id", fingerprint(["user_id", "event_type", "event_id"]).alias("fingerprint"))


@query(
    "available_labels",
    """WITH r AS (SELECT event_id, ts, CASE WHEN event_id % 10 <> 0 THEN value END AS label, ts + INTERVAL 15 MINUTES AS label_time FROM events)
      SELECT event_type, count(*) AS total_rows, count(label) AS finite_label_rows, count(*) FILTER (WHERE label IS NOT NULL AND label_time <= TIMESTAMP '2024-01-28') AS available_labeled_rows,
        count(*) FILTER (WHERE label IS NOT NULL AND label_time > TIMESTAMP '2024-01-28') AS pending_label_rows, count(*) FILTER (WHERE label IS NULL) AS missing_or_invalid_label_rows,
        max(label_time) FILTER (WHERE label IS NOT NULL AND label_time <= TIMESTAMP '2024-01-28') AS newest_available_label_time FROM r JOIN events USING (event_id) GROUP BY event_type""",
)
def available_labels(spark, sf):
    rows = _events(spark, sf).select("event_type", "ts", F.when(F.col("event_id") % 10 != 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("label"))
    return label_inventory(rows, ["event_type"], "label", "ts", None, 900, F.expr("timestamp_ntz'2024-01-28'"))
