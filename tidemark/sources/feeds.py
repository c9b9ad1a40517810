"""Raw files and API payloads as typed rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.numeric import change, clamp, number_or, ratio, zero
from tidemark.functions.lexicon import LIVE_SYMBOLS
from tidemark.functions.text import labels_where, squeeze, token_set
from tidemark.operators.bars import floor_time
from tidemark.operators.context import previous_change
from tidemark.operators.ranks import quantiles, value_ranks
from tidemark.operators.series import lag_across, micros, range_blocks

CANDLE_TEXT = "symbol string, interval string, open_time string, close_time string, open string, high string, low string, close string, volume string, is_closed string"


def _utc(column: str) -> Column:
    return F.coalesce(
        F.try_to_timestamp(F.col(column)), F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd HH:mm:ss"))
    ).cast("timestamp_ntz")


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Candle CSVs under a folder tree; bad numbers become 0, bad times null."""
    raw = spark.read.schema(CANDLE_TEXT).option("header", True).option("recursiveFileLookup", True).csv(path)
    out = raw.select(
        "symbol", "interval", _utc("open_time").alias("open_time"), _utc("close_time").alias("close_time"),
        *[number_or(c).alias(c) for c in ("open", "high", "low", "close", "volume")], F.lower("is_closed").isin("true", "1").alias("is_closed"),
    )
    return out.withColumn("as_of", F.coalesce("close_time", "open_time")).na.drop(subset=["as_of", "symbol"])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines files; blank lines and anything but an object are skipped."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value").startswith("{"))
    return raw.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j")).where(
        F.col("j").isNotNull() & F.col("j._bad").isNull()
    ).select("j.*").drop("_bad")


def read_research_rows(spark: SparkSession, path: str, numbers: list[str], flags: list[str] = ()) -> DataFrame:
    """Permissive CSV rows: blanks are null, true/false become booleans, numbers doubles."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    cells = []
    for c in raw.columns:
        if c in numbers:
            cells.append(blank(c).try_cast("double").alias(c))
        elif c in flags:
            low = F.lower(blank(c))
            cells.append(F.when(low == "true", True).when(low == "false", False).alias(c))
        else:
            cells.append(blank(c).alias(c))
    return raw.select(*cells)


def read_rss(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Feed items with a title and a link; the first date tag present counts."""
    schema = "title string, link string, description string, pubDate string, published string, updated string, date string, source string"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    when = F.coalesce("pubDate", "published", "updated", "date")
    parsed = F.coalesce(
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace(when, "^[A-Za-z]{3}, ", ""), " GMT$", " +0000"), F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(when)
    )
    return raw.where((F.trim("title") != "") & (F.trim("link") != "")).select(
        squeeze(F.col("title")).alias("title"), F.trim("link").alias("url"), parsed.alias("published_at"),
        F.concat_ws(" ", "title", "description", "source").alias("raw_text"),
    )


def _num(path: str) -> Column:
    return number_or(F.get_json_object("raw", path))


def derivative_events(rows: DataFrame) -> DataFrame:
    """(data_type, symbol, raw JSON) to metric facts; each type has its own value and clock."""
    kind = F.col("data_type")
    some = lambda p, d: F.coalesce(F.nullif(number_or(F.get_json_object("raw", p)), F.lit(0.0)), F.lit(d))
    is_ratio = kind.isin("global_long_short_account_ratio", "top_long_short_account_ratio", "top_long_short_position_ratio")
    long, short = some("$.longAccount", 0.5), some("$.shortAccount", 0.5)
    buy, sell = _num("$.buyVol"), _num("$.sellVol")
    pressure = F.when(buy + sell > 0, buy / F.when(buy + sell > 0, buy + sell)).otherwise(0.5)
    cell = lambda **kw: F.map_from_arrays(F.array(*[F.lit(k) for k in kw]), F.array(*kw.values()))
    ratio_value = number_or(F.get_json_object("raw", "$.longShortRatio"), 1.0)
    taker_value = number_or(F.get_json_object("raw", "$.buySellRatio"), 1.0)
    interest, worth = _num("$.sumOpenInterest"), _num("$.sumOpenInterestValue")
    payload = (
        F.when(is_ratio, cell(long_short_ratio=ratio_value, long_account_pct=long, short_account_pct=short, long_bias=clamp(long - short)))
        .when(kind == "taker_buy_sell_volume", cell(buy_sell_ratio=taker_value, buy_volume=buy, sell_volume=sell, buy_pressure=pressure, taker_bias=clamp((pressure - 0.5) * 2.0)))
        .when(kind == "open_interest_hist", cell(sum_open_interest=interest, sum_open_interest_value=worth))
        .when(kind == "open_interest", cell(open_interest=_num("$.openInterest")))
        .when(kind == "funding_rate", cell(funding_rate=_num("$.fundingRate"), mark_price=_num("$.markPrice")))
    )
    value = (
        F.when(is_ratio, ratio_value).when(kind == "taker_buy_sell_volume", taker_value)
        .when(kind == "open_interest_hist", F.when(worth != 0, worth).otherwise(interest)).when(kind == "open_interest", _num("$.openInterest"))
        .when(kind == "funding_rate", _num("$.fundingRate"))
    )
    stamp = F.when(kind == "funding_rate", F.get_json_object("raw", "$.fundingTime")).when(
        kind == "open_interest", F.get_json_object("raw", "$.time")
    ).otherwise(F.get_json_object("raw", "$.timestamp"))
    return rows.select(
        *[c for c in rows.columns if c != "raw"], F.timestamp_millis(stamp.try_cast("long")).cast("timestamp_ntz").alias("event_time"),
        value.alias("numeric_value"), payload.alias("payload"),
    )


def _long(rows: DataFrame, carry: list[str], metrics: Mapping[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("data_type"), c.alias("numeric_value")) for n, c in metrics.items()])
    return rows.select(*carry, F.explode(cells).alias("m")).select(*carry, "m.*")


def fear_greed_events(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Index payload ``{"data": [latest, previous]}`` to five metrics."""
    got = F.from_json("raw", "data array<struct<value:string,value_classification:string,timestamp:string>>")
    d = rows.withColumn("d", got["data"])
    latest, before = F.get("d", F.lit(0)), F.get("d", F.lit(1))
    value = number_or(latest["value"])
    moved = value - F.coalesce(before["value"].try_cast("double"), value)
    name = F.lower(F.trim(F.coalesce(latest["value_classification"], F.lit(""))))
    # Score of each class name, most specific first.
    score = (
        F.when(name.contains("extreme fear"), 0.0).when(name.contains("fear"), 25.0).when(name.contains("neutral"), 50.0)
        .when(name.contains("extreme greed"), 100.0).when(name.contains("greed"), 75.0).otherwise(50.0)
    )
    stamped = d.where(F.size("d") > 0).withColumn("event_time", floor_time(F.timestamp_seconds(latest["timestamp"].try_cast("long")), 60))
    return _long(
        stamped, [*carry, "event_time"],
        {"fear_greed_value": value, "fear_greed_change_1d": moved, "fear_greed_change_24h": moved, "fear_greed_classification_score": score, "fear_greed_classification": score},
    )


def global_market_events(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Global totals to ten metrics; two of them compare with the previous stored row."""
    base = {
        "cap": _num("$.data.total_market_cap.usd"), "volume": _num("$.data.total_volume.usd"),
        "cap_change": _num("$.data.market_cap_change_percentage_24h_usd") / 100.0, "btc": _num("$.data.market_cap_percentage.btc") / 100.0,
        "eth": _num("$.data.market_cap_percentage.eth") / 100.0,
    }
    flat = rows.select(*carry, "event_id", "event_time", *[e.alias(n) for n, e in base.items()])
    long = _long(flat, [*carry, "event_id", "event_time"], {"volume": F.col("volume"), "btc": F.col("btc")}).select(
        F.lit("global").alias("source_name"), "data_type", F.lit(None).cast("string").alias("symbol"), "event_id", "event_time", "numeric_value"
    )
    moved = previous_change(long).groupBy("event_id").agg(
        F.max(F.when(F.col("data_type") == "volume", zero(F.col("value_change_pct")))).alias("volume_change"),
        F.max(F.when(F.col("data_type") == "btc", zero(F.col("value_change")))).alias("btc_change"),
    )
    cols = {
        "global_market_cap_usd": "cap", "total_market_cap_usd": "cap", "global_market_cap_change_24h": "cap_change", "market_cap_change_24h": "cap_change",
        "total_volume_usd": "volume", "total_volume_change_24h": "volume_change", "btc_dominance": "btc", "eth_dominance": "eth",
        "btc_dominance_change": "btc_change", "btc_dominance_change_24h": "btc_change",
    }
    return _long(flat.join(moved, "event_id"), [*carry, "event_id", "event_time"], {n: F.col(c) for n, c in cols.items()})


def stablecoin_events(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Peg payload ``{"peggedAssets": [...]}`` to seven metrics."""
    got = F.from_json("raw", "peggedAssets array<struct<symbol:string,price:double,change_1d:double>>")["peggedAssets"]
    d = rows.withColumn("d", F.coalesce(got, F.array().cast("array<struct<symbol:string,price:double,change_1d:double>>")))
    pick = lambda s: F.get(F.filter("d", lambda a: F.upper(a["symbol"]) == s), F.lit(0))
    usdt, usdc = pick("USDT"), pick("USDC")
    off = lambda c: F.when(c.isNotNull(), F.coalesce(F.nullif(c["price"], F.lit(0.0)), F.lit(1.0)) - 1.0).otherwise(0.0)
    supply = zero(usdt["change_1d"]) + zero(usdc["change_1d"])
    risk = clamp(F.greatest(F.abs(off(usdt)), F.abs(off(usdc))) / 0.01, 0.0, 1.0)
    return _long(
        d, carry,
        {"usdt_price_deviation": off(usdt), "usdc_price_deviation": off(usdc), "usdt_deviation": off(usdt), "usdc_deviation": off(usdc),
         "stablecoin_depeg_risk": risk, "stablecoin_supply_change_1d": supply, "stablecoin_supply_change_24h": supply},
    )


def spot_events(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Ticker and order-book JSON to eleven spot metrics."""
    book = "array<array<double>>"
    d = rows.select(
        *carry, F.from_json("depth", f"bids {book}, asks {book}").alias("b"),
        *[number_or(F.get_json_object("ticker", f"$.{k}")).alias(n) for n, k in {
            "last": "lastPrice", "open": "openPrice", "high": "highPrice", "low": "lowPrice", "volume": "volume", "quote": "quoteVolume", "count": "count",
            "pct": "priceChangePercent", "avg_price": "weightedAvgPrice"}.items()],
    )
    best = lambda side: zero(F.get(F.get(F.col(f"b.{side}"), F.lit(0)), F.lit(0)))
    depth = lambda side: zero(F.aggregate(F.slice(F.col(f"b.{side}"), 1, 5), F.lit(0.0), lambda a, x: a + x[0] * x[1]))
    bid, ask = best("bids"), best("asks")
    both = (bid != 0) & (ask != 0)
    mid = F.when(both, (bid + ask) / 2.0).otherwise(F.col("last"))
    db, da = depth("bids"), depth("asks")
    move = F.col("pct") / 100.0
    return _long(
        d, carry,
        {
            "spot_price_change_24h": move, "spot_volume_24h": F.col("volume"), "spot_quote_volume_24h": F.col("quote"), "spot_trade_count_24h": F.col("count"),
            "spot_weighted_avg_price": F.col("avg_price"), "spot_bid_ask_spread_pct": F.when(both, zero(ratio(ask - bid, mid))).otherwise(0.0),
            "spot_orderbook_imbalance": clamp(zero(ratio(db - da, db + da))), "spot_depth_bid_notional_5": db, "spot_depth_ask_notional_5": da,
            "spot_intraday_range_pct": zero(ratio(F.col("high") - F.col("low"), F.col("open"))),
            "spot_activity_score": clamp(F.abs(move) * 8.0 + F.least(F.col("quote") / 1e9, F.lit(1.0)) + F.least(F.col("count") / 1e6, F.lit(1.0)), 0.0, 3.0),
        },
    )


def kline_arrays(rows: DataFrame, array: str = "kline") -> DataFrame:
    """Positional candle arrays of strings to typed, closed candles."""
    at = lambda i, t: F.get(F.col(array), F.lit(i)).try_cast(t)
    return rows.select(
        *[c for c in rows.columns if c != array], F.timestamp_millis(at(0, "long")).cast("timestamp_ntz").alias("open_time"),
        *[at(i + 1, "double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))],
        F.timestamp_millis(at(6, "long")).cast("timestamp_ntz").alias("close_time"), at(7, "double").alias("quote_volume"), at(8, "long").alias("trades"),
        F.lit(True).alias("is_closed"),
    )


def parse_klines(rows: DataFrame, raw: str = "value") -> DataFrame:
    """Stream messages ``{"data": {"E":…, "k": {…}}}`` to candle rows, closed or live."""
    k = "s: string, i: string, t: long, o: string, h: string, l: string, c: string, v: string, x: boolean"
    j = F.from_json(raw, f"data struct<E: long, k: struct<{k}>>")
    return rows.select(*[c for c in rows.columns if c != raw], j["data"].alias("d")).where(F.col("d.k").isNotNull()).select(
        *[c for c in rows.columns if c != raw], F.upper("d.k.s").alias("symbol"), F.col("d.k.i").alias("interval"),
        F.timestamp_millis(F.col("d.k.t")).alias("open_time"), F.timestamp_millis(F.col("d.E")).alias("event_time"),
        *[F.col(f"d.k.{s}").try_cast("double").alias(n) for s, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))],
        F.coalesce("d.k.x", F.lit(False)).alias("is_closed"),
    )


def parse_force_orders(rows: DataFrame, symbols: list[str], raw: str = "value") -> DataFrame:
    """Forced-order messages of the configured symbols with their notional."""
    get = lambda p: F.get_json_object(raw, p)
    symbol = F.upper(F.coalesce(get("$.data.o.s"), get("$.o.s"), F.lit("")))
    price = F.coalesce(F.nullif(number_or(F.coalesce(get("$.data.o.ap"), get("$.o.ap"))), F.lit(0.0)), number_or(F.coalesce(get("$.data.o.p"), get("$.o.p"))))
    quantity = number_or(F.coalesce(get("$.data.o.q"), get("$.o.q")))
    return rows.select(
        *[c for c in rows.columns if c != raw], symbol.alias("symbol"), F.upper(F.coalesce(get("$.data.o.S"), get("$.o.S"))).alias("side"),
        (price * quantity).alias("notional"), F.timestamp_millis(F.coalesce(get("$.data.E"), get("$.E")).try_cast("long")).alias("event_time"),
    ).where(F.col("symbol").isin(*symbols))


def article_payloads(rows: DataFrame, raw: str = "value") -> DataFrame:
    """``{"articles": [...]}`` payloads to article rows with a title and a link."""
    item = "title: string, url: string, domain: string, language: string, sourcecountry: string"
    j = F.from_json(raw, f"articles array<struct<{item}>>")
    keep = [c for c in rows.columns if c != raw]
    return rows.select(*keep, F.explode(j["articles"]).alias("a")).where((F.trim("a.title") != "") & (F.trim("a.url") != "")).select(
        *keep, F.col("a.title").alias("title"), F.col("a.url").alias("url"),
        F.concat_ws(" ", "a.title", "a.domain", "a.language", "a.sourcecountry").alias("raw_text"),
    )


def bounded_scan(df: DataFrame, time: str, start, end, symbols: list[str] | None = None, closed_only: bool = False) -> DataFrame:
    """Half-open time range, closed candles only if asked, optional symbol list."""
    out = df.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))
    if closed_only:
        out = out.where("is_closed")
    return out.where(F.upper("symbol").isin(*[s.upper() for s in symbols])) if symbols else out


def event_filter(
    events: DataFrame, source_prefix: str | None = None, kinds: list[str] | None = None, symbol: str | None = None, or_market_wide: bool = False, start=None, end=None
) -> DataFrame:
    """Events by optional conditions, all of which must hold: prefix of the source, kinds, symbol (or none at all), and a closed time range.

    Each is a plain comparison, so it reaches the scan.
    """
    out = events
    if source_prefix is not None:
        out = out.where(F.col("source_name").startswith(source_prefix))
    if kinds is not None:
        out = out.where(F.col("data_type").isin(*kinds))
    if symbol is not None:
        same = F.col("symbol") == symbol.upper()
        out = out.where(same | F.col("symbol").isNull() if or_market_wide else same)
    if start is not None:
        out = out.where(F.col("event_time") >= F.lit(start))
    return out.where(F.col("event_time") <= F.lit(end)) if end is not None else out


def sampling_names(rows: DataFrame, time: str = "ts") -> DataFrame:
    """Per symbol the median interval of a series in whole milliseconds (an hour if it has none) and the name of the timeframe it is read as."""
    blocks = range_blocks(rows.select("symbol", time).distinct(), ["symbol"], [time])
    gaps = lag_across(blocks, ["symbol"], [time], {"__p": F.col(time)}).where("__p IS NOT NULL")
    ms = F.floor(micros(time) / 1000) - F.floor(micros("__p") / 1000)
    ranked = value_ranks(gaps.select("symbol", ms.cast("double").alias("gap")).where("gap > 0"), ["symbol"], "gap")
    median = quantiles(ranked, ["symbol"], "gap", {"median": 0.5})
    out = rows.select("symbol").distinct().join(median, "symbol", "left")
    interval = F.coalesce(F.floor("median"), F.lit(3_600_000)).cast("long")
    return out.select("symbol", interval.alias("interval_ms")).withColumn("timeframe", timeframe_name(F.col("interval_ms") / 60000.0))


def news_items(rows: DataFrame, provider: str, raw: str = "value") -> DataFrame:
    """``{"articles": [{"source": {"name"}, "title", "url", "description", "publishedAt"}]}`` payloads as article rows with their symbols."""
    item = "source: struct<name: string>, title: string, url: string, description: string, publishedAt: string"
    keep = [c for c in rows.columns if c != raw]
    flat = rows.select(*keep, F.explode(F.from_json(raw, f"articles array<struct<{item}>>")["articles"]).alias("a"))
    known = flat.where((F.coalesce(F.trim("a.title"), F.lit("")) != "") & (F.coalesce(F.trim("a.url"), F.lit("")) != ""))
    text = F.concat_ws(" ", "a.title", "a.description")
    toks = token_set(text)
    return known.select(
        *keep, F.lit(provider).alias("provider"), F.coalesce(F.nullif(F.trim("a.source.name"), F.lit("")), F.lit(provider)).alias("source"), F.col("a.title").alias("title"), F.col("a.url").alias("url"),
        F.try_to_timestamp("a.publishedAt").cast("timestamp_ntz").alias("published_at"), text.alias("raw_text"),
        labels_where({s: F.arrays_overlap(toks, F.array(*[F.lit(x) for x in names])) for s, names in LIVE_SYMBOLS.items()}).alias("affected_symbols"),
    )


def imported_scores(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """External scores matched by article id, else by link; the id wins."""
    by_id = scores.where(F.col("article_id").isNotNull()).groupBy("article_id").agg(F.max_by("score", "seq").alias("s1"))
    by_url = scores.where(F.col("article_id").isNull()).groupBy("url").agg(F.max_by("score", "seq").alias("s2"))
    return articles.join(by_id, "article_id", "left").join(by_url, "url", "left").withColumn("score", F.coalesce("s1", "s2")).drop("s1", "s2")


def series_to_candles(points: DataFrame, key: str = "symbol", time: str = "ts", price: str = "price") -> DataFrame:
    """A price series as candles: open is the previous close; unique times per key."""
    got = lag_across(range_blocks(points, [key], [time]), [key], [time], {"before": F.col(price)})
    first = F.coalesce("before", F.col(price))
    return got.select(
        key, F.col(time).alias("close_time"), first.alias("open"), F.greatest(first, F.col(price)).alias("high"), F.least(first, F.col(price)).alias("low"),
        F.col(price).alias("close"), zero(change(F.col(price), F.col("before"))).alias("ret"),
    )


def timeframe_name(minutes: Column) -> Column:
    return F.when(minutes <= 7, "5m").when(minutes <= 90, "1h").when(minutes <= 360, "4h").otherwise("1d")
