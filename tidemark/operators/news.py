"""News joined to feature rows: decayed window means and as-of snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions.clock import recency_weight
from tidemark.functions.numeric import clamp, zero
from tidemark.functions.text import any_phrase, base_asset, phrase_hits
from tidemark.operators.asof import asof_join, interval_sums, latest_per_key
from tidemark.session import checkpointed

NEWS_VALUES = [
    "sentiment_score", "sentiment_confidence", "risk_score", "impact_score", "macro_related", "btc_related", "eth_related",
    "regulation_risk_score", "fed_risk_score", "war_risk_score", "security_risk_score", "exchange_hack_risk_score",
    "etf_bullish_score",
]
_SCOPES = ["btc", "eth", "sol", "bnb", "xrp"]


def window_means(rows: DataFrame, news: DataFrame, hours: float = 6.0) -> DataFrame:
    """Exponentially decayed means of the news in [t - hours, t] for every row.

    Rows of a symbol with its own relevance flag use only related or macro news
    when the window holds any, and the whole window otherwise.  Each article is
    counted once per scope it belongs to (at most six); no article-row pairs are
    formed.
    """
    scope = F.lower(F.replace(F.upper("symbol"), F.lit("USDT"), F.lit("")))
    points = rows.select("symbol", "as_of").distinct().withColumn(
        "scope", F.explode(F.array_distinct(F.array(F.lit("all"), F.when(scope.isin(_SCOPES), scope).otherwise("all"))))
    )
    member = F.array_compact(
        F.array(
            F.when(F.lit(True), F.lit("all")),
            *[F.when((F.col(f"{s}_related") > 0) | (F.col("macro_related") > 0), F.lit(s)) for s in _SCOPES],
        )
    )
    # Scores come from whole texts; they are stored once and read by two steps.
    tagged = checkpointed(news.select("event_time", F.explode(member).alias("scope"), *NEWS_VALUES))
    tau = max(hours / 2.0, 1.0) * 3600.0
    sums = interval_sums(
        points, tagged, ["scope"], "as_of", "event_time", int(hours * 3600),
        {"n": F.lit(1.0)},
        {"w": F.lit(1.0), **{f"s_{v}": F.col(v) for v in NEWS_VALUES}},
        tau,
        newest="newest",
    )
    age = F.unix_micros(F.col("as_of").cast("timestamp")) - F.col("newest")
    used = F.round("n")
    facts = F.struct(
        used.alias("n"), F.exp(-age / (tau * 1e6)).alias("recency"),
        *[F.when(used > 0, F.col(f"s_{v}") / F.col("w")).alias(v) for v in NEWS_VALUES],
    )
    wide = sums.groupBy("symbol", "as_of").agg(
        F.first(F.when(F.col("scope") == "all", facts), ignorenulls=True).alias("whole"),
        F.first(F.when((F.col("scope") != "all") & (used > 0), facts), ignorenulls=True).alias("own"),
    )
    pick = F.coalesce("own", "whole")
    out = wide.withColumn("__p", pick).select(
        "symbol", "as_of", *[zero(F.col(f"__p.{v}")).alias(v) for v in NEWS_VALUES],
        zero(F.when(F.col("__p.n") > 0, F.col("__p.recency"))).alias("recency_weight"),
        zero(F.col("__p.n")).alias("article_count_used"),
    )
    return rows.join(out, ["symbol", "as_of"], "left")


def external_summary(rows: DataFrame, events: DataFrame, hours: float = 24.0) -> DataFrame:
    """Count and mean of numeric events of the row's symbol and of the whole market."""
    points = rows.select("symbol", "as_of").distinct().withColumn(
        "scope", F.explode(F.array(F.lit("*"), F.concat(F.lit("="), "symbol")))
    )
    tagged = events.withColumn("scope", F.coalesce(F.concat(F.lit("="), "symbol"), F.lit("*")))
    sums = interval_sums(
        points, tagged, ["scope"], "as_of", "event_time", int(hours * 3600),
        {"n": F.lit(1.0), "total": zero(F.col("numeric_value")), "valid": F.col("numeric_value").isNotNull().cast("int")},
    )
    both = sums.groupBy("symbol", "as_of").agg(*[F.sum(c).alias(c) for c in ("n", "total", "valid")])
    out = both.select(
        "symbol", "as_of", F.round("n").alias("external_event_count_24h"),
        F.when(F.round("valid") > 0, F.col("total") / F.round("valid")).otherwise(0.0).alias("external_numeric_mean_24h"),
    )
    return rows.join(out, ["symbol", "as_of"], "left")


def available_time(*columns: str) -> Column:
    """When an article may be used: availability, else receipt, publication, creation."""
    return F.coalesce(*[F.col(c) for c in columns])


def _facing(symbols: DataFrame, recent: DataFrame) -> DataFrame:
    """Every symbol with the few newest items, carried as one bounded array.

    ``recent`` is already limited to a fixed number of rows, so the packed side
    is a single row of that many items and can be broadcast.
    """
    packed = recent.agg(F.collect_list(F.struct(*recent.columns)).alias("__items")).withColumn("__one", F.lit(0))
    facing = symbols.select("symbol").distinct().withColumn("__one", F.lit(0)).join(F.broadcast(packed), "__one")
    return facing.select("symbol", F.explode_outer("__items").alias("__i")).select("symbol", "__i.*")


def _impact_article(score: Column, confidence: Column, risk: Column, recency: Column) -> Column:
    return clamp(F.abs(score) * confidence * 0.45 + risk * 0.40 + recency * 0.15, 0.0, 1.0)


def scored_snapshot(
    symbols: DataFrame,
    scored: DataFrame,
    as_of: Column,
    time: str = "available_at",
    newest: int = 200,
    floor: float = 0.0,
    hours: float = 48.0,
) -> DataFrame:
    """Article-score news features of each symbol at ``as_of``.

    The newest articles of the last 48 hours are market wide (one top-n), then
    weighed per symbol by recency and confidence.  ``floor`` 0.05 with 100
    articles is the variant used for historical rows.
    """
    t = F.col(time)
    recent = scored.where((t >= as_of - F.make_dt_interval(hours=F.lit(int(hours)))) & (t <= as_of))
    recent = recent.orderBy(F.col(time).desc(), F.col("article_id").desc()).limit(newest)
    low = F.lower("text")
    flags = recent.select(
        "*",
        (F.array_contains("affected_symbols", "BTCUSDT") | any_phrase(F.concat(F.lit(" "), low), ["bitcoin", " btc"])).alias("btc"),
        (F.array_contains("affected_symbols", "ETHUSDT") | any_phrase(F.concat(F.lit(" "), low), ["ethereum", " eth"])).alias("eth"),
        (F.array_contains("topics", "macro") | any_phrase(low, lx.MACRO_TERMS)).alias("macro"),
        recency_weight(t, as_of, hours, floor).alias("recency"),
        F.coalesce("confidence", F.lit(0.5)).alias("conf"),
    )
    pairs = _facing(
        symbols,
        flags.select("article_id", "affected_symbols", "sentiment_score", "risk_score", "btc", "eth", "macro", "recency", "conf"),
    )
    relevant = (F.size("affected_symbols") == 0) | F.array_contains(F.col("affected_symbols"), F.col("symbol")) | F.col("macro")
    w = F.when(relevant, F.greatest("recency", F.lit(0.01)) * F.col("conf"))
    total = F.sum(w)
    flag = lambda c: F.coalesce(F.max(F.col(c).cast("double")), F.lit(0.0))
    out = pairs.groupBy("symbol").agg(
        (F.sum(F.col("sentiment_score") * w) / F.when(total != 0, total).otherwise(1.0)).alias("score"),
        (F.sum(F.col("risk_score") * w) / F.when(total != 0, total).otherwise(1.0)).alias("risk"),
        (F.sum(F.col("conf") * w) / F.when(total != 0, total).otherwise(1.0)).alias("conf"),
        F.avg(F.when(relevant, F.col("recency"))).alias("recency"),
        flag("btc").alias("btc_related"), flag("eth").alias("eth_related"), flag("macro").alias("macro_related"),
        F.count(F.when(relevant, 1)).alias("sentiment_articles_used"),
    )
    return out.select(
        "symbol", clamp(zero(F.col("score"))).alias("sentiment_score"), clamp(zero(F.col("conf")), 0, 1).alias("sentiment_confidence"),
        clamp(zero(F.col("risk")), 0, 1).alias("risk_score"),
        _impact_article(zero(F.col("score")), zero(F.col("conf")), zero(F.col("risk")), zero(F.col("recency"))).alias("impact_score"),
        clamp(zero(F.col("recency")), 0, 1).alias("recency_weight"), "btc_related", "eth_related", "macro_related",
        "sentiment_articles_used",
    )


def _valid(status: Column, accepted: Sequence[str]) -> Column:
    return F.lower(status).isin(*accepted) | status.isNull()


def structured_snapshot(symbols: DataFrame, events: DataFrame, as_of: Column, newest: int = 200, hours: float = 48.0) -> DataFrame:
    """Local structured-event news features of each symbol at ``as_of``."""
    t = F.col("available_at")
    recent = (
        events.where((t >= as_of - F.make_dt_interval(hours=F.lit(int(hours)))) & (t <= as_of))
        .where(_valid(F.col("validation_status"), ["valid", "valid_with_warnings"]))
        .orderBy(t.desc(), F.col("event_id").desc())
        .limit(newest)
        .withColumn("recency", recency_weight(t, as_of, hours))
    )
    pairs = _facing(symbols, recent)
    base = base_asset(F.col("symbol"))
    wide = (F.size("affected_assets") == 0) | F.col("event_type").isin("macro", "regulatory")
    mine = F.filter("asset_probabilities", lambda a: (a["asset"] == F.upper(F.col("symbol"))) | (a["asset"] == base))
    relevant = wide | (F.size(mine) > 0)
    chance = F.when(wide, 1.0).otherwise(F.array_max(F.transform(mine, lambda a: a["p"])))
    weight = F.when(
        relevant,
        F.greatest("recency", F.lit(0.01)) * F.greatest("confidence", F.lit(0.05)) * F.greatest("source_reliability", F.lit(0.05))
        * F.greatest(chance, F.lit(0.05)),
    )
    staged = pairs.withColumn("w", weight).withColumn("rel", relevant)
    total = F.sum("w")
    mean = lambda c: zero(F.sum(F.col(c) * F.col("w")) / F.when(total != 0, total).otherwise(1.0))
    has = lambda a: F.coalesce(F.max(F.arrays_overlap("affected_assets", F.array(F.lit(a), F.lit(a + "USDT"))).cast("double")), F.lit(0.0))
    out = staged.groupBy("symbol").agg(
        *[mean(c).alias(c) for c in ("sentiment", "confidence", "severity", "importance", "novelty")],
        zero(F.avg(F.when(F.col("rel"), F.col("recency")))).alias("recency"),
        has("BTC").alias("btc_related"), has("ETH").alias("eth_related"),
        F.coalesce(F.max(F.col("event_type").isin("macro", "regulatory").cast("double")), F.lit(0.0)).alias("macro_related"),
        F.count(F.when(F.col("rel"), 1)).alias("sentiment_articles_used"),
    )
    impact = clamp(
        F.abs("sentiment") * F.col("confidence") * 0.25 + F.col("severity") * 0.30 + F.col("importance") * 0.30
        + F.col("novelty") * 0.10 + F.col("recency") * 0.05, 0.0, 1.0,
    )
    return out.select(
        "symbol", clamp("sentiment").alias("sentiment_score"), clamp("confidence", 0, 1).alias("sentiment_confidence"),
        clamp("severity", 0, 1).alias("risk_score"),
        F.when(F.col("sentiment_articles_used") > 0, impact).otherwise(0.0).alias("impact_score"),
        clamp("recency", 0, 1).alias("recency_weight"), "btc_related", "eth_related", "macro_related", "sentiment_articles_used",
    )


def overlay_snapshot(symbols: DataFrame, events: DataFrame, as_of: Column, newest: int = 200, used: int = 20, hours: float = 48.0) -> DataFrame:
    """External-overlay direction score from each symbol's newest overlay events."""
    t = F.col("available_at")
    recent = (
        events.where((t >= as_of - F.make_dt_interval(hours=F.lit(int(hours)))) & (t <= as_of))
        .where(_valid(F.col("validation_status"), ["valid"]))
        .orderBy(t.desc(), F.col("event_id").desc())
        .limit(newest)
    )
    pairs = _facing(symbols, recent)
    base = base_asset(F.col("symbol"))
    alias = F.array(F.upper("symbol"), base)
    primary = F.upper(F.coalesce("primary_symbol", F.lit("")))
    relevant = ((primary == "") & (F.size("affected_assets") == 0)) | F.array_contains(alias, primary) | F.arrays_overlap("affected_assets", alias)
    mine = pairs.where(relevant & F.col("event_id").isNotNull())
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.col("available_at").desc(), F.col("event_id").desc()))
    ext_rank = F.row_number().over(
        W.partitionBy("symbol", "external_available").orderBy(F.col("available_at").desc(), F.col("event_id").desc())
    )
    ranked = mine.withColumn("r", rank).withColumn("er", ext_rank)
    sign = F.when(F.lower("direction").isin("bullish", "positive"), 1.0).when(F.lower("direction").isin("bearish", "negative"), -1.0).otherwise(0.0)
    size = clamp(F.greatest(F.abs("sentiment"), "importance", "severity"), 0.0, 1.0)
    conf = clamp("confidence", 0.0, 1.0)
    w = F.when(
        F.col("external_available") & (F.col("er") <= used),
        F.greatest(recency_weight(t, as_of, hours), F.lit(0.01)) * F.greatest(conf, F.lit(0.05)),
    )
    out = ranked.groupBy("symbol").agg(
        F.bool_or("external_available").alias("external_ai_available"),
        F.bool_or(F.col("external_failed") & (F.col("r") <= 20)).alias("any_failed"),
        (F.sum(sign * size * w) / F.sum(w)).alias("score"),
        (F.sum(conf * w) / F.sum(w)).alias("conf"),
        F.max(F.when(F.col("external_available"), t)).alias("latest_ext"),
        F.max(t).alias("latest_any"),
    )
    full = symbols.select("symbol").distinct().join(out, "symbol", "left")
    got = F.coalesce("external_ai_available", F.lit(False))
    chosen = F.coalesce("latest_ext", "latest_any")
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(chosen.cast("timestamp"))) / 1e6
    return full.select(
        "symbol", got.alias("external_ai_available"), (~got).alias("external_ai_missing"),
        (~got & F.coalesce("any_failed", F.lit(False))).alias("external_ai_failed"),
        zero(F.col("conf")).alias("external_ai_confidence"), age.alias("external_ai_age_seconds"),
        clamp(zero(F.col("score"))).alias("external_ai_direction_score"),
    )


def latest_news_state(scored: DataFrame, as_of: Column, hours: float = 48.0) -> DataFrame:
    """Average article scores with at most ten newest titles, per symbol scope."""
    t = F.col("available_at")
    recent = scored.where((t >= as_of - F.make_dt_interval(hours=F.lit(int(hours)))) & (t <= as_of))
    each = recent.withColumn("symbol", F.explode("affected_symbols"))
    top = latest_per_key(each, ["symbol"], [t.desc(), F.col("article_id").desc()], 10)
    lists = top.groupBy("symbol").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(t, "article_id")), asc=False), lambda a: a["article_id"].cast("string")), ","
        ).alias("newest_articles")
    )
    means = each.groupBy("symbol").agg(
        F.avg("sentiment_score").alias("sentiment_score"), F.avg("risk_score").alias("risk_score"), F.count(F.lit(1)).alias("articles")
    )
    return means.join(lists, "symbol")


def risk_feed(articles: DataFrame, newest: int | None = None) -> DataFrame:
    """Mean keyword risk per category over the articles that mention it; 0 if none does."""
    low = F.lower("text")
    risk = F.coalesce(F.col("risk_score"), F.lit(0.25))
    mood = F.greatest(F.coalesce(F.col("sentiment_score"), F.lit(0.0)), F.lit(0.0))
    cells = []
    for name, keywords in lx.RISK_FEED.items():
        hits = phrase_hits(low, keywords)
        lean = mood if name.startswith("etf") else risk
        cells.append(
            F.struct(F.lit(name).alias("data_type"), F.when(hits > 0, clamp((0.35 + lean) * F.least(hits, F.lit(3)) / 3.0, 0, 1)).alias("v"))
        )
    return (
        articles.select(F.explode(F.array(*cells)).alias("c"))
        .groupBy(F.col("c.data_type").alias("data_type"))
        .agg(zero(F.avg("c.v")).alias("numeric_value"))
    )
