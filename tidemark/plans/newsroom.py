"""Text scoring, news joins and snapshot queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import lexicon as lx
from tidemark.functions import text as tx
from tidemark.operators import asof, news
from tidemark.plans import bindings as b
from tidemark.plans.registry import common, query, rnd, sql_round


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _hits(values) -> str:
    return f"len(list_intersect(toks, {_list(values)}))"


def _phrases(values, low="low") -> str:
    return "(" + " + ".join(f"CAST(contains({low}, '{v}') AS INTEGER)" for v in values) + ")"


def _any(values, low="low") -> str:
    return "(" + " OR ".join(f"contains({low}, '{v}')" for v in values) + ")"


def _labels(conditions: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in conditions.items()) + "], lambda z: z IS NOT NULL)"


def _lowered(df: DataFrame, shortest: int = 1) -> DataFrame:
    return df.withColumn("low", F.lower("text")).withColumn("toks", tx.token_set(F.col("text"), shortest))


def scored_articles(spark, sf) -> DataFrame:
    counted = _lowered(b.news_rows(spark, sf))
    counted = counted.select("*", *[e.alias(n) for n, e in tx.live_sentiment("low", "toks").items()])
    return counted.select("*", *[e.alias(n) for n, e in tx.live_sentiment_scores().items()])


common(
    "scored",
    f"""
SELECT *, CASE WHEN sentiment_score > 0 THEN 'positive' WHEN sentiment_score < 0 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  CASE WHEN sentiment_score <> 0 THEN least(abs(sentiment_score), 0.75) ELSE 0.5 END AS confidence
FROM (SELECT *, CAST(positive - negative AS DOUBLE) / greatest(positive + negative, 1) AS sentiment_score, least(1, risk_hits / 4) AS risk_score
  FROM (SELECT *, p0 + calm AS positive, greatest(n0 - 2 * calm, 0) AS negative, greatest(r0 - 2 * calm, 0) AS risk_hits
    FROM (SELECT *, {_phrases(lx.LIVE_REDUCING_PHRASES)} AS calm,
        {_hits(lx.LIVE_POSITIVE)} + 2 * {_phrases(lx.LIVE_POSITIVE_PHRASES)} AS p0,
        {_hits(lx.LIVE_NEGATIVE)} + 2 * {_phrases(lx.LIVE_NEGATIVE_PHRASES)} AS n0,
        {_hits(lx.LIVE_RISK)} + {_phrases(lx.LIVE_RISK_PHRASES)} AS r0,
        {_labels({t: f"list_has_any(toks, {_list(w)})" for t, w in lx.LIVE_TOPICS.items()})} AS topics,
        {_labels({t: f"list_has_any(toks, {_list(w)})" for t, w in lx.LIVE_SYMBOLS.items()})} AS affected_symbols
      FROM (SELECT *, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS toks FROM news))))
""",
)


@query(
    "lexicon_sentiment_live",
    f"""SELECT article_id, CAST(positive AS BIGINT) AS positive, CAST(negative AS BIGINT) AS negative, CAST(risk_hits AS BIGINT) AS risk_hits,
    array_to_string(topics, ',') AS topics, array_to_string(affected_symbols, ',') AS affected_symbols, sentiment_label,
    {sql_round(["sentiment_score", "risk_score", "confidence"])} FROM scored""",
    uses="articles news scored",
)
def lexicon_sentiment_live(spark, sf):
    return scored_articles(spark, sf).select(
        "article_id", *[F.col(c).cast("long").alias(c) for c in ("positive", "negative", "risk_hits")],
        F.array_join("topics", ",").alias("topics"), F.array_join("affected_symbols", ",").alias("affected_symbols"), "sentiment_label",
        *[rnd(c).alias(c) for c in ("sentiment_score", "risk_score", "confidence")],
    )


def offline_articles(spark, sf) -> DataFrame:
    low = b.news_rows(spark, sf).withColumn("low", F.lower("text"))
    return low.select("*", *[e.alias(n) for n, e in tx.offline_sentiment("low").items()])


common(
    "offline_scored",
    f"""
SELECT *, greatest(-1, least(1, (positive - negative) / 3)) AS sentiment_score,
  least(1, 0.35 + 0.12 * (positive + negative + len(affected_symbols))) AS sentiment_confidence,
  least(1, 0.15 + 0.15 * len(affected_symbols) + macro_related * 0.25 + regulation_risk_score * 0.2) AS impact_score
FROM (SELECT *, {_phrases(lx.OFFLINE_POSITIVE)} AS positive, {_phrases(lx.OFFLINE_NEGATIVE)} AS negative,
    least(1, {_phrases(lx.OFFLINE_RISK)} / 4) AS risk_score,
    {_labels({s: _any(w) for s, w in lx.OFFLINE_SYMBOLS.items()})} AS affected_symbols,
    CAST({_any(lx.OFFLINE_MACRO)} AS DOUBLE) AS macro_related,
    {", ".join(f"CAST({_any(w)} AS DOUBLE) AS {s[:-4].lower()}_related" for s, w in lx.OFFLINE_SYMBOLS.items())},
    CAST({_any(lx.OFFLINE_REGULATION)} AS DOUBLE) AS regulation_risk_score, CAST({_any(lx.OFFLINE_FED)} AS DOUBLE) AS fed_risk_score,
    CAST({_any(lx.OFFLINE_WAR)} AS DOUBLE) AS war_risk_score, CAST({_any(lx.OFFLINE_SECURITY)} AS DOUBLE) AS security_risk_score,
    CAST({_any(lx.OFFLINE_SECURITY)} AND {_any(lx.OFFLINE_EXCHANGE)} AS DOUBLE) AS exchange_hack_risk_score,
    CAST({_any(lx.OFFLINE_ETF)} AS DOUBLE) AS etf_bullish_score
  FROM (SELECT *, lower(text) AS low FROM news))
""",
)

_OFFLINE = news.NEWS_VALUES + ["sol_related", "bnb_related", "xrp_related"]


@query(
    "lexicon_sentiment_offline",
    f"SELECT article_id, array_to_string(affected_symbols, ',') AS affected_symbols, {sql_round(_OFFLINE)} FROM offline_scored",
    uses="articles news offline_scored",
)
def lexicon_sentiment_offline(spark, sf):
    return offline_articles(spark, sf).select(
        "article_id", F.array_join("affected_symbols", ",").alias("affected_symbols"), *[rnd(c).alias(c) for c in _OFFLINE]
    )


@query(
    "token_counts",
    """SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS BIGINT) AS tokens,
    CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS distinct_tokens FROM documents""",
)
def token_counts(spark, sf):
    df = b.table(spark, sf, "documents")
    return df.select(
        "doc_id", F.size(tx.token_list(F.col("text"), 2)).cast("long").alias("tokens"),
        F.size(tx.token_set(F.col("text"))).cast("long").alias("distinct_tokens"),
    )


def structured_articles(spark, sf) -> DataFrame:
    dup = F.col("article_id") % 9 == 0
    df = _lowered(b.news_rows(spark, sf), 2)
    df = df.withColumn("listed", tx.event_words(F.col("toks")))
    df = df.select("*", *[e.alias(n) for n, e in tx.structured_event("low", "toks", dup, "listed").items()]).drop("listed")
    df = df.select("*", *[e.alias(n) for n, e in tx.structured_event_scores().items()])
    url = F.when(F.col("article_id") % 2 == 0, F.concat(F.lit("https://n/"), F.col("article_id").cast("string")))
    return df.withColumn(
        "source_reliability",
        tx.source_reliability(F.col("source"), url, F.col("published_at"), F.col("available_at"), F.size(tx.token_list(F.col("text"), 2)), dup),
    )


_BOUND = {a: " + ".join(f"len(regexp_extract_all(low, '\\b{k}\\b'))" for k in w) for a, w in lx.EVENT_ASSETS.items()}
_BEST = "greatest(" + ", ".join(_hits(w) for w in lx.EVENT_TYPES.values()) + ")"
common(
    "structured",
    f"""
SELECT *, CASE WHEN severity >= 0.7 THEN 'immediate' WHEN event_type IN ('macro', 'regulatory', 'protocol') THEN 'medium_term' WHEN event_type = 'other' THEN 'unknown' ELSE 'short_term' END AS time_horizon,
  list_transform(asset_hits, lambda a: a.asset) AS affected_assets,
  list_transform(asset_hits, lambda a: {{'asset': a.asset, 'p': greatest(0.05, least(0.95, 0.45 + least(a.hits, 4) * 0.1))}}) AS asset_probabilities
FROM (SELECT *, CASE WHEN sentiment > 0.15 THEN 'bullish' WHEN sentiment < -0.15 THEN 'bearish' WHEN positive > 0 AND negative > 0 THEN 'mixed' ELSE 'neutral' END AS direction,
    greatest(0, least(1, 0.10 + severe * 0.18 + CASE WHEN event_type = 'security_incident' THEN 0.08 ELSE 0 END)) AS severity,
    least(1, 0.10 + event_hits * 0.13 + severe * 0.12 + least(word_count, 500) / 4000) AS importance,
    CASE WHEN is_duplicate THEN 0.10 ELSE 0.35 + least(word_count, 400) / 2000 END AS novelty,
    least(0.85, 0.35 + least(positive + negative + event_hits, 6) * 0.07) AS confidence,
    greatest(0.05, least(0.95, 0.30 + 0.15 + CASE WHEN article_id % 2 = 0 THEN 0.10 ELSE 0 END + 0.08 + 0.07 + least(all_tokens, 200) / 1000 - CASE WHEN is_duplicate THEN 0.20 ELSE 0 END)) AS source_reliability
  FROM (SELECT *, CAST(positive - negative AS DOUBLE) / greatest(1, positive + negative) AS sentiment
    FROM (SELECT *, {_hits(lx.EVENT_POSITIVE)} AS positive, {_hits(lx.EVENT_NEGATIVE)} AS negative, {_hits(lx.EVENT_SEVERE)} AS severe, {_BEST} AS event_hits,
        CASE WHEN {_BEST} = 0 THEN 'other' {" ".join(f"WHEN {_hits(w)} = {_BEST} THEN '{t}'" for t, w in lx.EVENT_TYPES.items())} END AS event_type,
        len(toks) AS word_count, article_id % 9 = 0 AS is_duplicate,
        list_filter([{", ".join(f"{{'asset': '{a}', 'hits': {e}}}" for a, e in _BOUND.items())}], lambda a: a.hits > 0) AS asset_hits
      FROM (SELECT *, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS toks, len(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS all_tokens FROM news))))
""",
)
_STRUCT = ["sentiment", "severity", "importance", "novelty", "confidence", "source_reliability"]


@query(
    "structured_event_rules",
    f"""SELECT article_id, event_type, direction, time_horizon, array_to_string(affected_assets, ',') AS affected_assets,
    array_to_string(list_transform(asset_probabilities, lambda a: a.asset || '=' || CAST(CAST(round(a.p * 100) AS INTEGER) AS VARCHAR)), ',') AS asset_probabilities,
    {sql_round(_STRUCT)} FROM structured""",
    uses="articles news structured",
)
def structured_event_rules(spark, sf):
    return structured_articles(spark, sf).select(
        "article_id", "event_type", "direction", "time_horizon", F.array_join("affected_assets", ",").alias("affected_assets"),
        F.array_join(
            F.transform("asset_probabilities", lambda a: F.concat(a["asset"], F.lit("="), F.round(a["p"] * 100).cast("int").cast("string"))), ","
        ).alias("asset_probabilities"),
        *[rnd(c).alias(c) for c in _STRUCT],
    )


_NUM_SQL = r"regexp_extract_all(s, '(^|[^A-Za-z0-9_])([-+]?\d+(?:,\d{3})*(?:\.\d+)?%?)', 2)"


@query(
    "sentence_claims",
    rf"""WITH s AS (SELECT article_id, unnest(string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s,
        generate_subscripts(string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS i FROM news),
      n AS (SELECT article_id, i, s, {_NUM_SQL} AS nums FROM s),
      k AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY i) AS rn FROM n WHERE len(nums) > 0)
      SELECT article_id, rn AS place, s AS claim, array_to_string(nums, '|') AS numbers FROM k""",
    uses="articles news",
)
def sentence_claims(spark, sf):
    df = b.news_rows(spark, sf).select("article_id", F.posexplode(tx.claims(F.col("text"))).alias("i", "c"))
    return df.select(
        "article_id", (F.col("i") + 1).cast("long").alias("place"), F.col("c.claim").alias("claim"),
        F.array_join("c.numbers", "|").alias("numbers"),
    )


@query(
    "unverified_numbers",
    r"""WITH t AS (SELECT article_id, text AS s, lead(text) OVER (ORDER BY article_id) AS other FROM news),
      c AS (SELECT article_id, regexp_extract_all(s, '(^|[^A-Za-z0-9_])([-+]?\d+(?:,\d{3})*(?:\.\d+)?%?)', 2) AS a,
        regexp_extract_all(other, '(^|[^A-Za-z0-9_])([-+]?\d+(?:,\d{3})*(?:\.\d+)?%?)', 2) AS o FROM t WHERE other IS NOT NULL),
      p AS (SELECT article_id, list_transform(a, lambda v: rtrim(replace(v, ',', ''), '%')) AS a, list_transform(o, lambda v: rtrim(replace(v, ',', ''), '%')) AS o FROM c)
      SELECT article_id, array_to_string(list_filter(a, lambda v, i: NOT list_contains(o, v) AND list_position(a, v) = i), '|') AS missing FROM p WHERE len(list_filter(a, lambda v: NOT list_contains(o, v))) > 0""",
    uses="articles news",
)
def unverified_numbers(spark, sf):
    df = b.news_rows(spark, sf).select("article_id", tx.numbers(F.col("text")).alias("claimed"))
    following = b.news_rows(spark, sf).select((F.col("article_id") - 1).alias("article_id"), F.col("text").alias("other"))
    miss = tx.unverified_numbers(F.col("claimed"), F.col("other"))
    return df.join(following, "article_id").withColumn("m", miss).where(F.size("m") > 0).select(
        "article_id", F.array_join("m", "|").alias("missing")
    )


@query(
    "html_cleaning",
    r"""WITH d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS h FROM pages),
      a AS (SELECT page_id, regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g') AS h FROM d),
      s AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g') AS h FROM a)
      SELECT page_id, trim(regexp_replace(regexp_replace(h, '<[/!?a-zA-Z][^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM s""",
)
def html_cleaning(spark, sf):
    return b.dealt(b.table(spark, sf, "pages")).select("page_id", tx.clean_html(F.col("html")).alias("body"))


@query(
    "keyword_risk_feed",
    "WITH x AS (SELECT article_id, lower(text) AS low, risk_score AS risk, greatest(sentiment_score, 0) AS mood FROM scored), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS data_type, CASE WHEN {_phrases(w)} > 0 THEN least(1, (0.35 + {'mood' if n.startswith('etf') else 'risk'}) * least({_phrases(w)}, 3) / 3) END AS v FROM x"
        for n, w in lx.RISK_FEED.items()
    )
    + ") SELECT data_type, round(coalesce(avg(v), 0), 6) + 0.0 AS numeric_value FROM c GROUP BY data_type",
    uses="articles news scored",
)
def keyword_risk_feed(spark, sf):
    return news.risk_feed(scored_articles(spark, sf)).select("data_type", rnd("numeric_value").alias("numeric_value"))


def market_rows(spark, sf) -> DataFrame:
    return b.candles(spark, sf).select(b.market_symbol().alias("symbol"), F.col("close_time").alias("as_of"), "close")


_WINDOW_OUT = news.NEWS_VALUES + ["recency_weight", "article_count_used"]


@query(
    "news_window_means",
    f"""WITH r AS (SELECT m.symbol, close_time AS as_of FROM candles c JOIN market m ON m.kind = c.symbol),
      j AS (SELECT r.symbol, r.as_of, n.*, exp(-(epoch_us(r.as_of) - epoch_us(n.published_at)) / 3.6e9 / 3) AS w,
        CASE r.symbol WHEN 'BTCUSDT' THEN btc_related WHEN 'ETHUSDT' THEN eth_related WHEN 'SOLUSDT' THEN sol_related WHEN 'BNBUSDT' THEN bnb_related END AS rel
        FROM r JOIN offline_scored n ON n.published_at >= r.as_of - INTERVAL 6 HOURS AND n.published_at <= r.as_of),
      f AS (SELECT *, rel > 0 OR macro_related > 0 AS hit, coalesce(bool_or(rel IS NOT NULL AND (rel > 0 OR macro_related > 0)) OVER (PARTITION BY symbol, as_of), false) AS any_hit FROM j),
      k AS (SELECT * FROM f WHERE NOT any_hit OR hit),
      g AS (SELECT symbol, as_of, {", ".join(f"sum({v} * w) / sum(w) AS {v}" for v in news.NEWS_VALUES)}, max(w) AS recency_weight, CAST(count(*) AS DOUBLE) AS article_count_used
        FROM k GROUP BY symbol, as_of),
      o AS (SELECT r.symbol, r.as_of, {", ".join(f"coalesce({v}, 0) AS {v}" for v in _WINDOW_OUT)} FROM r LEFT JOIN g USING (symbol, as_of))
      SELECT symbol, as_of, {sql_round(_WINDOW_OUT)} FROM o""",
    uses="ticks candles market articles news offline_scored",
)
def news_window_means(spark, sf):
    articles = offline_articles(spark, sf).withColumn("event_time", F.col("published_at"))
    out = news.window_means(market_rows(spark, sf).select("symbol", "as_of"), articles)
    return out.select("symbol", "as_of", *[rnd(v).alias(v) for v in _WINDOW_OUT])


@query(
    "external_event_summary",
    """WITH r AS (SELECT event_id, symbol, event_time AS as_of FROM external WHERE symbol IS NOT NULL)
      SELECT r.event_id, CAST(count(*) AS DOUBLE) AS external_event_count_24h, round(avg(e.numeric_value), 9) + 0.0 AS external_numeric_mean_24h
      FROM r JOIN external e ON (e.symbol IS NULL OR e.symbol = r.symbol) AND e.event_time <= r.as_of AND e.event_time >= r.as_of - INTERVAL 24 HOURS
      GROUP BY r.event_id""",
    uses="external",
)
def external_event_summary(spark, sf):
    events = b.external_events(spark, sf)
    rows = events.where(F.col("symbol").isNotNull()).select("event_id", "symbol", F.col("event_time").alias("as_of"))
    return news.external_summary(rows, events).select(
        "event_id", "external_event_count_24h", rnd("external_numeric_mean_24h", 9).alias("external_numeric_mean_24h")
    )


_AS_OF = "2024-01-01 12:00:00"


def _symbols(spark, sf) -> DataFrame:
    return b.ticks(spark, sf).select(b.market_symbol().alias("symbol")).distinct()


_SNAP = ["sentiment_score", "sentiment_confidence", "risk_score", "impact_score", "recency_weight", "btc_related", "eth_related", "macro_related"]


def _score_snapshot_sql(time: str, newest: int, floor: float) -> str:
    return f"""WITH r AS (SELECT *, ' ' || lower(text) AS sp, greatest({floor}, least(1, 1 - (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us({time})) / 3.6e9 / 48)) AS rec
        FROM scored WHERE {time} <= TIMESTAMP '{_AS_OF}' AND {time} >= TIMESTAMP '{_AS_OF}' - INTERVAL 48 HOURS ORDER BY {time} DESC, article_id DESC LIMIT {newest}),
      f AS (SELECT *, list_contains(affected_symbols, 'BTCUSDT') OR contains(sp, 'bitcoin') OR contains(sp, ' btc') AS btc,
        list_contains(affected_symbols, 'ETHUSDT') OR contains(sp, 'ethereum') OR contains(sp, ' eth') AS eth,
        list_contains(topics, 'macro') OR {_any(lx.MACRO_TERMS, "sp")} AS macro FROM r),
      p AS (SELECT m.symbol, f.*, len(affected_symbols) = 0 OR list_contains(affected_symbols, m.symbol) OR macro AS rel, greatest(rec, 0.01) * confidence AS w FROM market m CROSS JOIN f),
      g AS (SELECT symbol, sum(sentiment_score * w) FILTER (WHERE rel) / sum(w) FILTER (WHERE rel) AS sentiment_score, sum(risk_score * w) FILTER (WHERE rel) / sum(w) FILTER (WHERE rel) AS risk_score,
        sum(confidence * w) FILTER (WHERE rel) / sum(w) FILTER (WHERE rel) AS sentiment_confidence, avg(rec) FILTER (WHERE rel) AS recency_weight,
        CAST(max(btc) AS DOUBLE) AS btc_related, CAST(max(eth) AS DOUBLE) AS eth_related, CAST(max(macro) AS DOUBLE) AS macro_related,
        count(*) FILTER (WHERE rel) AS sentiment_articles_used FROM p GROUP BY symbol),
      o AS (SELECT *, least(1, abs(sentiment_score) * sentiment_confidence * 0.45 + risk_score * 0.4 + recency_weight * 0.15) AS impact_score FROM g)
      SELECT symbol, sentiment_articles_used, {sql_round(_SNAP)} FROM o"""


def _snapshot(df: DataFrame) -> DataFrame:
    return df.select("symbol", "sentiment_articles_used", *[rnd(c).alias(c) for c in _SNAP])


@query("news_snapshot_articles", _score_snapshot_sql("available_at", 200, 0.0), uses="market articles news scored")
def news_snapshot_articles(spark, sf):
    as_of = F.expr(f"timestamp_ntz'{_AS_OF}'")
    return _snapshot(news.scored_snapshot(_symbols(spark, sf), scored_articles(spark, sf), as_of))


@query("news_snapshot_historical", _score_snapshot_sql("published_at", 100, 0.05), uses="market articles news scored")
def news_snapshot_historical(spark, sf):
    as_of = F.expr(f"timestamp_ntz'{_AS_OF}'")
    return _snapshot(
        news.scored_snapshot(_symbols(spark, sf), scored_articles(spark, sf), as_of, time="published_at", newest=100, floor=0.05)
    )


def event_rows(spark, sf) -> DataFrame:
    """Structured events with validation status and an optional external overlay."""
    i = F.col("article_id")
    return structured_articles(spark, sf).select(
        i.alias("event_id"), "article_id", "available_at", "event_type", "direction", "sentiment", "severity", "importance", "novelty",
        "confidence", "source_reliability", "affected_assets", "asset_probabilities",
        F.when(i % 11 == 0, "REJECTED").when(i % 5 == 0, "VALID_WITH_WARNINGS").when(i % 3 == 0, "VALID").alias("validation_status"),
        F.get("affected_assets", F.lit(0)).alias("primary_symbol"),
        (i % 4 == 0).alias("external_available"), (i % 7 == 0).alias("external_failed"),
    )


common(
    "news_events",
    """
SELECT article_id AS event_id, article_id, available_at, event_type, direction, sentiment, severity, importance, novelty, confidence, source_reliability,
  affected_assets, asset_probabilities, CASE WHEN article_id % 11 = 0 THEN 'REJECTED' WHEN article_id % 5 = 0 THEN 'VALID_WITH_WARNINGS' WHEN article_id % 3 = 0 THEN 'VALID' END AS validation_status,
  affected_assets[1] AS primary_symbol, article_id % 4 = 0 AS external_available, article_id % 7 = 0 AS external_failed
FROM structured
""",
)


@query(
    "news_snapshot_structured",
    f"""WITH r AS (SELECT *, least(1, 1 - (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(available_at)) / 3.6e9 / 48) AS rec FROM news_events
        WHERE available_at <= TIMESTAMP '{_AS_OF}' AND available_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 48 HOURS AND (validation_status IS NULL OR validation_status IN ('VALID', 'VALID_WITH_WARNINGS'))
        ORDER BY available_at DESC, event_id DESC LIMIT 200),
      p AS (SELECT m.symbol, r.*, len(affected_assets) = 0 OR event_type IN ('macro', 'regulatory') AS wide,
        list_filter(asset_probabilities, lambda a: a.asset = m.symbol OR a.asset = replace(m.symbol, 'USDT', '')) AS mine FROM market m CROSS JOIN r),
      w AS (SELECT *, wide OR len(mine) > 0 AS rel, greatest(rec, 0.01) * greatest(confidence, 0.05) * greatest(source_reliability, 0.05) *
        greatest(CASE WHEN wide THEN 1.0 ELSE list_max(list_transform(mine, lambda a: a.p)) END, 0.05) AS w FROM p),
      g AS (SELECT symbol, {", ".join(f"sum({c} * w) FILTER (WHERE rel) / sum(w) FILTER (WHERE rel) AS {n}" for c, n in (("sentiment", "sentiment_score"), ("confidence", "sentiment_confidence"), ("severity", "risk_score"), ("importance", "imp"), ("novelty", "nov")))},
        avg(rec) FILTER (WHERE rel) AS recency_weight, CAST(max(list_contains(affected_assets, 'BTC')) AS DOUBLE) AS btc_related, CAST(max(list_contains(affected_assets, 'ETH')) AS DOUBLE) AS eth_related,
        CAST(max(event_type IN ('macro', 'regulatory')) AS DOUBLE) AS macro_related, count(*) FILTER (WHERE rel) AS sentiment_articles_used FROM w GROUP BY symbol),
      o AS (SELECT *, least(1, abs(sentiment_score) * sentiment_confidence * 0.25 + risk_score * 0.3 + imp * 0.3 + nov * 0.1 + recency_weight * 0.05) AS impact_score FROM g)
      SELECT symbol, sentiment_articles_used, {sql_round(_SNAP)} FROM o""",
    uses="market articles news structured news_events",
)
def news_snapshot_structured(spark, sf):
    as_of = F.expr(f"timestamp_ntz'{_AS_OF}'")
    return _snapshot(news.structured_snapshot(_symbols(spark, sf), event_rows(spark, sf), as_of))


_OVERLAY = ["external_ai_confidence", "external_ai_age_seconds", "external_ai_direction_score"]


@query(
    "overlay_direction_snapshot",
    f"""WITH r AS (SELECT *, least(1, 1 - (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(available_at)) / 3.6e9 / 48) AS rec FROM news_events
        WHERE available_at <= TIMESTAMP '{_AS_OF}' AND available_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 48 HOURS AND (validation_status IS NULL OR validation_status = 'VALID')
        ORDER BY available_at DESC, event_id DESC LIMIT 200),
      p AS (SELECT m.symbol, r.* FROM market m JOIN r ON (r.primary_symbol IS NULL AND len(affected_assets) = 0)
        OR r.primary_symbol IN (m.symbol, replace(m.symbol, 'USDT', '')) OR list_has_any(affected_assets, [m.symbol, replace(m.symbol, 'USDT', '')])),
      k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY available_at DESC, event_id DESC) AS rn,
        row_number() OVER (PARTITION BY symbol, external_available ORDER BY available_at DESC, event_id DESC) AS er,
        greatest(rec, 0.01) * greatest(confidence, 0.05) AS w,
        CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END * least(1, greatest(abs(sentiment), importance, severity)) AS d FROM p),
      g AS (SELECT symbol, bool_or(external_available) AS a, bool_or(external_failed AND rn <= 20) AS f,
        sum(d * w) FILTER (WHERE external_available AND er <= 20) / sum(w) FILTER (WHERE external_available AND er <= 20) AS score,
        sum(confidence * w) FILTER (WHERE external_available AND er <= 20) / sum(w) FILTER (WHERE external_available AND er <= 20) AS conf,
        coalesce(max(available_at) FILTER (WHERE external_available), max(available_at)) AS latest FROM k GROUP BY symbol),
      o AS (SELECT m.symbol, coalesce(a, false) AS external_ai_available, NOT coalesce(a, false) AS external_ai_missing, NOT coalesce(a, false) AND coalesce(f, false) AS external_ai_failed,
        coalesce(conf, 0) AS external_ai_confidence, (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(latest)) / 1e6 AS external_ai_age_seconds, coalesce(score, 0) AS external_ai_direction_score
        FROM market m LEFT JOIN g USING (symbol))
      SELECT symbol, external_ai_available, external_ai_missing, external_ai_failed, {sql_round(_OVERLAY)} FROM o""",
    uses="market articles news structured news_events",
)
def overlay_direction_snapshot(spark, sf):
    as_of = F.expr(f"timestamp_ntz'{_AS_OF}'")
    return news.overlay_snapshot(_symbols(spark, sf), event_rows(spark, sf), as_of).select(
        "symbol", "external_ai_available", "external_ai_missing", "external_ai_failed", *[rnd(c).alias(c) for c in _OVERLAY]
    )


@query(
    "latest_news_state",
    f"""WITH e AS (SELECT unnest(affected_symbols) AS symbol, article_id, available_at, sentiment_score, risk_score FROM scored
        WHERE available_at <= TIMESTAMP '{_AS_OF}' AND available_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 48 HOURS),
      k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY available_at DESC, article_id DESC) AS rn FROM e)
      SELECT symbol, round(avg(sentiment_score), 6) + 0.0 AS sentiment_score, round(avg(risk_score), 6) + 0.0 AS risk_score, count(*) AS articles,
      string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY available_at DESC, article_id DESC) FILTER (WHERE rn <= 10) AS newest_articles FROM k GROUP BY symbol""",
    uses="articles news scored",
)
def latest_news_state(spark, sf):
    as_of = F.expr(f"timestamp_ntz'{_AS_OF}'")
    return news.latest_news_state(scored_articles(spark, sf), as_of).select(
        "symbol", rnd("sentiment_score").alias("sentiment_score"), rnd("risk_score").alias("risk_score"), "articles", "newest_articles"
    )


@query(
    "asof_candle_close",
    """WITH r AS (SELECT event_id, event_type AS symbol, ts FROM events)
      SELECT r.event_id, c.close, c.open_time AS candle_time FROM r ASOF LEFT JOIN candles c ON c.symbol = r.symbol AND c.close_time <= r.ts""",
    uses="ticks candles",
)
def asof_candle_close(spark, sf):
    rows = b.ticks(spark, sf).select("event_id", "symbol", "ts")
    return asof.asof_join(
        rows, b.candles(spark, sf), ["symbol"], "ts", "close_time", {"close": "close", "candle_time": "open_time"}
    ).select("event_id", "close", "candle_time")


_CLICKS = "SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'"
_VIEWS = "SELECT event_id AS view_id, user_id, ts, value FROM events WHERE event_type = 'view'"


def _clicks_views(spark, sf):
    e = b.table(spark, sf, "events")
    return (
        e.where(F.col("event_type") == "click").select("event_id", "user_id", "ts"),
        e.where(F.col("event_type") == "view").select(F.col("event_id").alias("view_id"), "user_id", "ts", "value"),
    )


@query(
    "asof_backward_by_user",
    f"""WITH l AS ({_CLICKS}), r AS ({_VIEWS}) SELECT l.event_id, r.view_id, r.value FROM l ASOF LEFT JOIN r ON r.user_id = l.user_id AND r.ts <= l.ts""",
)
def asof_backward_by_user(spark, sf):
    l, r = _clicks_views(spark, sf)
    return asof.asof_join(l, r, ["user_id"], "ts", "ts", {"view_id": "view_id", "value": "value"}, tie=["view_id"]).select("event_id", "view_id", "value")


@query(
    "asof_forward_by_user",
    f"""WITH l AS ({_CLICKS}), r AS ({_VIEWS}) SELECT l.event_id, r.view_id, r.value FROM l ASOF LEFT JOIN r ON r.user_id = l.user_id AND r.ts >= l.ts""",
)
def asof_forward_by_user(spark, sf):
    l, r = _clicks_views(spark, sf)
    return asof.asof_join(
        l, r, ["user_id"], "ts", "ts", {"view_id": "view_id", "value": "value"}, direction="forward", tie=["view_id"]
    ).select("event_id", "view_id", "value")


@query(
    "asof_nearest_with_tolerance",
    f"""WITH l AS ({_CLICKS}), r AS ({_VIEWS}),
      bk AS (SELECT l.event_id, l.ts, r.view_id, epoch_us(l.ts) - epoch_us(r.ts) AS d FROM l ASOF LEFT JOIN r ON r.user_id = l.user_id AND r.ts <= l.ts),
      fw AS (SELECT l.event_id, r.view_id, epoch_us(r.ts) - epoch_us(l.ts) AS d FROM l ASOF LEFT JOIN r ON r.user_id = l.user_id AND r.ts >= l.ts)
      SELECT bk.event_id, CASE WHEN least(coalesce(bk.d, 1e18), coalesce(fw.d, 1e18)) > 6 * 3600 * 1e6 THEN NULL WHEN bk.d IS NULL OR fw.d < bk.d THEN fw.view_id ELSE bk.view_id END AS view_id
      FROM bk JOIN fw USING (event_id)""",
)
def asof_nearest_with_tolerance(spark, sf):
    l, r = _clicks_views(spark, sf)
    return asof.asof_join(
        l, r, ["user_id"], "ts", "ts", {"view_id": "view_id"}, direction="nearest", tolerance_seconds=6 * 3600, tie=["view_id"]
    ).select("event_id", "view_id")
