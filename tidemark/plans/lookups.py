"""Queries of lookups, record unions and loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lookups as lk
from tidemark.plans import bindings as b
from tidemark.plans.registry import common, query


def _events(spark, sf):
    return b.table(spark, sf, "events")


common("half_closed", "SELECT symbol, open_time, close, CASE WHEN symbol = 'error' THEN open_time = (SELECT min(open_time) FROM candles) ELSE true END AS is_closed FROM candles")


@query(
    "usable_candles",
    """SELECT h.symbol, open_time, close, n >= 2 AS quality FROM half_closed h JOIN (SELECT symbol, count(*) FILTER (WHERE is_closed) AS n FROM half_closed GROUP BY symbol) c USING (symbol) WHERE is_closed OR n < 2""",
    uses="ticks candles half_closed",
)
def usable_candles(spark, sf):
    candles = b.candles(spark, sf)
    first = candles.agg(F.min("open_time").alias("first"))
    marked = candles.join(F.broadcast(first), F.lit(True)).withColumn("is_closed", (F.col("symbol") != "error") | (F.col("open_time") == F.col("first")))  # one row
    return lk.usable_candles(marked).select("symbol", "open_time", "close", "quality")


@query(
    "events_with_articles",
    "SELECT event_id, event_type, source, n_chars FROM (SELECT event_id, event_type, event_id % 1500 AS article_id FROM events) LEFT JOIN articles USING (article_id)",
    uses="articles",
)
def events_with_articles(spark, sf):
    rows = _events(spark, sf).select("event_id", "event_type", (F.col("event_id") % 1500).alias("article_id"))
    return lk.with_parent(rows, b.article_rows(spark, sf), "article_id", {"source": "source", "n_chars": "n_chars"}).drop("article_id")


@query(
    "predictions_and_signals",
    """WITH p AS (SELECT event_id AS prediction_id, user_id % 7 AS model, ts FROM events WHERE event_id % 2 = 0),
      s AS (SELECT event_id AS signal_id, CASE WHEN event_id % 9 <> 0 THEN event_id - event_id % 4 + event_id % 3 END AS prediction_id FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0),
      l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY model ORDER BY ts DESC, prediction_id DESC) = 1)
      SELECT model, prediction_id, signal_id FROM l LEFT JOIN s USING (prediction_id) UNION ALL SELECT NULL, prediction_id, signal_id FROM s WHERE prediction_id IS NULL OR prediction_id NOT IN (SELECT prediction_id FROM p)""",
)
def predictions_and_signals(spark, sf):
    e, i = _events(spark, sf), F.col("event_id")
    predictions = e.where(i % 2 == 0).select(i.alias("prediction_id"), (F.col("user_id") % 7).alias("model"), "ts")
    signals = e.where((i % 3 == 0) | (i % 5 == 0)).select(i.alias("signal_id"), F.when(i % 9 != 0, i - i % 4 + i % 3).alias("prediction_id"))
    return lk.predictions_and_signals(predictions, signals, [F.desc("ts"), F.desc("prediction_id")]).select("model", "prediction_id", "signal_id")


@query(
    "decision_lineage",
    """WITH d AS (SELECT event_id AS decision_id, event_id // 3 AS trace, event_type AS symbol FROM events WHERE event_id % 3 = 0),
      r AS (SELECT event_id AS record_id, event_id // 3 AS trace, event_type AS symbol, ts FROM events WHERE event_id % 3 = 1),
      a AS (SELECT trace, symbol, max(record_id) AS same FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY trace, symbol ORDER BY ts DESC, record_id DESC) = 1) GROUP BY ALL),
      n AS (SELECT symbol, record_id AS newest FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, record_id DESC) = 1)
      SELECT decision_id, symbol, coalesce(same, newest) AS record_id, same IS NOT NULL AS lineage_match FROM d LEFT JOIN a USING (trace, symbol) LEFT JOIN n USING (symbol)""",
)
def decision_lineage(spark, sf):
    e, i = _events(spark, sf), F.col("event_id")
    trace = F.floor(i / 3).cast("long").alias("trace")
    decisions = e.where(i % 3 == 0).select(i.alias("decision_id"), trace, F.col("event_type").alias("symbol"))
    records = e.where(i % 3 == 1).select(i.alias("record_id"), trace, F.col("event_type").alias("symbol"), "ts")
    return lk.lineage(decisions, records, [F.desc("ts"), F.desc("record_id")]).select("decision_id", "symbol", "record_id", "lineage_match")


@query(
    "prediction_model_versions",
    """WITH v AS (SELECT o_orderkey AS version_id, o_custkey % 20 AS family, o_orderstatus AS stage, o_orderdate AS made FROM orders),
      p AS (SELECT event_id AS prediction_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS version_id, user_id % 25 AS family, CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'O' END AS stage FROM events),
      n AS (SELECT family, stage, version_id AS newest FROM v QUALIFY row_number() OVER (PARTITION BY family, stage ORDER BY made DESC, version_id DESC) = 1)
      SELECT prediction_id, coalesce(v.version_id, n.newest) AS found_version FROM p LEFT JOIN v USING (version_id) LEFT JOIN n ON n.family = p.family AND n.stage = p.stage""",
)
def prediction_model_versions(spark, sf):
    i = F.col("event_id")
    versions = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("version_id"), (F.col("o_custkey") % 20).alias("family"), F.col("o_orderstatus").alias("stage"), F.col("o_orderdate").alias("made")
    )
    predictions = _events(spark, sf).select(
        i.alias("prediction_id"), F.when(i % 3 == 0, i).alias("version_id"), (F.col("user_id") % 25).alias("family"), F.when(i % 2 == 0, "F").otherwise("O").alias("stage")
    )
    found = lk.model_versions(predictions, versions, ["family", "stage"], [F.desc("made"), F.desc("version_id")])
    return found.select("prediction_id", "found_version")


@query(
    "newest_scores_with_articles",
    """SELECT s.article_id, score, source FROM (SELECT event_id % 500 AS article_id, event_id, value AS score FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100) s JOIN articles USING (article_id)""",
    uses="articles",
)
def newest_scores_with_articles(spark, sf):
    scores = _events(spark, sf).where("event_type = 'purchase'").select((F.col("event_id") % 500).alias("article_id"), "event_id", F.col("value").alias("score"), "ts")
    articles = b.article_rows(spark, sf).select("article_id", "source")
    return lk.newest_with(scores, articles, "article_id", [F.desc("ts"), F.desc("event_id")], 100, "inner").drop("ts", "event_id")


@query(
    "covered_days",
    """SELECT day, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT CAST(ts AS DATE) AS day, 'events' AS source FROM events UNION ALL SELECT CAST(published_at AS DATE), 'news' FROM articles
      UNION ALL SELECT CAST(o_orderdate AS DATE), 'orders' FROM orders) GROUP BY day""",
    uses="articles",
)
def covered_days(spark, sf):
    return lk.days_of({
        "events": (_events(spark, sf), F.col("ts")), "news": (b.article_rows(spark, sf), F.col("published_at")), "orders": (b.table(spark, sf, "orders"), F.col("o_orderdate")),
    })


@query(
    "timeline_overlays",
    """SELECT 'article' AS kind, * FROM (SELECT article_id AS id, published_at AS "at", source AS label FROM articles ORDER BY published_at DESC, article_id DESC LIMIT 40)
      UNION ALL SELECT 'event', * FROM (SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 40)
      UNION ALL SELECT 'order', * FROM (SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40)""",
    uses="articles",
)
def timeline_overlays(spark, sf):
    return lk.newest_of_each_kind({
        "article": b.article_rows(spark, sf).select(F.col("article_id").alias("id"), F.col("published_at").alias("at"), F.col("source").alias("label")),
        "event": _events(spark, sf).select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("label")),
        "order": b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("label")),
    }, 40)


@query(
    "raw_news_export",
    "SELECT article_id, provider, published_at, text FROM articles WHERE published_at >= TIMESTAMP '2024-01-01 02:00:00' AND provider = 'en'",
    uses="articles",
)
def raw_news_export(spark, sf):
    rows = b.article_rows(spark, sf).where((F.col("published_at") >= F.expr("timestamp_ntz'2024-01-01 02:00:00'")) & (F.col("provider") == "en"))
    return rows.select("article_id", "provider", "published_at", "text").orderBy("published_at", "article_id")


@query(
    "model_input_with_fallback",
    "SELECT event_id, k, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 4 <> 0 THEN value / 2 END) AS target FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE event_id % 3 = 0 OR event_id % 4 <> 0",
)
def model_input_with_fallback(spark, sf):
    i = F.col("event_id")
    rows = _events(spark, sf).select(
        "event_id", F.get_json_object("props", "$.k").cast("double").alias("k"), F.when(i % 3 == 0, F.col("value")).alias("t1"), F.when(i % 4 != 0, F.col("value") / 2).alias("t2")
    )
    return lk.labelled_rows(rows, ["event_id", "k"], "t1", "t2")


@query(
    "account_drawdowns",
    """WITH c AS (SELECT o_custkey AS account, o_orderdate, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS change FROM orders),
      e AS (SELECT *, sum(change) OVER w AS equity FROM c WINDOW w AS (PARTITION BY account ORDER BY o_orderdate, o_orderkey)),
      p AS (SELECT *, greatest(max(equity) OVER (PARTITION BY account ORDER BY o_orderdate, o_orderkey), 0) AS peak FROM e)
      SELECT account, o_orderkey, CAST(equity AS BIGINT) AS equity_cents, CAST(peak - equity AS BIGINT) AS drawdown_cents FROM p""",
)
def account_drawdowns(spark, sf):
    rows = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    change = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1) * F.round(F.col("o_totalprice") * 100).cast("long")
    out = lk.drawdowns(rows, "account", ["o_orderdate", "o_orderkey"], change)
    return out.select("account", "o_orderkey", F.col("equity").alias("equity_cents"), F.col("drawdown").alias("drawdown_cents"))
