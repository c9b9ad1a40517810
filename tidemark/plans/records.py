"""Feeds, observation files, shadow lists, rewards, gates, and feature vectors by schema version."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import lexicon as lx, schema as fs
from tidemark.operators import documents as dc, lifecycle as lc, quality as q, records as rc
from tidemark.plans import bindings as b
from tidemark.plans.library import _label_rows
from tidemark.plans.registry import SQL, query, rnd, sql_round
from tidemark.plans.scoring import feature_bank
from tidemark.session import scratch_path
from tidemark.sources import feeds


def _events(spark, sf) -> DataFrame:
    return b.table(spark, sf, "events")


def _k():
    return F.get_json_object("props", "$.k").cast("double")


@query(
    "atom_feed_scan",
    """SELECT 'Story ' || article_id AS title, CASE WHEN article_id % 5 = 0 THEN 'urn:' || article_id ELSE 'https://n/' || article_id END AS url, available_at AS published_at, 'Story ' || article_id || ' about ' || source AS raw_text
      FROM articles WHERE article_id % 11 <> 0""",
    uses="articles",
)
def atom_feed_scan(spark, sf):
    """Entries with a self and an alternate link, or with an id only; those without a title are left out."""
    i = F.col("article_id").cast("string")
    links = F.when(F.col("article_id") % 5 == 0, "").otherwise(F.concat(F.lit('<link rel="self" href="https://self/"/><link rel="alternate" href="https://n/'), i, F.lit('"/>')))
    title = F.when(F.col("article_id") % 11 != 0, F.concat(F.lit("Story "), i)).otherwise("")
    entry = F.concat(
        F.lit("<entry><title>"), title, F.lit("</title>"), links, F.lit("<id>urn:"), i, F.lit("</id><updated>"), F.date_format("available_at", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("Z</updated><summary>about "), F.col("source"), F.lit("</summary></entry>"),
    )
    path = scratch_path(spark, "atom")
    docs = b.article_rows(spark, sf).groupBy(F.floor(F.col("article_id") / 500).alias("file")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("value"))
    docs.write.partitionBy("file").text(path)
    return rc.read_atom(spark, path).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query(
    "news_item_rows",
    """WITH x AS (SELECT *, split_part(text, chr(10), 1) AS headline FROM news)
      SELECT article_id, CASE WHEN article_id % 9 = 0 THEN 'wire' ELSE source END AS source, headline AS title, 'https://n/' || article_id AS url, available_at AS published_at,
        array_to_string(list_filter([""" + ", ".join(f"CASE WHEN list_has_any(regexp_extract_all(lower(headline), '[a-z0-9]+'), {list(n)}) THEN '{s}' END" for s, n in lx.LIVE_SYMBOLS.items()) + """], lambda z: z IS NOT NULL), ',') AS symbols FROM x WHERE article_id % 7 <> 0""",
    uses="articles news",
)
def news_item_rows(spark, sf):
    """Provider payloads of one article each; one without a link is left out, one without a source is the provider's."""
    i = F.col("article_id")
    item = F.struct(
        F.struct(F.when(i % 9 != 0, F.col("source")).alias("name")).alias("source"), F.col("title"), F.when(i % 7 != 0, F.concat(F.lit("https://n/"), i.cast("string"))).alias("url"),
        F.lit("").alias("description"), F.date_format("available_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
    )
    rows = b.news_rows(spark, sf).select("article_id", F.to_json(F.struct(F.array(item).alias("articles"))).alias("value"))
    return feeds.news_items(rows, "wire").select("article_id", "source", "title", "url", "published_at", F.array_join("affected_symbols", ",").alias("symbols"))


@query(
    "sampling_intervals",
    """WITH d AS (SELECT DISTINCT event_type AS symbol, ts FROM events), g AS (SELECT symbol, (epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) // 1000) AS ms FROM d),
      m AS (SELECT symbol, CAST(floor(coalesce(quantile_cont(ms, 0.5) FILTER (WHERE ms > 0), 3600000)) AS BIGINT) AS interval_ms FROM g GROUP BY symbol)
      SELECT *, CASE WHEN interval_ms / 60000 <= 7 THEN '5m' WHEN interval_ms / 60000 <= 90 THEN '1h' WHEN interval_ms / 60000 <= 360 THEN '4h' ELSE '1d' END AS timeframe FROM m""",
)
def sampling_intervals(spark, sf):
    return feeds.sampling_names(b.ticks(spark, sf))


@query(
    "source_events_selected",
    """SELECT event_id, symbol FROM external WHERE data_type IN ('click', 'view') AND (symbol = 'S3' OR symbol IS NULL) AND event_time >= TIMESTAMP '2024-01-05' AND event_time <= TIMESTAMP '2024-01-19 12:00:00'""",
    uses="external",
)
def source_events_selected(spark, sf):
    import datetime as dt

    found = feeds.event_filter(b.external_events(spark, sf), "fee", ["click", "view"], "s3", True, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 19, 12))
    return found.select("event_id", "symbol")


@query(
    "oos_observation_file",
    "SELECT seq, symbol, round(prediction, 9) + 0.0 AS prediction, CASE WHEN seq % 7 <> 0 THEN round(actual_return, 9) + 0.0 END AS actual_return FROM observations",
    uses="observations",
)
def oos_observation_file(spark, sf):
    """Written twice (the second time nothing changes), then read back; a NaN becomes null."""
    path = scratch_path(spark, "oos")
    rows = b.observation_rows(spark, sf).select("seq", "symbol", "prediction", F.when(F.col("seq") % 7 != 0, F.col("actual_return")).otherwise(F.lit(float("nan"))).alias("actual_return"))
    rc.write_observations(rows, path)
    rc.write_observations(rows.repartition(5), path)
    back = spark.read.schema("seq long, symbol string, prediction double, actual_return double").json(path)
    return back.select("seq", "symbol", rnd("prediction", 9).alias("prediction"), rnd("actual_return", 9).alias("actual_return"))


@query(
    "window_article_first",
    """WITH w AS (SELECT *, CASE WHEN article_id % 6 <> 0 THEN 'https://n/' || (article_id % 400) ELSE '' END AS url, CASE WHEN article_id % 30 <> 0 THEN 'T' || (article_id % 90) ELSE '' END AS title,
        time_bucket(INTERVAL 1 DAY, published_at) AS day FROM articles),
      f AS (SELECT article_id AS place, url, title, day AS seen, unnest([epoch_ms(day) // 43200000, epoch_ms(day) // 43200000 + 1]) AS win FROM w),
      k AS (SELECT *, CASE WHEN url <> '' THEN url ELSE title || ':' || strftime(seen, '%Y-%m-%d %H:%M:%S') END AS key FROM f WHERE url <> '' OR title <> '')
      SELECT sha256(key) AS article_id, win AS window, place, url, title FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY win, place) = 1""",
    uses="articles",
)
def window_article_first(spark, sf):
    """Every article is found by two overlapping windows."""
    i = F.col("article_id")
    day = F.date_trunc("day", "published_at").cast("timestamp_ntz")
    half = F.floor(F.unix_seconds(day.cast("timestamp")) / 43200)
    rows = b.article_rows(spark, sf).select(
        i.alias("place"), F.when(i % 6 != 0, F.concat(F.lit("https://n/"), (i % 400).cast("string"))).otherwise("").alias("url"),
        F.when(i % 30 != 0, F.concat(F.lit("T"), (i % 90).cast("string"))).otherwise("").alias("title"), day.alias("published_at"), F.explode(F.array(half, half + 1)).alias("window"),
    )
    return rc.window_articles(rows).select("article_id", "window", "place", "url", "title")


@query(
    "shadow_predictions_list",
    """WITH s AS (SELECT event_id AS shadow_id, user_id % 60 AS model_version_id, 'd' || (event_id % 3000) AS trace_id, ts AS generated_at FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 50),
      m AS (SELECT n_nationkey AS model_version_id, n_name AS model FROM nation),
      e AS (SELECT 'd' || o_orderkey AS trace_id, o_orderkey * 10 + l_linenumber AS ensemble_id, l_shipdate AS made, l_returnflag AS status, l_discount AS ret FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, o_orderkey * 10 + l_linenumber DESC) = 1)
      SELECT shadow_id, model, ensemble_id, status AS ensemble_status, ret AS combined_expected_return FROM s LEFT JOIN m USING (model_version_id) LEFT JOIN e USING (trace_id)""",
)
def shadow_predictions_list(spark, sf):
    shadows = _events(spark, sf).where("event_type = 'view'").select(
        F.col("event_id").alias("shadow_id"), (F.col("user_id") % 60).alias("model_version_id"), F.concat(F.lit("d"), (F.col("event_id") % 3000).cast("string")).alias("trace_id"), F.col("ts").alias("generated_at")
    )
    models = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("model_version_id"), F.col("n_name").alias("model"))
    made = b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("trace_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ensemble_id"), F.col("l_shipdate").alias("generated_at"),
        F.col("l_returnflag").alias("decision_status"), F.col("l_discount").alias("combined_expected_return"),
    )
    return rc.shadow_list(shadows, models, made).select("shadow_id", "model", "ensemble_id", "ensemble_status", "combined_expected_return")


@query(
    "research_record_union",
    """SELECT * FROM (SELECT 'model_health' AS record_type, CAST(event_id AS VARCHAR) AS id, event_type AS symbol, CAST(NULL AS VARCHAR) AS name, CASE WHEN event_id % 3 = 0 THEN 'WATCH' ELSE 'HEALTHY' END AS health_status, CAST(NULL AS VARCHAR) AS lifecycle_status, CAST(NULL AS BOOLEAN) AS approved, ts AS created_at FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 40)
      UNION ALL SELECT * FROM (SELECT 'promotion_decisions', CAST(o_orderkey AS VARCHAR), NULL, NULL, NULL, o_orderstatus, o_orderkey % 2 = 0, o_orderdate FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 40)
      UNION ALL SELECT * FROM (SELECT 'strategy_candidates', CAST(c_custkey AS VARCHAR), NULL, c_name, NULL, NULL, NULL, NULL FROM customer ORDER BY CAST(c_custkey AS VARCHAR) DESC LIMIT 40)""",
)
def research_record_union(spark, sf):
    found = rc.research_records({
        "model_health": _events(spark, sf).select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 3 == 0, "WATCH").otherwise("HEALTHY").alias("health_status"), F.col("ts").alias("observed_at")),
        "promotion_decisions": b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("promotion_decision_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("approved"), F.col("o_orderdate").alias("generated_at")),
        "strategy_candidates": b.table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("name")).withColumn("created_at", F.lit(None).cast("timestamp_ntz")),
    }, 40)
    return found.select("record_type", "id", "symbol", "name", "health_status", "lifecycle_status", "approved", "created_at")


@query(
    "decisions_with_features",
    """SELECT d.event_id AS decision_id, d.k, CASE WHEN d.event_id % 4 <> 0 THEN f.quality END AS quality FROM (SELECT * FROM ek ORDER BY ts DESC, event_id DESC LIMIT 80) d LEFT JOIN labels f ON f.doc_id = d.event_id % 700 AND d.event_id % 4 <> 0""",
    uses="ek",
)
def decisions_with_features(spark, sf):
    """The newest decisions, each with the features it was made from, if it names any."""
    from tidemark.operators import lookups as lk

    i = F.col("event_id")
    made = _events(spark, sf).select(i.alias("decision_id"), F.when(i % 4 != 0, i % 700).alias("doc_id"), _k().alias("k"), "ts")
    found = lk.newest_with(made, b.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", [F.desc("ts"), F.desc("decision_id")], 80, "left")
    return found.select("decision_id", "k", "quality")


_REWARD = ["price_change", "movement_pnl", "drawdown_penalty", "reward"]


@query(
    "experience_horizon_rewards",
    f"""WITH x AS (SELECT event_id AS experience_id, event_type AS symbol, ts AS created_at, CASE event_id % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'sell' WHEN 2 THEN 'HOLD' ELSE 'CLOSE' END AS action, CASE WHEN event_id % 3 = 0 THEN 'HELD' ELSE 'FILLED' END AS status,
        value AS entry, CASE WHEN event_id % 5 <> 0 THEN value * 2 END AS notional, value * 0.001 AS fee, k / 100 AS pnl FROM ek WHERE event_id % 10 = 1 AND value > 0),
      h AS (SELECT *, unnest([5, 15, 60]) AS horizon FROM x), d AS (SELECT *, created_at + to_minutes(horizon) AS due FROM h),
      p AS (SELECT d.*, c.close AS price FROM d ASOF JOIN candles c ON c.symbol = d.symbol AND c.open_time >= d.due),
      q AS (SELECT date_trunc('hour', ts) AS marked_at, min(k - 50) / 100 AS drawdown FROM ek GROUP BY 1),
      m AS (SELECT p.*, q.drawdown FROM p ASOF LEFT JOIN q ON q.marked_at >= p.due),
      r AS (SELECT *, (price - entry) / entry AS price_change, CASE upper(action) WHEN 'BUY' THEN 1 WHEN 'HOLD' THEN 0 ELSE -1 END AS side, abs(least(coalesce(drawdown, 0), 0)) * greatest(coalesce(notional, 0), 10) AS drawdown_penalty FROM m),
      o AS (SELECT experience_id, horizon, price_change, price_change * coalesce(notional, 0) * side AS movement_pnl, drawdown_penalty, status, pnl, fee FROM r),
      f AS (SELECT *, CASE WHEN status = 'FILLED' THEN movement_pnl + pnl - fee - drawdown_penalty ELSE 0 END AS reward FROM o)
      SELECT experience_id, horizon, {sql_round(_REWARD, 5)} FROM f""",
    uses="ek ticks candles",
)
def experience_horizon_rewards(spark, sf):
    i, val = F.col("event_id"), F.col("value")
    rows = _events(spark, sf).where((i % 10 == 1) & (val > 0)).select(
        i.alias("experience_id"), F.col("event_type").alias("symbol"), F.col("ts").alias("created_at"), F.when(i % 4 == 0, "BUY").when(i % 4 == 1, "sell").when(i % 4 == 2, "HOLD").otherwise("CLOSE").alias("action"),
        F.when(i % 3 == 0, "HELD").otherwise("FILLED").alias("status"), val.alias("entry_price"), F.when(i % 5 != 0, val * 2).alias("notional"), (val * 0.001).alias("fee"), (_k() / 100).alias("realized_pnl"),
    )
    marks = _events(spark, sf).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("marked_at")).agg((F.min(_k() - 50) / 100).alias("drawdown"))
    out = rc.horizon_rewards(rows, b.candles(spark, sf).select("symbol", "open_time", "close"), marks)
    return out.select("experience_id", "horizon", *[rnd(c, 5).alias(c) for c in _REWARD])


@query(
    "linear_model_evaluation",
    "SELECT count(*) AS rows, round(avg((p - y) ** 2), 9) + 0.0 AS mse, round(avg(abs(p - y)), 9) + 0.0 AS mae, round(avg(CAST(sign(p) = sign(y) AS DOUBLE)), 9) + 0.0 AS sign_agreement FROM (SELECT 0.002 + 0.03 * price_change - 0.02 * volatility AS p, target AS y FROM research_rows)",
    uses="research_rows",
)
def linear_model_evaluation(spark, sf):
    from tidemark.operators.fit import LinearModel
    from tidemark.plans.learning import research_rows

    model = LinearModel(("price_change", "volatility"), (0.03, -0.02), 0.002)
    return rc.linear_evaluation(research_rows(spark, sf), model.predict(), "target").select("rows", *[rnd(c, 9).alias(c) for c in ("mse", "mae", "sign_agreement")])


_REJECTED = SQL["label_validation_rejects"]


@query(
    "label_validation_split",
    _REJECTED.replace("SELECT article_id, concat_ws", ", x AS (SELECT article_id, concat_ws", 1).rstrip()
    + ") SELECT CASE WHEN x.article_id IS NULL THEN 'accepted' ELSE 'rejected' END AS part, count(*) AS rows, CAST(sum(s.article_id) AS BIGINT) AS id_sum FROM structured s LEFT JOIN x USING (article_id) GROUP BY 1",
)
def label_validation_split(spark, sf):
    """Both outputs are written; no label is in both or in neither."""
    path = scratch_path(spark, "labels")
    for name, part in zip(("accepted", "rejected"), rc.split_labels(_label_rows(spark, sf), dc.label_rejects(0.5, True))):
        part.select("article_id").write.parquet(f"{path}/part={name}")
    return spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("article_id").alias("id_sum"))


def _candidates(spark, sf) -> DataFrame:
    """Orders as trained candidates with what acting on them gave."""
    i = F.col("o_orderkey")
    return b.table(spark, sf, "orders").select(
        i.alias("candidate"), ((i % 41 - 15) / F.lit(100.0)).alias("net_return_after_fees"), (i % 400).alias("number_of_trades"), ((i % 29) / F.lit(100.0)).alias("max_drawdown"),
        F.when(i % 37 != 0, (i % 23) / F.lit(12.0)).alias("profit_factor"), ((i % 61) / F.lit(100.0)).alias("simulated_win_rate"), (i % 19).alias("longest_losing_streak"), F.lit(500).alias("test_rows"),
        (i % 400 * 700).alias("labeled_rows"), ((i % 30) / F.lit(2.0)).alias("dataset_days"),
    )


_GATED = """c AS (SELECT o_orderkey AS candidate, (o_orderkey % 41 - 15) / 100 AS ret, o_orderkey % 400 AS trades, (o_orderkey % 29) / 100 AS dd, CASE WHEN o_orderkey % 37 <> 0 THEN (o_orderkey % 23) / 12 END AS pf, (o_orderkey % 61) / 100 AS wr, o_orderkey % 19 AS streak, o_orderkey % 400 * 700 AS n, (o_orderkey % 30) / 2 AS days FROM orders),
      g AS (SELECT *, list_filter([CASE WHEN ret < 0 THEN 'net_return_not_positive' END, CASE WHEN trades < 25 THEN 'too_few_trades' END, CASE WHEN dd > 0.20 THEN 'max_drawdown_too_high' END, CASE WHEN coalesce(pf, 0) < 1.05 THEN 'profit_factor_too_low' END,
        CASE WHEN wr < 0.42 THEN 'win_rate_too_low' END, CASE WHEN streak > 12 THEN 'losing_streak_too_long' END], lambda z: z IS NOT NULL) AS failures, trades > 350 AS busy FROM c)"""


@query(
    "candidate_gate",
    f"""WITH {_GATED} SELECT candidate, array_to_string(failures, ',') AS failures, len(failures) = 0 AS passed, round(greatest(0, 100.0 * (6 - len(failures)) / 6 - CASE WHEN busy THEN 10 ELSE 0 END), 6) + 0.0 AS score,
      CASE WHEN n < 1000 OR days < 1 THEN 'D' WHEN n < 20000 OR days < 3 THEN 'C-' WHEN n < 75000 OR days < 7 THEN 'C/B-' WHEN n < 250000 OR days < 14 THEN 'B' ELSE 'A' END AS readiness FROM g""",
)
def candidate_gate(spark, sf):
    return rc.gate(_candidates(spark, sf)).select("candidate", F.array_join("failures", ",").alias("failures"), "passed", rnd("score").alias("score"), "readiness")


@query(
    "candidate_advice",
    f"""WITH {_GATED}, f AS (SELECT * FROM g WHERE len(failures) > 0 AND days < 3), t AS (SELECT arg_max(failures, (ret, candidate)) AS failures, arg_max(busy, (ret, candidate)) AS busy, max(days) AS days FROM f)
      SELECT concat_ws(';', 'NO_CANDIDATE_PASSED', CASE WHEN days < 3 THEN 'COLLECT_MORE_DAYS' END, 'BEST_FAILED:' || array_to_string(failures, '|'), CASE WHEN busy THEN 'TRADES_TOO_OFTEN' END) AS advice FROM t""",
)
def candidate_advice(spark, sf):
    """The advice on the failed candidates of short data sets."""
    failed = rc.gate(_candidates(spark, sf)).where("NOT passed AND dataset_days < 3")
    return rc.advice(failed, F.col("dataset_days")).select(F.array_join("advice", ";").alias("advice"))


_SMALL = [*fs.NEWS, *fs.MOVES]
_IN_BANK = {"sentiment_score", "sentiment_confidence", "risk_score", "impact_score", "recency_weight", *fs.MOVES}


@query(
    "schema_version_vector",
    f"""SELECT event_id, {len(_SMALL)} AS columns, round({" + ".join(f"CASE WHEN event_id % 4 = 0 THEN 0 ELSE {c} END" if c == "risk_score" else c for c in _SMALL if c in _IN_BANK)} + 1e-12, 6) + 0.0 AS total FROM bank""",
    uses="bank",
)
def schema_version_vector(spark, sf):
    """The vector of a schema version: stored numbers, and defaults for what is null, not finite or not stored."""
    bank = feature_bank(spark, sf)
    gaps = bank.withColumn("risk_score", F.when(F.col("event_id") % 8 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 != 0, F.col("risk_score")))
    whole = fs.with_defaults(gaps.select("event_id", *[c for c in _SMALL if c in bank.columns]), "price-news-v2")
    made = whole.select("event_id", fs.vector("price-news-v2").alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return made.select("event_id", F.size("x").alias("columns"), (F.round(total + F.lit(1e-12), 6) + F.lit(0.0)).alias("total"))


@query(
    "schema_default_fill",
    f"""SELECT event_id, {len(fs.columns_for(None)) + 1} AS columns, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE round(rsi_14 + 1e-12, 6) + 0.0 END AS rsi_14, round(regime_trend_strength + 1e-12, 6) + 0.0 AS regime_trend_strength,
      CASE WHEN event_id % 5 = 0 THEN 0.25 ELSE round(regime_crowd_pressure + 1e-12, 6) + 0.0 END AS regime_crowd_pressure, CAST(0 AS DOUBLE) AS spot_volume_24h FROM regimes""",
    uses="bank regimes",
)
def schema_default_fill(spark, sf):
    """An unknown version is the current one; a stored score stays, a missing one is derived, the rest takes its default."""
    i = F.col("event_id")
    rows = feature_bank(spark, sf).withColumn("rsi_14", F.when(i % 4 != 0, F.col("rsi_14"))).withColumn("regime_crowd_pressure", F.when(i % 5 == 0, 0.25))
    known = [c for c in rows.columns if c in fs.columns_for(None)]
    out = fs.with_defaults(rows.select("event_id", *known), "no such version")
    show = lambda c: (F.round(F.col(c) + F.lit(1e-12), 6) + F.lit(0.0)).alias(c)
    return out.select("event_id", F.lit(len(out.columns)).alias("columns"), show("rsi_14"), show("regime_trend_strength"), show("regime_crowd_pressure"), "spot_volume_24h")


@query(
    "exported_range_deleted",
    """SELECT 'orders' AS table_name, count(*) AS rows FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01')
      UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE NOT (l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01') UNION ALL SELECT 'events', count(*) FROM events""",
)
def exported_range_deleted(spark, sf):
    """What is left of three tables after an exported year is dropped, children first; the kept table loses nothing."""
    import datetime as dt

    tables = {"orders": (b.table(spark, sf, "orders"), "o_orderdate"), "lineitem": (b.table(spark, sf, "lineitem"), "l_shipdate"), "events": (_events(spark, sf), "ts")}
    part = lc.Slice(dt.datetime(1995, 1, 1), dt.datetime(1996, 1, 1))
    facts = q.manifest_facts({"orders": (tables["orders"][0], "o_orderdate", None, ["o_orderkey"])})
    left = lc.delete_range(tables, part, {"lineitem": ["orders"], "orders": [], "events": []}, ["events"], q.manifest_mismatches(facts, facts))
    out = None
    for name, rows in left.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
