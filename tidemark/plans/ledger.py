"""Lineage, attribution, quality and lifecycle queries."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import money as mo
from tidemark.operators import attribution as at
from tidemark.operators import lifecycle as lc
from tidemark.operators import quality as q
from tidemark.plans import bindings as b
from tidemark.plans.registry import common, query, rnd


def total(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast(mo.TOTAL)


def total_sql(name: str, alias: str | None = None) -> str:
    return f"CAST({name} AS DECIMAL(30, 8)) AS {alias or name}"


def _exact(column: str, digits: int = 2) -> Column:
    """A stored double that stands for a decimal of few digits."""
    return F.col(column).cast(f"decimal(14,{digits})")


def ledger(spark, sf) -> dict[str, DataFrame]:
    line, part = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    orders, nation, region = (b.table(spark, sf, t) for t in ("orders", "nation", "region"))
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    trace = F.concat(F.lit("d"), k.cast("string"))
    trades = line.join(part, line.l_partkey == part.p_partkey, "left").select(
        F.col("l_orderkey").alias("order_id"), F.lit(None).cast("long").alias("risk_id"),
        F.when(n % 2 == 0, F.concat(F.lit("d"), F.col("l_orderkey").cast("string"))).alias("trace_id"), F.col("p_brand").alias("symbol"),
        F.when(n != 7, _exact("l_tax") * _exact("l_extendedprice") * F.lit(Decimal("0.01"))).alias("fee"),
        ((_exact("l_discount") - F.lit(Decimal("0.05"))) * _exact("l_extendedprice")).alias("realized_pnl"),
        F.when(n != 6, (_exact("l_discount") - F.lit(Decimal("0.04"))) * _exact("l_extendedprice")).alias("gross_pnl"),
        F.when(F.col("l_returnflag") == "R", "close").when(F.col("l_returnflag") == "A", "open").alias("intent"),
        F.when(F.col("l_linestatus") == "F", "CLOSE").otherwise("BUY").alias("action"), F.col("l_shipdate").alias("created_at"),
        F.when(n == 5, F.create_map(F.lit("ensemble_contribution"), F.col("l_quantity"))).alias("explicit"),
    )
    asked = F.col("o_totalprice") / 1e6 - 0.2
    weights = orders.where(k % 17 != 0).select(
        F.concat(F.lit("e"), k.cast("string")).alias("ensemble_id"), k, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")
    ).select(
        "ensemble_id", F.concat(F.lit("s"), ((k + F.col("i")) % 50).cast("string")).alias("signal_id"),
        F.when((F.col("i") != 2) | (k % 9 != 0), 0.5 / (F.col("i") + 1)).alias("weight"),
    )
    return {
        "trades": trades,
        "orders": orders.select(k.alias("order_id"), F.when(k % 7 != 0, k).alias("risk_id"), F.when(k % 5 != 0, k).alias("target_id"), trace.alias("trace_id")),
        "risks": orders.where(k % 11 != 0).select(
            k.alias("risk_id"), k.alias("target_id"), trace.alias("trace_id"), asked.alias("requested_exposure"),
            F.when(k % 4 == 0, asked).when(k % 4 == 1, asked / 2).when(k % 4 == 2, -asked).otherwise(asked * 1.5).alias("approved_exposure"),
        ),
        "targets": orders.where(k % 13 != 0).select(
            k.alias("target_id"), asked.alias("requested_target_exposure"), F.when(k % 3 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("ensemble_id")
        ),
        "ensembles": orders.where(k % 17 != 0).select(
            F.concat(F.lit("e"), k.cast("string")).alias("ensemble_id"), trace.alias("trace_id"), F.col("o_orderdate").alias("generated_at"),
            F.col("o_orderstatus").alias("regime"),
        ),
        "fills": line.select(
            F.col("l_orderkey").alias("order_id"), (_exact("l_discount") * F.lit(Decimal("0.01"))).alias("slippage"), _exact("l_extendedprice").alias("notional"),
            F.when(F.col("l_linestatus") == "O", _exact("l_tax")).alias("funding"), F.when(n % 4 == 0, -_exact("l_tax") * F.lit(Decimal(10))).alias("funding_cash_flow"),
        ),
        "weights": weights,
        "signals": nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("signal_id"), F.col("r_name").alias("signal_family"),
            F.when(F.col("n_nationkey") % 6 != 0, F.concat(F.lit("p"), F.col("n_nationkey").cast("string"))).alias("prediction_id"),
        ),
        "predictions": nation.select(
            F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("prediction_id"), F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("model_id"),
            F.lit("1").alias("model_version"), (F.col("n_nationkey") % 2 == 0).alias("external_context_available"),
            F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).alias("external_ai_provider"),
        ),
    }


_ASKED = "(o_totalprice / CAST(1e6 AS DOUBLE) - CAST(0.2 AS DOUBLE))"
common(
    "amounts",
    """SELECT * REPLACE (CAST(l_tax AS DECIMAL(6, 2)) AS l_tax, CAST(l_discount AS DECIMAL(6, 2)) AS l_discount, CAST(l_extendedprice AS DECIMAL(14, 2)) AS l_extendedprice,
  CAST(l_quantity AS DECIMAL(20, 8)) AS l_quantity) FROM lineitem""",
)
common(
    "linked",
    f"""
SELECT t.*, coalesce(e1.regime, e2.regime, 'unknown') AS regime, coalesce(e1.ensemble_id, e2.ensemble_id) AS ensemble_id, r.risk_id IS NOT NULL AS has_risk, g.target_id IS NOT NULL AS has_target,
  r.req AS risk_requested, r.app AS risk_approved, g.req AS requested_target_exposure, coalesce(t.trace_id, o.trace_id, r.trace_id) AS link_trace, f.fill_count, f.slippage_cost, f.booked_funding, f.estimated_funding
FROM (SELECT l_orderkey AS order_id, CASE WHEN l_linenumber % 2 = 0 THEN 'd' || l_orderkey END AS trace_id, p_brand AS symbol, CASE WHEN l_linenumber <> 7 THEN CAST(l_tax * l_extendedprice * 0.01 AS DECIMAL(20, 8)) END AS fee,
    CAST((l_discount - 0.05) * l_extendedprice AS DECIMAL(20, 8)) AS realized_pnl, CASE WHEN l_linenumber <> 6 THEN CAST((l_discount - 0.04) * l_extendedprice AS DECIMAL(20, 8)) END AS gross_pnl,
    CASE l_returnflag WHEN 'R' THEN 'close' WHEN 'A' THEN 'open' END AS intent, CASE WHEN l_linestatus = 'F' THEN 'CLOSE' ELSE 'BUY' END AS action, l_shipdate AS created_at,
    CASE WHEN l_linenumber = 5 THEN l_quantity END AS said_ensemble FROM amounts LEFT JOIN part ON p_partkey = l_partkey) t
LEFT JOIN (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS risk_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS target_id, 'd' || o_orderkey AS trace_id FROM orders) o ON o.order_id = t.order_id
LEFT JOIN (SELECT o_orderkey AS risk_id, 'd' || o_orderkey AS trace_id, {_ASKED} AS req, CASE o_orderkey % 4 WHEN 0 THEN {_ASKED} WHEN 1 THEN {_ASKED} / 2 WHEN 2 THEN -{_ASKED} ELSE {_ASKED} * 1.5 END AS app FROM orders WHERE o_orderkey % 11 <> 0) r ON r.risk_id = o.risk_id
LEFT JOIN (SELECT o_orderkey AS target_id, {_ASKED} AS req, CASE WHEN o_orderkey % 3 = 0 THEN 'e' || o_orderkey END AS ensemble_id FROM orders WHERE o_orderkey % 13 <> 0) g ON g.target_id = coalesce(o.target_id, r.risk_id)
LEFT JOIN (SELECT 'e' || o_orderkey AS ensemble_id, o_orderstatus AS regime FROM orders WHERE o_orderkey % 17 <> 0) e1 ON e1.ensemble_id = g.ensemble_id
LEFT JOIN (SELECT 'e' || o_orderkey AS ensemble_id, 'd' || o_orderkey AS trace_id, o_orderstatus AS regime FROM orders WHERE o_orderkey % 17 <> 0) e2 ON e2.trace_id = coalesce(t.trace_id, o.trace_id, r.trace_id)
LEFT JOIN (SELECT l_orderkey, count(*) AS fill_count, sum(CAST(l_discount * 0.01 * l_extendedprice AS DECIMAL(20, 8))) AS slippage_cost, sum(CASE WHEN l_linenumber % 4 = 0 THEN -l_tax * 10 END) AS booked_funding,
    sum(CASE WHEN l_linenumber % 4 <> 0 AND l_linestatus = 'O' THEN -l_tax END) AS estimated_funding FROM amounts GROUP BY l_orderkey) f ON f.l_orderkey = t.order_id
""",
)
common(
    "decomposed",
    """
SELECT *, CAST(total_paper_pnl - coalesce(fees, 0) - coalesce(slippage, 0) - coalesce(funding, 0) - coalesce(ensemble_contribution, 0) - coalesce(alpha_contribution, 0) AS DECIMAL(20, 8)) AS unexplained_residual FROM (
  SELECT *, CAST(-fee AS DECIMAL(20, 8)) AS fees, CASE WHEN fill_count > 0 THEN CAST(-slippage_cost AS DECIMAL(20, 8)) END AS slippage, CAST(booked_funding AS DECIMAL(20, 8)) AS funding, said_ensemble AS ensemble_contribution,
    CASE WHEN gross_pnl IS NOT NULL AND said_ensemble IS NULL THEN CAST(gross_pnl + coalesce(CASE WHEN fill_count > 0 THEN slippage_cost END, 0) AS DECIMAL(20, 8)) END AS alpha_contribution, realized_pnl AS total_paper_pnl FROM linked)
""",
)
common(
    "lw",
    """SELECT 'e' || o_orderkey AS ensemble_id, 's' || ((o_orderkey + i) % 50) AS signal_id, CASE WHEN i <> 2 OR o_orderkey % 9 <> 0 THEN CAST(0.5 AS DOUBLE) / (i + 1) END AS weight
FROM orders, range(3) r(i) WHERE o_orderkey % 17 <> 0""",
)
common(
    "lp",
    """SELECT 's' || n_nationkey AS signal_id, r_name AS family, CASE WHEN n_nationkey % 6 <> 0 THEN 'm' || n_regionkey || ':1' END AS model, n_nationkey % 2 = 0 AS ext, CASE WHEN n_nationkey % 4 = 0 THEN n_name END AS provider
FROM nation JOIN region ON r_regionkey = n_regionkey""",
)


def trades_with_parts(spark, sf) -> DataFrame:
    t = ledger(spark, sf)
    return at.decompose(at.link_lineage(t["trades"], t["orders"], t["risks"], t["targets"], t["ensembles"], t["fills"]))


@query(
    "lineage_links",
    """SELECT order_id, symbol, created_at, link_trace, regime, ensemble_id, coalesce(fill_count, 0) AS fill_count, has_risk, has_target, count(*) AS trades FROM linked GROUP BY ALL""",
    uses="amounts linked",
)
def lineage_links(spark, sf):
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return trades_with_parts(spark, sf).groupBy(
        "order_id", "symbol", "created_at", "link_trace", "regime", "ensemble_id", F.coalesce("fill_count", F.lit(0)).alias("fill_count"), no("has_risk"), no("has_target")
    ).agg(F.count(F.lit(1)).alias("trades"))


_COMP = [*at.COMPONENTS, "unexplained_residual"]
_HAVE = {"fees", "slippage", "funding", "ensemble_contribution", "alpha_contribution", "unexplained_residual"}


@query(
    "pnl_component_totals",
    "WITH c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS component, {c if c in _HAVE else 'CAST(NULL AS DECIMAL(20, 8))'} AS v FROM decomposed" for c in _COMP
    ) + f") SELECT component, {total_sql('coalesce(sum(v), 0)', 'reconciliation_value')}, {total_sql('sum(v)', 'value')}, count(v) AS available_trade_count, count(*) AS trade_count, count(v) / count(*) AS coverage_ratio FROM c GROUP BY component",
    uses="amounts linked decomposed",
)
def pnl_component_totals(spark, sf):
    return at.component_totals(trades_with_parts(spark, sf)).select(
        "component", total("reconciliation_value").alias("reconciliation_value"), total("value").alias("value"), "available_trade_count", "trade_count", "coverage_ratio"
    )


_BUCKET = "CASE WHEN {x} IS NULL THEN 'unattributed' WHEN abs({x}) <= 1e-12 THEN 'flat' WHEN abs({x}) <= 0.05 THEN '0-5pct' WHEN abs({x}) <= 0.10 THEN '5-10pct' WHEN abs({x}) <= 0.25 THEN '10-25pct' WHEN abs({x}) <= 0.5 THEN '25-50pct' ELSE 'over-50pct' END".format(x="requested_target_exposure")
_RESIZE = "CASE WHEN risk_requested IS NULL THEN 'unattributed' WHEN abs(risk_requested - risk_approved) <= greatest(1e-12, 1e-9 * greatest(abs(risk_requested), abs(risk_approved))) THEN 'unchanged' WHEN risk_requested * risk_approved < 0 THEN 'direction_changed' WHEN abs(risk_approved) < abs(risk_requested) THEN 'reduced' ELSE 'increased' END"
_INTENT = "CASE WHEN intent = 'close' THEN 'closed' WHEN intent = 'open' THEN 'open_or_increase' WHEN action = 'CLOSE' THEN 'closed' WHEN abs(gross_pnl) > 1e-12 THEN 'closed_inferred' ELSE 'unknown_legacy' END"
_DIMS = {
    "symbol": "symbol", "regime": "regime", "ensemble": "coalesce(ensemble_id, 'unattributed')", "portfolio_sizing": _BUCKET, "risk_resizing": _RESIZE,
    "period": "strftime(date_trunc('week', created_at), '%Y-%m-%d') || '/week'", "intent": _INTENT,
}


@query(
    "pnl_by_dimension",
    "WITH d AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {e} AS key, total_paper_pnl AS p FROM decomposed" for d, e in _DIMS.items())
    + f") SELECT dimension, key, {total_sql('sum(p)', 'pnl')}, count(*) AS trades FROM d GROUP BY dimension, key",
    uses="amounts linked decomposed",
)
def pnl_by_dimension(spark, sf):
    return at.direct_rollups(trades_with_parts(spark, sf), "week").select("dimension", "key", total("pnl").alias("pnl"), "trades")


@query(
    "pnl_allocated_alpha",
    f"""WITH a AS (SELECT ensemble_id, sum(coalesce(alpha_contribution, 0)) AS alpha FROM decomposed WHERE ensemble_id IS NOT NULL GROUP BY ensemble_id),
      l AS (SELECT lw.signal_id, CAST(CAST(alpha AS DECIMAL(24, 8)) * CAST(weight AS DECIMAL(14, 10)) AS DECIMAL(30, 8)) AS g, family, model, ext, provider, model IS NOT NULL AS got FROM a JOIN lw USING (ensemble_id) LEFT JOIN lp ON lp.signal_id = lw.signal_id),
      d AS (SELECT 'signal' AS dimension, signal_id AS key, g FROM l UNION ALL SELECT 'signal_family', coalesce(family, 'unattributed'), g FROM l UNION ALL SELECT 'model', model, g FROM l WHERE got
        UNION ALL SELECT 'external_availability', CASE WHEN NOT got THEN 'unknown' WHEN ext THEN 'available' ELSE 'unavailable' END, g FROM l
        UNION ALL SELECT 'external_provider', CASE WHEN NOT got THEN 'unknown' WHEN ext AND provider IS NOT NULL THEN provider WHEN ext THEN 'available_provider_unrecorded' ELSE 'unavailable' END, g FROM l)
      SELECT dimension, key, {total_sql('coalesce(sum(g), 0)', 'allocated_alpha')} FROM d GROUP BY dimension, key""",
    uses="amounts linked decomposed lw lp",
)
def pnl_allocated_alpha(spark, sf):
    t = ledger(spark, sf)
    return at.weighted_rollups(trades_with_parts(spark, sf), t["weights"], t["signals"], t["predictions"]).select(
        "dimension", "key", total("allocated_alpha").alias("allocated_alpha")
    )


@query(
    "pnl_evidence_coverage",
    """WITH e AS (SELECT ensemble_id, bool_and(model IS NOT NULL) AS complete, bool_and(model IS NOT NULL AND (NOT ext OR provider IS NOT NULL)) AS prov FROM lw LEFT JOIN lp USING (signal_id) GROUP BY ensemble_id),
      x AS (SELECT d.*, coalesce(complete, false) AS complete, coalesce(prov, false) AS prov FROM decomposed d LEFT JOIN e USING (ensemble_id)),
      c AS (SELECT unnest([{'n': 'decision_trace', 'ok': link_trace IS NOT NULL}, {'n': 'model_signal_lineage', 'ok': complete}, {'n': 'ensemble_weighting', 'ok': ensemble_id IS NOT NULL}, {'n': 'portfolio_sizing', 'ok': has_target},
        {'n': 'risk_resizing', 'ok': has_risk}, {'n': 'execution_fill', 'ok': coalesce(fill_count, 0) > 0}, {'n': 'fees', 'ok': fees IS NOT NULL}, {'n': 'funding_status', 'ok': funding IS NOT NULL OR estimated_funding IS NOT NULL},
        {'n': 'external_ai_status', 'ok': complete AND prov}]) AS f, CAST(abs(total_paper_pnl) AS DECIMAL(20, 8)) AS s FROM x)
      SELECT f.n AS evidence, count(*) FILTER (WHERE f.ok) AS covered_trade_count, count(*) AS trade_count, round(avg(CAST(f.ok AS DOUBLE)), 6) + 0.0 AS trade_ratio, round(CAST(coalesce(sum(s) FILTER (WHERE f.ok), 0) AS DOUBLE) / CAST(sum(s) AS DOUBLE), 6) + 0.0 AS absolute_pnl_ratio FROM c GROUP BY f.n""",
    uses="amounts linked decomposed lw lp",
)
def pnl_evidence_coverage(spark, sf):
    t = ledger(spark, sf)
    lineage = at.ensemble_lineage(t["weights"], t["signals"], t["predictions"])
    return at.coverage(trades_with_parts(spark, sf), lineage).select(
        "evidence", "covered_trade_count", "trade_count", rnd("trade_ratio").alias("trade_ratio"), rnd("absolute_pnl_ratio").alias("absolute_pnl_ratio")
    )


_NOW = "2024-01-28 00:00:00"


def raw_feed(spark, sf) -> DataFrame:
    """Ticks as an unclean one-minute candle feed in event order."""
    i, p = F.col("event_id"), F.col("price")
    return b.ticks(spark, sf).select(
        i.alias("seq"), "symbol", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("open_time"), p.alias("open"),
        F.when(i % 50 == 0, p - 0.5).otherwise(p).alias("high"), p.alias("low"), p.alias("close"), (F.col("quantity") - 2.0).alias("volume"),
    )


common(
    "feed",
    """SELECT event_id AS seq, symbol, date_trunc('minute', ts) AS open_time, price AS open, CASE WHEN event_id % 50 = 0 THEN price - 0.5 ELSE price END AS high, price AS low, price AS close, quantity - 2 AS volume FROM ticks""",
)


@query(
    "candle_feed_issues",
    f"""WITH a AS (SELECT *, lag(open_time) OVER w AS pt, last_value(CASE WHEN close > 0 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc FROM feed WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
      t AS (SELECT *, lag(open_time) OVER w AS pt, lag(struct_pack(o := open, h := high, l := low, c := close, v := volume)) OVER w AS pv FROM feed WINDOW w AS (PARTITION BY symbol ORDER BY open_time, seq)),
      u AS (
        SELECT 'NON_MONOTONIC_TIMESTAMP' AS code, 'ERROR' AS severity, symbol, seq, open_time, CAST(NULL AS BIGINT) AS estimated_missing FROM a WHERE open_time <= pt
        UNION ALL SELECT 'FUTURE_TIMESTAMP', 'ERROR', symbol, seq, open_time, NULL FROM a WHERE open_time > TIMESTAMP '{_NOW}' + INTERVAL 5 SECONDS
        UNION ALL SELECT 'INVALID_OHLC', 'ERROR', symbol, seq, open_time, NULL FROM a WHERE least(open, high, low, close) < 0 OR high < greatest(open, close) OR low > least(open, close) OR high < low
        UNION ALL SELECT 'NEGATIVE_VOLUME', 'ERROR', symbol, seq, open_time, NULL FROM a WHERE volume < 0
        UNION ALL SELECT 'PRICE_OUTLIER', 'WARNING', symbol, seq, open_time, NULL FROM a WHERE pc > 0 AND close > 0 AND abs(close / pc - 1) > 0.5
        UNION ALL SELECT 'DUPLICATE_CANDLE', 'ERROR', symbol, seq, open_time, NULL FROM t WHERE open_time = pt
        UNION ALL SELECT 'REVISED_VALUE', 'WARNING', symbol, seq, open_time, NULL FROM t WHERE open_time = pt AND pv <> struct_pack(o := open, h := high, l := low, c := close, v := volume)
        UNION ALL SELECT 'MISSING_CANDLE_INTERVAL', 'WARNING', symbol, seq, open_time, greatest(CAST(epoch_us(open_time) - epoch_us(pt) AS BIGINT) // 60000000 - 1, 1) FROM t WHERE epoch_us(open_time) - epoch_us(pt) > 90000000
        UNION ALL SELECT 'STALE_FEED', 'ERROR', NULL, NULL, max(open_time), NULL FROM feed HAVING max(open_time) < TIMESTAMP '2024-02-05' - INTERVAL 1 DAY)
      SELECT * FROM u WHERE code <> 'STALE_FEED'""",
    uses="ticks feed",
)
def candle_feed_issues(spark, sf):
    now = F.expr(f"timestamp_ntz'{_NOW}'")
    return q.candle_issues(raw_feed(spark, sf), "seq", now, 60, stale_seconds=86400.0)


@query(
    "candle_gaps",
    """SELECT symbol, pt AS gap_from, open_time AS gap_to, greatest(CAST(epoch_us(open_time) - epoch_us(pt) AS BIGINT) // 60000000 - 1, 1) AS estimated_missing
      FROM (SELECT *, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS pt FROM candles) WHERE epoch_us(open_time) - epoch_us(pt) > 90000000""",
    uses="ticks candles",
)
def candle_gaps(spark, sf):
    return q.candle_gaps(b.candles(spark, sf).select("symbol", "open_time"), 60)


@query(
    "feature_payload_issues",
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 31 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k, value, event_id % 41 = 0 AS extra, event_id % 29 = 0 AS noprov FROM events),
      s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
      SELECT event_id, 'MISSING_REQUIRED_FEATURES' AS code, 'ERROR' AS severity, 'k' AS detail FROM r WHERE k IS NULL
      UNION ALL SELECT event_id, 'SCHEMA_DRIFT', 'WARNING', 'surplus' FROM r WHERE extra
      UNION ALL SELECT event_id, 'MISSING_PROVIDER_DATA', 'WARNING', NULL FROM r WHERE noprov
      UNION ALL SELECT event_id, 'FEATURE_OUTLIER', 'WARNING', 'value' FROM r, s WHERE abs(value - m) / sd > 3""",
)
def feature_payload_issues(spark, sf):
    i = F.col("event_id")
    k = F.when(i % 31 != 0, F.get_json_object("props", "$.k").cast("double"))
    base = F.create_map(F.lit("k"), k, F.lit("value"), F.col("value"))
    events = b.table(spark, sf, "events")
    rows = events.select(
        "event_id", F.when(i % 41 == 0, F.map_concat(base, F.create_map(F.lit("surplus"), F.lit(1.0)))).otherwise(base).alias("values"),
        F.when(i % 29 != 0, "provider").alias("provider"),
    )
    reference = events.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).select(F.lit("value").alias("feature"), "mean", "std")
    return q.feature_issues(rows, "event_id", "values", ["k", "value"], ["k", "value"], reference, max_z=3.0, provider="provider")


@query(
    "news_availability_issues",
    """SELECT article_id, CASE WHEN article_id % 10 = 0 THEN 'MISSING_AVAILABILITY_TIME' ELSE 'FUTURE_NEWS_LEAKAGE' END AS code FROM articles
      WHERE article_id % 10 = 0 OR available_at > published_at + to_minutes(article_id % 14)""",
    uses="articles",
)
def news_availability_issues(spark, sf):
    rows = b.article_rows(spark, sf)
    available = F.when(F.col("article_id") % 10 != 0, F.col("available_at"))
    decision = F.col("published_at") + F.make_dt_interval(mins=(F.col("article_id") % 14).cast("int"))
    return q.news_availability_issues(rows, "article_id", available, decision)


@query(
    "feature_snapshot_checks",
    """SELECT event_id, event_id % 5 = 0 AS leaks, CASE WHEN event_id % 7 = 0 THEN 'k' ELSE '' END AS missing_required, round(greatest(value / 100, k / 50) * 3600, 6) + 0.0 AS oldest_seconds
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""",
)
def feature_snapshot_checks(spark, sf):
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    rows = b.table(spark, sf, "events").withColumn("hours", F.create_map(F.lit("spot"), F.col("value") / 100, F.lit("macro"), k / 50, F.lit("none"), F.lit(None).cast("double")))
    out = q.snapshot_check(
        rows, "event_id", F.when(i % 5 == 0, F.col("ts") + F.expr("interval 1 minute")).otherwise(F.col("ts")), F.col("ts"), "hours",
        {"k": F.when(i % 7 != 0, k)},
    )
    return out.select("event_id", "leaks", F.array_join("missing_required", ",").alias("missing_required"), rnd("oldest_seconds").alias("oldest_seconds"))


#: Every column of a table; times and decimals as whole numbers, which both engines print alike.
_HASHED = {
    "events": ["event_id", "ts_us", "user_id", "event_type", "value_e4", "props"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "price_e2", "date_us", "o_orderpriority"],
    "documents": ["article_id", "source", "provider", "text", "n_chars"],
}


def _tables(spark, sf, lossy: bool = False):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    events = b.table(spark, sf, "events").withColumns({"ts_us": micros("ts"), "value_e4": F.round(F.col("value") * 10_000).cast("long")})
    orders = b.table(spark, sf, "orders").withColumns({"date_us": micros("o_orderdate"), "price_e2": F.round(F.col("o_totalprice") * 100).cast("long")})
    if lossy:
        events = events.where(F.col("event_type") != "error")
    return {
        "events": (events, "ts", "event_type", _HASHED["events"]),
        "orders": (orders, "o_orderdate", "o_orderstatus", _HASHED["orders"]),
        "documents": (b.article_rows(spark, sf), "published_at", None, _HASHED["documents"]),
    }


def _facts_sql(name, src, time, sym, cols):
    h = "concat_ws('|', " + ", ".join(f"coalesce(replace(replace(CAST({c} AS VARCHAR), '\\', '\\\\'), '|', '\\|'), '\\N')" for c in cols) + ")"
    return f"SELECT '{name}' AS table_name, count(*) AS row_count, min({time}) AS first_timestamp, max({time}) AS last_timestamp, {f'count(DISTINCT {sym})' if sym else 'CAST(0 AS BIGINT)'} AS symbols, CAST(sum(CAST('0x' || substr(md5({h}), 1, 15) AS BIGINT)) AS VARCHAR) AS content_hash FROM {src}"


_FACTS = [
    ("events", "(SELECT *, epoch_us(ts) AS ts_us, CAST(round(value * 10000) AS BIGINT) AS value_e4 FROM events)", "ts", "event_type", _HASHED["events"]),
    ("orders", "(SELECT *, epoch_us(o_orderdate) AS date_us, CAST(round(o_totalprice * 100) AS BIGINT) AS price_e2 FROM orders)", "o_orderdate", "o_orderstatus", _HASHED["orders"]),
    ("documents", "articles", "published_at", None, _HASHED["documents"]),
]


@query("manifest_facts", " UNION ALL ".join(_facts_sql(*f) for f in _FACTS), uses="articles")
def manifest_facts(spark, sf):
    return q.manifest_facts(_tables(spark, sf))


@query(
    "export_verification",
    """WITH f AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS kept, min(ts) AS a, min(ts) FILTER (WHERE event_type <> 'error') AS b, max(ts) AS c, max(ts) FILTER (WHERE event_type <> 'error') AS d FROM events)
      SELECT 'events' AS table_name, 'ROW_COUNT_MISMATCH' AS error FROM f WHERE n <> kept UNION ALL SELECT 'events', 'CHECKSUM_MISMATCH' FROM f WHERE n <> kept
      UNION ALL SELECT 'events', 'FIRST_TIMESTAMP_MISMATCH' FROM f WHERE a <> b UNION ALL SELECT 'events', 'LAST_TIMESTAMP_MISMATCH' FROM f WHERE c <> d""",
)
def export_verification(spark, sf):
    """Facts of the tables against those of a lossy copy."""
    manifest = q.manifest_facts(_tables(spark, sf))
    return q.manifest_mismatches(manifest, q.manifest_facts(_tables(spark, sf, lossy=True)))


@query(
    "export_candle_gaps",
    """WITH a AS (SELECT *, lag(open_time) OVER (PARTITION BY symbol ORDER BY seq) AS p FROM feed),
      d AS (SELECT symbol, (epoch_us(open_time) - epoch_us(p)) / 1e6 AS s FROM a WHERE p IS NOT NULL)
      SELECT symbol, count(*) FILTER (WHERE s <= 0) AS order_errors, count(*) FILTER (WHERE s > 90) AS gaps, CAST(coalesce(sum(greatest(round(s / 60) - 1, 1)) FILTER (WHERE s > 90), 0) AS BIGINT) AS missing_intervals FROM d GROUP BY symbol""",
    uses="ticks feed",
)
def export_candle_gaps(spark, sf):
    """Continuity of an export's candles in the order of the file: rows that do not move on, gaps, and the intervals missing in them."""
    return q.continuity(raw_feed(spark, sf), "seq", 60)


@query(
    "manifest_row_issues",
    """WITH m AS (SELECT o_orderkey AS manifest_id, o_orderkey % 4 = 0 AS a, o_orderkey % 6 = 0 AS c, o_orderkey % 8 <> 0 AS w, o_orderkey % 10 = 0 AS u, o_orderkey % 12 = 0 AS split FROM orders)
      SELECT manifest_id, 'MISSING_ROW_COUNTS' AS code FROM m WHERE a UNION ALL SELECT manifest_id, 'MISSING_FILE_CHECKSUMS' FROM m WHERE c AND NOT split
      UNION ALL SELECT manifest_id, 'UNCONFIRMED_FILE_CLOSE' FROM m WHERE NOT w AND NOT split UNION ALL SELECT manifest_id, 'INCOMPLETE_DAILY_BUNDLE' FROM m WHERE u""",
)
def manifest_row_issues(spark, sf):
    k = F.col("o_orderkey")
    some = F.create_map(F.lit("candles"), F.lit(1))
    rows = b.table(spark, sf, "orders").select(
        k.alias("manifest_id"), F.when(k % 4 != 0, some).alias("row_counts"), F.when(k % 6 != 0, some).alias("checksums"), (k % 8 != 0).alias("writers_closed"),
        F.when(k % 10 == 0, F.array(F.lit("2024-01-01"))).otherwise(F.array().cast("array<string>")).alias("unfinished_days"),
        F.when(k % 12 == 0, "daily_split").alias("mode"),
    )
    return q.manifest_issues(rows)


@query(
    "retention_by_cutoff",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' OR o_orderstatus = 'O'""",
)
def retention_by_cutoff(spark, sf):
    rows = b.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return lc.retained(rows, "o_orderdate", F.expr("timestamp_ntz'1997-01-01'"), F.col("o_orderstatus") == "O").select("o_orderkey", "o_orderdate")


@query(
    "blank_text_where_scored",
    """SELECT doc_id, CASE WHEN NOT (doc_id < 600 AND doc_id IN (SELECT doc_id FROM labels)) THEN text END IS NULL AS blanked FROM documents""",
)
def blank_text_where_scored(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    return lc.blank_where(docs, b.table(spark, sf, "labels"), "doc_id", "text", F.col("doc_id") < 600).select("doc_id", F.col("text").isNull().alias("blanked"))


@query(
    "detach_expired_parents",
    """SELECT l.l_orderkey AS child, CASE WHEN o.o_orderkey IS NULL THEN l.l_orderkey END AS parent, count(*) AS n FROM lineitem l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') o ON o.o_orderkey = l.l_orderkey GROUP BY ALL""",
)
def detach_expired_parents(spark, sf):
    children = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("child"), F.col("l_orderkey").alias("parent"))
    expired = b.table(spark, sf, "orders").where(F.col("o_orderdate") < F.expr("timestamp_ntz'1996-01-01'"))
    return lc.detach(children, expired, "parent", "o_orderkey").groupBy("child", "parent").agg(F.count(F.lit(1)).alias("n"))


@query(
    "equity_first_per_hour",
    """SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""",
)
def equity_first_per_hour(spark, sf):
    return lc.first_per_hour(b.table(spark, sf, "events").select("event_type", "event_id", "ts"), ["event_type"], "ts", "event_id")


@query(
    "keyed_upsert",
    """SELECT source_name, data_type, symbol, event_id, numeric_value FROM (SELECT *, row_number() OVER (PARTITION BY source_name, data_type, symbol, date_trunc('hour', event_time) ORDER BY event_id DESC) AS n FROM external) WHERE n = 1""",
    uses="external",
)
def keyed_upsert(spark, sf):
    ext = b.external_events(spark, sf).withColumn("slot", F.date_trunc("hour", "event_time"))
    old, new = ext.where(F.col("event_id") % 2 == 0), ext.where(F.col("event_id") % 2 == 1)
    return lc.upsert(old, new, ["source_name", "data_type", "symbol", "slot"], "event_id").select("source_name", "data_type", "symbol", "event_id", "numeric_value")


@query(
    "payload_compaction",
    """SELECT event_id, 'k' AS value_keys, CASE WHEN event_id % 2 = 0 THEN 'interval' ELSE '' END AS metadata_keys FROM events""",
)
def payload_compaction(spark, sf):
    i = F.col("event_id")
    rows = b.table(spark, sf, "events").select(
        "event_id", F.create_map(F.lit("k"), F.col("props"), F.lit("final_ai_input"), F.col("event_type")).alias("values"),
        F.when(i % 2 == 0, F.create_map(F.lit("interval"), F.lit("1m"), F.lit("debug"), F.lit("x"))).otherwise(F.create_map(F.lit("news_context"), F.lit("y"))).alias("metadata"),
    )
    made = lc.compact_payload("values", "metadata")
    return rows.select("event_id", F.array_join(F.map_keys(made["values"]), ",").alias("value_keys"), F.array_join(F.map_keys(made["metadata"]), ",").alias("metadata_keys"))


@query(
    "handoff_slice",
    """SELECT event_id, ts FROM events WHERE ts >= (SELECT min(ts) FROM events) AND ts < TIMESTAMP '2024-01-20 10:30:00'""",
)
def handoff_slice(spark, sf):
    events = b.table(spark, sf, "events").select("event_id", "ts")
    bounds = events.agg(F.min("ts").alias("first_timestamp"))
    part = lc.next_slice(bounds, None, dt.datetime(2024, 1, 20, 10, 30, 42))
    return lc.in_slice(events, "ts", part)


@query(
    "latest_risk_context",
    """WITH d AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id)
      SELECT e.user_id, round(sum(CASE WHEN e.ts >= date_trunc('day', d.t) THEN k - 50 ELSE 0 END), 6) + 0.0 AS daily_pnl, round(last(abs(k - 50) / 100 ORDER BY e.ts, e.event_id), 6) + 0.0 AS drawdown,
        coalesce(last(k - 50 ORDER BY e.ts, e.event_id) FILTER (WHERE k < 50 AND e.ts >= d.t - INTERVAL 6 HOURS) <= -20, false) AS cooldown
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) e JOIN d USING (user_id) GROUP BY e.user_id""",
)
def latest_risk_context(spark, sf):
    pnl = F.get_json_object("props", "$.k").cast("double") - 50.0
    rows = b.table(spark, sf, "events").select("user_id", "event_id", "ts", pnl.alias("pnl"))
    now = rows.groupBy("user_id").agg(F.max("ts").alias("now"))
    both = rows.join(now, "user_id")
    order = F.struct("ts", "event_id")
    recent_loss = F.when((F.col("pnl") < 0) & (F.col("ts") >= F.col("now") - F.expr("interval 6 hours")), order)
    return both.groupBy("user_id").agg(
        rnd(F.sum(F.when(F.col("ts") >= F.date_trunc("day", "now"), F.col("pnl")).otherwise(0.0))).alias("daily_pnl"),
        rnd(F.max_by(F.abs("pnl") / 100.0, order)).alias("drawdown"),
        F.coalesce(F.max_by("pnl", recent_loss) <= -20, F.lit(False)).alias("cooldown"),
    )
