"""Evaluation, execution-cost, split and rank queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import ranks
from tidemark.plans import bindings as b
from tidemark.plans.registry import common, query, rnd, sql_round

common(
    "segmented",
    """
SELECT 'all' AS dimension, 'all' AS segment, * FROM observations
UNION ALL SELECT 'symbol', symbol, * FROM observations
UNION ALL SELECT 'model_family', model_family, * FROM observations
UNION ALL SELECT 'regime', regime, * FROM observations WHERE regime IS NOT NULL
UNION ALL SELECT 'external', CASE WHEN external_ai_available THEN 'available' WHEN NOT external_ai_available THEN 'unavailable' ELSE 'unknown' END, * FROM observations
""",
)


def _suite_sql(keys: str) -> str:
    """The metric suite in SQL for a CTE ``src`` (keys, seq, timestamp, prediction, actual, position, cost)."""
    return f"""
    base AS (SELECT {keys}, seq, timestamp AS ts, prediction AS p, actual AS y, position AS pos, cost, position * actual AS gross,
      position * actual - cost AS net FROM src),
    w1 AS (SELECT *, lag(pos, 1, 0.0) OVER w AS ppos, lag(sign(pos)) OVER w AS psign, lag(ts) OVER w AS pts, lead(ts) OVER w AS nts,
      sum(ln(1 + net)) OVER w AS leq, sum(ln(1 + gross)) OVER w AS lgeq,
      row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC, seq DESC) AS rrn,
      rank() OVER (PARTITION BY {keys} ORDER BY p) + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2.0 AS rp,
      rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry
      FROM base WINDOW w AS (PARTITION BY {keys} ORDER BY ts, seq)),
    w2 AS (SELECT *, greatest(0, max(leq) OVER (PARTITION BY {keys} ORDER BY ts, seq)) AS peak,
      epoch_us(ts) - epoch_us(pts) AS gap FROM w1),
    q AS (SELECT {keys}, quantile_cont(net, 0.05) AS var95, quantile_cont(gap, 0.5) FILTER (WHERE gap > 0) AS med FROM w2 GROUP BY {keys}),
    g AS (
      SELECT {keys}, count(*) AS observation_count, count(*) FILTER (WHERE pos <> 0) AS active_observation_count,
        count(*) FILTER (WHERE pos <> 0) / count(*) AS active_rate, corr(p, y) AS information_coefficient,
        corr(rp, ry) AS rank_information_coefficient,
        avg(CAST(sign(p) = sign(y) AS DOUBLE)) FILTER (WHERE pos <> 0) AS directional_hit_rate,
        avg(gross) FILTER (WHERE pos <> 0) AS gross_expectancy, avg(net) FILTER (WHERE pos <> 0) AS net_expectancy,
        avg(gross) AS gross_return_mean, avg(net) AS net_return_mean,
        avg(net) FILTER (WHERE pos <> 0 AND net > 0) AS average_win, avg(net) FILTER (WHERE pos <> 0 AND net < 0) AS average_loss,
        coalesce(sum(net) FILTER (WHERE pos <> 0 AND net > 0), 0) / nullif(abs(sum(net) FILTER (WHERE pos <> 0 AND net < 0)), 0) AS profit_factor,
        exp(max(leq) FILTER (WHERE rrn = 1)) - 1 AS total_return, exp(max(lgeq) FILTER (WHERE rrn = 1)) - 1 AS gross_total_return,
        stddev_samp(net) AS sd, sqrt(avg(least(net, 0) * least(net, 0))) AS dd,
        max(1 - exp(leq - peak)) AS maximum_drawdown, sum(abs(pos - ppos)) AS turnover, avg(abs(pos)) AS exposure,
        (coalesce(sum(epoch_us(nts) - epoch_us(ts)) FILTER (WHERE pos <> 0 AND nts IS NOT NULL), 0) / 1e6
          + count(*) FILTER (WHERE rrn = 1 AND pos <> 0 AND (psign IS NULL OR psign <> sign(pos))))
          / nullif(count(*) FILTER (WHERE pos <> 0 AND (psign IS NULL OR psign <> sign(pos))), 0) AS average_holding_time_seconds,
        sum(cost) AS transaction_cost_total, avg(cost) AS transaction_cost_mean,
        avg(net) FILTER (WHERE net <= var95) AS conditional_value_at_risk_95, min(net) AS worst_return, max(net) AS best_return,
        any_value(var95) AS value_at_risk_95, any_value(med) AS med
      FROM w2 JOIN q USING ({keys}) GROUP BY {keys}),
    h AS (SELECT *, coalesce(greatest(1, 365.25 * 86400 * 1e6 / med), 1) AS annualization_factor FROM g),
    o AS (SELECT *, net_return_mean / nullif(sd, 0) * sqrt(annualization_factor) AS sharpe_ratio,
      net_return_mean / nullif(dd, 0) * sqrt(annualization_factor) AS sortino_ratio,
      CASE WHEN ln(1 + total_return) * annualization_factor / observation_count < 709 THEN exp(ln(1 + total_return) * annualization_factor / observation_count) - 1 END AS annualized_return,
      turnover / observation_count AS average_turnover, greatest(0, -conditional_value_at_risk_95) AS tail_loss_95 FROM h),
    oo AS (SELECT *, CASE WHEN maximum_drawdown > 0 THEN annualized_return / maximum_drawdown END AS calmar_ratio FROM o)"""


# Annualised minute-scale figures are huge; they are compared on a log scale.
_SHOWN = [m for m in ev.METRICS if m not in ("annualized_return", "calmar_ratio", "annualization_factor")]
_LOGGED = ["annualized_return", "calmar_ratio", "annualization_factor"]


def _show(df, keys):
    return df.select(
        *keys, "observation_count", "active_observation_count",
        *[rnd(m).alias(m) for m in _SHOWN],
        *[rnd(F.signum(m) * F.log1p(F.abs(m)), 5).alias(m) for m in _LOGGED],
    )


def _show_sql(keys: str) -> str:
    logged = ", ".join(f"round(sign({m}) * ln(1 + abs({m})), 5) + 0.0 AS {m}" for m in _LOGGED)
    return f"SELECT {keys}, observation_count, active_observation_count, {sql_round(_SHOWN)}, {logged} FROM oo"


@query(
    "evaluation_by_segment",
    f"""WITH src AS (SELECT dimension, segment, seq, timestamp, prediction, actual_return AS actual, CAST(sign(prediction) AS DOUBLE) AS position,
      transaction_cost AS cost FROM segmented), {_suite_sql("dimension, segment")} {_show_sql("dimension, segment")}""",
    uses="observations segmented",
)
def evaluation_by_segment(spark, sf):
    obs = ev.observations(b.observation_rows(spark, sf))
    external = F.when(F.col("external_ai_available"), "available").when(~F.col("external_ai_available"), "unavailable").otherwise("unknown")
    cut = ev.segments(
        obs,
        {"symbol": F.col("symbol"), "model_family": F.col("model_family"), "regime": F.col("regime"), "external": external},
    )
    return _show(ev.evaluate(cut, ["dimension", "segment"]), ["dimension", "segment"])


@query(
    "evaluation_overall",
    f"""WITH src AS (SELECT 'book' AS book, seq, timestamp, prediction, actual_return AS actual, CAST(sign(prediction) AS DOUBLE) AS position,
      transaction_cost AS cost FROM observations), {_suite_sql("book")} {_show_sql("book")}""",
    uses="observations",
)
def evaluation_overall(spark, sf):
    obs = ev.observations(b.observation_rows(spark, sf)).withColumn("book", F.lit("book"))
    return _show(ev.evaluate(obs, ["book"]), ["book"])


@query(
    "transaction_cost_sensitivity",
    f"""WITH t AS (SELECT seq, timestamp, prediction, actual_return AS actual, CAST(sign(prediction) AS DOUBLE) AS position,
        abs(sign(prediction) - coalesce(lag(sign(prediction)) OVER (ORDER BY timestamp, seq), 0)) AS turn FROM observations),
      src AS (SELECT CAST(r AS DOUBLE) AS cost_rate, t.*, CAST(r AS DOUBLE) * turn AS cost FROM t CROSS JOIN (VALUES (0.0), (0.0002), (0.0005), (0.001)) v(r)),
      {_suite_sql("cost_rate")} {_show_sql("cost_rate")}""",
    uses="observations",
)
def transaction_cost_sensitivity(spark, sf):
    obs = ev.observations(b.observation_rows(spark, sf))
    return _show(ev.evaluate(ev.turnover_costs(obs), ["cost_rate"]), ["cost_rate"])


@query(
    "observation_normaliser",
    """SELECT seq, timestamp, round(prediction, 6) + 0.0 AS prediction, round(actual_return, 6) + 0.0 AS actual_return, symbol,
       model_family, regime, round(transaction_cost, 9) + 0.0 AS transaction_cost, external_ai_available FROM observations""",
    uses="observations",
)
def observation_normaliser(spark, sf):
    raw = b.observation_rows(spark, sf).select(
        "seq", F.col("timestamp").alias("decision_time"), F.col("prediction").alias("expected_return"),
        F.col("actual_return").alias("realized_return"), "symbol", "model_family", F.col("regime").alias("market_regime"),
        F.col("transaction_cost").alias("expected_cost"), "external_ai_available",
    )
    return ev.observations(raw).select(
        "seq", "timestamp", rnd("prediction").alias("prediction"), rnd("actual_return").alias("actual_return"), "symbol",
        "model_family", "regime", rnd("transaction_cost", 9).alias("transaction_cost"), "external_ai_available",
    )


@query(
    "leakage_rows",
    """SELECT event_id, ts AS timestamp, ts + to_seconds(CAST(k AS BIGINT) - 60) AS available_to_model_time
       FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k > 60""",
)
def leakage_rows(spark, sf):
    df = b.table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        (F.col("ts") + F.make_dt_interval(secs=F.get_json_object("props", "$.k").cast("decimal(18,6)") - 60)).alias(
            "available_to_model_time"
        ),
    )
    return ev.leakage(df)


@query(
    "average_ranks",
    """SELECT event_type, event_id, rank() OVER (PARTITION BY event_type ORDER BY value)
       + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS avg_rank FROM events""",
)
def average_ranks(spark, sf):
    ev_rows = b.table(spark, sf, "events").select("event_type", "event_id", "value")
    ranked = ranks.value_ranks(ev_rows, ["event_type"], "value").select(
        "event_type", "value", ranks.average_rank().alias("avg_rank")
    )
    return ev_rows.join(ranked, ["event_type", "value"]).select("event_type", "event_id", "avg_rank")


@query(
    "interpolated_quantiles",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95
       FROM events GROUP BY event_type)
       SELECT event_type, round(p05, 6) + 0.0 AS p05, round(p50, 6) + 0.0 AS p50, round(p95, 6) + 0.0 AS p95,
       round((SELECT avg(value) FROM events e WHERE e.event_type = q.event_type AND value <= p05), 6) + 0.0 AS tail_mean FROM q""",
)
def interpolated_quantiles(spark, sf):
    ranked = ranks.value_ranks(b.table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value")
    q = ranks.quantiles(ranked, ["event_type"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    tail = ranked.join(q, "event_type").where(F.col("value") <= F.col("p05")).groupBy("event_type").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("tail_mean")
    )
    return q.join(tail, "event_type").select("event_type", *[rnd(c).alias(c) for c in ("p05", "p50", "p95", "tail_mean")])


@query(
    "kolmogorov_smirnov",
    """WITH v AS (SELECT event_type, value, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS a, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS b
         FROM events GROUP BY ALL),
       c AS (SELECT event_type, sum(a) OVER w / sum(a) OVER (PARTITION BY event_type) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY event_type) AS fb
         FROM v WINDOW w AS (PARTITION BY event_type ORDER BY value))
       SELECT event_type, round(max(abs(fa - fb)), 6) + 0.0 AS ks_distance FROM c GROUP BY event_type""",
)
def kolmogorov_smirnov(spark, sf):
    rows = b.table(spark, sf, "events").select("event_type", "value", "ts")
    out = ranks.ks_distance(rows, ["event_type"], "value", F.col("ts") >= F.expr("timestamp_ntz'2024-01-16'"))
    return out.select("event_type", rnd("ks_distance").alias("ks_distance"))


def _fills_input(spark, sf):
    obs = ev.observations(b.observation_rows(spark, sf))
    s = F.col("seq")
    return (
        obs.withColumn("missing_data", s % 17 == 0)
        .withColumn("symbol_available", s % 23 != 0)
        .withColumn("coverage_changed", s % 29 == 0)
        .withColumn("requested_volume_participation", (s % 10) * 0.05)
    )


_FILL_VALUES = [
    "requested_position", "previous_position", "filled_position", "fill_fraction", "cost_fees", "cost_spread", "cost_slippage",
    "cost_latency", "cost_funding", "cost_market_impact", "total_cost",
]


@query(
    "execution_partial_fills",
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS rn,
        CAST(sign(prediction) AS DOUBLE) AS requested_position, (seq % 17 = 0 OR seq % 23 = 0) AS skipped,
        CASE WHEN (seq % 10) * CAST(0.05 AS DOUBLE) > 0.1 THEN least(CAST(0.8 AS DOUBLE), CAST(0.1 AS DOUBLE) / ((seq % 10) * CAST(0.05 AS DOUBLE))) ELSE CAST(0.8 AS DOUBLE) END AS f FROM observations),
      e AS (SELECT symbol, seq, rn, CAST(0 AS DOUBLE) AS previous_position, CASE WHEN skipped THEN 0 ELSE requested_position * f END AS filled_position FROM r WHERE rn = 1
        UNION ALL SELECT r.symbol, r.seq, r.rn, e.filled_position, CASE WHEN r.skipped THEN 0 ELSE e.filled_position + (r.requested_position - e.filled_position) * r.f END
        FROM e JOIN r ON r.symbol = e.symbol AND r.rn = e.rn + 1),
      t AS (SELECT e.*, r.requested_position, CASE WHEN skipped THEN 0 ELSE f END AS fill_fraction, r.transaction_cost,
        concat_ws(',', CASE WHEN seq % 17 = 0 THEN 'MISSING_DATA_SKIPPED' END, CASE WHEN seq % 23 = 0 THEN 'UNAVAILABLE_SYMBOL_SKIPPED' END,
          CASE WHEN seq % 29 = 0 THEN 'DATA_COVERAGE_CHANGED' END, CASE WHEN (seq % 10) * CAST(0.05 AS DOUBLE) > 0.1 THEN 'VOLUME_PARTICIPATION_CAPPED' END,
          'PARTIAL_FILL_APPLIED') AS reason_codes,
        abs(e.filled_position - e.previous_position) AS turn FROM e JOIN r USING (symbol, seq)),
      o AS (SELECT *, turn * 0.0004 AS cost_fees, turn * 0.0002 AS cost_spread, turn * 0.0003 AS cost_slippage, turn * 0.00001 AS cost_latency,
        abs(filled_position) * 0.0001 AS cost_funding, turn * turn * 0.0001 AS cost_market_impact FROM t),
      x AS (SELECT *, transaction_cost + cost_fees + cost_spread + cost_slippage + cost_latency + cost_funding + cost_market_impact AS total_cost FROM o)
      SELECT symbol, seq, reason_codes, {sql_round(_FILL_VALUES, 12)} FROM x""",
    uses="observations",
)
def execution_partial_fills(spark, sf):
    out = ev.apply_execution(_fills_input(spark, sf), fill_fraction=0.8)
    return out.select(
        "symbol", "seq", F.array_join("reason_codes", ",").alias("reason_codes"), *[rnd(c, 12).alias(c) for c in _FILL_VALUES]
    )
