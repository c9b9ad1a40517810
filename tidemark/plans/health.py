"""Outcome maturation and monitoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import monitoring as mon
from tidemark.plans import bindings as b
from tidemark.plans.registry import common, query, rnd, sql_round

_NOW = "2024-01-25 00:00:00"


def _now():
    return F.expr(f"timestamp_ntz'{_NOW}'")


def signal_rows(spark, sf) -> DataFrame:
    """Events as trading signals on their own symbol."""
    k = F.get_json_object("props", "$.k").cast("double")
    i = F.col("event_id")
    return b.table(spark, sf, "events").select(
        i.alias("signal_id"), i.alias("prediction_id"), F.col("event_type").alias("symbol"),
        F.concat(F.lit("f"), (i % 4).cast("string")).alias("family"), F.col("ts").alias("generated_at"),
        (F.when(i % 3 == 0, 900).when(i % 3 == 1, 3600).otherwise(0)).alias("forecast_horizon_seconds"),
        F.when(k < 40, "LONG").when(k < 80, "SHORT").otherwise("FLAT").alias("direction"),
        (0.0005 + k * 0.00002).alias("expected_cost"), ((k - 50.0) / 1000.0).alias("expected_return"),
        ((k - 50.0) / 1000.0 - 0.001).alias("net_expected_return"), (k / 100.0).alias("confidence"),
        F.when(k < 33, "calm").when(k < 66, "trend").when(k < 90, "Stress").otherwise("unknown").alias("regime"),
        (F.col("user_id") % 10 / F.lit(10.0)).alias("liquidity_score"), (i % 19 == 0).alias("missing_features"),
        (i / 4).cast("long").alias("trace_id"),
        F.create_map(
            F.lit("k"), k, F.lit("value"), F.col("value"), F.lit("user"), F.col("user_id").cast("double"),
        ).alias("features"),
    )


common(
    "signals",
    """
SELECT event_id AS signal_id, event_id AS prediction_id, event_type AS symbol, 'f' || CAST(event_id % 4 AS VARCHAR) AS family, ts AS generated_at,
  CASE event_id % 3 WHEN 0 THEN 900 WHEN 1 THEN 3600 ELSE 0 END AS forecast_horizon_seconds,
  CASE WHEN k < 40 THEN 'LONG' WHEN k < 80 THEN 'SHORT' ELSE 'FLAT' END AS direction,
  CAST(0.0005 AS DOUBLE) + k * CAST(0.00002 AS DOUBLE) AS expected_cost, (k - 50) / 1000 AS expected_return, (k - 50) / 1000 - CAST(0.001 AS DOUBLE) AS net_expected_return,
  k / 100 AS confidence, CASE WHEN k < 33 THEN 'calm' WHEN k < 66 THEN 'trend' WHEN k < 90 THEN 'Stress' ELSE 'unknown' END AS regime,
  CAST(user_id % 10 AS DOUBLE) / 10 AS liquidity_score, event_id % 19 = 0 AS missing_features, event_id // 4 AS trace_id, k, value, CAST(user_id AS DOUBLE) AS usr
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
""",
)
common(
    "outcomes",
    f"""
SELECT *, CASE WHEN direction = 'SHORT' THEN -realized_return ELSE realized_return END - realized_cost AS net_return,
  (direction = 'LONG' AND realized_return > 0) OR (direction = 'SHORT' AND realized_return < 0) OR (direction = 'FLAT' AND abs(realized_return) <= expected_cost) AS directional_hit
FROM (SELECT a.*, e.close / a.start_price - 1 AS realized_return, expected_cost AS realized_cost, e.close_time AS observed_at
  FROM (SELECT s.*, s.generated_at + to_seconds(greatest(forecast_horizon_seconds, 1)) AS due, c.close AS start_price
    FROM signals s ASOF JOIN candles c ON c.symbol = s.symbol AND c.close_time <= s.generated_at) a
  ASOF JOIN (SELECT * FROM candles WHERE close_time <= TIMESTAMP '{_NOW}') e ON e.symbol = a.symbol AND e.close_time >= a.due
  WHERE a.due <= TIMESTAMP '{_NOW}')
""",
)


def outcome_rows(spark, sf) -> DataFrame:
    return mon.mature_outcomes(signal_rows(spark, sf), b.candles(spark, sf), _now())


_OUT = ["realized_return", "realized_cost", "net_return"]


@query(
    "matured_outcomes",
    f"SELECT signal_id, symbol, observed_at, directional_hit, {sql_round(_OUT, 8)} FROM outcomes",
    uses="ticks candles signals outcomes",
)
def matured_outcomes(spark, sf):
    return outcome_rows(spark, sf).select("signal_id", "symbol", "observed_at", "directional_hit", *[rnd(c, 8).alias(c) for c in _OUT])


@query(
    "unlabelled_signals",
    "SELECT signal_id, symbol, generated_at FROM signals WHERE signal_id NOT IN (SELECT signal_id FROM outcomes)",
    uses="ticks candles signals outcomes",
)
def unlabelled_signals(spark, sf):
    return mon.unlabelled(signal_rows(spark, sf), outcome_rows(spark, sf)).select("signal_id", "symbol", "generated_at")


_W = 200
common(
    "windowed_outcomes",
    f"""
SELECT *, rn <= {_W} AS recent FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY observed_at DESC, signal_id DESC) AS rn FROM outcomes) WHERE rn <= {2 * _W}
""",
)


def _ks_sql(value: str, keys: str = "family", src: str = "windowed_outcomes") -> str:
    return f"""(SELECT {keys}, max(abs(fa - fb)) AS ks FROM (
      SELECT {keys}, sum(a) OVER w / sum(a) OVER (PARTITION BY {keys}) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY {keys}) AS fb
      FROM (SELECT {keys}, {value} AS v, count(*) FILTER (WHERE recent) AS a, count(*) FILTER (WHERE NOT recent) AS b FROM {src} GROUP BY ALL) WINDOW w AS (PARTITION BY {keys} ORDER BY v)) GROUP BY {keys})"""


_HEALTH = [
    "information_coefficient", "net_expectancy", "calibration_error", "missing_feature_rate", "transaction_cost_increase",
    "capacity_decline", "prediction_drift", "historical_divergence", "feature_drift", "out_of_distribution_rate", "regime_dependence",
    "signal_correlation_increase", "paired_divergence",
]


def _reasons_sql() -> str:
    d = [f"CASE WHEN {c} >= {x} THEN '{n}_DEGRADED' END" for c, n, _, x in mon.HIGH_IS_BAD] + [
        f"CASE WHEN {c} <= {x} THEN '{n}_DEGRADED' END" for c, n, _, x in mon.LOW_IS_BAD
    ]
    w = [f"CASE WHEN {c} >= {a} AND {c} < {x} THEN '{n}_WATCH' END" for c, n, a, x in mon.HIGH_IS_BAD] + [
        f"CASE WHEN {c} <= {a} AND {c} > {x} THEN '{n}_WATCH' END" for c, n, a, x in mon.LOW_IS_BAD
    ]
    return f"concat_ws(',', {', '.join(d)}) AS dcodes, concat_ws(',', {', '.join(w)}) AS wcodes"


@query(
    "rolling_signal_health",
    f"""WITH b AS (SELECT family, count(*) FILTER (WHERE recent) AS observations, count(*) FILTER (WHERE NOT recent) AS reference_observations,
        corr(net_expected_return, net_return) FILTER (WHERE recent) AS information_coefficient, avg(net_return) FILTER (WHERE recent) AS net_expectancy,
        avg(abs(confidence - CAST(directional_hit AS DOUBLE))) FILTER (WHERE recent) AS calibration_error, avg(CAST(missing_features AS DOUBLE)) FILTER (WHERE recent) AS missing_feature_rate,
        avg(realized_cost) FILTER (WHERE recent) AS c1, avg(realized_cost) FILTER (WHERE NOT recent) AS c0,
        avg(liquidity_score * greatest(1 - least(realized_cost / 0.003, 1), 0)) FILTER (WHERE recent) AS k1, avg(liquidity_score * greatest(1 - least(realized_cost / 0.003, 1), 0)) FILTER (WHERE NOT recent) AS k0
        FROM windowed_outcomes GROUP BY family),
      lf AS (SELECT family, signal_id, recent, 'k' AS f, k AS v FROM windowed_outcomes UNION ALL SELECT family, signal_id, recent, 'value', value FROM windowed_outcomes UNION ALL SELECT family, signal_id, recent, 'user', usr FROM windowed_outcomes),
      fd AS (SELECT family, max(ks) AS feature_drift FROM {_ks_sql("v", "family, f", "lf")} GROUP BY family),
      st AS (SELECT family, f, avg(v) AS c, stddev_pop(v) AS sd FROM lf WHERE NOT recent GROUP BY ALL),
      od AS (SELECT family, avg(CAST(odd >= 0.1 AS DOUBLE)) AS out_of_distribution_rate FROM (SELECT lf.family, signal_id, avg(CAST(abs(v - c) / sd > 4 AS DOUBLE)) AS odd FROM lf JOIN st ON st.family = lf.family AND st.f = lf.f WHERE recent GROUP BY ALL) GROUP BY family),
      rg AS (SELECT family, lower(regime) AS g, net_return AS r, avg(net_return) OVER (PARTITION BY family) AS m, avg(net_return) OVER (PARTITION BY family, lower(regime)) AS mg FROM windowed_outcomes WHERE recent AND lower(regime) <> 'unknown'),
      rd AS (SELECT family, least(1, greatest(0, sum((mg - m) * (mg - m)) / sum((r - m) * (r - m)))) AS regime_dependence FROM rg GROUP BY family),
      mi AS (SELECT family, recent, date_trunc('minute', observed_at) AS m, avg(net_return) AS r FROM windowed_outcomes GROUP BY ALL),
      cp AS (SELECT a.family, c.family AS peer, a.recent, CASE WHEN count(*) >= 10 THEN corr(a.r, c.r) END AS c FROM mi a JOIN mi c ON a.m = c.m AND a.recent = c.recent AND a.family <> c.family GROUP BY ALL),
      ci AS (SELECT family, max(greatest(x - y, 0)) AS signal_correlation_increase FROM (SELECT family, peer, max(abs(c)) FILTER (WHERE recent) AS x, max(abs(c)) FILTER (WHERE NOT recent) AS y FROM cp GROUP BY ALL) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY family),
      sh AS (SELECT w.family, avg(least(abs(w.expected_return - s.expected_return * 0.9) / greatest(abs(w.expected_return) + abs(s.expected_return * 0.9), 1e-9), 1)) AS paired_divergence, count(*) AS shadow_pairs
        FROM windowed_outcomes w JOIN signals s ON s.trace_id = w.trace_id AND s.family = w.family WHERE w.recent AND s.signal_id % 3 = 0 GROUP BY w.family),
      o AS (SELECT b.*, greatest((c1 - c0) / greatest(abs(c0), 1e-9), 0) AS transaction_cost_increase, CASE WHEN k0 <= 1e-9 THEN 0 ELSE least(1, greatest(0, (k0 - k1) / k0)) END AS capacity_decline,
        pd.ks AS prediction_drift, hd.ks AS historical_divergence, feature_drift, out_of_distribution_rate, regime_dependence, signal_correlation_increase, paired_divergence, shadow_pairs,
        greatest(hd.ks, paired_divergence) AS live_shadow_divergence
        FROM b JOIN {_ks_sql("expected_return")} pd USING (family) JOIN {_ks_sql("net_return")} hd USING (family) JOIN fd USING (family) JOIN od USING (family) JOIN rd USING (family)
        LEFT JOIN ci USING (family) LEFT JOIN sh USING (family)),
      x AS (SELECT *, {_reasons_sql()} FROM o)
      SELECT family, observations, reference_observations, shadow_pairs, CASE WHEN dcodes <> '' THEN 'DEGRADED' WHEN wcodes <> '' THEN 'WATCH' ELSE 'HEALTHY' END AS health_status,
        CASE WHEN dcodes = '' AND wcodes = '' THEN 'ROLLING_HEALTH_WITHIN_THRESHOLDS' ELSE concat_ws(',', nullif(dcodes, ''), nullif(wcodes, '')) END AS reason_codes, {sql_round(_HEALTH)} FROM x""",
    uses="ticks candles signals outcomes windowed_outcomes",
)
def rolling_signal_health(spark, sf):
    shadows = signal_rows(spark, sf).where(F.col("signal_id") % 3 == 0).select(
        "family", "trace_id", F.concat(F.lit("shadow-"), F.col("prediction_id").cast("string")).alias("prediction_id"),
        (F.col("expected_return") * 0.9).alias("expected_return"),
    )
    out = mon.rolling_health(outcome_rows(spark, sf), shadows, window=_W)
    return out.select(
        "family", "observations", "reference_observations", "shadow_pairs", "health_status", F.array_join("reason_codes", ",").alias("reason_codes"),
        *[rnd(c).alias(c) for c in _HEALTH],
    )


@query(
    "recent_family_performance",
    f"""SELECT family, round(greatest(-0.2, least(0.2, avg(net_return))), 6) + 0.0 AS recent_performance
    FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY observed_at DESC, signal_id DESC) AS n FROM outcomes) WHERE n <= {_W} GROUP BY family""",
    uses="ticks candles signals outcomes",
)
def recent_family_performance(spark, sf):
    return mon.recent_performance(outcome_rows(spark, sf), _W).select("family", rnd("recent_performance").alias("recent_performance"))


@query(
    "family_outcome_correlations",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY observed_at DESC, signal_id DESC) AS rk FROM outcomes),
      m AS (SELECT family, date_trunc('minute', observed_at) AS m, first(net_return ORDER BY observed_at, signal_id) AS r FROM n WHERE rk <= {_W} GROUP BY ALL)
      SELECT a.family AS left_family, b.family AS right_family, count(*) AS points, round(corr(a.r, b.r), 6) + 0.0 AS correlation
      FROM m a JOIN m b ON a.m = b.m AND a.family < b.family GROUP BY ALL""",
    uses="ticks candles signals outcomes",
)
def family_outcome_correlations(spark, sf):
    return mon.family_correlations(outcome_rows(spark, sf), _W).select(
        "left_family", "right_family", "points", rnd("correlation").alias("correlation")
    )


@query(
    "model_error_streaks",
    """WITH l AS (SELECT user_id, max(ts) FILTER (WHERE event_type <> 'error') AS last_success FROM events GROUP BY user_id)
      SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND (last_success IS NULL OR ts > last_success)) AS consecutive_errors, any_value(last_success) AS last_success
      FROM events JOIN l USING (user_id) GROUP BY user_id""",
)
def model_error_streaks(spark, sf):
    log = b.table(spark, sf, "events").select("user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return mon.error_streaks(log, ["user_id"], "ts", "ok")


@query(
    "sticky_health_status",
    """WITH l AS (SELECT user_id, last(CASE WHEN event_type = 'error' THEN 'SUSPENDED' ELSE 'WATCH' END ORDER BY ts, event_id) AS prev FROM events GROUP BY user_id),
      h AS (SELECT user_id, count(*) AS n, avg(CAST(event_type = 'error' AS DOUBLE)) AS miss FROM events GROUP BY user_id)
      SELECT user_id, n AS observations, CASE WHEN prev = 'SUSPENDED' THEN prev WHEN n < 20 THEN 'WATCH' WHEN miss >= 0.25 THEN 'DEGRADED' WHEN miss >= 0.10 THEN 'WATCH' ELSE 'HEALTHY' END AS health_status
      FROM h JOIN l USING (user_id)""",
)
def sticky_health_status(spark, sf):
    events = b.table(spark, sf, "events")
    bad = F.col("event_type") == "error"
    rows = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("observations"), F.avg(bad.cast("double")).alias("missing_feature_rate"),
        F.max_by(F.when(bad, "SUSPENDED").otherwise("WATCH"), F.struct("ts", "event_id")).alias("previous"),
    )
    blank = F.lit(None).cast("double")
    for c, *_ in [*mon.HIGH_IS_BAD, *mon.LOW_IS_BAD]:
        if c not in rows.columns:
            rows = rows.withColumn(c, blank)
    return mon.health_status(rows, previous="previous").select("user_id", "observations", "health_status")
