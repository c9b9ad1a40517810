"""Regime, forecast, signal, ensemble, portfolio and risk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import scores as sc
from tidemark.functions.numeric import correlation
from tidemark.functions import text as tx
from tidemark.operators import ensemble as en
from tidemark.plans import bindings as b
from tidemark.plans.registry import common, query, rnd_nudged as rnd, sql_nudged as sql_round

# Feature columns derived from the event number: name -> (modulus, offset, divisor).
SPEC = {
    "sentiment_score": (21, 10, 10), "sentiment_confidence": (11, 0, 10), "risk_score": (13, 0, 12), "impact_score": (7, 0, 6),
    "recency_weight": (5, 0, 4), "macro_risk_score": (17, 0, 32), "world_risk_score": (19, 0, 40), "regulation_risk_score": (23, 0, 50),
    "fed_risk_score": (29, 0, 60), "war_risk_score": (31, 0, 70), "security_risk_score": (37, 0, 80), "stablecoin_depeg_risk": (41, 0, 90),
    "liquidation_spike_score": (43, 0, 100), "trader_crowd_score": (47, 23, 40), "crowd_risk_score": (53, 0, 106),
    "open_interest_change": (59, 29, 3000), "funding_rate": (61, 30, 60000), "spot_bid_ask_spread_pct": (67, 0, 50000),
    "spot_orderbook_imbalance": (71, 35, 40), "spot_intraday_range_pct": (73, 0, 1500), "spot_activity_score": (79, 0, 60),
    "crowd_long_short_ratio": (83, 0, 40), "rsi_14": (89, 0, 88), "bollinger_position": (97, 0, 96), "adx_14": (101, 0, 100),
    "macd_histogram_pct": (103, 51, 20000), "ema_20_distance_pct": (107, 53, 5000), "vwap_20_distance_pct": (109, 54, 5000),
    "atr_14_pct": (113, 0, 10000), "taker_buy_pressure": (127, 0, 126), "liquidation_imbalance_5m": (131, 65, 65),
    "market_regime_score": (137, 68, 68), "fear_greed_value": (149, 24, 1), "global_market_cap_change_24h": (139, 69, 1000),
    "candles_used": (151, 0, 2),
}


def feature_bank(spark, sf, dealt: bool = False) -> DataFrame:
    """Features of an event, of rows dealt by event or, where a stored file has fewer splits than there are cores, evenly."""
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    events = b.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return (events.repartition("event_id") if dealt else b.dealt(events)).select(
        "event_id", F.col("event_type").alias("symbol"), "ts",
        ((k - 50.0) / 50.0).alias("trend_score"), ((F.col("value") - 50.0) / 50000.0).alias("candle_return_1m"),
        ((k - 50.0) / 5000.0).alias("candle_return_5m"), (F.col("value") / 20000.0).alias("volatility"),
        ((F.col("user_id") % 20 - 10) / F.lit(5.0)).alias("volume_change"), ((k - 40.0) / 2000.0).alias("price_change"),
        F.col("value").alias("last_close"), (i % 2 == 0).alias("external_ai_missing"),
        *[((i % m - o) / F.lit(float(d))).alias(n) for n, (m, o, d) in SPEC.items()],
    )


common(
    "bank",
    "SELECT event_id, event_type AS symbol, ts, (k - 50) / 50 AS trend_score, (value - 50) / 50000 AS candle_return_1m, (k - 50) / 5000 AS candle_return_5m, "
    "value / 20000 AS volatility, CAST(user_id % 20 - 10 AS DOUBLE) / 5 AS volume_change, (k - 40) / 2000 AS price_change, value AS last_close, event_id % 2 = 0 AS external_ai_missing, "
    + ", ".join(f"CAST(event_id % {m} - {o} AS DOUBLE) / {d} AS {n}" for n, (m, o, d) in SPEC.items())
    + " FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)",
)


def _regime_sql(spot: bool) -> str:
    s = lambda x: x if spot else ""
    return f"""
SELECT *, greatest(-1, least(1, trend_score + candle_return_5m * 40)) AS regime_direction_score,
  least(1, greatest(abs(candle_return_5m) * 70, greatest(volume_change, 0) * 0.15{s(', spot_activity_score, abs(spot_intraday_range_pct) * 10')}) * greatest(0.25, regime_trend_strength)) AS regime_breakout_pressure,
  greatest(0, least(1, regime_volatility_score * (1 - regime_trend_strength) * (1 - regime_news_shock_score))) AS regime_mean_reversion_pressure,
  least(1, greatest(abs(trader_crowd_score), crowd_risk_score, abs(crowd_long_short_ratio - 1) * 0.25{s(', abs(spot_orderbook_imbalance)')})) AS regime_crowd_pressure
FROM (SELECT *, least(1, greatest(abs(trend_score), least(abs(candle_return_5m) * 80, 1))) AS regime_trend_strength,
    least(1, greatest(tanh(abs(volatility) * 120){s(', least(abs(spot_intraday_range_pct) * 15, 1)')})) AS regime_volatility_score,
    least(1, greatest(abs(sentiment_score) * greatest(impact_score, 0), risk_score, regulation_risk_score, fed_risk_score, war_risk_score, security_risk_score)) AS regime_news_shock_score,
    least(1, greatest(risk_score, macro_risk_score, world_risk_score, regulation_risk_score, fed_risk_score, war_risk_score, security_risk_score, stablecoin_depeg_risk)) AS regime_risk_off_score,
    least(1, greatest(liquidation_spike_score, least(abs(open_interest_change) * 25, 1), least(abs(funding_rate) * 500, 1){s(', least(abs(spot_bid_ask_spread_pct) * 200, 1)')})) AS regime_liquidity_stress_score
  FROM bank)"""


common("regimes", _regime_sql(True))
common("regimes_offline", _regime_sql(False))
_REG = [
    "regime_trend_strength", "regime_direction_score", "regime_volatility_score", "regime_news_shock_score", "regime_risk_off_score",
    "regime_liquidity_stress_score", "regime_breakout_pressure", "regime_mean_reversion_pressure", "regime_crowd_pressure",
]


def regimes(spark, sf, spot: bool = True, dealt: bool = False) -> DataFrame:
    return sc.with_columns(feature_bank(spark, sf, dealt), sc.regime_scores(spot))


@query("regime_scores_live", f"SELECT event_id, {sql_round(_REG)} FROM regimes", uses="bank regimes")
def regime_scores_live(spark, sf):
    return regimes(spark, sf).select("event_id", *[rnd(c).alias(c) for c in _REG])


@query("regime_scores_offline", f"SELECT event_id, {sql_round(_REG)} FROM regimes_offline", uses="bank regimes_offline")
def regime_scores_offline(spark, sf):
    return regimes(spark, sf, False).select("event_id", *[rnd(c).alias(c) for c in _REG])


_SINGLE = """CASE WHEN regime_news_shock_score >= 0.55 THEN 'news_shock' WHEN regime_risk_off_score >= 0.55 THEN 'risk_off' WHEN regime_liquidity_stress_score >= 0.45 THEN 'liquidity_stress'
  WHEN regime_breakout_pressure >= 0.5 THEN 'breakout' WHEN regime_mean_reversion_pressure >= 0.5 THEN 'mean_reversion'
  WHEN regime_trend_strength >= 0.35 THEN CASE WHEN regime_direction_score >= 0 THEN 'trend_up' ELSE 'trend_down' END WHEN regime_volatility_score >= 0.5 THEN 'high_volatility' ELSE 'range' END"""
_MASKS = {
    "news_shock": "regime_news_shock_score >= 0.45", "risk_off": "regime_risk_off_score >= 0.45", "liquidity_stress": "regime_liquidity_stress_score >= 0.35",
    "crowded_market": "regime_crowd_pressure >= 0.35", "breakout_pressure": "regime_breakout_pressure >= 0.35",
    "mean_reversion_pressure": "regime_mean_reversion_pressure >= 0.35", "trend_up": "regime_trend_strength >= 0.35 AND regime_direction_score > 0.10",
    "trend_down": "regime_trend_strength >= 0.35 AND regime_direction_score < -0.10",
    "range_low_volatility": "regime_trend_strength < 0.25 AND regime_volatility_score < 0.20", "high_volatility": "regime_volatility_score >= 0.35",
}


@query(
    "regime_labels",
    f"SELECT event_id, {_SINGLE} AS single_regime, concat_ws(',', {', '.join(f'''CASE WHEN {c} THEN '{r}' END''' for r, c in _MASKS.items())}) AS active_regimes FROM regimes",
    uses="bank regimes",
)
def regime_labels(spark, sf):
    return regimes(spark, sf).select(
        "event_id", sc.single_regime().alias("single_regime"), F.array_join(sc.active_regimes(), ",").alias("active_regimes")
    )


_F_SQL = {
    "alpha.short_horizon_momentum": ("candle_return_1m * 120 + candle_return_5m * 80 + trend_score * 0.55 + macd_histogram_pct * 70 + greatest(volume_change, 0) * 0.06", "volatility", 0.0025, "0.38", 300),
    "alpha.medium_horizon_momentum": ("price_change * 45 + trend_score * 0.85 + ema_20_distance_pct * 55 + vwap_20_distance_pct * 35 + adx_14 * (CASE WHEN trend_score >= 0 THEN 1 ELSE -1 END) * 0.2", "volatility", 0.0035, "0.42", 1800),
    "alpha.mean_reversion": ("((0.5 - rsi_14) * 1.25 + (0.5 - bollinger_position) - vwap_20_distance_pct * 30) * greatest(regime_mean_reversion_pressure, 0.15)", "volatility", 0.002, "0.48", 600),
    "alpha.breakout_pressure": ("(trend_score * 0.9 + candle_return_5m * 70 + greatest(volume_change, 0) * 0.08 + adx_14 * 0.25) * greatest(regime_breakout_pressure, 0.1)", "atr_14_pct", 0.003, "0.45", 900),
    "alpha.derivatives_flow": ("(taker_buy_pressure - 0.5) * 2 * 0.8 + trader_crowd_score * 0.25 - funding_rate * 500 * 0.25 + open_interest_change * 12 * 0.15", "volatility", 0.0022, "(0.42 + crowd_risk_score * 0.25)", 600),
    "alpha.liquidation_pressure": ("liquidation_imbalance_5m * greatest(liquidation_spike_score, 0.15) * 1.5", "volatility", 0.002, "(0.52 - least(liquidation_spike_score * 0.15, 0.12))", 300),
    "alpha.news_event": ("(sentiment_score * greatest(sentiment_confidence, 0.2) * 1.2 - risk_score * 0.75) * greatest(impact_score, 0.1) * greatest(recency_weight, 0.1)", "volatility", 0.0028, "(CASE WHEN external_ai_missing THEN 0.52 ELSE 0.46 END)", 1800),
    "alpha.market_context": ("market_regime_score * 0.45 + (fear_greed_value - 50) / 50 * 0.15 + global_market_cap_change_24h * 5 - macro_risk_score * 0.55", "volatility", 0.0018, "0.52", 3600),
}
common(
    "forecasts",
    "SELECT event_id, symbol, ts, family, horizon_seconds, regime, cost, fill_probability, external_ai_missing, s * scale AS expected_return, greatest(vol, abs(s * scale) * 0.6, 0.0001) AS expected_volatility, "
    "1 / (1 + exp(-s * 1.8)) AS probability_up, 1 / (1 + exp(s * 1.8)) AS probability_down, "
    "least(0.92, 0.35 + (1 - u) * 0.35 + abs(1 / (1 + exp(-s * 1.8)) - 1 / (1 + exp(s * 1.8))) * 0.40) AS confidence, u AS uncertainty FROM ("
    + " UNION ALL ".join(
        f"SELECT event_id, symbol, ts, external_ai_missing, '{f}' AS family, {h} AS horizon_seconds, {_SINGLE} AS regime, cost, fill_probability, greatest(-2, least(2, {s})) AS s, abs({vol}) AS vol, "
        f"CAST({sc_} AS DOUBLE) AS scale, greatest(0.05, least(0.95, {u} + least(abs({vol}) * 30, 0.25))) AS u FROM costs"
        for f, (s, vol, sc_, u, h) in _F_SQL.items()
    )
    + ")",
)
_COST = ["cost_spread", "cost_slippage", "cost_fee", "cost_funding", "total_cost", "fill_probability"]
common(
    "costs",
    """
SELECT *, cost_spread + cost_slippage + 0.0004 + cost_funding AS total_cost, cost_spread + cost_slippage + 0.0004 + cost_funding AS cost,
  greatest(0, 1 - greatest(cost_spread * 150, regime_liquidity_stress_score)) AS fill_probability
FROM (SELECT *, least(0.02, CASE WHEN spot_bid_ask_spread_pct > 0 THEN spot_bid_ask_spread_pct ELSE least(abs(volatility) * 0.05, 0.002) END) AS cost_spread,
    least(0.01, 0.00005 + abs(volatility) * 0.4 + regime_liquidity_stress_score * 0.001) AS cost_slippage, CAST(0.0004 AS DOUBLE) AS cost_fee, least(0.01, abs(funding_rate) * 0.5) AS cost_funding FROM regimes)
""",
)
_FC = ["expected_return", "expected_volatility", "probability_up", "probability_down", "confidence", "uncertainty"]


def costed(spark, sf, dealt: bool = False) -> DataFrame:
    return sc.with_columns(regimes(spark, sf, dealt=dealt), sc.cost_estimate())


def forecasts(spark, sf, dealt: bool = False) -> DataFrame:
    """One row per family; ``dealt`` by event beforehand, where what follows groups by event: the narrow features are shuffled, not the forecasts."""
    df = costed(spark, sf, dealt).withColumn("regime", sc.single_regime())
    return sc.family_forecasts(df, ["event_id", "symbol", "ts", "regime", "total_cost", "fill_probability", "external_ai_missing"])


@query(
    "family_forecasts",
    f"SELECT event_id, family, CAST(horizon_seconds AS INTEGER) AS horizon_seconds, {sql_round(_FC, 8)} FROM forecasts",
    uses="bank regimes costs forecasts",
)
def family_forecasts(spark, sf):
    return forecasts(spark, sf).select("event_id", "family", "horizon_seconds", *[rnd(c, 8).alias(c) for c in _FC])


@query("cost_estimates", f"SELECT event_id, {sql_round(_COST, 8)} FROM costs", uses="bank regimes costs")
def cost_estimates(spark, sf):
    return costed(spark, sf).select("event_id", *[rnd(c, 8).alias(c) for c in _COST])


@query(
    "market_conditions",
    """WITH x AS (SELECT event_id, regime_trend_strength AS st, regime_direction_score AS di, least(1, greatest(regime_volatility_score, abs(volatility) * 40)) AS vo,
        least(1, greatest(regime_liquidity_stress_score, spot_bid_ask_spread_pct * 150)) AS li, least(1, greatest(crowd_risk_score, abs(funding_rate) * 500)) AS cr,
        least(1, greatest(regime_news_shock_score, impact_score * recency_weight)) AS sh, greatest(-1, least(1, least(1, greatest(market_regime_score, 0)) - least(1, greatest(regime_risk_off_score, macro_risk_score)))) AS ap FROM regimes),
      u AS (
        SELECT event_id, 'condition.trend_regime' AS condition, CASE WHEN st < 0.35 THEN 'range' WHEN di >= 0 THEN 'trend_up' ELSE 'trend_down' END AS label, di * st AS score, 0.5 + st * 0.5 AS confidence FROM x
        UNION ALL SELECT event_id, 'condition.volatility_regime', CASE WHEN vo < 0.25 THEN 'low_volatility' WHEN vo >= 0.60 THEN 'high_volatility' ELSE 'normal_volatility' END, vo, least(1, 0.55 + abs(vo - 0.45) * 0.7) FROM x
        UNION ALL SELECT event_id, 'condition.liquidity_regime', CASE WHEN li >= 0.55 THEN 'liquidity_stress' WHEN li >= 0.30 THEN 'thin_liquidity' ELSE 'normal_liquidity' END, li, least(1, 0.6 + abs(li - 0.4) * 0.5) FROM x
        UNION ALL SELECT event_id, 'condition.crowding_regime', CASE WHEN cr >= 0.60 THEN 'crowded' WHEN cr >= 0.35 THEN 'watch' ELSE 'balanced' END, cr, least(1, 0.55 + abs(cr - 0.45) * 0.6) FROM x
        UNION ALL SELECT event_id, 'condition.news_shock', CASE WHEN sh >= 0.55 THEN 'news_shock' WHEN sh >= 0.25 THEN 'news_active' ELSE 'news_normal' END, sh, least(1, 0.55 + abs(sh - 0.4) * 0.6) FROM x
        UNION ALL SELECT event_id, 'condition.risk_appetite', CASE WHEN ap <= -0.25 THEN 'risk_off' WHEN ap >= 0.25 THEN 'risk_on' ELSE 'risk_neutral' END, ap, least(1, 0.55 + abs(ap) * 0.4) FROM x)
      SELECT event_id, condition, label, round(score + 1e-12, 6) + 0.0 AS score, round(confidence + 1e-12, 6) + 0.0 AS confidence FROM u""",
    uses="bank regimes",
)
def market_conditions(spark, sf):
    return sc.condition_classes(regimes(spark, sf), ["event_id"]).select(
        "event_id", "condition", "label", rnd("score").alias("score"), rnd("confidence").alias("confidence")
    )


_REL = ["reliability_confidence", "combined_uncertainty", "data_quality_confidence"]


@query(
    "forecast_reliability",
    f"""WITH x AS (SELECT event_id, 0.7 AS cal, least(1, 0.20 + least(abs(volatility) * 10, 0.25) + least((event_id % 4) * 0.15, 0.6)) AS un, fed_risk_score AS dr, war_risk_score AS od,
        greatest(0, 1 - least((event_id % 4) * 0.15, 0.7) - least((event_id % 900) / 1800, 0.6)) AS q FROM bank),
      o AS (SELECT event_id, cal * (1 - un) * (1 - dr) * (1 - od) * q AS reliability_confidence, greatest(un, dr, od, 1 - q) AS combined_uncertainty, q AS data_quality_confidence FROM x)
      SELECT event_id, {sql_round(_REL)} FROM o""",
    uses="bank",
)
def forecast_reliability(spark, sf):
    i = F.col("event_id")
    parts = sc.reliability(i % 4, (i % 900).cast("double"), F.lit(None).cast("double"), F.col("fed_risk_score"), F.col("war_risk_score"))
    return feature_bank(spark, sf).select("event_id", *[rnd(e).alias(n) for n, e in parts.items()])


def signals(spark, sf, dealt: bool = False) -> DataFrame:
    health = F.when(F.col("event_id") % 13 == 0, "SUSPENDED").when(F.col("event_id") % 7 == 0, "DEGRADED").when(F.col("event_id") % 5 == 0, "WATCH").otherwise("HEALTHY")
    df = forecasts(spark, sf, dealt).withColumn("health_status", health)
    made = sc.signal_columns(
        F.col("expected_return"), F.col("total_cost"), F.col("confidence"), F.lit(0.70), ~F.col("external_ai_missing"), F.col("health_status")
    )
    return sc.with_columns(df, made)


common(
    "signal_set",
    """
SELECT *, CASE WHEN abs(net) < 0.0005 THEN 'FLAT' WHEN net > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, least(abs(net) / 0.002, 1) AS strength, confidence * 0.70 AS signal_confidence
FROM (SELECT *, CASE WHEN expected_return >= 0 THEN expected_return - cost ELSE expected_return + cost END AS net,
    CASE WHEN event_id % 13 = 0 THEN 'SUSPENDED' WHEN event_id % 7 = 0 THEN 'DEGRADED' WHEN event_id % 5 = 0 THEN 'WATCH' ELSE 'HEALTHY' END AS health_status FROM forecasts)
""",
)


@query(
    "forecast_signals",
    """SELECT event_id, family, direction, round(net + 1e-12, 8) + 0.0 AS net_expected_return, round(strength + 1e-12, 6) + 0.0 AS strength, round(signal_confidence + 1e-12, 6) + 0.0 AS signal_confidence,
      concat_ws(',', CASE direction WHEN 'FLAT' THEN 'NET_EDGE_BELOW_THRESHOLD' WHEN 'LONG' THEN 'POSITIVE_NET_EXPECTED_RETURN' ELSE 'NEGATIVE_NET_EXPECTED_RETURN' END,
        CASE WHEN external_ai_missing THEN 'BASE_ENSEMBLE_ONLY' ELSE 'EXTERNAL_CONTEXT_AVAILABLE' END, CASE WHEN health_status <> 'HEALTHY' THEN 'MODEL_HEALTH_' || health_status END) AS reason_codes FROM signal_set""",
    uses="bank regimes costs forecasts signal_set",
)
def forecast_signals(spark, sf):
    return signals(spark, sf).select(
        "event_id", "family", "direction", rnd("net_expected_return", 8).alias("net_expected_return"), rnd("strength").alias("strength"),
        rnd("signal_confidence").alias("signal_confidence"), F.array_join("reason_codes", ",").alias("reason_codes"),
    )


def ensemble_input(spark, sf) -> DataFrame:
    i = F.col("event_id")
    return signals(spark, sf, dealt=True).select(
        i.alias("decision_id"), F.concat(i.cast("string"), F.lit(":"), "family").alias("signal_id"), "family", "regime", "direction", "strength",
        F.col("signal_confidence").alias("confidence"), "uncertainty", "expected_volatility", "net_expected_return",
        F.col("total_cost").alias("expected_cost"), F.col("fill_probability").alias("liquidity_score"), "health_status",
        F.when(i % 17 == 0, "RESEARCH").otherwise("PAPER").alias("lifecycle_status"), F.col("ts").alias("generated_at"),
        (F.col("ts") + F.expr("interval 5 minutes")).alias("valid_until"), (F.col("ts") + F.make_dt_interval(secs=(i % 310).cast("decimal(18,6)"))).alias("decided_at"),
        F.lit(0.05).alias("recent_performance"),
    )


def family_pairs(spark, sf) -> DataFrame:
    """A correlation per family pair, measured on the forecasts themselves."""
    names = sorted(_F_SQL)
    wide = forecasts(spark, sf, dealt=True).groupBy("event_id").agg(
        *[F.max(F.when(F.col("family") == n, F.col("expected_return"))).alias(f"r{i}") for i, n in enumerate(names)]
    )
    spots = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    row = wide.agg(*[correlation(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i, j in spots])
    cells = F.array(
        *[F.struct(F.lit(names[i]).alias("left_family"), F.lit(names[j]).alias("right_family"), F.col(f"c{i}_{j}").alias("correlation")) for i, j in spots]
    )
    return row.select(F.explode(cells).alias("c")).select("c.*")


common(
    "weights",
    """
SELECT *, CASE WHEN excl IS NOT NULL THEN 0 WHEN sum(raw) OVER (PARTITION BY decision_id) <> 0 THEN raw / sum(raw) OVER (PARTITION BY decision_id) ELSE 0 END AS weight FROM (
  SELECT *, CASE WHEN excl IS NULL THEN greatest(base * (1 - 0.75 * coalesce(pen, 0)), 0) END AS raw FROM (
    SELECT *, CASE WHEN excl IS NULL AND place > 1 AND mx >= 0.3 THEN least((mx - 0.3) / 0.7, 1) END AS pen FROM (
      SELECT r.*, (SELECT max(c.correlation) FROM pairs c, ranked e WHERE e.decision_id = r.decision_id AND e.excl IS NULL AND e.place < r.place AND ((c.a = e.family AND c.b = r.family) OR (c.b = e.family AND c.a = r.family))) AS mx
      FROM ranked r)))
""",
)
common(
    "ranked",
    """
SELECT *, row_number() OVER (PARTITION BY decision_id, excl IS NULL ORDER BY confidence * (1 - uncertainty) * fill_probability DESC, signal_id) AS place FROM (
  SELECT event_id AS decision_id, CAST(event_id AS VARCHAR) || ':' || family AS signal_id, family, regime, net, cost, uncertainty, signal_confidence AS confidence, fill_probability, expected_volatility,
    signal_confidence * (1 - uncertainty) * fill_probability * greatest(strength, 0.05) * CASE health_status WHEN 'HEALTHY' THEN 1.0 WHEN 'WATCH' THEN 0.75 WHEN 'DEGRADED' THEN 0.35 ELSE 0 END * 1.05 AS base,
    CASE WHEN event_id % 310 >= 300 THEN 'EXPIRED' WHEN event_id % 17 = 0 THEN 'LIFECYCLE_RESEARCH' WHEN health_status = 'SUSPENDED' THEN 'HEALTH_SUSPENDED' WHEN direction = 'FLAT' THEN 'FLAT_SIGNAL' END AS excl
  FROM signal_set)
""",
)
common(
    "pairs",
    "SELECT x.family AS a, y.family AS b, corr(x.expected_return, y.expected_return) AS correlation FROM forecasts x JOIN forecasts y ON x.event_id = y.event_id AND x.family < y.family GROUP BY ALL",
)
_EN = [
    "combined_expected_return", "combined_expected_volatility", "combined_uncertainty", "combined_confidence", "correlation_penalty",
    "transaction_cost_penalty", "regime_penalty", "external_context_adjustment",
]
common(
    "ensembles",
    """
SELECT *, CASE WHEN n = 0 THEN 'NO_VALID_SIGNALS' ELSE concat_ws(',', 'DETERMINISTIC_WEIGHTED_ENSEMBLE', CASE WHEN correlation_penalty <> 0 THEN 'CORRELATED_SIGNAL_WEIGHT_REDUCED' END,
    CASE WHEN transaction_cost_penalty <> 0 THEN 'EXPECTED_COST_PENALTY_APPLIED' END, CASE WHEN regime_penalty > 0 THEN 'REGIME_PENALTY_' || upper(regime) END,
    CASE WHEN external_context_adjustment <> 0 THEN 'BOUNDED_EXTERNAL_CONTEXT_ADJUSTMENT' END, CASE WHEN NOT acts THEN 'COMBINED_EDGE_BELOW_THRESHOLD' END) END AS reason_codes,
  CASE WHEN acts THEN 'ACTIONABLE' ELSE 'NEUTRAL' END AS decision_status
FROM (SELECT *, n > 0 AND abs(combined_expected_return) >= 0.0005 AND combined_confidence > 0 AS acts FROM (
  SELECT decision_id, regime, n, cp AS correlation_penalty, tc AS transaction_cost_penalty, vol AS combined_expected_volatility,
    CASE WHEN n > 0 THEN rp ELSE 0 END AS regime_penalty, CASE WHEN n > 0 THEN ext ELSE 0 END AS external_context_adjustment,
    CASE WHEN n > 0 THEN ret * (1 - cp * 0.5) * (1 - rp) + ext ELSE 0 END AS combined_expected_return,
    CASE WHEN n > 0 THEN least(1, unc + cp * 0.2 + rp * 0.25) ELSE 1 END AS combined_uncertainty,
    CASE WHEN n > 0 THEN greatest(0, least(1, conf * (1 - least(cp * 0.2 + rp * 0.3, 0.6)))) ELSE 0 END AS combined_confidence
  FROM (SELECT decision_id, any_value(regime) AS regime, count(*) FILTER (WHERE excl IS NULL) AS n, coalesce(avg(pen), 0) AS cp, sum(net * weight) AS ret, sum(expected_volatility * weight) AS vol,
      sum(uncertainty * weight) AS unc, sum(confidence * weight) AS conf, sum(cost * weight) AS tc,
      any_value(CASE WHEN regime IN ('risk_off', 'liquidity_stress', 'news_shock') THEN 0.30 WHEN regime IN ('high_volatility', 'crowded_market') THEN 0.15 ELSE 0 END) AS rp,
      any_value(CASE WHEN decision_id % 3 = 0 THEN least(0.1, (decision_id % 10) / 1000) ELSE 0 END) AS ext FROM weights GROUP BY decision_id)))
""",
)


def weighted(spark, sf) -> DataFrame:
    return en.signal_weights(ensemble_input(spark, sf), family_pairs(spark, sf), threshold=0.3)


def ensembles(spark, sf) -> DataFrame:
    w = weighted(spark, sf)
    ctx = b.table(spark, sf, "events").select(
        F.col("event_id").alias("decision_id"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 10 / F.lit(1000.0)).otherwise(0.0).alias("external_context_score"),
    )
    return en.combine(w, ctx)


@query(
    "ensemble_signal_weights",
    "SELECT decision_id, signal_id, excl AS exclusion_reason, round(weight + 1e-12, 6) + 0.0 AS weight, round(pen + 1e-12, 6) + 0.0 AS correlation_penalty FROM weights",
    uses="bank regimes costs forecasts signal_set pairs ranked weights",
)
def ensemble_signal_weights(spark, sf):
    return weighted(spark, sf).select(
        "decision_id", "signal_id", "exclusion_reason", rnd("weight").alias("weight"), rnd("correlation_penalty").alias("correlation_penalty")
    )


@query(
    "ensemble_decisions",
    f"SELECT decision_id, n AS valid_signals, decision_status, reason_codes, {sql_round(_EN)} FROM ensembles",
    uses="bank regimes costs forecasts signal_set pairs ranked weights ensembles",
)
def ensemble_decisions(spark, sf):
    return ensembles(spark, sf).select(
        "decision_id", "valid_signals", "decision_status", F.array_join("reason_codes", ",").alias("reason_codes"), *[rnd(c).alias(c) for c in _EN]
    )


# Portfolio context of a decision, from its number.
_CONTEXT = {
    "current_exposure": (21, 10, 100), "gross_exposure": (45, -10, 100), "net_exposure": (41, 20, 100), "cluster_exposure": (30, -10, 100),
    "liquidity_score": (101, 0, 100), "confidence": (83, 0, 82), "expected_cost": (37, 0, 10000), "daily_pnl": (61, 55, 0.02),
    "drawdown": (53, 0, 220), "open_positions": (13, 0, 1),
}


def proposal_rows(spark, sf) -> DataFrame:
    i = F.col("event_id")
    ctx = {n: (i % m - o) / F.lit(float(d)) for n, (m, o, d) in _CONTEXT.items()}
    k = F.get_json_object("props", "$.k").cast("double")
    return b.table(spark, sf, "events").select(
        "event_id", *[e.alias(n) for n, e in ctx.items()], F.lit(1000.0).alias("equity"), (F.col("value") - 5.0).alias("cash_balance"),
        ((k - 50.0) / 200.0).alias("requested_target_exposure"), F.col("value").alias("price"),
        F.when(i % 11 != 0, (i % 200 - 10).cast("double")).alias("market_age_seconds"), (i % 23 == 0).alias("features_missing"),
        (i % 97 == 0).alias("kill_switch"), (i % 31 == 0).alias("cooldown"), F.when(i % 19 == 0, "SUSPENDED").otherwise("HEALTHY").alias("health_status"),
        ((k - 50.0) / 10000.0).alias("combined_expected_return"), (k / 200.0).alias("combined_uncertainty"), (k / 5000.0).alias("combined_expected_volatility"),
        (k / 100.0).alias("combined_confidence"), F.when(i % 4 == 0, "NEUTRAL").otherwise("ACTIONABLE").alias("decision_status"),
        F.when(i % 3 == 0, "BUY").when(i % 3 == 1, "SELL").when(i % 7 == 0, "CLOSE").otherwise("HOLD").alias("action"),
        F.when(i % 5 == 0, "LONG").when(i % 5 == 1, "SHORT").alias("position_side"), F.when(i % 2 == 0, F.col("value") * 10).alias("requested_notional"),
    )


common(
    "proposals",
    "SELECT event_id, " + ", ".join(f"CAST(event_id % {m} - {o} AS DOUBLE) / {d} AS {n}" for n, (m, o, d) in _CONTEXT.items())
    + """, CAST(1000 AS DOUBLE) AS equity, value - 5 AS cash_balance, (k - 50) / 200 AS requested_target_exposure, value AS price, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 200 - 10 AS DOUBLE) END AS market_age_seconds,
  event_id % 23 = 0 AS features_missing, event_id % 97 = 0 AS kill_switch, event_id % 31 = 0 AS cooldown, CASE WHEN event_id % 19 = 0 THEN 'SUSPENDED' ELSE 'HEALTHY' END AS health_status,
  (k - 50) / 10000 AS combined_expected_return, k / 200 AS combined_uncertainty, k / 5000 AS combined_expected_volatility, k / 100 AS combined_confidence,
  CASE WHEN event_id % 4 = 0 THEN 'NEUTRAL' ELSE 'ACTIONABLE' END AS decision_status, CASE WHEN event_id % 3 = 0 THEN 'BUY' WHEN event_id % 3 = 1 THEN 'SELL' WHEN event_id % 7 = 0 THEN 'CLOSE' ELSE 'HOLD' END AS action,
  CASE event_id % 5 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' END AS position_side, CASE WHEN event_id % 2 = 0 THEN value * 10 END AS requested_notional
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
""",
)
_PT = ["requested_target_exposure", "requested_delta", "risk_contribution", "urgency"]


@query(
    "portfolio_targets",
    f"""WITH a AS (SELECT *, least(1, abs(combined_expected_return) / 0.003) AS edge, least(0.85, combined_uncertainty * 0.55 + combined_expected_volatility * 25) AS drag, greatest(0, least(1, (liquidity_score - 0.2) / 0.8)) AS room FROM proposals),
      s AS (SELECT *, CASE WHEN combined_expected_return > 0 THEN 1 ELSE -1 END * 0.10 * edge * (1 - drag) * combined_confidence * room AS x0, greatest(0.40 - (gross_exposure - abs(current_exposure)), 0) AS g, net_exposure - current_exposure AS o,
        greatest(0.25 - (cluster_exposure - abs(current_exposure)), 0) AS c FROM a),
      t AS (SELECT *, greatest(-g, least(g, greatest(-0.10, least(0.10, x0)))) AS x1 FROM s),
      u AS (SELECT *, greatest(-0.25 - o, least(0.25 - o, x1)) AS x2 FROM t),
      w AS (SELECT *, greatest(-c, least(c, x2)) AS x3, decision_status = 'ACTIONABLE' AND liquidity_score >= 0.2 AS live FROM u),
      f AS (SELECT event_id, CASE WHEN live THEN x3 ELSE 0 END AS requested_target_exposure, CASE WHEN live THEN x3 ELSE 0 END - current_exposure AS requested_delta,
        abs(CASE WHEN live THEN x3 ELSE 0 END) * greatest(combined_uncertainty, 0.01) AS risk_contribution, CASE WHEN live THEN edge * combined_confidence ELSE 0 END AS urgency FROM w)
      SELECT event_id, {sql_round(_PT)} FROM f""",
    uses="proposals",
)
def portfolio_targets(spark, sf):
    made = sc.portfolio_target()
    return proposal_rows(spark, sf).drop("requested_target_exposure").select("event_id", *[rnd(e).alias(n) for n, e in made.items()])


_GATES = {
    "KILL_SWITCH|KILL_SWITCH_ACTIVE": "kill_switch", "MIN_CONFIDENCE|CONFIDENCE_BELOW_MINIMUM": "confidence < 0.55",
    "MARKET_DATA|MISSING_MARKET_DATA": "(price <= 0 OR market_age_seconds IS NULL)", "STALE_DATA|STALE_MARKET_DATA": "price > 0 AND market_age_seconds > 180",
    "FUTURE_DATA|FUTURE_MARKET_DATA": "price > 0 AND market_age_seconds < -5", "MISSING_REQUIRED_FEATURES|MISSING_REQUIRED_FEATURES": "features_missing",
    "MODEL_HEALTH|MODEL_HEALTH_REJECTED": "health_status = 'SUSPENDED'", "MINIMUM_LIQUIDITY|LIQUIDITY_BELOW_MINIMUM": "liquidity_score < 0.2",
    "MAX_DAILY_LOSS|MAX_DAILY_LOSS_REACHED": "daily_pnl <= -50", "MAX_PORTFOLIO_DRAWDOWN|MAX_PORTFOLIO_DRAWDOWN_REACHED": "abs(drawdown) >= 0.20",
    "COOLDOWN|COOLDOWN_ACTIVE": "cooldown", "MAX_OPEN_POSITIONS|MAX_OPEN_POSITIONS_REACHED": "current_exposure = 0 AND open_positions >= 10",
}
_LIMITS = ", ".join([f"CASE WHEN {c} THEN '{n.split('|')[0]}' END" for n, c in _GATES.items()] + [
    "CASE WHEN t1 THEN 'MAX_SYMBOL_EXPOSURE' END", "CASE WHEN t2 THEN 'MAX_GROSS_EXPOSURE' END", "CASE WHEN t3 THEN 'MAX_NET_EXPOSURE' END",
    "CASE WHEN t4 THEN 'MAX_MARGIN_ALLOCATION' END", "CASE WHEN t5 THEN 'MAX_CORRELATED_CLUSTER_EXPOSURE' END", "CASE WHEN t6 THEN 'MAX_FEE_EXPOSURE' END",
    "CASE WHEN uneven THEN 'CORRELATED_CLUSTER_DATA' END"])
_REJECTS = ", ".join([f"CASE WHEN {c} THEN '{n.split('|')[1]}' END" for n, c in _GATES.items()] + [
    "CASE WHEN uneven THEN 'INCONSISTENT_CORRELATED_CLUSTER_EXPOSURE' END", "CASE WHEN expected_cost > 0.003 THEN 'MAX_EXPECTED_TRANSACTION_COST' END",
    "CASE WHEN equity <= 0 OR cash_balance <= 0 THEN 'NO_AVAILABLE_PAPER_EQUITY' END",
    "CASE WHEN abs(a5 - cur) * equity < 50 AND abs(a5 - cur) > 1e-12 THEN 'BELOW_MINIMUM_PAPER_NOTIONAL' END",
    "CASE WHEN abs(a6 - cur) <= 1e-12 AND abs(req - cur) > 1e-12 THEN 'NO_EXPOSURE_REMAINS_AFTER_RISK_CAPS' END"])


@query(
    "risk_screening",
    f"""WITH p AS (SELECT *, current_exposure AS cur, requested_target_exposure AS req,
        NOT (abs(requested_target_exposure) <= abs(current_exposure) AND (current_exposure = 0 OR requested_target_exposure = 0 OR sign(current_exposure) = sign(requested_target_exposure))) AND abs(requested_target_exposure) > 1e-12 AS inc FROM proposals),
      q1 AS (SELECT *, abs(req) > 0.10 AS t1, CASE WHEN abs(req) > 0.10 THEN 0.10 * sign(req) ELSE req END AS a1 FROM p),
      q2 AS (SELECT *, gross_exposure - abs(cur) + abs(a1) > 0.40 AS t2, CASE WHEN gross_exposure - abs(cur) + abs(a1) > 0.40 THEN least(abs(a1), greatest(0.40 - (gross_exposure - abs(cur)), 0)) * (CASE WHEN a1 < 0 THEN -1 ELSE 1 END) ELSE a1 END AS a2 FROM q1),
      q3 AS (SELECT *, abs(net_exposure - cur + a2) > 0.25 AS t3, CASE WHEN abs(net_exposure - cur + a2) > 0.25 THEN least(greatest(a2, -0.25 - (net_exposure - cur)), 0.25 - (net_exposure - cur)) ELSE a2 END AS a3 FROM q2),
      q4 AS (SELECT *, abs(a3) > 0.10 AS t4, CASE WHEN abs(a3) > 0.10 THEN 0.10 * sign(a3) ELSE a3 END AS a4, cluster_exposure + 1e-12 < abs(cur) AS uneven, greatest(0.25 - greatest(cluster_exposure - abs(cur), 0), 0) AS room FROM q3),
      q5 AS (SELECT *, NOT uneven AND abs(a4) > room AS t5, CASE WHEN NOT uneven AND abs(a4) > room THEN room * (CASE WHEN a4 < 0 THEN -1 ELSE 1 END) ELSE a4 END AS a5 FROM q4),
      q6 AS (SELECT *, abs(a5 - cur) * equity * 0.0004 > equity * 0.00005 AS t6 FROM q5),
      q7 AS (SELECT *, CASE WHEN t6 THEN cur + abs(a5 - cur) * (equity * 0.00005 / (abs(a5 - cur) * equity * 0.0004)) * (CASE WHEN a5 - cur < 0 THEN -1 ELSE 1 END) ELSE a5 END AS a6 FROM q6),
      r AS (SELECT *, list_sort(list_filter([{_LIMITS}], lambda z: z IS NOT NULL)) AS lim, list_sort(list_filter([{_REJECTS}], lambda z: z IS NOT NULL)) AS rej FROM q7)
      SELECT event_id, NOT inc OR len(rej) = 0 AS approved, CASE WHEN inc THEN array_to_string(lim, ',') ELSE '' END AS triggered_limits, CASE WHEN inc THEN array_to_string(rej, ',') ELSE '' END AS rejection_reasons,
        round(CASE WHEN NOT inc THEN req WHEN len(rej) = 0 THEN a6 ELSE 0 END + 1e-12, 6) + 0.0 AS approved_exposure FROM r""",
    uses="proposals",
)
def risk_screening(spark, sf):
    return sc.risk_screen(proposal_rows(spark, sf), max_fee=0.00005).select(
        "event_id", "approved", F.array_join("triggered_limits", ",").alias("triggered_limits"),
        F.array_join("rejection_reasons", ",").alias("rejection_reasons"), rnd("approved_exposure").alias("approved_exposure"),
    )


@query(
    "legacy_risk_screening",
    """WITH p AS (SELECT *, CASE WHEN action = 'HOLD' THEN 'hold' WHEN action = 'CLOSE' AND position_side IS NULL THEN 'missing_position' WHEN action = 'CLOSE' THEN 'close' WHEN position_side IS NULL THEN 'open'
          WHEN position_side = CASE action WHEN 'BUY' THEN 'LONG' ELSE 'SHORT' END THEN 'increase' ELSE 'close' END AS intent, greatest(0, least(1, (confidence - 0.55) / 0.45)) AS sc FROM proposals),
      c AS (SELECT *, intent IN ('open', 'increase') AS opening, concat_ws(',', CASE WHEN confidence < 0.55 THEN 'CONFIDENCE_BELOW_MINIMUM' END, CASE WHEN kill_switch THEN 'KILL_SWITCH_ACTIVE' END,
          CASE WHEN market_age_seconds IS NULL THEN 'MISSING_MARKET_DATA_TIMESTAMP' WHEN market_age_seconds < -5 THEN 'FUTURE_MARKET_DATA' WHEN market_age_seconds > 180 THEN 'STALE_MARKET_DATA' END,
          CASE WHEN daily_pnl <= -50 THEN 'MAX_DAILY_LOSS_REACHED' END, CASE WHEN abs(drawdown) >= 0.2 THEN 'MAX_PORTFOLIO_DRAWDOWN_REACHED' END, CASE WHEN cooldown THEN 'COOLDOWN_ACTIVE' END,
          CASE WHEN position_side IS NULL AND open_positions >= 10 THEN 'MAX_OPEN_POSITIONS_REACHED' END) AS codes, 1 + 2 * sc AS lev, 0.10 * sc AS alloc FROM p),
      n AS (SELECT *, least(cash_balance / (1 + 0.0004 * lev), equity * alloc) * lev AS raw FROM c),
      m AS (SELECT *, least(least(raw, coalesce(greatest(requested_notional, 0), raw)), 1000 * 0.01 / 0.0004) AS cap FROM n),
      r AS (SELECT *, CASE WHEN opening THEN CASE WHEN codes <> '' THEN codes WHEN alloc <= 0 THEN 'NO_POSITIVE_SIZE' WHEN cap <= 0 THEN 'NO_AVAILABLE_CASH' ELSE '' END WHEN intent = 'missing_position' THEN 'MISSING_POSITION' ELSE '' END AS rej FROM m)
      SELECT event_id, intent, rej = '' AS approved, rej AS rejection_reasons, round(CASE WHEN opening AND rej = '' THEN cap ELSE 0 END + 1e-12, 6) + 0.0 AS approved_notional,
        round(CASE WHEN opening AND rej = '' THEN lev ELSE 1 END + 1e-12, 6) + 0.0 AS approved_leverage, round(CASE WHEN opening AND rej = '' THEN alloc ELSE 0 END + 1e-12, 6) + 0.0 AS allocation_pct FROM r""",
    uses="proposals",
)
def legacy_risk_screening(spark, sf):
    return sc.legacy_risk(proposal_rows(spark, sf)).select(
        "event_id", "intent", "approved", F.array_join("rejection_reasons", ",").alias("rejection_reasons"), rnd("approved_notional").alias("approved_notional"),
        rnd("approved_leverage").alias("approved_leverage"), rnd("allocation_pct").alias("allocation_pct"),
    )


@query(
    "rule_strategy_decisions",
    """WITH a AS (SELECT *, CASE WHEN rsi_14 = 0 THEN 0.5 ELSE rsi_14 END AS rsi, CASE WHEN bollinger_position = 0 THEN 0.5 ELSE bollinger_position END AS bp, volatility AS vol,
        abs(candle_return_5m) + abs(candle_return_1m) * 0.45 + abs(sentiment_score) * greatest(sentiment_confidence, 0.25) * 0.0025 + CASE WHEN taker_buy_pressure <> 0 THEN abs(trader_crowd_score) * 0.0015 + abs(taker_buy_pressure - 0.5) * 0.002 ELSE 0 END
          + greatest(0, adx_14 - 0.20) * 0.0015 + least(atr_14_pct * 1.5, 0.002) AS edge FROM bank),
      c AS (SELECT *, candle_return_5m * 80 + candle_return_1m * 35 + trend_score * 0.7 + sentiment_score * greatest(sentiment_confidence, 0.35) * 0.35 + CASE WHEN taker_buy_pressure <> 0 THEN (taker_buy_pressure - 0.5) * 0.85 ELSE 0 END
          + trader_crowd_score * 0.2 + market_regime_score * 0.15 + greatest(-1, least(1, (rsi - 0.5) * 2)) * 0.16 + greatest(-0.35, least(0.35, vwap_20_distance_pct * 80)) * 0.12 + adx_14 * trend_score * 0.18 + liquidation_imbalance_5m * 0.12 AS bias FROM a),
      s AS (SELECT *, bias + CASE WHEN bp >= 0.9 THEN -0.10 WHEN bp <= 0.1 THEN 0.06 ELSE 0 END + greatest(sentiment_score, 0) * impact_score * 0.2 - risk_score * 0.18 AS ls,
        -bias + CASE WHEN bp >= 0.9 THEN 0.06 WHEN bp <= 0.1 THEN -0.10 ELSE 0 END + greatest(-sentiment_score, 0) * impact_score * 0.2 - risk_score * 0.10 AS ss, CASE WHEN vol >= 0.0008 THEN 0.22 ELSE 0.30 END AS lim FROM c),
      d AS (SELECT *, CASE WHEN candles_used <> 0 AND candles_used < 20 THEN 'young' WHEN risk_score >= 0.85 THEN 'noisy' WHEN crowd_risk_score >= 0.9 AND abs(trend_score) < 0.35 THEN 'crowded' WHEN edge < 0.0018 THEN 'thin'
        WHEN ls > lim AND ls > ss + 0.08 THEN 'buy' WHEN ss > lim AND ss > ls + 0.08 THEN 'sell' ELSE 'none' END AS st FROM s),
      e AS (SELECT *, CASE st WHEN 'buy' THEN ls WHEN 'sell' THEN ss END AS score, greatest(0.01, least(0.025, 0.006 + greatest(vol, atr_14_pct) * 8)) AS stop FROM d)
      SELECT event_id, CASE st WHEN 'buy' THEN 'BUY' WHEN 'sell' THEN 'SELL' ELSE 'HOLD' END AS action,
        round(CASE st WHEN 'young' THEN 0.6 WHEN 'noisy' THEN 0.7 WHEN 'crowded' THEN 0.65 WHEN 'thin' THEN 0.6 WHEN 'none' THEN 0.55 ELSE
          greatest(0.56, least(0.92, 0.55 + least(score, 1) * 0.22 + greatest(0, least(0.18, (edge - 0.0018) * 35)) + least(0.10, vol * 40))) END + 1e-12, 6) + 0.0 AS confidence,
        round(last_close * (1 - CASE st WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 END * stop) + 1e-12, 6) + 0.0 AS stop_loss,
        round(last_close * (1 + CASE st WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 END * greatest(0.02, least(0.055, stop * CASE st WHEN 'buy' THEN 2.0 ELSE 1.8 END))) + 1e-12, 6) + 0.0 AS take_profit,
        round(ls + 1e-12, 6) + 0.0 AS long_score, round(ss + 1e-12, 6) + 0.0 AS short_score FROM e""",
    uses="bank",
)
def rule_strategy_decisions(spark, sf):
    made = sc.rule_decision()
    return feature_bank(spark, sf).select(
        "event_id", made["action"].alias("action"), *[rnd(made[c]).alias(c) for c in ("confidence", "stop_loss", "take_profit", "long_score", "short_score")]
    )


_MODEL = ({"candle_return_5m": 0.6, "sentiment_score": 0.002, "volatility": -0.1}, 0.0001)
_SPECIAL = {"news_shock": ({"sentiment_score": 0.004}, 0.0), "trend_up": ({"trend_score": 0.003}, 0.0002)}
_MD = ["predicted_return", "confidence", "expected_volatility", "probability_up", "probability_down", "uncertainty"]


@query(
    "specialist_model_forecast",
    f"""WITH r AS (SELECT *, CASE {" ".join(f"WHEN {c} THEN '{n}'" for n, c in _MASKS.items())} END AS specialist_regime FROM regimes),
      p AS (SELECT *, CASE specialist_regime WHEN 'news_shock' THEN sentiment_score * 0.004 WHEN 'trend_up' THEN 0.0002 + trend_score * 0.003 ELSE 0.0001 + candle_return_5m * 0.6 + sentiment_score * 0.002 - volatility * 0.1 END AS predicted_return FROM r),
      q AS (SELECT *, greatest(0, least(0.95, 0.45 + abs(predicted_return) / 0.0072 * 0.35)) AS confidence, greatest(abs(volatility), abs(predicted_return) * 0.5, 0.0001) AS expected_volatility FROM p),
      o AS (SELECT *, 1 / (1 + exp(-greatest(-20, least(20, predicted_return / expected_volatility)))) AS probability_up, 1 - confidence AS uncertainty FROM q),
      z AS (SELECT *, 1 - probability_up AS probability_down FROM o)
      SELECT event_id, specialist_regime, CASE WHEN specialist_regime IN ('news_shock', 'trend_up') THEN 'regime_specialist:' || specialist_regime ELSE 'global_model' END AS prediction_source,
        CASE WHEN predicted_return > 0.0018 THEN 'LONG' WHEN predicted_return < -0.0018 THEN 'SHORT' ELSE 'FLAT' END AS direction, {sql_round(_MD, 8)} FROM z""",
    uses="bank regimes",
)
def specialist_model_forecast(spark, sf):
    df = sc.with_columns(regimes(spark, sf), sc.specialist_forecast(_SPECIAL, _MODEL))
    df = sc.with_columns(df.drop("confidence", "direction"), sc.model_decision(F.col("predicted_return"), F.col("volatility")))
    return df.select("event_id", "specialist_regime", "prediction_source", "direction", *[rnd(c, 8).alias(c) for c in _MD])


@query(
    "symbol_identity_flags",
    "SELECT m.symbol, count(*) AS rows, CAST(max(m.symbol = 'BTCUSDT') AS DOUBLE) AS symbol_is_BTCUSDT, CAST(max(m.symbol IN ('BTCUSDT', 'ETHUSDT', 'BNBUSDT')) AS DOUBLE) AS symbol_group_major, "
    "CAST(max(m.symbol = 'SOLUSDT') AS DOUBLE) AS symbol_group_layer1, CAST(max(m.symbol = 'DOGEUSDT') AS DOUBLE) AS symbol_group_meme, CAST(1 AS DOUBLE) AS identity_sum FROM events e JOIN market m ON m.kind = e.event_type GROUP BY m.symbol",
    uses="market",
)
def symbol_identity_flags(spark, sf):
    flags = sc.symbol_identity(F.col("symbol"))
    df = b.ticks(spark, sf).select(b.market_symbol().alias("symbol"))
    df = sc.with_columns(df, flags)
    total = F.lit(0.0)
    for s in sc.SYMBOLS:
        total = total + F.col(f"symbol_is_{s}")
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), *[F.max(c).alias(c) for c in ("symbol_is_BTCUSDT", "symbol_group_major", "symbol_group_layer1", "symbol_group_meme")],
        F.max(total).alias("identity_sum"),
    )


@query(
    "base_asset_extraction",
    "SELECT DISTINCT m.symbol, replace(m.symbol, 'USDT', '') AS base FROM events e JOIN market m ON m.kind = e.event_type",
    uses="market",
)
def base_asset_extraction(spark, sf):
    return b.ticks(spark, sf).select(b.market_symbol().alias("symbol")).distinct().withColumn("base", tx.base_asset(F.col("symbol")))


_ET = ["target_trade_action", "target_edge_threshold", "target_edge_aware_trade_score"]


@query(
    "edge_aware_targets",
    f"""WITH x AS (SELECT *, candle_return_5m AS ret, least(0.02, greatest(0.0012, 0.0012 + least(0.006, abs(volatility) * 0.4) + least(0.0005, (1 - regime_trend_strength) * 0.0005))) AS target_edge_threshold FROM regimes_offline),
      y AS (SELECT *, CASE WHEN ret > target_edge_threshold THEN 1.0 WHEN ret < -target_edge_threshold THEN -1.0 ELSE 0.0 END AS target_trade_action FROM x),
      o AS (SELECT *, CASE WHEN target_trade_action = 0 THEN 0 ELSE ret - target_trade_action * target_edge_threshold END AS target_edge_aware_trade_score FROM y)
      SELECT event_id, {sql_round(_ET)} FROM o""",
    uses="bank regimes_offline",
)
def edge_aware_targets(spark, sf):
    made = sc.edge_targets(F.col("candle_return_5m"))
    return regimes(spark, sf, False).select("event_id", *[rnd(e).alias(n) for n, e in made.items()])


_PL = ["target_best_margin_pct", "target_best_leverage", "target_best_stop_loss_pct", "target_best_take_profit_pct", "target_best_hold_seconds"]


@query(
    "plan_targets",
    f"""WITH x AS (SELECT event_id, candle_return_5m AS ret, candle_return_5m - 0.0008 AS q, greatest(candle_return_5m, 0) AS up, least(candle_return_5m, 0) AS dn, CAST(event_id % 2 AS DOUBLE) AS tk,
        CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS act FROM bank),
      y AS (SELECT *, least(1, abs(ret) / 0.025) AS reach FROM x),
      z AS (SELECT *, greatest(greatest(0, least(1, (q + 0.004) / 0.035)), reach * 0.65) * act AS plan FROM y),
      o AS (SELECT event_id, 0.10 * plan AS target_best_margin_pct, 1 + 124 * plan AS target_best_leverage, greatest(0.003, least(0.08, greatest(abs(dn) * 1.15, abs(ret) * 0.65))) * act AS target_best_stop_loss_pct,
        greatest(0.006, least(0.20, greatest(abs(up) * 0.9, abs(ret) * 1.8))) * act AS target_best_take_profit_pct, greatest(300, least(14400, 900 + 13500 * (1 - reach) - tk * 1800)) AS target_best_hold_seconds FROM z)
      SELECT event_id, {sql_round(_PL)} FROM o""",
    uses="bank",
)
def plan_targets(spark, sf):
    ret = F.col("candle_return_5m")
    made = sc.plan_targets(
        ret, ret - 0.0008, F.greatest(ret, F.lit(0.0)), F.least(ret, F.lit(0.0)), (F.col("event_id") % 2).cast("double"),
        F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(1.0),
    )
    return feature_bank(spark, sf).select("event_id", *[rnd(e).alias(n) for n, e in made.items()])


@query(
    "rule_baseline_predictions",
    "SELECT event_id, round(candle_return_5m + sentiment_score * 0.002 + trader_crowd_score * 0.001 - risk_score * 0.002 + 1e-12, 6) + 0.0 AS prediction FROM bank",
    uses="bank",
)
def rule_baseline_predictions(spark, sf):
    return feature_bank(spark, sf).select("event_id", rnd(sc.rule_baseline()).alias("prediction"))


@query(
    "worst_health_by_symbol",
    """SELECT event_type AS symbol, CASE max(CASE WHEN event_id % 101 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) WHEN 0 THEN 'HEALTHY' WHEN 1 THEN 'WATCH' WHEN 2 THEN 'DEGRADED' ELSE 'SUSPENDED' END AS health,
      last(value ORDER BY ts, event_id) AS mark_price FROM events GROUP BY event_type""",
)
def worst_health_by_symbol(spark, sf):
    i = F.col("event_id")
    status = F.when(i % 101 == 0, "SUSPENDED").when(i % 7 == 0, "DEGRADED").when(i % 5 == 0, "WATCH").otherwise("HEALTHY")
    return b.table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(
        sc.worst_health(status).alias("health"), F.max_by("value", F.struct("ts", "event_id")).alias("mark_price")
    )


_FILL = ["fill_price", "fill_fraction", "fee", "gross_pnl"]


@query(
    "fill_price_columns",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_extendedprice / l_quantity AS p, CASE WHEN l_returnflag = 'A' THEN 'SHORT' ELSE 'LONG' END AS side,
        CASE WHEN l_linenumber <> 3 THEN l_quantity * l_linenumber * 2 END AS vol FROM lineitem),
      y AS (SELECT *, 0.0001 + 0.001 * sqrt(CASE WHEN vol IS NOT NULL THEN least(1, q / vol) ELSE 0 END) AS sh FROM x),
      z AS (SELECT *, CASE WHEN side = 'LONG' THEN p * 1.0001 * (1 + sh) ELSE p * 0.9999 * (1 - sh) END AS fill_price FROM y),
      o AS (SELECT *, CASE WHEN vol IS NULL THEN 1 ELSE least(1, vol * 0.1 / q) END AS fill_fraction, fill_price * q * 0.0004 AS fee, CASE WHEN side = 'LONG' THEN fill_price - p ELSE p - fill_price END * q AS gross_pnl FROM z)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_round(_FILL, 4)} FROM o""",
)
def fill_price_columns(spark, sf):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    made = sc.fill_columns(
        price, F.when(F.col("l_returnflag") == "A", "SHORT").otherwise("LONG"), F.col("l_quantity"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * F.col("l_linenumber") * 2), price,
    )
    return b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[rnd(e, 4).alias(n) for n, e in made.items()]
    )
