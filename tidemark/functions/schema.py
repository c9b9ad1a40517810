"""Versioned feature vectors: column lists, defaults, flattening, assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import finite
from tidemark.functions.scores import regime_scores

NEWS = ["sentiment_score", "sentiment_confidence", "risk_score", "impact_score", "recency_weight", "btc_related", "eth_related", "macro_related"]
MOVES = ["candle_return_1m", "candle_return_5m", "volatility", "volume_change", "trend_score"]
TECHNICAL = [
    "rsi_14", "macd_pct", "macd_signal_pct", "macd_histogram_pct", "sma_20_distance_pct", "ema_20_distance_pct", "bollinger_width_pct",
    "bollinger_position", "atr_14_pct", "vwap_20_distance_pct", "adx_14",
]
CLOCK = [
    "time_hour_utc_sin", "time_hour_utc_cos", "time_day_of_week_sin", "time_day_of_week_cos", "time_is_weekend", "session_asia",
    "session_london", "session_new_york",
]
DERIVATIVES = [
    "crowd_long_account_pct", "crowd_short_account_pct", "crowd_long_short_ratio", "top_trader_long_account_pct",
    "top_trader_position_long_pct", "taker_buy_pressure", "taker_buy_sell_ratio", "open_interest_value", "open_interest_change",
    "funding_rate", "trader_crowd_score", "crowd_risk_score", "derivatives_recency_weight",
]
SPOT = [
    "spot_price_change_24h", "spot_volume_24h", "spot_quote_volume_24h", "spot_trade_count_24h", "spot_weighted_avg_price",
    "spot_bid_ask_spread_pct", "spot_orderbook_imbalance", "spot_depth_bid_notional_5", "spot_depth_ask_notional_5",
    "spot_intraday_range_pct", "spot_activity_score",
]
CONTEXT = [
    "fear_greed_value", "fear_greed_change_1d", "fear_greed_change_24h", "fear_greed_classification", "total_market_cap_usd",
    "market_cap_change_24h", "global_market_cap_change_24h", "total_volume_usd", "total_volume_change_24h", "btc_dominance",
    "btc_dominance_change", "btc_dominance_change_24h", "eth_dominance", "liquidation_long_usd_1m", "liquidation_short_usd_1m",
    "liquidation_long_usd_5m", "liquidation_short_usd_5m", "liquidation_total_usd_5m", "liquidation_imbalance_5m",
    "liquidation_spike_score", "usdt_deviation", "usdc_deviation", "usdt_price_deviation", "usdc_price_deviation",
    "stablecoin_depeg_risk", "stablecoin_supply_change_1d", "stablecoin_supply_change_24h", "macro_risk_score",
    "regulation_risk_score", "fed_risk_score", "war_risk_score", "exchange_hack_risk_score", "etf_positive_score",
    "security_risk_score", "etf_bullish_score", "world_risk_score", "market_regime_score",
]
REGIME = [
    "regime_trend_strength", "regime_direction_score", "regime_volatility_score", "regime_news_shock_score", "regime_risk_off_score",
    "regime_liquidity_stress_score", "regime_breakout_pressure", "regime_mean_reversion_pressure", "regime_crowd_pressure",
]
# The columns of each feature version, in order.
VERSIONS: dict[str, list[str]] = {
    "price-news-v1": ["price_change", "volume_change", "volatility", "sentiment_score", "risk_score"],
    "price-news-v2": [*NEWS, *MOVES],
    "price-news-v3": [*NEWS, *MOVES, *DERIVATIVES],
    "price-news-market-v4": [*NEWS, *MOVES, *DERIVATIVES, *SPOT, *CONTEXT, *REGIME],
    "price-news-market-v5": [*NEWS, *MOVES, *TECHNICAL, *CLOCK, *DERIVATIVES, *SPOT, *CONTEXT, *REGIME],
}
CURRENT = "price-news-market-v5"
# Everything else defaults to zero.
DEFAULTS = {"rsi_14": 0.5, "bollinger_position": 0.5}


def columns_for(version: str | None) -> list[str]:
    return VERSIONS.get(version or CURRENT, VERSIONS[CURRENT])


def flatten(rows: DataFrame, columns: Sequence[str], values: str = "feature_values", payload: str = "payload", defaults: Mapping[str, float] | None = None) -> DataFrame:
    """Named numbers out of the JSON values, or of the payload's values when there are none."""
    own = F.from_json(values, "map<string,string>")
    nested = F.from_json(F.get_json_object(payload, "$.values"), "map<string,string>")
    m = F.when(F.size(F.coalesce(own, F.create_map().cast("map<string,string>"))) > 0, own).otherwise(nested)
    staged = rows.withColumn("__m", F.map_filter(m, lambda k, x: k != "final_ai_input"))
    fill = defaults or {}
    cell = lambda c: F.coalesce(F.try_element_at("__m", F.lit(c)).try_cast("double"), F.lit(fill.get(c)).cast("double"))
    return staged.select(*[c for c in rows.columns if c not in (values, payload)], *[cell(c).alias(c) for c in columns])


def with_defaults(rows: DataFrame, version: str | None = None) -> DataFrame:
    """All columns of a version: stored value, else derived regime score, else default."""
    names = columns_for(version)
    have = set(rows.columns)
    staged = rows
    for c in {*names, *MOVES, *NEWS, *DERIVATIVES, *SPOT, *CONTEXT} - have:
        staged = staged.withColumn(c, F.lit(None).cast("double")) if c not in REGIME else staged
    derived = regime_scores(True)
    cells = []
    for c in names:
        parts = [F.col(c)] if c in staged.columns else []
        parts += [derived[c]] if c in derived else []
        cells.append(F.coalesce(*parts, F.lit(DEFAULTS.get(c, 0.0))).cast("double").alias(c))
    rest = [c for c in rows.columns if c not in names]
    return staged.select(*rest, *cells)


def vector(version: str | None = None) -> Column:
    """Numeric vector of a version; null and non-finite values become the default."""
    return F.array(*[F.coalesce(finite(c), F.lit(DEFAULTS.get(c, 0.0))) for c in columns_for(version)])
