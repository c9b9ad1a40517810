"""Latest-value snapshots of long event facts and the scores built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.clock import age_hours, recency_weight
from tidemark.functions.numeric import change, clamp, zero
from tidemark.operators.series import BLOCK, lag_across, range_blocks


def _within(events: DataFrame, as_of: Column, hours: int) -> DataFrame:
    t = F.col("event_time")
    return events.where((t >= as_of - F.make_dt_interval(hours=F.lit(hours))) & (t <= as_of))


def latest_by_type(
    events: DataFrame, as_of: Column, hours: int, types: Sequence[str], keys: Sequence[str] = ("symbol",), tie: str = "event_id"
) -> DataFrame:
    """Newest value and time of each data type, one row per key.

    One aggregate with a filtered ``max_by`` per type; partial maxima are made
    before the shuffle, so a busy symbol costs no more than one row per task.
    """
    order = F.struct("event_time", tie)
    cells = []
    for name in types:
        mine = F.col("data_type") == name
        cells += [
            F.max_by("numeric_value", F.when(mine, order)).alias(name), F.max(F.when(mine, F.col("event_time"))).alias(f"{name}__at"),
        ]
    return _within(events, as_of, hours).where(F.col("data_type").isin(*types)).groupBy(*keys).agg(*cells)


def with_global_fallback(
    symbols: DataFrame, events: DataFrame, as_of: Column, hours: int, symbol_first: Sequence[str], market_wide: Sequence[str], tie: str = "event_id"
) -> DataFrame:
    """Latest values per symbol: own value first where asked, else any newest value."""
    own = latest_by_type(events.where(F.col("symbol").isNotNull()), as_of, hours, symbol_first, tie=tie)
    every = latest_by_type(events.withColumn("__all", F.lit(0)), as_of, hours, [*symbol_first, *market_wide], keys=["__all"], tie=tie)
    own = own.select("symbol", *[F.col(c).alias(f"__o_{c}") for c in own.columns if c != "symbol"])
    # ``every`` is a single row.
    out = symbols.select("symbol").distinct().join(own, "symbol", "left").withColumn("__all", F.lit(0)).join(F.broadcast(every), "__all", "left")
    picked = []
    for name in symbol_first:
        has = F.col(f"__o_{name}__at").isNotNull()
        picked += [F.when(has, F.col(f"__o_{name}")).otherwise(F.col(name)).alias(name), F.coalesce(f"__o_{name}__at", f"{name}__at").alias(f"{name}__at")]
    return out.select("symbol", *picked, *[F.col(c) for n in market_wide for c in (n, f"{n}__at")])


# Source, the types whose time counts, and the age at which it is stale.
FRESHNESS = {
    "fear_greed": (["fear_greed_value"], 30.0),
    "global_market": (["global_market_cap_change_24h", "market_cap_change_24h"], 12.0),
    "spot_context": (["spot_activity_score"], 1.0),
    "liquidations": (["liquidation_total_usd_5m"], 1.0),
    "stablecoin_risk": (["stablecoin_depeg_risk"], 30.0),
    "macro_risk": (["macro_risk_score"], 12.0),
}


def stale_sources(as_of: Column, columns: Sequence[str]) -> Column:
    """Names of sources that are missing or older than their limit."""
    cells = []
    for source, (types, limit) in FRESHNESS.items():
        times = [F.col(f"{t}__at") for t in types if f"{t}__at" in columns]
        newest = F.greatest(*times) if len(times) > 1 else (times[0] if times else F.lit(None).cast("timestamp_ntz"))
        cells.append(F.when(newest.isNull() | (age_hours(newest, as_of) > limit), F.lit(source)))
    return F.array_compact(F.array(*cells))


def market_regime_score() -> Column:
    """Market score from the latest context columns; missing values count as zero."""
    g = lambda c: zero(F.col(c))
    fear = F.when(g("fear_greed_value") != 0, clamp((g("fear_greed_value") - 50.0) / 50.0)).otherwise(0.0)
    cap = F.coalesce(F.col("global_market_cap_change_24h"), F.col("market_cap_change_24h"), F.lit(0.0))
    growth = clamp(cap * 8.0 + g("total_volume_change_24h") * 2.0)
    drag = clamp(
        g("stablecoin_depeg_risk") * 0.35 + g("macro_risk_score") * 0.20 + g("regulation_risk_score") * 0.15
        + g("security_risk_score") * 0.15 + g("world_risk_score") * 0.15, 0.0, 1.0,
    )
    liquid = clamp(g("spot_activity_score") * 0.5 - g("spot_bid_ask_spread_pct") * 100.0, -0.5, 0.5)
    shock = clamp(g("liquidation_spike_score") / 5.0, 0.0, 1.0)
    return clamp(fear * 0.25 + growth * 0.25 + liquid * 0.10 + g("etf_bullish_score") * 0.20 - drag * 0.35 - shock * 0.10)


# Derivative feeds in the order they are reported.
DERIVATIVE_TYPES = [
    "global_long_short_account_ratio", "top_long_short_account_ratio", "top_long_short_position_ratio", "taker_buy_sell_volume",
    "open_interest_hist", "open_interest", "funding_rate",
]


def derivatives_snapshot(events: DataFrame, as_of: Column, hours: int = 24, tie: str = "event_id") -> DataFrame:
    """Crowd, flow, open interest and funding features of each symbol.

    ``events`` carries ``payload`` as a map of doubles.  The change of open
    interest compares the two newest readings of either open-interest feed.
    """
    order = F.struct("event_time", tie)
    recent = _within(events, as_of, hours).where(F.col("data_type").isin(*DERIVATIVE_TYPES) & F.col("symbol").isNotNull())
    picked = {t: F.max_by("payload", F.when(F.col("data_type") == t, order)) for t in DERIVATIVE_TYPES}
    latest = recent.groupBy("symbol").agg(
        *[e.alias(f"p_{t}") for t, e in picked.items()],
        *[F.max(F.when(F.col("data_type") == t, F.col("event_time"))).alias(f"t_{t}") for t in DERIVATIVE_TYPES],
    )
    interest = recent.where(F.col("data_type").isin("open_interest_hist", "open_interest") & F.col("numeric_value").isNotNull())
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.col("event_time").desc(), F.col(tie).desc()))
    two = interest.withColumn("__n", place).where(F.col("__n") <= 2).groupBy("symbol").agg(
        F.max(F.when(F.col("__n") == 1, F.col("numeric_value"))).alias("oi_now"), F.max(F.when(F.col("__n") == 2, F.col("numeric_value"))).alias("oi_before")
    )

    def got(kind: str, key: str) -> Column:
        return zero(F.try_element_at(F.col(f"p_{kind}"), F.lit(key)))

    long_pct, short_pct = got("global_long_short_account_ratio", "long_account_pct"), got("global_long_short_account_ratio", "short_account_pct")
    top_long, top_pos = got("top_long_short_account_ratio", "long_account_pct"), got("top_long_short_position_ratio", "long_account_pct")
    taker = got("taker_buy_sell_volume", "buy_pressure")
    held = got("open_interest_hist", "sum_open_interest_value")
    funding = got("funding_rate", "funding_rate")
    biases = F.array_compact(
        F.array(
            F.when((long_pct != 0) | (short_pct != 0), clamp((long_pct - short_pct) * 2.0)),
            F.when(top_long != 0, clamp((top_long - 0.5) * 2.0)), F.when(top_pos != 0, clamp((top_pos - 0.5) * 2.0)),
            F.when(taker != 0, clamp((taker - 0.5) * 2.0)),
        )
    )
    out = latest.join(two, "symbol", "left").withColumn("__b", biases)
    total = F.aggregate("__b", F.lit(0.0), lambda a, x: a + x)
    crowding = zero(F.array_max(F.transform("__b", lambda x: F.abs(x))))
    moved = F.when(F.col("oi_before").isNotNull(), zero(change(F.col("oi_now"), F.col("oi_before")))).otherwise(0.0)
    pressure = clamp(funding / 0.0005)
    fresh = F.transform(
        F.array_compact(F.array(*[F.col(f"t_{t}") for t in DERIVATIVE_TYPES])), lambda t: recency_weight(t, as_of, 24.0)
    )
    return out.select(
        "symbol", long_pct.alias("crowd_long_account_pct"), short_pct.alias("crowd_short_account_pct"),
        got("global_long_short_account_ratio", "long_short_ratio").alias("crowd_long_short_ratio"),
        top_long.alias("top_trader_long_account_pct"), top_pos.alias("top_trader_position_long_pct"), taker.alias("taker_buy_pressure"),
        got("taker_buy_sell_volume", "buy_sell_ratio").alias("taker_buy_sell_ratio"),
        F.when(held == 0, got("open_interest", "open_interest")).otherwise(held).alias("open_interest_value"),
        clamp(moved).alias("open_interest_change"), funding.alias("funding_rate"),
        clamp(F.when(F.size("__b") > 0, total / F.when(F.size("__b") > 0, F.size("__b"))).otherwise(0.0)).alias("trader_crowd_score"),
        clamp(crowding * 0.45 + F.abs(pressure) * 0.35 + F.abs(moved) * 8.0 * 0.20, 0.0, 1.0).alias("crowd_risk_score"),
        clamp(F.aggregate(fresh, F.lit(0.0), lambda a, x: a + x) / F.size(fresh), 0.0, 1.0).alias("derivatives_recency_weight"),
    )


def previous_change(events: DataFrame) -> DataFrame:
    """Change of each metric against its previous stored value.

    Series are cut into balanced runs, so a busy one is no single task.
    """
    keys = ["source_name", "data_type", "__sym"]
    keyed = range_blocks(events.withColumn("__sym", F.coalesce("symbol", F.lit(""))), keys, ["event_time", "event_id"])
    out = lag_across(keyed, keys, ["event_time", "event_id"], {"previous_value": F.col("numeric_value")})
    return out.withColumn("value_change", F.col("numeric_value") - F.col("previous_value")).withColumn(
        "value_change_pct", change(F.col("numeric_value"), F.col("previous_value"))
    ).drop("__sym", BLOCK)
