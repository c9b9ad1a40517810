"""Combine the signals of one decision into one weighted estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.numeric import clamp


def regime_penalty(regime: Column) -> Column:
    r = F.lower(F.coalesce(regime, F.lit("")))
    return (
        F.when(r.isin("risk_off", "liquidity_stress", "news_shock"), 0.30)
        .when(r.isin("high_volatility", "crowded_market"), 0.15).otherwise(0.0)
    )


def exclusion(at: Column) -> Column:
    """Why a signal takes no part, null when it does."""
    tradable = F.col("lifecycle_status").isin("PAPER", "LIMITED", "PRODUCTION", "REDUCED")
    return (
        F.when(~((F.col("generated_at") <= at) & (at < F.col("valid_until"))), "EXPIRED")
        .when(~tradable, F.concat(F.lit("LIFECYCLE_"), "lifecycle_status"))
        .when(F.col("health_status").isin("SUSPENDED", "RETIRED"), F.concat(F.lit("HEALTH_"), "health_status"))
        .when(F.col("direction") == "FLAT", "FLAT_SIGNAL")
    )


def _named(family: Column) -> Column:
    """A family as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), family.cast("string")), F.lit(""))


def _pair_map(correlations: DataFrame) -> Column:
    """Correlations of family pairs, in both directions, as a map of maps: as many entries as the registry has pairs of models."""
    both = correlations.select(_named(F.col("left_family")).alias("a"), _named(F.col("right_family")).alias("b"), clamp("correlation").alias("c")).where("c IS NOT NULL")
    cells = both.union(both.select("b", "a", "c")).groupBy("a", "b").agg(F.max("c").alias("c"))
    rows = cells.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"))
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("a", "m"))).alias("m")).scalar()


def signal_weights(
    signals: DataFrame, correlations: DataFrame | None = None, decision: str = "decision_id", threshold: float = 0.70
) -> DataFrame:
    """Weight of each signal inside its decision.

    Signals are ranked by quality; a signal too correlated with an earlier-ranked
    one loses up to three quarters of its weight.  ``correlations`` holds one row
    per unordered family pair.  A decision holds one signal per model: its signals are ordered once, each
    sees the families ahead of it, and columns nobody asks for are not carried along.
    """
    health = F.when(F.col("health_status") == "HEALTHY", 1.0).when(F.col("health_status") == "WATCH", 0.75).when(
        F.col("health_status") == "DEGRADED", 0.35
    ).otherwise(0.0)
    lift = clamp(F.coalesce("recent_performance", F.lit(0.0)), -0.2, 0.2)
    base = (
        F.greatest("confidence", F.lit(0.0)) * F.greatest(1.0 - F.col("uncertainty"), F.lit(0.0)) * F.greatest("liquidity_score", F.lit(0.0))
        * F.greatest("strength", F.lit(0.05)) * health * (1.0 + lift)
    )
    quality = F.col("confidence") * (1.0 - F.col("uncertainty")) * F.col("liquidity_score")
    kept = [c for c in signals.columns if c != decision]
    # Excluded ones sort behind; the best quality comes first, nulls behind it.
    order = ["__out", "__unknown", "__q", "signal_id", "__base", "__family"]
    staged = signals.withColumn("exclusion_reason", exclusion(F.col("decided_at"))).withColumns({
        "__out": F.col("exclusion_reason").isNotNull(), "__unknown": quality.isNull(), "__q": -quality, "__base": base, "__family": _named(F.col("family")),
    })
    mine = W.partitionBy(decision).orderBy(*order)
    staged = staged.withColumn("__ahead", F.collect_list("__family").over(mine.rowsBetween(W.unboundedPreceding, -1)))
    out, family = F.col("__out"), F.col("__family")
    if correlations is not None:
        staged = staged.withColumn("__pairs", F.try_element_at(_pair_map(correlations), family))

    def alike(other: Column) -> Column:
        same = F.when(other == family, F.lit(threshold)).otherwise(0.0)
        return same if correlations is None else F.greatest(same, F.coalesce(F.try_element_at(F.col("__pairs"), other), F.lit(0.0)))

    staged = staged.withColumn("__top", F.when(~out & (F.size("__ahead") > 0), F.array_max(F.transform("__ahead", alike))))
    penalty = F.when(F.col("__top") >= threshold, F.least((F.col("__top") - threshold) / max(1.0 - threshold, 1e-9), F.lit(1.0)))
    staged = staged.withColumn("correlation_penalty", penalty)
    raw = F.when(~out, F.greatest(F.col("__base") * (1.0 - 0.75 * F.coalesce("correlation_penalty", F.lit(0.0))), F.lit(0.0)))
    staged = staged.withColumn("raw_weight", raw).withColumn("__total", F.sum(F.coalesce("raw_weight", F.lit(0.0))).over(W.partitionBy(decision)))
    weight = F.when(F.col("raw_weight").isNotNull() & (F.col("__total") != 0), F.col("raw_weight") / F.when(F.col("__total") != 0, F.col("__total"))).otherwise(0.0)
    return staged.select(decision, *kept, "exclusion_reason", "correlation_penalty", "raw_weight", weight.alias("weight"))


def combine(
    weights: DataFrame, context: DataFrame | None = None, decision: str = "decision_id", min_edge: float = 0.0005, bound: float = 0.10
) -> DataFrame:
    """One estimate per decision from the weighted signals."""
    live = F.col("exclusion_reason").isNull()
    w = F.col("weight")
    total = lambda c: F.coalesce(F.sum(F.when(live, F.col(c) * w)), F.lit(0.0))
    out = weights.groupBy(decision).agg(
        F.first("regime").alias("regime"),
        F.count(F.when(live, 1)).alias("valid_signals"),
        total("net_expected_return").alias("__ret"), total("expected_volatility").alias("__vol"), total("uncertainty").alias("__unc"),
        total("confidence").alias("__conf"), total("expected_cost").alias("transaction_cost_penalty"),
        F.coalesce(F.avg("correlation_penalty"), F.lit(0.0)).alias("correlation_penalty"),
        F.sort_array(F.collect_list(F.when(live & (w > 0), F.struct("signal_id", "net_expected_return")))).alias("__parts"),
    )
    if context is not None:
        out = out.join(context.select(decision, "external_context_score"), decision, "left")
    else:
        out = out.withColumn("external_context_score", F.lit(0.0))
    some = F.col("valid_signals") > 0
    regime = regime_penalty(F.col("regime"))
    shift = clamp(F.coalesce("external_context_score", F.lit(0.0)), -bound, bound)
    cp = F.col("correlation_penalty")
    ret = F.when(some, F.col("__ret") * (1.0 - cp * 0.5) * (1.0 - regime) + shift).otherwise(0.0)
    conf = clamp(F.col("__conf") * (1.0 - F.least(cp * 0.2 + regime * 0.3, F.lit(0.6))), 0, 1)
    out = out.withColumn("combined_expected_return", ret).withColumn("combined_confidence", F.when(some, conf).otherwise(0.0))
    acts = some & (F.abs("combined_expected_return") >= min_edge) & (F.col("combined_confidence") > 0)
    side = lambda s: F.transform(
        F.filter("__parts", lambda p: p["net_expected_return"] * F.col("combined_expected_return") * s > 0), lambda p: p["signal_id"]
    )
    codes = F.when(~some, F.array(F.lit("NO_VALID_SIGNALS"))).otherwise(
        F.array_compact(
            F.array(
                F.lit("DETERMINISTIC_WEIGHTED_ENSEMBLE"), F.when(cp != 0, "CORRELATED_SIGNAL_WEIGHT_REDUCED"),
                F.when(F.col("transaction_cost_penalty") != 0, "EXPECTED_COST_PENALTY_APPLIED"),
                F.when(regime > 0, F.concat(F.lit("REGIME_PENALTY_"), F.upper("regime"))),
                F.when(shift != 0, "BOUNDED_EXTERNAL_CONTEXT_ADJUSTMENT"), F.when(~acts, "COMBINED_EDGE_BELOW_THRESHOLD"),
            )
        )
    )
    return out.select(
        decision, "regime", "valid_signals", "combined_expected_return",
        F.greatest("__vol", F.lit(0.0)).alias("combined_expected_volatility"),
        F.when(some, F.least(F.lit(1.0), F.col("__unc") + cp * 0.2 + regime * 0.25)).otherwise(1.0).alias("combined_uncertainty"),
        "combined_confidence", "correlation_penalty", "transaction_cost_penalty",
        F.when(some, regime).otherwise(0.0).alias("regime_penalty"),
        F.when(some, shift).otherwise(0.0).alias("external_context_adjustment"),
        F.when(acts, "ACTIONABLE").otherwise("NEUTRAL").alias("decision_status"),
        side(1).alias("supporting_signals"), side(-1).alias("conflicting_signals"), codes.alias("reason_codes"),
    )
