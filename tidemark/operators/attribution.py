"""Profit-and-loss attribution over the decision lineage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.money import TOTAL, amount, nil, rate, times
from tidemark.functions.numeric import finite
from tidemark.functions.scores import exposure_bucket, resize_class
from tidemark.operators.asof import latest_per_key

COUNTERFACTUALS = ["ensemble_contribution", "position_sizing_contribution", "broad_market_exposure", "execution_contribution"]
COMPONENTS = ["alpha_contribution", *COUNTERFACTUALS, "fees", "slippage", "funding"]


def fill_facts(fills: DataFrame) -> DataFrame:
    """Slippage estimate and booked or estimated funding per order."""
    booked = amount("funding_cash_flow")
    return fills.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("fill_count"),
        nil(amount(F.sum(times(F.abs(amount("notional")), F.abs(rate("slippage")))))).alias("slippage_cost"),
        amount(F.sum(booked)).alias("booked_funding"),
        amount(F.sum(F.when(booked.isNull(), -F.abs(amount("funding"))))).alias("estimated_funding"),
    )


def link_lineage(
    trades: DataFrame, orders: DataFrame, risks: DataFrame, targets: DataFrame, ensembles: DataFrame, fills: DataFrame
) -> DataFrame:
    """Left-join the ledger onto trades with the key fallbacks of each step.

    Every right side is unique per key, so no join multiplies trades.  What a trade meets
    follows from its three keys alone: each set of keys is resolved once, in narrow rows, and the
    trades with their amounts are shuffled once, to meet what was found.  That last join
    hashes the narrow side, so the wide one is not sorted.
    """
    keys = ["order_id", "risk_id", "trace_id"]
    o = orders.select("order_id", F.col("risk_id").alias("o_risk"), F.col("target_id").alias("o_target"), F.col("trace_id").alias("o_trace"))
    r = risks.select(
        "risk_id", F.lit(True).alias("has_risk"), F.col("target_id").alias("r_target"), F.col("trace_id").alias("r_trace"),
        F.col("requested_exposure").alias("risk_requested"), F.col("approved_exposure").alias("risk_approved"),
    )
    t = targets.select("target_id", F.lit(True).alias("has_target"), "requested_target_exposure", F.col("ensemble_id").alias("t_ensemble"))
    e = ensembles.select(F.col("ensemble_id").alias("t_ensemble"), F.col("regime").alias("e_regime"), F.lit(True).alias("e_direct"))
    newest = latest_per_key(ensembles, ["trace_id"], [F.col("generated_at").desc(), F.col("ensemble_id").desc()]).select(
        F.col("trace_id").alias("link_trace"), F.col("ensemble_id").alias("n_ensemble"), F.col("regime").alias("n_regime")
    )
    links = trades.select(*keys).repartition("order_id").distinct().select(*[F.col(k).alias(f"__{k}") for k in keys], "order_id", "risk_id", "trace_id")
    links = links.join(o.withColumn("has_order", F.lit(True)), "order_id", "left").join(fill_facts(fills), "order_id", "left").drop("order_id")
    links = links.withColumn("risk_id", F.coalesce("risk_id", "o_risk")).join(r, "risk_id", "left")
    links = links.withColumn("link_trace", F.coalesce("trace_id", "o_trace", "r_trace")).withColumn("target_id", F.coalesce("o_target", "r_target"))
    links = links.drop("trace_id", "o_risk", "o_target", "r_target", "o_trace", "r_trace").join(t, "target_id", "left")
    links = links.join(e, "t_ensemble", "left").join(newest, "link_trace", "left")
    links = links.withColumn("ensemble_id", F.when(F.col("e_direct"), F.col("t_ensemble")).otherwise(F.col("n_ensemble")))
    links = links.withColumn("regime", F.coalesce(F.when(F.col("e_direct"), F.col("e_regime")).otherwise(F.col("n_regime")), F.lit("unknown")))
    links = links.withColumnRenamed("risk_id", "__risk").drop("e_direct", "e_regime", "n_ensemble", "n_regime", "t_ensemble").hint("shuffle_hash")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    out = trades.join(links, same[0] & same[1] & same[2], "left")
    return out.withColumn("risk_id", F.col("__risk")).drop("__risk", *[f"__{k}" for k in keys])


def decompose(linked: DataFrame) -> DataFrame:
    """Components per trade, as exact amounts; an unknown component is null and stays in the residual.

    ``explicit`` is a map of recorded components that win over the estimates.
    """
    said = {c: amount(F.element_at("explicit", c)) for c in ("slippage", "funding", "alpha_contribution", *COUNTERFACTUALS)}
    out = linked.select(
        "*",
        amount(-amount("fee")).alias("fees"),
        F.coalesce(said["slippage"], F.when(F.col("fill_count") > 0, amount(-F.col("slippage_cost")))).alias("slippage"),
        F.coalesce(said["funding"], F.col("booked_funding")).alias("funding"),
        *[said[c].alias(c) for c in COUNTERFACTUALS],
    )
    stated = F.coalesce(*[F.col(c) for c in COUNTERFACTUALS]).isNotNull()
    gross = amount("gross_pnl")
    out = out.withColumn(
        "alpha_contribution",
        F.coalesce(said["alpha_contribution"], F.when(gross.isNotNull() & ~stated, amount(gross - nil(F.col("slippage"))))),
    )
    total = nil(amount("realized_pnl"))
    left = total
    for c in COMPONENTS:
        left = amount(left - nil(F.col(c)))
    return out.withColumn("total_paper_pnl", total).withColumn("unexplained_residual", left)


def trade_intent() -> Column:
    said = F.lower("intent")
    return (
        F.when(said == "close", "closed").when(said.isin("open", "increase"), "open_or_increase").when(said.isNotNull() & (said != ""), said)
        .when(F.upper("action") == "CLOSE", "closed").when(F.abs(finite("gross_pnl")) > 1e-12, "closed_inferred").otherwise("unknown_legacy")
    )


def period_key(time: Column, period: str) -> Column:
    made = {
        "hour": F.date_format(time, "yyyy-MM-dd'T'HH:00:00'Z'"),
        "day": F.date_format(time, "yyyy-MM-dd"),
        "week": F.concat(F.date_format(F.date_trunc("week", time), "yyyy-MM-dd"), F.lit("/week")),
        "month": F.date_format(time, "yyyy-MM"),
    }[period]
    return F.coalesce(made, F.lit("unknown"))


def component_totals(trades: DataFrame) -> DataFrame:
    """Sum, availability and coverage of each component, plus the reconciled total."""
    names = [*COMPONENTS, "unexplained_residual"]
    cells = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("v")) for c in names])
    return trades.select(F.explode(cells).alias("c"), "total_paper_pnl").groupBy("c.component").agg(
        nil(F.sum("c.v"), TOTAL).alias("reconciliation_value"), F.sum("c.v").alias("value"),
        F.count("c.v").alias("available_trade_count"), F.count(F.lit(1)).alias("trade_count"),
    ).withColumn("coverage_ratio", F.col("available_trade_count") / F.col("trade_count"))


def direct_rollups(trades: DataFrame, period: str = "day") -> DataFrame:
    """Total PnL, exact, by symbol, regime, ensemble, sizing, resize and period in one pass."""
    dims: Mapping[str, Column] = {
        "symbol": F.col("symbol"), "regime": F.col("regime"), "ensemble": F.coalesce(F.col("ensemble_id"), F.lit("unattributed")),
        "portfolio_sizing": exposure_bucket(finite("requested_target_exposure")),
        "risk_resizing": resize_class(finite("risk_requested"), finite("risk_approved")),
        "period": period_key(F.col("created_at"), period), "intent": trade_intent(),
    }
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("key")) for d, c in dims.items()])
    return trades.select(F.explode(cells).alias("d"), "total_paper_pnl").groupBy("d.dimension", "d.key").agg(
        F.sum("total_paper_pnl").alias("pnl"), F.count(F.lit(1)).alias("trades")
    )


def weighted_rollups(trades: DataFrame, weights: DataFrame, signals: DataFrame, predictions: DataFrame) -> DataFrame:
    """Alpha allocated by ensemble weight to signals, families, models and providers.

    Contributions are linear in alpha, so alpha is first summed per ensemble; the
    trades themselves never meet the weights.
    """
    alpha = trades.where(F.col("ensemble_id").isNotNull()).groupBy("ensemble_id").agg(F.sum(nil(F.col("alpha_contribution"))).alias("alpha"))
    s = signals.select("signal_id", "signal_family", "prediction_id")
    p = predictions.select(
        "prediction_id", F.concat_ws(":", "model_id", "model_version").alias("model"), F.col("external_context_available").alias("ext"),
        F.col("external_ai_provider").alias("provider"), F.lit(True).alias("has_prediction"),
    )
    lines = alpha.join(weights.select("ensemble_id", "signal_id", rate("weight").alias("w")), "ensemble_id").join(s, "signal_id", "left").join(p, "prediction_id", "left")
    gain = (amount("alpha") * F.col("w")).try_cast(TOTAL)
    got = F.coalesce("has_prediction", F.lit(False))
    availability = F.when(~got, "unknown").when(F.col("ext"), "available").otherwise("unavailable")
    provider = F.when(~got, "unknown").when(F.col("ext") & F.col("provider").isNotNull(), F.col("provider")).when(
        F.col("ext"), "available_provider_unrecorded"
    ).otherwise("unavailable")
    cells = F.array_compact(
        F.array(
            F.struct(F.lit("signal").alias("dimension"), F.col("signal_id").cast("string").alias("key")),
            F.struct(F.lit("signal_family").alias("dimension"), F.coalesce("signal_family", F.lit("unattributed")).alias("key")),
            F.when(got, F.struct(F.lit("model").alias("dimension"), F.col("model").alias("key"))),
            F.struct(F.lit("external_availability").alias("dimension"), availability.alias("key")),
            F.struct(F.lit("external_provider").alias("dimension"), provider.alias("key")),
        )
    )
    return lines.select(F.explode(cells).alias("d"), gain.alias("g")).groupBy("d.dimension", "d.key").agg(nil(F.sum("g").try_cast(TOTAL), TOTAL).alias("allocated_alpha"))


def coverage(trades: DataFrame, lineage: DataFrame) -> DataFrame:
    """Share of trades, and of absolute PnL, with each kind of evidence.

    ``lineage`` tells per ensemble whether all its weights resolve to predictions.
    """
    # Counts and sums are linear in the trades: they are first taken per ensemble and set of flags, and only these rows meet the lineage.
    own = {
        "decision_trace": F.col("link_trace").isNotNull(), "ensemble_weighting": F.col("ensemble_id").isNotNull(),
        "portfolio_sizing": F.col("has_target").isNotNull(), "risk_resizing": F.col("has_risk").isNotNull(),
        "execution_fill": F.coalesce("fill_count", F.lit(0)) > 0, "fees": F.col("fees").isNotNull(),
        "funding_status": F.col("funding").isNotNull() | F.col("estimated_funding").isNotNull(),
    }
    some = trades.select("ensemble_id", F.struct(*[c.alias(n) for n, c in own.items()]).alias("own"), F.abs("total_paper_pnl").alias("s")).groupBy("ensemble_id", "own").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("s")
    )
    full = some.join(lineage.select("ensemble_id", "complete", "provider_complete"), "ensemble_id", "left")
    done = F.coalesce("complete", F.lit(False))
    flags = {n: F.col(f"own.{n}") for n in own} | {"model_signal_lineage": done, "external_ai_status": done & F.coalesce("provider_complete", F.lit(False))}
    cells = F.array(*[F.struct(F.lit(n).alias("evidence"), c.alias("ok")) for n, c in flags.items()])
    ok = F.col("c.ok")
    return full.select(F.explode(cells).alias("c"), "n", "s").groupBy("c.evidence").agg(
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0).cast("long")).alias("covered_trade_count"), F.sum("n").alias("trade_count"),
        (F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0).cast("long")) / F.sum("n")).alias("trade_ratio"),
        (nil(F.sum(F.when(ok, F.col("s"))).try_cast(TOTAL), TOTAL).cast("double") / F.when(F.sum("s") != 0, F.sum("s")).cast("double")).alias("absolute_pnl_ratio"),
    )


def ensemble_lineage(weights: DataFrame, signals: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per ensemble: do all weights lead to predictions, and is every provider known?"""
    p = predictions.select("prediction_id", F.lit(True).alias("has"), F.col("external_context_available").alias("ext"), F.col("external_ai_provider").alias("prov"))
    lines = weights.join(signals.select("signal_id", "prediction_id"), "signal_id", "left").join(p, "prediction_id", "left")
    got = F.coalesce("has", F.lit(False))
    return lines.groupBy("ensemble_id").agg(
        F.bool_and(got).alias("complete"), F.bool_and(got & (~F.col("ext") | F.col("prov").isNotNull())).alias("provider_complete")
    )
