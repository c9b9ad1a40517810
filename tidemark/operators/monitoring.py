"""Matured outcomes and rolling signal health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.numeric import clamp, correlation, zero
from tidemark.operators.asof import asof_join, latest_per_key
from tidemark.session import checkpointed


def unlabelled(signals: DataFrame, outcomes: DataFrame, key: str = "signal_id") -> DataFrame:
    """Signals that have no outcome yet."""
    return signals.join(outcomes.select(key).distinct(), key, "left_anti")


def mature_outcomes(signals: DataFrame, candles: DataFrame, now: Column, width_seconds: int | None = None) -> DataFrame:
    """Outcomes of the signals whose horizon has passed by ``now``.

    The start is the last candle closed at or before the signal, the end the first
    one closed at or after the due time and not after ``now``.
    """
    closed = candles.where(F.col("is_closed") & F.col("close_time").isNotNull())
    due = F.col("generated_at") + F.make_dt_interval(
        secs=F.greatest(F.col("forecast_horizon_seconds"), F.lit(1)).cast("decimal(18,6)")
    )
    ready = signals.withColumn("due", due).where(F.col("due") <= now)
    started = asof_join(
        ready, closed, ["symbol"], "generated_at", "close_time", {"start_price": "close"}, width_seconds=width_seconds
    )
    ended = asof_join(
        started, closed.where(F.col("close_time") <= now), ["symbol"], "due", "close_time", {"end_price": "close"},
        direction="forward", width_seconds=width_seconds, matched_time="observed_at",
    ).where((F.col("start_price") > 0) & F.col("end_price").isNotNull())
    realized = F.col("end_price") / F.col("start_price") - 1.0
    cost = F.greatest(zero(F.col("expected_cost")), F.lit(0.0))
    side = F.upper(F.coalesce("direction", F.lit("FLAT")))
    hit = (
        ((side == "LONG") & (F.col("realized_return") > 0))
        | ((side == "SHORT") & (F.col("realized_return") < 0))
        | ((side == "FLAT") & (F.abs("realized_return") <= F.greatest(F.col("expected_cost"), F.lit(1e-9))))
    )
    return (
        ended.withColumn("realized_return", realized)
        .withColumn("realized_cost", cost)
        .withColumn("net_return", F.when(side == "SHORT", -F.col("realized_return")).otherwise(F.col("realized_return")) - cost)
        .withColumn("directional_hit", hit)
    )


def windowed(outcomes: DataFrame, keys: Sequence[str], window: int, tie: str = "signal_id") -> DataFrame:
    """The newest ``window`` rows per key as ``recent``, the next ``window`` as reference."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("observed_at").desc(), F.col(tie).desc()))
    return (
        outcomes.withColumn("__rn", rank).where(F.col("__rn") <= 2 * window)
        .withColumn("recent", F.col("__rn") <= window).drop("__rn")
    )


def _bounded_ks(rows: DataFrame, keys: Sequence[str], value: str, name: str, min_recent: int, min_reference: int) -> DataFrame:
    """KS distance over windowed rows (at most two windows per key)."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.when(F.col("recent"), 1)).alias("a"), F.count(F.when(~F.col("recent"), 1)).alias("b")
    )
    upto = W.partitionBy(*keys).orderBy(value)
    whole = W.partitionBy(*keys)
    steps = counts.select(
        *keys, F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb"),
        F.sum("a").over(whole).alias("ta"), F.sum("b").over(whole).alias("tb"),
    )
    enough = (F.col("ta") >= min_recent) & (F.col("tb") >= min_reference)
    gap = F.when(enough, F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb")))
    return steps.groupBy(*keys).agg(F.max(gap).alias(name))


def capacity_proxy(liquidity: Column, cost: Column, max_cost: float = 0.003) -> Column:
    return clamp(zero(liquidity), 0, 1) * F.greatest(1.0 - F.least(F.greatest(cost, F.lit(0.0)) / max_cost, F.lit(1.0)), F.lit(0.0))


def relative_increase(recent: Column, reference: Column) -> Column:
    return F.greatest((recent - reference) / F.greatest(F.abs(reference), F.lit(1e-9)), F.lit(0.0))


def relative_decline(recent: Column, reference: Column) -> Column:
    return F.when(reference <= 1e-9, 0.0).otherwise(clamp((reference - recent) / reference, 0.0, 1.0))


def basic_health(rows: DataFrame, keys: Sequence[str], min_reference: int = 10) -> DataFrame:
    """Rolling IC, expectancy, calibration, missing rate, cost and capacity changes."""
    r = F.col("recent")
    x, y = F.when(r, zero(F.col("net_expected_return"))), F.when(r, zero(F.col("net_return")))
    cost = F.greatest(zero(F.col("realized_cost")), F.lit(0.0))
    capacity = capacity_proxy(F.col("liquidity_score"), F.col("realized_cost"))
    enough = F.count(F.when(~r, 1)) >= min_reference
    hit = F.abs(zero(F.col("confidence")) - F.col("directional_hit").cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(F.when(r, 1)).alias("observations"),
        F.count(F.when(~r, 1)).alias("reference_observations"),
        correlation(x, y).alias("information_coefficient"),
        F.avg(y).alias("net_expectancy"),
        F.avg(F.when(r, hit)).alias("calibration_error"),
        F.coalesce(F.avg(F.when(r, F.col("missing_features").cast("double"))), F.lit(0.0)).alias("missing_feature_rate"),
        F.when(enough, relative_increase(F.avg(F.when(r, cost)), F.avg(F.when(~r, cost)))).alias("transaction_cost_increase"),
        F.when(enough, relative_decline(F.avg(F.when(r, capacity)), F.avg(F.when(~r, capacity)))).alias("capacity_decline"),
    )


def regime_dependence(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of return variation explained by the regime (eta squared) in the recent window."""
    regime = F.lower(F.trim(F.coalesce("regime", F.lit(""))))
    each = (
        rows.where(F.col("recent")).withColumn("__g", regime).where(~F.col("__g").isin("", "unknown"))
        .groupBy(*keys, "__g").agg(
            F.count(F.lit(1)).alias("n"), F.sum("net_return").alias("s"), F.sum(F.col("net_return") * F.col("net_return")).alias("ss")
        )
    )
    n, s = F.sum("n"), F.sum("s")
    total = F.sum("ss") - s * s / n
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n
    return each.groupBy(*keys).agg(
        F.when(n < 2, None).when(F.count(F.lit(1)) == 1, 1.0).when(total <= 1e-18, 0.0).otherwise(clamp(between / F.when(total > 1e-18, total), 0, 1)).alias("regime_dependence")
    )


def feature_diagnostics(
    rows: DataFrame, keys: Sequence[str], features: str = "features", min_reference: int = 10, z_limit: float = 4.0,
    fraction: float = 0.10, row_id: str = "signal_id",
) -> DataFrame:
    """Mean drift of the most drifted tenth of features, and the share of odd rows.

    A feature counts only if every row of both windows carries it.
    """
    keys = list(keys)
    vectors = rows.where(F.size(F.coalesce(features, F.create_map().cast("map<string,double>"))) > 0)
    sizes = vectors.groupBy(*keys).agg(
        F.count(F.when(F.col("recent"), 1)).alias("__nr"), F.count(F.when(~F.col("recent"), 1)).alias("__nf")
    ).where((F.col("__nr") >= 2) & (F.col("__nf") >= min_reference))
    long = vectors.join(sizes, keys).select(
        *keys, row_id, "recent", "__nr", "__nf", F.explode(features).alias("feature", "v")
    ).where(F.col("v").isNotNull())
    seen = F.count(F.lit(1)).over(W.partitionBy(*keys, "feature"))
    common = long.withColumn("__seen", seen).where(F.col("__seen") == F.col("__nr") + F.col("__nf"))
    drift = _bounded_ks(common, [*keys, "feature"], "v", "ks", 2, min_reference)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("ks").desc(), "feature"))
    top = drift.where(F.col("ks").isNotNull()).withColumn("__p", place).withColumn(
        "__n", F.count(F.lit(1)).over(W.partitionBy(*keys))
    )
    feature_drift = top.where(F.col("__p") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * 0.10))).groupBy(*keys).agg(
        F.avg("ks").alias("feature_drift"), F.max("__n").alias("comparable_features")
    )
    stats = common.where(~F.col("recent")).groupBy(*keys, "feature").agg(
        F.avg("v").alias("c"), F.stddev_pop("v").alias("sd")
    )
    floor = F.greatest(F.abs("c") * 1e-6, F.lit(1e-9))
    gap = F.abs(F.col("v") - F.col("c"))
    odd = F.when(F.col("sd") <= floor, gap > floor).otherwise(gap / F.col("sd") > z_limit)
    per_row = common.where(F.col("recent")).join(stats, [*keys, "feature"]).groupBy(*keys, row_id).agg(
        F.avg(odd.cast("double")).alias("odd")
    )
    rate = per_row.groupBy(*keys).agg(F.avg((F.col("odd") >= fraction).cast("double")).alias("out_of_distribution_rate"))
    return feature_drift.join(rate, keys, "left")


def shadow_divergence(rows: DataFrame, shadows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean relative gap between live forecasts and shadow forecasts of the same trace."""
    live = rows.where(F.col("recent")).select(
        *keys, "trace_id", F.col("prediction_id").cast("string").alias("prediction_id"), F.col("expected_return").alias("x")
    )
    other = shadows.select(
        F.col("family").alias("__f"), "trace_id", F.col("prediction_id").cast("string").alias("__pid"),
        F.col("expected_return").alias("y"),
    )
    pairs = live.join(other, "trace_id").where((F.col("__pid") != F.col("prediction_id")) & (F.col("__f") == F.col("family")))
    scale = F.greatest(F.abs("x") + F.abs("y"), F.lit(1e-9))
    return pairs.groupBy(*keys).agg(
        F.avg(F.least(F.abs(F.col("x") - F.col("y")) / scale, F.lit(1.0))).alias("paired_divergence"),
        F.count(F.lit(1)).alias("shadow_pairs"),
    )


def correlation_increase(rows: DataFrame, min_points: int = 10) -> DataFrame:
    """Largest rise of absolute return correlation with any other family."""
    minute = rows.groupBy("family", "recent", F.date_trunc("minute", "observed_at").alias("m")).agg(F.avg("net_return").alias("r"))
    other = minute.select(F.col("family").alias("peer"), "recent", "m", F.col("r").alias("q"))
    both = minute.join(other, ["recent", "m"]).where(F.col("family") != F.col("peer"))
    enough = F.count(F.lit(1)) >= min_points
    corr = both.groupBy("family", "peer", "recent").agg(F.when(enough, correlation("r", "q")).alias("c"))
    wide = corr.groupBy("family", "peer").agg(
        F.max(F.when(F.col("recent"), F.abs("c"))).alias("a"), F.max(F.when(~F.col("recent"), F.abs("c"))).alias("b")
    )
    rise = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest(F.col("a") - F.col("b"), F.lit(0.0)))
    return wide.groupBy("family").agg(F.max(rise).alias("signal_correlation_increase"))


def rolling_health(
    outcomes: DataFrame, shadows: DataFrame | None = None, window: int = 100, min_reference: int = 10
) -> DataFrame:
    """Every rolling diagnostic of each signal family, with its health status."""
    # At most two windows per family, read by every diagnostic below.
    rows = checkpointed(windowed(outcomes, ["family"], window))
    keys = ["family"]
    out = basic_health(rows, keys, min_reference)
    for value, name in (("expected_return", "prediction_drift"), ("net_return", "historical_divergence")):
        out = out.join(_bounded_ks(rows, keys, value, name, 2, max(min_reference, 2)), keys, "left")
    out = out.join(feature_diagnostics(rows, keys, min_reference=min_reference), keys, "left")
    out = out.join(regime_dependence(rows, keys), keys, "left").join(correlation_increase(rows, min_reference), keys, "left")
    if shadows is not None:
        out = out.join(shadow_divergence(rows, shadows, keys), keys, "left")
    else:
        out = out.withColumn("paired_divergence", F.lit(None).cast("double")).withColumn("shadow_pairs", F.lit(None).cast("long"))
    out = out.withColumn("live_shadow_divergence", F.greatest("historical_divergence", "paired_divergence"))
    return health_status(out)


# Fixed values: (column, code, watch from, degraded from).
HIGH_IS_BAD = [
    ("calibration_error", "CALIBRATION_ERROR", 0.25, 0.40),
    ("missing_feature_rate", "MISSING_FEATURE_RATE", 0.10, 0.25),
    ("prediction_drift", "PREDICTION_DRIFT", 0.25, 0.50),
    ("feature_drift", "FEATURE_DRIFT", 0.25, 0.50),
    ("out_of_distribution_rate", "OOD_RATE", 0.10, 0.25),
    ("live_shadow_divergence", "LIVE_SHADOW_DIVERGENCE", 0.30, 0.60),
    ("transaction_cost_increase", "TRANSACTION_COST_INCREASE", 0.25, 0.75),
    ("signal_correlation_increase", "SIGNAL_CORRELATION_INCREASE", 0.15, 0.30),
    ("regime_dependence", "REGIME_DEPENDENCE", 0.70, 0.90),
    ("capacity_decline", "CAPACITY_DECLINE", 0.15, 0.35),
]
LOW_IS_BAD = [
    ("information_coefficient", "INFORMATION_COEFFICIENT", 0.0, -0.10),
    ("net_expectancy", "NET_EXPECTANCY", 0.0, -0.001),
]
# Weight and action per status.
HEALTH_POLICY = {
    "HEALTHY": (1.0, "NORMAL_WEIGHT"),
    "WATCH": (0.75, "VISIBLE_WARNING"),
    "DEGRADED": (0.35, "REDUCED_ENSEMBLE_WEIGHT"),
    "SUSPENDED": (0.0, "BLOCK_NEW_EXPOSURE"),
    "RETIRED": (0.0, "UNAVAILABLE_FOR_NEW_DECISIONS"),
}


def health_status(metrics: DataFrame, min_observations: int = 20, previous: str | None = None) -> DataFrame:
    """Status, reasons and weight from the twelve thresholds.

    A ``previous`` status column of SUSPENDED or RETIRED is never overridden.
    """
    degraded, watch = [], []
    for column, code, w, d in HIGH_IS_BAD:
        v = F.col(column)
        degraded.append(F.when(v >= d, F.lit(f"{code}_DEGRADED")))
        watch.append(F.when((v >= w) & (v < d), F.lit(f"{code}_WATCH")))
    for column, code, w, d in LOW_IS_BAD:
        v = F.col(column)
        degraded.append(F.when(v <= d, F.lit(f"{code}_DEGRADED")))
        watch.append(F.when((v <= w) & (v > d), F.lit(f"{code}_WATCH")))
    out = metrics.withColumn("__d", F.array_compact(F.array(*degraded))).withColumn("__w", F.array_compact(F.array(*watch)))
    few = F.col("observations") < min_observations
    status = (
        F.when(few, "WATCH").when(F.size("__d") > 0, "DEGRADED").when(F.size("__w") > 0, "WATCH").otherwise("HEALTHY")
    )
    reasons = (
        F.when(few, F.array(F.lit("INSUFFICIENT_LIVE_OUTCOMES")))
        .when(F.size("__d") + F.size("__w") > 0, F.concat("__d", "__w"))
        .otherwise(F.array(F.lit("ROLLING_HEALTH_WITHIN_THRESHOLDS")))
    )
    if previous:
        stuck = F.upper(F.col(previous)).isin("SUSPENDED", "RETIRED")
        reasons = F.when(stuck, F.concat(reasons, F.array(F.lit("TERMINAL_SIGNAL_HEALTH_REQUIRES_EXPLICIT_REACTIVATION")))).otherwise(reasons)
        status = F.when(stuck, F.upper(F.col(previous))).otherwise(status)
    out = out.withColumn("health_status", status).withColumn("reason_codes", reasons).drop("__d", "__w")
    weight = F.coalesce(*[F.when(F.col("health_status") == s, F.lit(v[0])) for s, v in HEALTH_POLICY.items()])
    action = F.coalesce(*[F.when(F.col("health_status") == s, F.lit(v[1])) for s, v in HEALTH_POLICY.items()])
    return out.withColumn("recommended_weight_multiplier", weight).withColumn("recommended_action", action)


def recent_performance(outcomes: DataFrame, window: int = 100) -> DataFrame:
    """Mean of each family's newest outcomes, bounded to +-0.2."""
    newest = latest_per_key(
        outcomes.where(F.col("net_return").isNotNull()), ["family"], [F.col("observed_at").desc(), F.col("signal_id").desc()], window
    )
    return newest.groupBy("family").agg(clamp(F.avg("net_return"), -0.2, 0.2).alias("recent_performance"))


def family_correlations(outcomes: DataFrame, window: int = 100) -> DataFrame:
    """Pairwise correlation of the families' newest outcomes, aligned by minute."""
    newest = latest_per_key(
        outcomes.where(F.col("net_return").isNotNull()), ["family"], [F.col("observed_at").desc(), F.col("signal_id").desc()], window
    )
    minute = newest.groupBy("family", F.date_trunc("minute", "observed_at").alias("m")).agg(
        F.min_by("net_return", F.struct("observed_at", "signal_id")).alias("r")
    )
    left = minute.select(F.col("family").alias("left_family"), "m", F.col("r").alias("a"))
    right = minute.select(F.col("family").alias("right_family"), "m", F.col("r").alias("b"))
    both = left.join(right, "m").where(F.col("left_family") < F.col("right_family"))
    return both.groupBy("left_family", "right_family").agg(
        F.count(F.lit(1)).alias("points"), correlation("a", "b").alias("correlation")
    )


def error_streaks(log: DataFrame, keys: Sequence[str], order: str, success: str) -> DataFrame:
    """Consecutive failures since the last success, per key.

    Needs only the time of the last success, so it is two aggregates and no
    ordered window over a key's whole history.
    """
    keys = list(keys)
    last = log.where(F.col(success)).groupBy(*keys).agg(F.max(order).alias("last_success"))
    return (
        log.join(last, keys, "left")
        .groupBy(*keys)
        .agg(
            F.count(F.when(~F.col(success) & (F.col("last_success").isNull() | (F.col(order) > F.col("last_success"))), 1)).alias("consecutive_errors"),
            F.max("last_success").alias("last_success"),
        )
    )
