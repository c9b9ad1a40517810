"""Dependence between signals, correlated groups, and the saturation curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.numeric import correlation
from tidemark.operators.evaluation import evaluate
from tidemark.operators.series import BLOCK, range_blocks, running
from tidemark.session import checkpointed


def by_timestamp(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Mean prediction, position, PnL and drawdown of each signal per timestamp."""
    position = F.coalesce(F.col("position"), F.signum("prediction")).cast("double")
    staged = rows.select(
        "signal_id", "timestamp", F.col(seq).alias("seq"), F.col("prediction").cast("double").alias("prediction"),
        position.alias("position"),
        (position * F.col("actual_return") - F.coalesce("transaction_cost", F.lit(0.0))).alias("pnl"),
    )
    blocks = range_blocks(staged, ["signal_id"], ["timestamp", "seq"])
    growth = F.when(F.col("pnl") > -1, F.log1p("pnl")).otherwise(0.0)
    lost = F.when(F.col("pnl") <= -1, 1)
    eq = running(blocks, ["signal_id"], ["timestamp", "seq"], {"eq": ("sum", growth), "ruined": ("count", lost)})
    top = running(eq, ["signal_id"], ["timestamp", "seq"], {"top": ("max", F.when(F.col("ruined") == 0, F.col("eq")))})
    drawdown = F.when(F.col("ruined") > 0, 1.0).otherwise(
        -F.expm1(F.col("eq") - F.greatest(F.lit(0.0), F.col("top")))
    )
    return top.withColumn("drawdown", drawdown).groupBy("signal_id", "timestamp").agg(
        *[F.avg(c).alias(c) for c in ("prediction", "position", "pnl", "drawdown")]
    )


def pair_correlations(series: DataFrame, feature_sets: DataFrame | None = None) -> DataFrame:
    """Four correlations and the trade overlap of every pair of signals.

    ``series`` is unique per (signal, timestamp).  The join key is the timestamp
    and the number of signals is the width of the research grid, so a timestamp
    meets at most that many rows.
    """
    values = ("prediction", "position", "pnl", "drawdown")
    left = series.select("timestamp", F.col("signal_id").alias("left_signal_id"), *[F.col(c).alias(f"l_{c}") for c in values])
    right = series.select("timestamp", F.col("signal_id").alias("right_signal_id"), *[F.col(c).alias(f"r_{c}") for c in values])
    both = left.join(right, "timestamp").where(F.col("left_signal_id") < F.col("right_signal_id"))

    pairs = both.groupBy("left_signal_id", "right_signal_id").agg(
        F.count(F.lit(1)).alias("aligned_observations"),
        *[correlation(f"l_{c}", f"r_{c}").alias(f"{c}_correlation") for c in values],
        F.count(F.when((F.col("l_position") != 0) & (F.col("r_position") != 0), 1)).alias("__both"),
    )
    active = series.groupBy("signal_id").agg(F.count(F.when(F.col("position") != 0, 1)).alias("n"))
    ids = series.select("signal_id").distinct()
    grid = ids.select(F.col("signal_id").alias("left_signal_id"), F.lit(1).alias("j")).join(
        ids.select(F.col("signal_id").alias("right_signal_id"), F.lit(1).alias("j")), "j"
    ).where(F.col("left_signal_id") < F.col("right_signal_id")).drop("j")
    out = (
        grid.join(pairs, ["left_signal_id", "right_signal_id"], "left")
        .join(active.select(F.col("signal_id").alias("left_signal_id"), F.col("n").alias("__ln")), "left_signal_id")
        .join(active.select(F.col("signal_id").alias("right_signal_id"), F.col("n").alias("__rn")), "right_signal_id")
    )
    both_n = F.coalesce("__both", F.lit(0))
    either = F.col("__ln") + F.col("__rn") - both_n
    out = out.withColumn("trade_overlap", F.when(either > 0, both_n / either))
    if feature_sets is not None:
        f_left = feature_sets.select(F.col("signal_id").alias("left_signal_id"), F.col("feature_families").alias("__lf"))
        f_right = feature_sets.select(F.col("signal_id").alias("right_signal_id"), F.col("feature_families").alias("__rf"))
        union = F.size(F.array_union("__lf", "__rf"))
        out = out.join(f_left, "left_signal_id", "left").join(f_right, "right_signal_id", "left").withColumn(
            "feature_overlap", F.when(union > 0, F.size(F.array_intersect("__lf", "__rf")) / union)
        )
    else:
        out = out.withColumn("feature_overlap", F.lit(None).cast("double"))
    strongest = F.greatest(*[F.abs(F.col(f"{c}_correlation")) for c in values])
    return out.select(
        "left_signal_id", "right_signal_id", F.coalesce("aligned_observations", F.lit(0)).alias("aligned_observations"),
        *[f"{c}_correlation" for c in values], "trade_overlap", "feature_overlap",
        strongest.alias("maximum_absolute_correlation"),
    )


def connected_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest member of each node's component, by min-label spreading with shortcuts.

    Each round takes the least label among neighbours and then jumps to that
    label's own label, so long chains close in logarithmically many rounds; the
    labels are checkpointed because every round reads the previous one.
    """
    links = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = checkpointed(nodes.select(F.col("node"), F.col("node").alias("label")))
    while True:
        near = (
            links.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, "node", "left").select("node", F.least("label", "near").alias("mid"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        following = checkpointed(
            stepped.join(jump, "mid", "left").select("node", F.least("mid", "far").alias("label"), "was")
        )
        changed = following.where(F.col("label") != F.col("was")).limit(1).count()
        labels = following.select("node", "label")
        if not changed:
            return labels


def correlated_groups(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Groups of at least two signals linked by correlation or shared features."""
    nodes = pairs.select(F.col("left_signal_id").alias("node")).union(pairs.select("right_signal_id")).distinct()
    strong = (F.coalesce("maximum_absolute_correlation", F.lit(0.0)) >= threshold) | (
        F.coalesce("feature_overlap", F.lit(0.0)) >= threshold
    )
    edges = pairs.where(strong).select(F.col("left_signal_id").alias("a"), F.col("right_signal_id").alias("b"))
    labels = connected_groups(nodes, edges)
    size = F.count(F.lit(1)).over(W.partitionBy("label"))
    return labels.withColumn("members", size).where(F.col("members") > 1).select(
        F.col("label").alias("group_id"), F.col("node").alias("signal_id"), "members"
    )


def saturation_curve(
    series: DataFrame, order: Sequence[str], horizon_seconds: float | None = None, threshold: float = 0.0
) -> DataFrame:
    """Utility of the equal-weight mean of the first k signals, for k = 0 .. n.

    Only timestamps all listed signals share are used; ``order`` is the list of
    registered signals, a driver-side parameter.
    """
    ids = list(dict.fromkeys(order))
    place = F.coalesce(*[F.when(F.col("signal_id") == s, i) for i, s in enumerate(ids)])
    wide = (
        series.withColumn("k", place).where(F.col("k").isNotNull())
        .groupBy("timestamp")
        .agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("k") == i, F.col("pnl"))).alias(f"p{i}") for i in range(len(ids))])
        .where(F.col("n") == len(ids))
    )
    means = [F.lit(0.0)]
    total = F.lit(0.0)
    for i in range(len(ids)):
        total = total + F.col(f"p{i}")
        means.append(total / float(i + 1))
    steps = wide.select(
        "timestamp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("signal_count"), m.alias("r")) for k, m in enumerate(means)])).alias("s"),
    ).select(
        "timestamp", F.col("s.signal_count").alias("signal_count"), F.col("s.r").alias("prediction"),
        F.col("s.r").alias("actual_return"), F.lit(1.0).alias("position"), F.lit(0.0).alias("transaction_cost"),
        F.lit(None).cast("double").alias("holding_seconds"), F.lit(0).alias("seq"),
    )
    # The return itself plays prediction and outcome; only position 1 matters here.
    metrics = evaluate(steps, ["signal_count"], horizon_seconds=horizon_seconds).select(
        "signal_count", "observation_count", "net_expectancy", "total_return", "sharpe_ratio", "maximum_drawdown"
    )
    w = W.orderBy("signal_count")  # at most one row per registered signal
    for c in ("net_expectancy", "sharpe_ratio", "total_return"):
        metrics = metrics.withColumn(f"marginal_{c}", F.col(c) - F.lag(c).over(w))
    gain = F.col("marginal_net_expectancy")
    return metrics.select(
        "*",
        ((F.col("signal_count") > 0) & (gain.isNull() | (gain <= threshold))).alias("saturated"),
        ((F.col("signal_count") > 1) & (gain < F.lag(gain).over(w))).alias("diminishing_return"),
    )
