"""Signal evaluation: return, risk, rank and holding metrics per segment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.numeric import clamp, correlation, ratio
from tidemark.operators.ranks import average_rank, quantiles, value_ranks
from tidemark.operators.recurrence import linear_scan
from tidemark.operators.series import BLOCK, micros, range_blocks

YEAR_SECONDS = 365.25 * 24 * 3600


def observations(df: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Bring permissive research rows to the standard observation columns.

    The first listed alias that exists as a column is used; missing optional
    columns become null (cost 0).
    """
    names = {
        "prediction": ("prediction", "expected_return"),
        "actual_return": ("actual_return", "realized_return", "target_return", "label_return", "target"),
        "timestamp": ("timestamp", "decision_time", "signal_time", "available_to_model_time", "as_of", "event_time",
                      "time", "created_at"),
        "symbol": ("symbol",),
        "signal_id": ("signal_id",),
        "model_family": ("model_family",),
        "regime": ("regime", "market_regime"),
        "position": ("position", "signal_position", "exposure"),
        "transaction_cost": ("transaction_cost", "expected_cost", "cost"),
        "holding_seconds": ("holding_seconds", "holding_time_seconds"),
        "external_ai_available": ("external_ai_available",),
        "label_available_time": ("label_available_time", "label_end_time", "label_end"),
        **(aliases or {}),
    }
    types = {"timestamp": "timestamp_ntz", "label_available_time": "timestamp_ntz", "symbol": "string",
             "signal_id": "string", "model_family": "string", "regime": "string", "external_ai_available": "boolean"}
    columns = []
    for name, options in names.items():
        found = [F.col(o) for o in options if o in df.columns]
        kind = types.get(name, "double")
        if name == "timestamp":
            value = F.coalesce(*found)
        elif found:
            value = found[0]
        else:
            value = F.lit(0.0) if name == "transaction_cost" else F.lit(None)
        columns.append(value.cast(kind).alias(name))
    available = F.col("available_to_model_time") if "available_to_model_time" in df.columns else F.col("timestamp")
    rest = [c for c in df.columns if c not in names and c != "available_to_model_time"]
    out = df.select(*columns, *rest, *(["available_to_model_time"] if "available_to_model_time" in df.columns else []))
    if "available_to_model_time" not in df.columns:
        out = out.withColumn("available_to_model_time", available)
    return out


def leakage(df: DataFrame, decision: str = "timestamp", available: str = "available_to_model_time") -> DataFrame:
    """Rows whose inputs only became available after the decision."""
    return df.where(F.col(available) > F.col(decision))


def segments(obs: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """One copy of each observation per dimension it has a value for, plus ``all``."""
    options = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("segment"))]
    options += [
        F.when(value.isNotNull() & (value.cast("string") != ""), F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("segment")))
        for name, value in dimensions.items()
    ]
    return (
        obs.withColumn("__s", F.explode(F.array_compact(F.array(*options))))
        .withColumn("dimension", F.col("__s.dimension"))
        .withColumn("segment", F.col("__s.segment"))
        .drop("__s")
    )


def _prepared(obs: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    position = F.coalesce(F.col("position"), F.signum("prediction")).cast("double")
    cost = F.greatest(F.coalesce(F.col("transaction_cost"), F.lit(0.0)), F.lit(0.0))
    return obs.select(
        *keys,
        F.col("timestamp").alias("ts"),
        F.col(seq).alias("seq"),
        F.col("prediction").cast("double").alias("prediction"),
        F.col("actual_return").cast("double").alias("actual"),
        position.alias("position"),
        cost.alias("cost"),
        F.col("holding_seconds").cast("double").alias("holding"),
    )


def _returns(rows: DataFrame) -> DataFrame:
    gross = F.col("position") * F.col("actual")
    return rows.withColumns({"gross": gross, "net": gross - F.col("cost")})


def _plain_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics that need no order: one aggregate with map-side combine."""
    active = F.col("position") != 0
    net, gross = F.col("net"), F.col("gross")
    hit = F.signum("prediction") == F.signum("actual")
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        n.alias("observation_count"),
        F.count(F.when(active, 1)).alias("active_observation_count"),
        (F.count(F.when(active, 1)) / n).alias("active_rate"),
        correlation("prediction", "actual").alias("information_coefficient"),
        F.avg(F.when(active, hit.cast("double"))).alias("directional_hit_rate"),
        F.avg(F.when(active, gross)).alias("gross_expectancy"),
        F.avg(F.when(active, net)).alias("net_expectancy"),
        F.avg(gross).alias("gross_return_mean"),
        F.avg(net).alias("net_return_mean"),
        F.avg(F.when(active & (net > 0), net)).alias("average_win"),
        F.avg(F.when(active & (net < 0), net)).alias("average_loss"),
        ratio(
            F.coalesce(F.sum(F.when(active & (net > 0), net)), F.lit(0.0)), F.abs(F.sum(F.when(active & (net < 0), net)))
        ).alias("profit_factor"),
        F.stddev_samp(net).alias("__net_sd"),
        F.sqrt(F.avg(F.pow(F.least(net, F.lit(0.0)), F.lit(2.0)))).alias("__downside"),
        F.avg(F.abs("position")).alias("exposure"),
        F.sum("cost").alias("transaction_cost_total"),
        F.avg("cost").alias("transaction_cost_mean"),
        F.min(net).alias("worst_return"),
        F.max(net).alias("best_return"),
        F.avg("holding").alias("__holding"),
    )


def _log_growth(value: Column) -> Column:
    # Ruin (return <= -100%) is carried by its own flag.
    return F.when(value > -1.0, F.log1p(value)).otherwise(0.0)


def _block_facts(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reduce each block to what the next blocks need to know."""
    inside = W.partitionBy(*keys, BLOCK).orderBy("ts", "seq")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    us = micros("ts")
    sign = F.signum("position")
    rows = blocks.select(
        "*",
        us.alias("us"),
        sign.alias("sign"),
        F.row_number().over(inside).alias("rn"),
        F.lag("position").over(inside).alias("p_pos"),
        F.lag(sign).over(inside).alias("p_sign"),
        F.lag(us).over(inside).alias("p_us"),
        F.sum(_log_growth(F.col("net"))).over(upto).alias("log_eq"),
    ).withColumn("log_peak", F.max("log_eq").over(upto))
    return rows


def _series_metrics(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    per_block = rows.groupBy(*keys, BLOCK).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(_log_growth(F.col("net"))).alias("growth"),
        F.sum(_log_growth(F.col("gross"))).alias("gross_growth"),
        F.max("log_eq").alias("top"),
        F.min("log_eq").alias("bottom"),
        F.min(F.col("log_eq") - F.col("log_peak")).alias("drop"),
        F.max((F.col("net") <= -1.0).cast("int")).alias("ruin"),
        F.max((F.col("gross") <= -1.0).cast("int")).alias("gross_ruin"),
        F.sum(F.abs(F.col("position") - F.col("p_pos"))).alias("turn"),
        F.min_by("position", "rn").alias("first_pos"),
        F.max_by("position", "rn").alias("last_pos"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count(F.when((F.col("sign") != 0) & F.col("p_sign").isNotNull() & (F.col("sign") != F.col("p_sign")), 1)).alias("runs"),
        F.max_by(F.col("p_sign") != F.col("sign"), "rn").alias("last_turned"),
        F.sum(F.when((F.col("p_sign") != 0), F.col("us") - F.col("p_us"))).alias("active_us"),
    )
    prior = W.partitionBy(*keys).orderBy(BLOCK)
    before = prior.rowsBetween(W.unboundedPreceding, -1)
    table = per_block.select(
        "*",
        F.coalesce(F.sum("growth").over(before), F.lit(0.0)).alias("eq0"),
        F.lag("last_pos").over(prior).alias("pos0"),
        F.lag("last_us").over(prior).alias("us0"),
        F.lead(F.lit(1)).over(prior).isNull().alias("is_last"),
    )
    table = table.withColumn(
        "peak0", F.greatest(F.lit(0.0), F.max(F.col("eq0") + F.col("top")).over(before))
    )
    s0, s1 = F.signum("pos0"), F.signum("first_pos")
    starts_run = (s1 != 0) & (s0.isNull() | (s0 != s1))
    tail_run = F.when(F.col("rows") > 1, F.col("last_turned")).otherwise(s0.isNull() | (s0 != s1))
    series = table.groupBy(*keys).agg(
        F.max("ruin").alias("ruin"),
        F.max("gross_ruin").alias("gross_ruin"),
        F.sum("growth").alias("growth"),
        F.sum("gross_growth").alias("gross_growth"),
        F.min(
            F.least(F.col("drop"), F.col("bottom") - (F.col("peak0") - F.col("eq0")))
        ).alias("deepest"),
        F.sum(F.coalesce(F.col("turn"), F.lit(0.0)) + F.abs(F.col("first_pos") - F.coalesce(F.col("pos0"), F.lit(0.0)))).alias("turnover"),
        F.sum(F.col("runs") + starts_run.cast("int")).alias("runs"),
        F.sum(
            F.coalesce(F.col("active_us"), F.lit(0)) + F.coalesce(F.when(s0 != 0, F.col("first_us") - F.col("us0")), F.lit(0))
        ).alias("active_us"),
        F.max(F.when(F.col("is_last"), (F.signum("last_pos") != 0) & tail_run)).alias("ends_on_start"),
    )
    seams = table.where(F.col("us0").isNotNull()).select(*keys, (F.col("first_us") - F.col("us0")).alias("gap"))
    gaps = rows.where(F.col("p_us").isNotNull()).select(*keys, (F.col("us") - F.col("p_us")).alias("gap")).unionByName(seams)
    return series, gaps.where(F.col("gap") > 0)


METRICS = [
    "active_rate", "information_coefficient", "rank_information_coefficient", "directional_hit_rate",
    "gross_expectancy", "net_expectancy", "gross_return_mean", "net_return_mean", "average_win", "average_loss",
    "profit_factor", "total_return", "gross_total_return", "annualized_return", "sharpe_ratio", "sortino_ratio",
    "maximum_drawdown", "calmar_ratio", "turnover", "average_turnover", "exposure", "average_holding_time_seconds",
    "transaction_cost_total", "transaction_cost_mean", "value_at_risk_95", "conditional_value_at_risk_95",
    "tail_loss_95", "worst_return", "best_return", "annualization_factor",
]


def evaluate(
    obs: DataFrame,
    keys: Sequence[str],
    seq: str = "seq",
    annualization: float | None = None,
    horizon_seconds: float | None = None,
) -> DataFrame:
    """The metric suite, one row per key; undefined metrics are null.

    Observations are ordered by (timestamp, ``seq``) inside a key.  The order is
    cut into balanced blocks, every ordered metric is a composition of block
    facts, and quantiles and ranks come from value counts.
    """
    keys = list(keys)
    blocks = _returns(range_blocks(_prepared(obs, keys, seq), keys, ["ts", "seq"]))
    rows = _block_facts(blocks, keys)
    series, gaps = _series_metrics(rows, keys)
    # A row's measures are told apart by a number and looked up, which makes narrow rows without an array of them.
    number = {m: i for i, m in enumerate(("net", "prediction", "actual", "gap"))}
    own = ["net", "prediction", "actual"]
    measures = blocks.select(*keys, *own, F.explode(F.array(*[F.lit(number[m]) for m in own])).alias("measure")).select(
        *keys, "measure", F.coalesce(*[F.when(F.col("measure") == number[m], F.col(m)) for m in own]).alias("v")
    )
    needs_gap = annualization is None and horizon_seconds is None
    if needs_gap:
        measures = measures.unionByName(
            gaps.select(*keys, F.lit(number["gap"]).alias("measure"), F.col("gap").cast("double").alias("v"))
        )
    ranked = value_ranks(measures, [*keys, "measure"], "v")
    var = quantiles(ranked.where(F.col("measure") == number["net"]), keys, "v", {"value_at_risk_95": 0.05})
    tail = (
        ranked.where(F.col("measure") == number["net"])
        .join(var, keys)
        .where(F.col("v") <= F.col("value_at_risk_95"))
        .groupBy(*keys)
        .agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("conditional_value_at_risk_95"))
    )

    def ranks_of(measure: str) -> DataFrame:
        return ranked.where(F.col("measure") == number[measure]).select(
            *keys, F.col("v").alias(measure), average_rank().alias(f"rank_{measure}")
        )

    pairs = blocks.groupBy(*keys, "prediction", "actual").agg(F.count(F.lit(1)).alias("w"))
    x, y, w = F.col("rank_prediction"), F.col("rank_actual"), F.col("w")
    sums = (
        pairs.join(ranks_of("prediction"), [*keys, "prediction"])
        .join(ranks_of("actual"), [*keys, "actual"])
        .groupBy(*keys)
        .agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
             F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"))
    )
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    rank_ic = sums.select(
        *keys,
        F.when((F.col("n") >= 2) & (vx > 0) & (vy > 0), clamp(cov / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy)))).alias("rank_information_coefficient"),
    )
    out = _plain_metrics(blocks, keys).join(series, keys).join(var, keys, "left").join(tail, keys, "left").join(
        rank_ic, keys, "left"
    )
    if needs_gap:
        median = quantiles(ranked.where(F.col("measure") == number["gap"]), keys, "v", {"__median": 0.5})
        out = out.join(median, keys, "left").withColumn(
            "annualization_factor",
            F.coalesce(F.greatest(F.lit(1.0), F.lit(YEAR_SECONDS * 1e6) / F.col("__median")), F.lit(1.0)),
        )
    else:
        out = out.withColumn("annualization_factor", F.lit(float(annualization or YEAR_SECONDS / horizon_seconds)))
    return _derived(out, keys)


def _derived(out: DataFrame, keys: Sequence[str]) -> DataFrame:
    a = F.col("annualization_factor")
    n = F.col("observation_count")
    log_year = F.col("growth") * a / n
    mean = F.col("net_return_mean")
    out = out.select(
        "*",
        F.when(F.col("ruin") == 1, -1.0).otherwise(F.expm1("growth")).alias("total_return"),
        F.when(F.col("gross_ruin") == 1, -1.0).otherwise(F.expm1("gross_growth")).alias("gross_total_return"),
        F.when(F.col("ruin") == 1, -1.0).when(log_year < 709.0, F.expm1(log_year)).alias("annualized_return"),
        ratio(mean, F.col("__net_sd")).alias("__sharpe"),
        ratio(mean, F.col("__downside")).alias("__sortino"),
        F.when(F.col("ruin") == 1, 1.0).otherwise(-F.expm1(F.least(F.col("deepest"), F.lit(0.0)))).alias("maximum_drawdown"),
        (F.col("turnover") / n).alias("average_turnover"),
        F.coalesce(
            F.col("__holding"),
            ratio(F.col("active_us") / 1e6 + F.when(F.col("ends_on_start"), 1.0).otherwise(0.0), F.col("runs")),
        ).alias("average_holding_time_seconds"),
        F.greatest(F.lit(0.0), -F.coalesce(F.col("conditional_value_at_risk_95"), F.lit(0.0))).alias("tail_loss_95"),
    )
    out = out.select(
        "*",
        (F.col("__sharpe") * F.sqrt(a)).alias("sharpe_ratio"),
        (F.col("__sortino") * F.sqrt(a)).alias("sortino_ratio"),
        F.when(F.col("maximum_drawdown") > 0, F.col("annualized_return") / F.col("maximum_drawdown")).alias("calmar_ratio"),
    )
    return out.select(*keys, "observation_count", "active_observation_count", *METRICS)


def turnover_costs(
    obs: DataFrame, rates: Sequence[float] = (0.0, 0.0002, 0.0005, 0.001), seq: str = "seq"
) -> DataFrame:
    """Copies of the observations charged at each rate per unit of turnover."""
    position = F.coalesce(F.col("position"), F.signum("prediction")).cast("double")
    staged = obs.withColumn("position", position).withColumn("__all", F.lit(0))
    blocks = range_blocks(staged, ["__all"], ["timestamp", seq])
    inside = W.partitionBy("__all", BLOCK).orderBy("timestamp", seq)
    seams = W.partitionBy("__all").orderBy(BLOCK)
    lasts = blocks.groupBy("__all", BLOCK).agg(
        F.max_by("position", F.struct("timestamp", seq)).alias("__last")
    ).select("__all", BLOCK, F.lag("__last").over(seams).alias("__seam"))
    moved = (
        blocks.withColumn("__p", F.lag("position").over(inside))
        .join(lasts, ["__all", BLOCK])
        .withColumn("__turn", F.abs(F.col("position") - F.coalesce("__p", "__seam", F.lit(0.0))))
    )
    return (
        moved.withColumn("cost_rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
        .withColumn("transaction_cost", F.col("cost_rate") * F.col("__turn"))
        .drop("__p", "__seam", "__turn", "__all", BLOCK)
    )


def apply_execution(
    obs: DataFrame,
    seq: str = "seq",
    fee: float = 0.0004,
    spread: float = 0.0002,
    slippage: float = 0.0003,
    latency_seconds: float = 1.0,
    latency_rate: float = 0.00001,
    funding: float = 0.0001,
    fill_fraction: float = 1.0,
    max_participation: float = 0.1,
    impact: float = 0.0001,
    missing_policy: str = "skip",
    unavailable_policy: str = "skip",
    coverage_policy: str = "record",
) -> DataFrame:
    """Sequential partial fills per symbol, cost parts and reason codes.

    The filled position follows pos = prev + (desired - prev) * f, a linear
    recurrence that is scanned block by block; the costs are then plain columns.
    """
    def flag(name: str, default: bool = False) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in obs.columns else F.lit(default)

    missing, gone, changed = flag("missing_data"), ~flag("symbol_available", True), flag("coverage_changed")
    skip = (
        (missing & F.lit(missing_policy == "skip"))
        | (gone & F.lit(unavailable_policy == "skip"))
        | (changed & F.lit(coverage_policy == "skip"))
    )
    asked = (
        F.greatest(F.col("requested_volume_participation").cast("double"), F.lit(0.0))
        if "requested_volume_participation" in obs.columns else F.lit(None).cast("double")
    )
    capped = asked.isNotNull() & (asked > max_participation)
    fraction = F.when(capped, F.least(F.lit(fill_fraction), ratio(F.lit(max_participation), asked))).otherwise(fill_fraction)
    desired = F.coalesce(F.col("position"), F.signum("prediction")).cast("double")

    def coded(condition: Column, policy: str, skipped: str, recorded: str) -> Column:
        code = {"skip": skipped, "record": recorded}.get(policy)
        return F.when(condition, F.lit(code)) if code else F.lit(None).cast("string")

    codes = F.array_compact(
        F.array(
            coded(missing, missing_policy, "MISSING_DATA_SKIPPED", "MISSING_DATA_RECORDED"),
            coded(gone, unavailable_policy, "UNAVAILABLE_SYMBOL_SKIPPED", "UNAVAILABLE_SYMBOL_RECORDED"),
            coded(changed, coverage_policy, "DATA_COVERAGE_CHANGE_SKIPPED", "DATA_COVERAGE_CHANGED"),
            F.when(capped, "VOLUME_PARTICIPATION_CAPPED"),
            F.when(fraction < 1.0, "PARTIAL_FILL_APPLIED"),
        )
    )
    staged = obs.select(
        "*",
        F.coalesce(F.col("symbol"), F.lit("*")).alias("__sym"),
        desired.alias("requested_position"),
        F.when(skip, 0.0).otherwise(fraction).alias("fill_fraction"),
        skip.alias("__skip"),
        codes.alias("reason_codes"),
    ).select(
        "*",
        F.when(F.col("__skip"), 0.0).otherwise(1.0 - F.col("fill_fraction")).alias("__a"),
        F.when(F.col("__skip"), 0.0).otherwise(F.col("fill_fraction") * F.col("requested_position")).alias("__b"),
    )
    order = ["timestamp", seq]
    blocks = range_blocks(staged, ["__sym"], order)
    thin = blocks.select("__sym", BLOCK, *order, "__a", "__b")
    scanned = linear_scan(thin, ["__sym"], order, "__a", "__b", "filled_position")
    # With f = 1 or a skip the previous position does not enter the recurrence,
    # so it is looked up: inside the block, else from the block before.
    inside = W.partitionBy("__sym", BLOCK).orderBy(*order)
    seam = W.partitionBy("__sym").orderBy(BLOCK)
    ends = scanned.groupBy("__sym", BLOCK).agg(F.max_by("filled_position", F.struct(*order)).alias("__end")).select(
        "__sym", BLOCK, F.coalesce(F.lag("__end").over(seam), F.lit(0.0)).alias("__start")
    )
    filled = scanned.withColumn("__prev", F.lag("filled_position").over(inside)).join(ends, ["__sym", BLOCK]).select(
        "__sym", *order, "filled_position", F.coalesce("__prev", "__start").alias("previous_position")
    )
    turn = F.abs(F.col("filled_position") - F.col("previous_position"))
    parts = {
        "cost_fees": turn * fee,
        "cost_spread": turn * spread,
        "cost_slippage": turn * slippage,
        "cost_latency": turn * (latency_seconds * latency_rate),
        "cost_funding": F.abs("filled_position") * funding,
        "cost_market_impact": turn * turn * impact,
    }
    out = blocks.drop("__a", "__b", "__skip", BLOCK).join(filled, ["__sym", *order])
    total = F.coalesce(F.col("transaction_cost"), F.lit(0.0))
    for part in parts.values():
        total = total + part
    return out.select("*", *[e.alias(n) for n, e in parts.items()], total.alias("total_cost")).drop("__sym")
