"""Read-side reports: counts, latest rows, runs, streaks, simulated results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.money import TOTAL, amount, cents, nil
from tidemark.functions.numeric import zero
from tidemark.operators.asof import latest_per_key
from tidemark.operators.ranks import quantiles, value_ranks
from tidemark.operators.series import BLOCK, lag_across, meet, micros, positions, range_blocks, running


def inventory(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def counts_by(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing)).alias(column)).agg(F.count(F.lit(1)).alias("rows"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table; one small aggregate per table, united."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def bounds_and_size(df: DataFrame, time: str, text: str) -> DataFrame:
    """Row count, time bounds and the estimated bytes of a text column (exact average)."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        F.round(zero(F.avg(F.octet_length(text))) * F.count(F.lit(1))).cast("long").alias("estimated_bytes"),
    )


def label_status(rows: DataFrame, targets: Sequence[str], main: str, time: str) -> DataFrame:
    done = F.col(main).isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.count(t).alias(f"rows_with_{t}") for t in targets],
        zero(F.avg(done.cast("double"))).alias("label_coverage_pct"), F.max(F.when(done, F.col(time))).alias("latest_labeled"),
        F.min(F.when(~done, F.col(time))).alias("oldest_unlabeled"), F.countDistinct("symbol").alias("symbols"),
    )


def rows_with_future(rows: DataFrame, counts: DataFrame, horizons: Mapping[str, int]) -> DataFrame:
    """Rows whose series still has the horizon's number of bars after them."""
    both = rows.join(counts, "symbol")
    return both.groupBy("symbol").agg(*[F.count(F.when(F.col("pos") + h < F.col("n"), 1)).alias(f"possible_{n}") for n, h in horizons.items()])


def trade_summary(trades: DataFrame, pnl: str, keys: Sequence[str] = ()) -> DataFrame:
    v = F.col(pnl)
    won, lost = F.when(v > 0, v), F.when(v < 0, v)
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"), F.count(won).alias("win_count"), F.count(lost).alias("loss_count"),
        F.avg((v > 0).cast("double")).alias("win_rate"), F.avg(won).alias("average_win"), F.avg(lost).alias("average_loss"),
        F.sum(v).alias("net_realized_pnl"), (zero(F.sum(won)) / F.abs(F.sum(lost))).alias("profit_factor"),
    )


def exact_trade_summary(trades: DataFrame, pnl: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``trade_summary`` of exact amounts, with sums as decimals and the deepest fall of the running profit from its peak (from zero on)."""
    v = F.col(pnl)
    won, lost = F.when(v > 0, v), F.when(v < 0, v)
    mean = lambda c: F.sum(c).cast("double") / F.when(F.count(c) > 0, F.count(c))
    profit, loss = nil(F.sum(won), TOTAL), nil(-F.sum(lost), TOTAL)
    sums = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"), F.count(won).alias("win_count"), F.count(lost).alias("loss_count"), F.avg((v > 0).cast("double")).alias("win_rate"),
        mean(won).alias("average_win"), mean(lost).alias("average_loss"), profit.alias("gross_profit"), loss.alias("gross_loss"), nil(F.sum(v), TOTAL).alias("net_realized_pnl"),
        (profit.cast("double") / F.when(loss != 0, loss.cast("double"))).alias("profit_factor"),
    )
    blocks = range_blocks(trades.select(*keys, *order, pnl), keys, order)
    path = running(blocks, keys, order, {"__e": ("sum", v.cast(TOTAL))}).withColumn("__e", F.col("__e").cast(TOTAL))
    top = running(path, keys, order, {"__p": ("max", F.col("__e"))})
    fall = top.groupBy(*keys).agg(F.max(F.greatest(nil(F.lit(None).cast(TOTAL), TOTAL), F.col("__p")) - F.col("__e")).cast(TOTAL).alias("max_drawdown"))
    return meet(sums, fall, list(keys))


def provider_ledger(requests: DataFrame, today: Column, http: str = "attempts") -> DataFrame:
    """Daily requests, spend of the month, last request and failures since the newest success, per provider."""
    at = F.col("requested_at")
    last_ok = requests.where(F.col("status") == "SUCCESS").groupBy("provider").agg(F.max(F.struct("requested_at", "request_id")).alias("__ok"))
    both = requests.join(last_ok, "provider", "left")
    after = F.col("__ok").isNull() | (F.struct("requested_at", "request_id") > F.col("__ok"))
    return both.groupBy("provider").agg(
        zero(F.sum(F.when(F.to_date(at) == today, F.col(http)))).cast("long").alias("daily_requests"),
        zero(F.sum(F.when(F.trunc(F.to_date(at), "month") == F.trunc(today, "month"), F.greatest("cost", F.lit(0.0)) * F.col(http)))).alias("monthly_spend"), F.max(at).alias("last_requested"),
        zero(F.sum(F.when(after & (F.col("status") == "FAILED"), F.col(http)))).cast("long").alias("consecutive_failures"),
    )


def newest_decisions(decisions: DataFrame, n: int = 100) -> DataFrame:
    return decisions.orderBy(F.desc("created_at"), F.desc("decision_id")).limit(n)


def trading_diagnostics(decisions: DataFrame, n: int = 100) -> DataFrame:
    """Fill and hold counts among the newest decisions."""
    filled = (F.col("trade_id").isNotNull()) & (F.col("execution_status") == "FILLED")
    return newest_decisions(decisions, n).agg(
        F.count(F.when(filled & (F.col("source") != "exploration"), 1)).alias("strategy_trades"),
        F.count(F.when(filled & (F.col("source") == "exploration"), 1)).alias("exploration_trades"),
        F.count(F.when(~filled, 1)).alias("skipped_trades"),
        F.count(F.when((F.col("action") == "HOLD") | F.col("execution_status").isin("HELD", "REJECTED"), 1)).alias("holds"),
    )


def equity_mark(positions_: DataFrame, cash: DataFrame) -> DataFrame:
    """Equity per account: cash plus margins and open profit of its positions."""
    side = F.when(F.col("side") == "LONG", F.col("mark") - F.col("entry")).otherwise(F.col("entry") - F.col("mark"))
    held = positions_.groupBy("account").agg(
        F.sum("margin").alias("reserved_margin"), F.sum(side * F.col("quantity")).alias("unrealized_pnl"), F.count(F.lit(1)).alias("open_positions")
    )
    out = cash.join(held, "account", "left").na.fill(0, ["reserved_margin", "unrealized_pnl", "open_positions"])
    return out.withColumn("equity", F.col("cash_balance") + F.col("reserved_margin") + F.col("unrealized_pnl"))


def reconcile(accounts: DataFrame, positions_: DataFrame) -> DataFrame:
    """Stored equity against cash plus margins and open profit of the account's positions, to the cent.

    ``accounts`` has account, cash_balance, equity; ``positions_`` account, quantity, margin, unrealized.  A
    position is invalid when its quantity or margin is missing, not finite, too large for an amount or below zero; it
    counts in the sum with what it has.
    """
    q, m, u = amount("quantity"), amount("margin"), amount("unrealized")
    wrong = q.isNull() | m.isNull() | (q < 0) | (m < 0)
    held = positions_.groupBy("account").agg(
        nil(F.sum(nil(m) + nil(u)).cast(TOTAL), TOTAL).alias("__held"), F.count(F.lit(1)).alias("position_count"), F.count_if(wrong).alias("invalid_positions")
    )
    expected = (nil(amount("cash_balance")) + nil(F.col("__held"), TOTAL)).cast(TOTAL)
    out = accounts.join(held, "account", "left").withColumn("expected_equity", expected)
    gap = (cents(nil(amount("equity"))) - cents("expected_equity")).cast("decimal(30,2)")
    return out.select(
        "account", amount("cash_balance").alias("cash_balance"), amount("equity").alias("equity"), "expected_equity", gap.alias("difference"), (gap == 0).alias("cash_reconciled"),
        F.coalesce("position_count", F.lit(0)).alias("position_count"), F.coalesce("invalid_positions", F.lit(0)).alias("invalid_positions"),
    )


def exposures(holdings: DataFrame) -> DataFrame:
    """Gross, net and largest cluster exposure per account."""
    share = F.col("signed_notional") / F.col("equity")
    by_cluster = holdings.groupBy("account", "cluster").agg(F.sum(F.abs(share)).alias("c"), F.sum(share).alias("s"))
    return by_cluster.groupBy("account").agg(F.sum("c").alias("gross"), F.sum("s").alias("net"), F.max("c").alias("largest_cluster"))


def unfilled(orders: DataFrame, fills: DataFrame, key: str = "order_id") -> DataFrame:
    """Orders marked filled that have no fill row."""
    return orders.where(F.col("state") == "FILLED").join(fills.select(key).distinct(), key, "left_anti")


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Runs of equal values: run number, value, length, first and last time.

    A run's number is a running count of changes, so runs cross block borders.
    """
    staged = df.withColumn("__v", value)
    blocks = range_blocks(staged, keys, order)
    prior = lag_across(blocks, keys, order, {"__p": F.col("__v"), "__had": F.lit(True)})
    turned = F.when(F.col("__had").isNull() | ~F.col("__v").eqNullSafe(F.col("__p")), 1)
    numbered = running(prior, keys, order, {"run": ("count", turned)})
    return numbered.groupBy(*keys, "run").agg(
        F.first("__v").alias("value"), F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at")
    )


def longest_losing_streak(trades: DataFrame, keys: Sequence[str], order: Sequence[str], ret: str) -> DataFrame:
    runs = run_lengths(trades, keys, order, F.col(ret) <= 0)
    return runs.groupBy(*keys).agg(zero(F.max(F.when(F.col("value"), F.col("length")))).cast("long").alias("longest_losing_streak"))


def simulate(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fee: float, min_edge: float, slippage: float = 0.0, multiplier: float = 1.0) -> DataFrame:
    """Eighteen statistics of acting on forecasts beyond the edge threshold, per key."""
    keys = list(keys)
    edge, cost = max(min_edge, fee * 2.0), max(0.0, (fee + slippage) * 2.0 * max(0.0, multiplier))
    p = F.col("prediction")
    act = F.when(p > edge, 1).when(p < -edge, -1).otherwise(0)
    staged = rows.withColumn("act", act).withColumn("ret", F.when(F.col("act") != 0, F.col("act") * F.col("realized") - cost).otherwise(0.0))
    blocks = range_blocks(staged.select(*keys, *order, "act", "ret", "realized"), keys, order)
    growth = F.when(F.col("ret") > -1, F.log1p("ret")).otherwise(0.0)
    eq = running(blocks, keys, order, {"eq": ("sum", growth), "ruined": ("count", F.when(F.col("ret") <= -1, 1))})
    top = running(eq, keys, order, {"top": ("max", F.when(F.col("ruined") == 0, F.col("eq")))})
    drop = F.when(F.col("ruined") > 0, 1.0).otherwise(-F.expm1(F.col("eq") - F.greatest(F.lit(0.0), F.col("top"))))
    path = top.groupBy(*keys).agg(
        F.max(drop).alias("max_drawdown"), F.max("ruined").alias("r")
    )
    traded = F.col("act") != 0
    win, loss = F.when(traded & (F.col("ret") > 0), F.col("ret")), F.when(traded & (F.col("ret") <= 0), F.col("ret"))
    n = F.count(F.when(traded, 1))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.when(a > 0, 999.0).otherwise(0.0))
    share = lambda x: zero(x / F.when(n > 0, n))
    longs, shorts = F.count(F.when(F.col("act") == 1, 1)), F.count(F.when(F.col("act") == -1, 1))
    hits = F.count(F.when(traded & (F.signum(F.when(F.col("realized") > 0, 1.0).otherwise(-1.0)) == F.col("act")), 1))
    stats = blocks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(growth).alias("__g"), n.alias("number_of_trades"), F.count(F.when(~traded, 1)).alias("skipped_no_trade_count"),
        (n / F.count(F.lit(1))).alias("trade_rate"), longs.alias("long_trade_count"), shorts.alias("short_trade_count"),
        share(longs - shorts).alias("action_bias"), share(F.count(win)).alias("simulated_win_rate"), share(hits).alias("trade_directional_accuracy"),
        zero(F.avg(F.when(traded, F.col("ret")))).alias("average_return_per_trade"), F.avg("ret").alias("average_realized_return_after_fees"),
        zero(F.max(F.when(traded, F.col("ret")))).alias("best_trade_return"), zero(F.min(F.when(traded, F.col("ret")))).alias("worst_trade_return"),
        zero(F.avg(win)).alias("average_win_return"), zero(F.abs(F.avg(loss))).alias("average_loss_return"),
        per(zero(F.avg(win)), zero(F.abs(F.avg(loss)))).alias("payoff_ratio"), per(zero(F.sum(win)), zero(F.abs(F.sum(loss)))).alias("profit_factor"),
    )
    streak = longest_losing_streak(staged.where(F.col("act") != 0), keys, order, "ret")
    return (
        stats.join(path, keys).join(streak, keys, "left")
        .withColumn("net_return_after_fees", F.when(F.col("r") > 0, -1.0).otherwise(F.expm1("__g")))
        .withColumn("longest_losing_streak", F.coalesce("longest_losing_streak", F.lit(0).cast("long")))
        .withColumn("edge_threshold_used", F.lit(edge)).withColumn("round_trip_cost_used", F.lit(cost)).drop("__g", "r")
    )


def simulate_by_group(rows: DataFrame, group: str, names: Sequence[str], order: Sequence[str], fee: float, min_edge: float, slippage: float = 0.0, least: int = 25) -> DataFrame:
    """``simulate`` per group, with a row for every name: evaluated, or ``too_few_rows`` and no statistics."""
    stats = simulate(rows, [group], order, fee, min_edge, slippage)
    known = rows.sparkSession.createDataFrame([(n,) for n in names], f"{group} string")
    out = known.join(stats, group, "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    enough = F.col("rows") >= least
    return out.select(
        group, "rows", F.when(enough, "evaluated").otherwise("too_few_rows").alias("status"),
        *[F.when(enough, F.col(c)).alias(c) for c in stats.columns if c not in (group, "rows")],
    )


def even_slices(df: DataFrame, order: Sequence[str], slices: int) -> DataFrame:
    """Contiguous slices; the first (n mod k) hold one row more."""
    placed = positions(range_blocks(df.withColumn("__all", F.lit(0)), ["__all"], order), ["__all"], order)
    n = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    base, extra = divmod(n, slices)
    big = extra * (base + 1)
    number = F.when(F.col("pos") < big, F.floor(F.col("pos") / max(base + 1, 1))).otherwise(extra + F.floor((F.col("pos") - big) / max(base, 1)))
    return placed.withColumn("slice", (number + 1).cast("long")).drop("pos", "__all", BLOCK)


def source_weights(df: DataFrame, order: Sequence[str], historical: Column, old: float, live: float, recency: float) -> DataFrame:
    """Base weight by source times one plus a recency share of the time rank."""
    placed = positions(range_blocks(df.withColumn("__all", F.lit(0)), ["__all"], order), ["__all"], order)
    total = df.agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.lit(0))
    out = placed.join(total, "__all")
    weight = F.when(historical, old).otherwise(live) * (1.0 + recency * (F.col("pos") + 1) / F.col("__n"))
    return out.withColumn("weight", weight).drop("pos", "__all", BLOCK, "__n")


def distinct_lines(files: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    """First occurrence of each line over all files."""
    return files.groupBy(line).agg(F.min(seq).alias(seq))


def common_times(df: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """Times at which all ``n`` keys have a row."""
    return df.select(key, time).distinct().groupBy(time).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == n).select(time)


def stage_events(tables: Mapping[str, tuple[DataFrame, str, str]], trace: str) -> DataFrame:
    """One (trace, stage, time, id) row per record of each table."""
    out = None
    for stage, (df, time, ident) in tables.items():
        one = df.select(F.col(trace).alias("trace"), F.lit(stage).alias("stage"), F.col(time).alias("at"), F.col(ident).cast("string").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


def timeline_traces(timeline: DataFrame, partial: DataFrame, legacy: DataFrame) -> DataFrame:
    """Decisions from the timeline, else from partial traces, plus untraced ones."""
    full = timeline.groupBy("trace").agg(
        F.max_by("stage", F.struct("at", "id")).alias("latest_stage"), F.max("at").alias("at"), F.count(F.lit(1)).alias("events")
    ).withColumn("kind", F.lit("timeline"))
    rest = partial.join(full.select("trace"), "trace", "left_anti").groupBy("trace").agg(
        F.max_by("stage", F.struct("at", "id")).alias("latest_stage"), F.max("at").alias("at"), F.count(F.lit(1)).alias("events")
    ).withColumn("kind", F.lit("partial"))
    old = legacy.select("trace", "latest_stage", "at", F.lit(1).cast("long").alias("events"), F.lit("legacy").alias("kind"))
    return full.unionByName(rest).unionByName(old)


def append_live(closed: DataFrame, live: DataFrame, keys: Sequence[str] = ("symbol",), time: str = "open_time") -> DataFrame:
    """Closed bars plus the newest live bar of each key if it is not older."""
    last = closed.groupBy(*keys).agg(F.max(time).alias("__last"))
    newest = latest_per_key(live, keys, [F.col(time).desc()])
    fresh = newest.join(last, list(keys), "left").where(F.col("__last").isNull() | (F.col(time) > F.col("__last"))).drop("__last")
    return closed.withColumn("is_closed", F.lit(True)).unionByName(fresh.withColumn("is_closed", F.lit(False)))


def scoped_champion(rows: DataFrame, champions: DataFrame, at: str, key: Sequence[str]) -> DataFrame:
    """The active champion of each row: an exact symbol beats ``*``, newer beats older."""
    cells = rows.withColumn("scope", F.explode(F.array(F.col("symbol"), F.lit("*"))))
    c = champions.select(F.col("scope_symbol").alias("scope"), "champion", "active_from", "active_to")
    hit = cells.join(c, "scope", "left").where(
        F.col("champion").isNotNull() & (F.col("active_from") <= F.col(at)) & (F.col("active_to").isNull() | (F.col(at) < F.col("active_to")))
    )
    best = latest_per_key(hit, key, [(F.col("scope") != "*").desc(), F.col("active_from").desc(), F.col("champion")])
    return rows.join(best.select(*key, "champion"), list(key), "left")


def annualisation(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Year over the median positive interval, at least one."""
    blocks = range_blocks(df, keys, [time])
    gaps = lag_across(blocks, keys, [time], {"__p": F.col(time)}).select(*keys, (micros(time) - micros("__p")).alias("gap")).where(F.col("gap") > 0)
    med = quantiles(value_ranks(gaps, keys, "gap"), keys, "gap", {"median_gap": 0.5})
    return med.withColumn("annualization_factor", F.greatest(F.lit(1.0), F.lit(365.25 * 86400e6) / F.col("median_gap")))
