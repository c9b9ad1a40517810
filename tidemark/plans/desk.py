"""Report, ranking, union and lookup queries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import money as mo, numeric as nm
from tidemark.operators import asof, context as cx, labels, reports as rp
from tidemark.operators.monitoring import windowed
from tidemark.operators.ranks import value_ranks
from tidemark.operators.series import numbered
from tidemark.plans import bindings as b
from tidemark.plans.registry import common, query, rnd, sql_round

def _k():
    return F.get_json_object("props", "$.k").cast("double")


def _events(spark, sf) -> DataFrame:
    return b.table(spark, sf, "events")


common("ek", "SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")


@query("candle_inventory", "SELECT symbol, is_closed, count(*) AS rows, min(open_time) AS first_time, max(open_time) AS last_time FROM candles GROUP BY symbol, is_closed", uses="ticks candles")
def candle_inventory(spark, sf):
    return rp.inventory(b.candles(spark, sf), ["symbol", "is_closed"], "open_time")


@query("article_counts_by_provider", "SELECT provider, count(*) AS rows FROM articles GROUP BY provider", uses="articles")
def article_counts_by_provider(spark, sf):
    return rp.counts_by(b.article_rows(spark, sf), "provider")


@query(
    "collection_report",
    """WITH a AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY ALL)
      SELECT CAST(day AS TIMESTAMP) AS day, event_type, n AS rows, hours AS hours_covered, concat_ws(',', CASE WHEN hours < 24 THEN 'HOURS_MISSING' END, CASE WHEN n < 70 THEN 'FEW_ROWS' END) AS recommendations FROM a""",
)
def collection_report(spark, sf):
    a = _events(spark, sf).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(F.date_trunc("hour", "ts")).alias("hours_covered")
    )
    advice = F.array_compact(F.array(F.when(F.col("hours_covered") < 24, "HOURS_MISSING"), F.when(F.col("rows") < 70, "FEW_ROWS")))
    return a.withColumn("recommendations", F.array_join(advice, ","))


def _labelled(spark, sf) -> DataFrame:
    c = b.candles(spark, sf).withColumn("as_of", F.col("close_time"))
    return labels.future_returns_by_time(c.select("symbol", "as_of", "close"), c)


@query(
    "label_status",
    """WITH c AS (SELECT symbol, close_time AS as_of, close FROM candles),
      f AS (SELECT c.symbol, c.as_of, a.close AS f5, d.close AS f240 FROM c ASOF LEFT JOIN c a ON a.symbol = c.symbol AND a.as_of >= c.as_of + INTERVAL 5 MINUTES ASOF LEFT JOIN c d ON d.symbol = c.symbol AND d.as_of >= c.as_of + INTERVAL 4 HOURS)
      SELECT count(*) AS total_rows, count(f5) AS rows_with_target_future_return_5m, count(f240) AS rows_with_target_future_return_4h, round(avg(CAST(f240 IS NOT NULL AS DOUBLE)), 6) + 0.0 AS label_coverage_pct,
        max(as_of) FILTER (WHERE f240 IS NOT NULL) AS latest_labeled, min(as_of) FILTER (WHERE f240 IS NULL) AS oldest_unlabeled, count(DISTINCT symbol) AS symbols FROM f""",
    uses="ticks candles",
)
def label_status(spark, sf):
    out = rp.label_status(_labelled(spark, sf), ["target_future_return_5m", "target_future_return_4h"], "target_future_return_4h", "as_of")
    return out.withColumn("label_coverage_pct", rnd("label_coverage_pct"))


@query(
    "rows_with_enough_future",
    """WITH c AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM candles)
      SELECT symbol, count(*) FILTER (WHERE pos + 5 < n) AS possible_5m, count(*) FILTER (WHERE pos + 15 < n) AS possible_15m, count(*) FILTER (WHERE pos + 60 < n) AS possible_1h FROM c GROUP BY symbol""",
    uses="ticks candles",
)
def rows_with_enough_future(spark, sf):
    c = b.candles(spark, sf).select("symbol", "open_time")
    placed = numbered(c, ["symbol"], ["open_time"], 7 * 86400, "open_time")
    counts = c.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return rp.rows_with_future(placed, counts, {"5m": 5, "15m": 15, "1h": 60})


@query("action_balance", "SELECT coalesce(CASE WHEN k < 20 THEN 'BUY' WHEN k < 40 THEN 'SELL' WHEN k < 90 THEN 'HOLD' END, 'UNKNOWN') AS action, count(*) AS rows FROM ek GROUP BY ALL", uses="ek")
def action_balance(spark, sf):
    action = F.when(_k() < 20, "BUY").when(_k() < 40, "SELL").when(_k() < 90, "HOLD")
    return rp.counts_by(_events(spark, sf).select(action.alias("action")), "action", "UNKNOWN")


@query(
    "trade_history_summary",
    """WITH t AS (SELECT o_orderpriority AS book, CAST((CAST(l_discount AS DECIMAL(6, 2)) - 0.05) * CAST(l_extendedprice AS DECIMAL(14, 2)) AS DECIMAL(20, 8)) AS v, l_shipdate, l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
      r AS (SELECT book, sum(v) OVER (PARTITION BY book ORDER BY l_shipdate, l_orderkey, l_linenumber) AS e, l_shipdate, l_orderkey, l_linenumber FROM t),
      d AS (SELECT book, max(greatest(0, p) - e) AS dd FROM (SELECT book, e, max(e) OVER (PARTITION BY book ORDER BY l_shipdate, l_orderkey, l_linenumber) AS p FROM r) GROUP BY book)
      SELECT book, count(*) AS trade_count, count(*) FILTER (WHERE v > 0) AS win_count, count(*) FILTER (WHERE v < 0) AS loss_count, round(avg(CAST(v > 0 AS DOUBLE)), 6) + 0.0 AS win_rate,
        CAST(sum(v) FILTER (WHERE v > 0) AS DECIMAL(30, 8)) AS gross_profit, CAST(-sum(v) FILTER (WHERE v < 0) AS DECIMAL(30, 8)) AS gross_loss, CAST(sum(v) AS DECIMAL(30, 8)) AS net_realized_pnl,
        round(CAST(sum(v) FILTER (WHERE v > 0) AS DOUBLE) / count(*) FILTER (WHERE v > 0), 6) + 0.0 AS average_win, round(CAST(sum(v) FILTER (WHERE v < 0) AS DOUBLE) / count(*) FILTER (WHERE v < 0), 6) + 0.0 AS average_loss,
        round(CAST(coalesce(sum(v) FILTER (WHERE v > 0), 0) AS DOUBLE) / CAST(abs(sum(v) FILTER (WHERE v < 0)) AS DOUBLE), 6) + 0.0 AS profit_factor, CAST(any_value(dd) AS DECIMAL(30, 8)) AS max_drawdown FROM t JOIN d USING (book) GROUP BY book""",
)
def trade_history_summary(spark, sf):
    """Sums and the deepest fall of the running profit are exact; averages are one division of exact sums."""
    exact = lambda c: F.col(c).cast("decimal(14,2)")
    t = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderpriority").alias("book"), mo.amount((exact("l_discount") - F.lit(Decimal("0.05"))) * exact("l_extendedprice")).alias("v"), "l_shipdate", "l_orderkey", "l_linenumber"
    )
    s = rp.exact_trade_summary(t, "v", ["book"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return s.select(
        "book", "trade_count", "win_count", "loss_count", *[rnd(c).alias(c) for c in ("win_rate", "average_win", "average_loss", "profit_factor")],
        *[F.col(c).cast(mo.TOTAL).alias(c) for c in ("gross_profit", "gross_loss", "net_realized_pnl", "max_drawdown")],
    )


def _decisions(spark, sf) -> DataFrame:
    i, k = F.col("event_id"), _k()
    source = F.when(k < 10, "exploration").when(k < 50, "model").otherwise("strategy")
    return _events(spark, sf).select(
        i.alias("decision_id"), F.col("ts").alias("created_at"), source.alias("source"), F.when(i % 3 == 0, i).alias("trade_id"),
        F.when(i % 3 == 0, "FILLED").when(i % 3 == 1, "HELD").otherwise("REJECTED").alias("execution_status"), F.when(k < 60, "HOLD").otherwise("BUY").alias("action"),
        F.col("event_type").alias("symbol"), k.alias("k"),
    )


@query(
    "trading_diagnostics",
    """WITH d AS (SELECT * FROM ek ORDER BY ts DESC, event_id DESC LIMIT 100)
      SELECT count(*) FILTER (WHERE event_id % 3 = 0 AND k >= 10) AS strategy_trades, count(*) FILTER (WHERE event_id % 3 = 0 AND k < 10) AS exploration_trades, count(*) FILTER (WHERE event_id % 3 <> 0) AS skipped_trades,
        count(*) FILTER (WHERE k < 60 OR event_id % 3 <> 0) AS holds FROM d""",
    uses="ek",
)
def trading_diagnostics(spark, sf):
    return rp.trading_diagnostics(_decisions(spark, sf))


@query(
    "hold_reasons_top",
    """SELECT event_id AS decision_id, CASE WHEN event_id % 3 = 0 THEN 'FILLED' WHEN event_id % 3 = 1 THEN 'HELD' ELSE 'REJECTED' END AS execution_status FROM (SELECT * FROM ek ORDER BY ts DESC, event_id DESC LIMIT 100) WHERE k < 60 OR event_id % 3 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 10""",
    uses="ek",
)
def hold_reasons_top(spark, sf):
    held = (F.col("action") == "HOLD") | F.col("execution_status").isin("HELD", "REJECTED")
    return rp.newest_decisions(rp.newest_decisions(_decisions(spark, sf)).where(held), 10).select("decision_id", "execution_status")


@query("decision_source", "SELECT event_id AS decision_id, CASE WHEN event_id % 13 = 0 THEN 'manual' WHEN k < 10 THEN 'model' WHEN k < 20 THEN 'exploration' ELSE 'strategy' END AS decision_source FROM ek", uses="ek")
def decision_source(spark, sf):
    raw = F.when(F.col("event_id") % 13 == 0, "manual")
    made = F.coalesce(raw, F.when(_k() < 10, "model"), F.when(_k() < 20, "exploration"), F.lit("strategy"))
    return _events(spark, sf).select(F.col("event_id").alias("decision_id"), made.alias("decision_source"))


@query(
    "table_bounds_and_size",
    "SELECT count(*) AS rows, min(published_at) AS first_time, max(published_at) AS last_time, CAST(round(avg(strlen(text)) * count(*)) AS BIGINT) AS estimated_bytes FROM articles",
    uses="articles",
)
def table_bounds_and_size(spark, sf):
    return rp.bounds_and_size(b.article_rows(spark, sf), "published_at", "text")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _TABLES))
def table_row_counts(spark, sf):
    return rp.table_counts({t: b.table(spark, sf, t) for t in _TABLES})


@query(
    "provider_usage_ledger",
    """WITH r AS (SELECT 'p' || CAST(user_id % 6 AS VARCHAR) AS provider, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'SUCCESS' WHEN event_type = 'error' THEN 'FAILED' ELSE 'TIMEOUT' END AS status, event_id % 3 + 1 AS attempts, value / 1000 AS cost FROM events),
      s AS (SELECT provider, max((ts, event_id)) AS ok FROM r WHERE status = 'SUCCESS' GROUP BY provider)
      SELECT r.provider, CAST(sum(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN attempts ELSE 0 END) AS BIGINT) AS daily_requests, round(coalesce(sum(CASE WHEN date_trunc('month', ts) = DATE '2024-01-01' THEN cost * attempts END), 0), 6) + 0.0 AS monthly_spend, max(ts) AS last_requested,
        CAST(coalesce(sum(CASE WHEN status = 'FAILED' AND (ok IS NULL OR (ts, event_id) > ok) THEN attempts END), 0) AS BIGINT) AS consecutive_failures FROM r LEFT JOIN s USING (provider) GROUP BY r.provider""",
)
def provider_usage_ledger(spark, sf):
    r = _events(spark, sf).select(
        F.concat(F.lit("p"), (F.col("user_id") % 6).cast("string")).alias("provider"), F.col("event_id").alias("request_id"), F.col("ts").alias("requested_at"),
        F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "error", "FAILED").otherwise("TIMEOUT").alias("status"),
        (F.col("event_id") % 3 + 1).alias("attempts"), (F.col("value") / 1000).alias("cost"),
    )
    return rp.provider_ledger(r, F.lit("2024-01-15").cast("date")).withColumn("monthly_spend", rnd("monthly_spend"))


@query(
    "account_equity_mark",
    """WITH h AS (SELECT o_custkey AS account, sum(l_extendedprice / 10) AS m, sum(CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END * (l_extendedprice / l_quantity * l_discount / 10) * l_quantity) AS u, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey)
      SELECT c_custkey AS account, coalesce(n, 0) AS open_positions, round(c_acctbal + coalesce(m, 0) + coalesce(u, 0) + 3e-6, 2) + 0.0 AS equity FROM customer LEFT JOIN h ON h.account = c_custkey""",
)
def account_equity_mark(spark, sf):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    held = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("account"), F.when(F.col("l_returnflag") == "A", "SHORT").otherwise("LONG").alias("side"), price.alias("entry"),
        (price + price * F.col("l_discount") / 10).alias("mark"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 10).alias("margin"),
    )
    cash = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("cash_balance"))
    return rp.equity_mark(held, cash).select("account", "open_positions", (F.round(F.col("equity") + F.lit(3e-6), 2) + F.lit(0.0)).alias("equity"))


@query(
    "portfolio_exposures",
    """WITH h AS (SELECT o_custkey AS account, p_brand AS cluster, sum(abs(CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END * l_extendedprice / 1e6)) AS c, sum(CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END * l_extendedprice / 1e6) AS s
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
      SELECT account, round(sum(c), 8) + 0.0 AS gross, round(sum(s), 8) + 0.0 AS net, round(max(c), 8) + 0.0 AS largest_cluster FROM h GROUP BY account""",
)
def portfolio_exposures(spark, sf):
    rows = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(
        b.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")
    ).select(
        F.col("o_custkey").alias("account"), F.col("p_brand").alias("cluster"), F.lit(1e6).alias("equity"),
        (F.when(F.col("l_returnflag") == "A", -1.0).otherwise(1.0) * F.col("l_extendedprice")).alias("signed_notional"),
    )
    out = rp.exposures(rows)
    return out.select("account", *[rnd(c, 8).alias(c) for c in ("gross", "net", "largest_cluster")])


@query(
    "account_reconciliation",
    """WITH p AS (SELECT o_custkey AS account, CAST(o_totalprice AS DECIMAL(14, 2)) * 0.1 AS margin, CAST(o_totalprice AS DECIMAL(14, 2)) * ((o_orderkey % 21 - 10) * 0.001) AS unrealized, o_orderkey % 50 = 0 AS wrong FROM orders WHERE o_orderstatus = 'O'),
      h AS (SELECT account, sum(CAST(margin AS DECIMAL(20, 8)) * CASE WHEN wrong THEN -1 ELSE 1 END + CAST(unrealized AS DECIMAL(20, 8))) AS held, count(*) AS n, count(*) FILTER (WHERE wrong) AS bad FROM p GROUP BY account),
      a AS (SELECT c_custkey AS account, CAST(c_acctbal AS DECIMAL(20, 8)) AS cash, coalesce(held, 0) AS held, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM customer LEFT JOIN h ON account = c_custkey),
      e AS (SELECT *, CAST(cash + held AS DECIMAL(30, 8)) AS expected, CAST(CAST(cash + held AS DECIMAL(30, 2)) + CASE WHEN account % 7 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(20, 8)) AS equity FROM a)
      SELECT account, cash AS cash_balance, equity, expected AS expected_equity, CAST(CAST(equity AS DECIMAL(30, 2)) - CAST(expected AS DECIMAL(30, 2)) AS DECIMAL(30, 2)) AS difference, account % 7 <> 0 AS cash_reconciled, n AS position_count, bad AS invalid_positions FROM e""",
)
def account_reconciliation(spark, sf):
    """Customers as accounts, open orders as their positions; every seventh stored equity is off by a cent."""
    price, cent = F.col("o_totalprice").cast("decimal(14,2)"), F.lit(Decimal("0.01"))
    share = (F.col("o_orderkey") % 21 - 10).cast("decimal(4,0)") * F.lit(Decimal("0.001"))
    held = b.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(
        F.col("o_custkey").alias("account"), F.lit(1).alias("quantity"), (price * F.when(F.col("o_orderkey") % 50 == 0, Decimal("-0.1")).otherwise(Decimal("0.1"))).alias("margin"), (price * share).alias("unrealized")
    )
    cash = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").cast(mo.MONEY).alias("cash_balance"))
    known = rp.reconcile(cash.withColumn("equity", F.lit(None).cast(mo.MONEY)), held).select(F.col("account"), F.col("cash_balance"), mo.cents("expected_equity").alias("e"))
    stored = known.select("account", "cash_balance", (F.col("e") + F.when(F.col("account") % 7 == 0, cent).otherwise(cent * 0).cast("decimal(4,2)")).alias("equity"))
    return rp.reconcile(stored, held)


@query(
    "exact_fill_prices",
    """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(20, 8)) AS p, CAST(CAST(l_tax AS DECIMAL(6, 2)) * 0.01 AS DECIMAL(14, 10)) AS s, l_linestatus = 'F' AS short, CAST(l_quantity AS DECIMAL(14, 10)) * 0.37 AS q FROM lineitem),
      f AS (SELECT *, CAST(p + CASE WHEN short THEN -1 ELSE 1 END * CAST(p * s AS DECIMAL(20, 8)) AS DECIMAL(20, 8)) AS entry FROM t),
      g AS (SELECT *, CAST(entry * 1.01 AS DECIMAL(20, 8)) AS out_price, CAST(CAST(q AS DECIMAL(20, 8)) - CAST(q AS DECIMAL(20, 8)) % CAST(0.25 AS DECIMAL(20, 8)) AS DECIMAL(20, 8)) AS size FROM f)
      SELECT l_orderkey, l_linenumber, entry, size, CAST(CASE WHEN short THEN entry - out_price ELSE out_price - entry END * CAST(size AS DECIMAL(14, 10)) AS DECIMAL(20, 8)) AS gross FROM g""",
)
def exact_fill_prices(spark, sf):
    """Side-aware prices, quantities rounded down to a quarter, and the profit of a one per cent move."""
    short = F.col("l_linestatus") == "F"
    rows = b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(short, "SHORT").otherwise("LONG").alias("side"),
        mo.fill_price("l_extendedprice", F.when(short, "SELL").otherwise("BUY"), F.col("l_tax").cast("decimal(6,2)") * F.lit(Decimal("0.01"))).alias("entry"),
        mo.round_down(mo.rate("l_quantity") * F.lit(Decimal("0.37")), F.lit(Decimal("0.25"))).alias("size"),
    )
    target = mo.amount(F.col("entry") * F.lit(Decimal("1.01")))
    return rows.select("l_orderkey", "l_linenumber", "entry", "size", mo.gross_pnl("side", "entry", target, "size").alias("gross"))


@query(
    "filled_orders_without_fill",
    "SELECT o_orderkey AS order_id FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')",
)
def filled_orders_without_fill(spark, sf):
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "F", "FILLED").otherwise("OPEN").alias("state"))
    fills = b.table(spark, sf, "lineitem").where(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("order_id"))
    return rp.unfilled(orders, fills).select("order_id")


_SIM = [
    "net_return_after_fees", "max_drawdown", "trade_rate", "action_bias", "simulated_win_rate", "trade_directional_accuracy", "average_return_per_trade",
    "average_realized_return_after_fees", "best_trade_return", "worst_trade_return", "average_win_return", "average_loss_return", "payoff_ratio", "profit_factor",
]


def _simulate_sql(keys: str, src: str) -> str:
    return f"""a AS (SELECT *, CASE WHEN p > 0.002 THEN 1 WHEN p < -0.002 THEN -1 ELSE 0 END AS act FROM {src}),
      r AS (SELECT *, CASE WHEN act <> 0 THEN act * y - 0.0012 ELSE CAST(0 AS DOUBLE) END AS ret FROM a),
      e AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY {keys} ORDER BY ts, seq) AS eq FROM r),
      d AS (SELECT *, 1 - exp(eq - greatest(0, max(eq) OVER (PARTITION BY {keys} ORDER BY ts, seq))) AS dd FROM e),
      t AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, seq) - row_number() OVER (PARTITION BY {keys}, ret <= 0 ORDER BY ts, seq) AS g FROM r WHERE act <> 0),
      s AS (SELECT {keys}, max(n) AS longest_losing_streak FROM (SELECT {keys}, g, count(*) AS n FROM t WHERE ret <= 0 GROUP BY {keys}, g) GROUP BY {keys}),
      m AS (SELECT {keys}, count(*) AS rows, exp(sum(ln(1 + ret))) - 1 AS net_return_after_fees, max(dd) AS max_drawdown, count(*) FILTER (WHERE act <> 0) AS number_of_trades, count(*) FILTER (WHERE act = 0) AS skipped_no_trade_count,
        count(*) FILTER (WHERE act <> 0) / count(*) AS trade_rate, count(*) FILTER (WHERE act = 1) AS long_trade_count, count(*) FILTER (WHERE act = -1) AS short_trade_count,
        sum(act) / count(*) FILTER (WHERE act <> 0) AS action_bias, count(*) FILTER (WHERE act <> 0 AND ret > 0) / count(*) FILTER (WHERE act <> 0) AS simulated_win_rate,
        count(*) FILTER (WHERE act <> 0 AND act = CASE WHEN y > 0 THEN 1 ELSE -1 END) / count(*) FILTER (WHERE act <> 0) AS trade_directional_accuracy, avg(ret) FILTER (WHERE act <> 0) AS average_return_per_trade,
        avg(ret) AS average_realized_return_after_fees, max(ret) FILTER (WHERE act <> 0) AS best_trade_return, min(ret) FILTER (WHERE act <> 0) AS worst_trade_return,
        avg(ret) FILTER (WHERE act <> 0 AND ret > 0) AS average_win_return, abs(avg(ret) FILTER (WHERE act <> 0 AND ret <= 0)) AS average_loss_return,
        avg(ret) FILTER (WHERE act <> 0 AND ret > 0) / abs(avg(ret) FILTER (WHERE act <> 0 AND ret <= 0)) AS payoff_ratio, sum(ret) FILTER (WHERE act <> 0 AND ret > 0) / abs(sum(ret) FILTER (WHERE act <> 0 AND ret <= 0)) AS profit_factor
        FROM d GROUP BY {keys})
      SELECT m.{keys}, rows, number_of_trades, skipped_no_trade_count, long_trade_count, short_trade_count, longest_losing_streak, {sql_round(_SIM)} FROM m JOIN s USING ({keys})"""


def _sim_rows(spark, sf) -> DataFrame:
    return b.observation_rows(spark, sf).select("symbol", "timestamp", "seq", "prediction", F.col("actual_return").alias("realized"))


def _sim_out(df, key):
    return df.select(key, "rows", "number_of_trades", "skipped_no_trade_count", "long_trade_count", "short_trade_count", "longest_losing_streak", *[rnd(c).alias(c) for c in _SIM])


@query(
    "simulated_returns",
    f"WITH src AS (SELECT symbol, timestamp AS ts, seq, prediction AS p, actual_return AS y FROM observations), {_simulate_sql('symbol', 'src')}",
    uses="observations",
)
def simulated_returns(spark, sf):
    return _sim_out(rp.simulate(_sim_rows(spark, sf), ["symbol"], ["timestamp", "seq"], 0.0004, 0.002, slippage=0.0002), "symbol")


@query(
    "simulated_returns_by_slice",
    f"WITH src AS (SELECT ntile(4) OVER (ORDER BY timestamp, seq) AS slice, timestamp AS ts, seq, prediction AS p, actual_return AS y FROM observations), {_simulate_sql('slice', 'src')}",
    uses="observations",
)
def simulated_returns_by_slice(spark, sf):
    cut = rp.even_slices(_sim_rows(spark, sf), ["timestamp", "seq"], 4)
    return _sim_out(rp.simulate(cut, ["slice"], ["timestamp", "seq"], 0.0004, 0.002, slippage=0.0002), "slice")


@query(
    "same_sign_runs",
    """WITH g AS (SELECT event_type, k >= 50 AS up, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - row_number() OVER (PARTITION BY event_type, k >= 50 ORDER BY ts, event_id) AS g FROM ek)
      SELECT event_type, up AS value, count(*) AS length, min(ts) AS first_at, max(ts) AS last_at FROM g GROUP BY event_type, up, g""",
    uses="ek",
)
def same_sign_runs(spark, sf):
    rows = _events(spark, sf).select("event_type", "ts", "event_id", "props")
    return rp.run_lengths(rows, ["event_type"], ["ts", "event_id"], _k() >= 50).select("event_type", "value", "length", "first_at", "last_at")


@query("contiguous_slices", "SELECT event_id, ntile(7) OVER (ORDER BY ts, event_id) AS slice FROM events")
def contiguous_slices(spark, sf):
    return rp.even_slices(_events(spark, sf).select("event_id", "ts"), ["ts", "event_id"], 7).select("event_id", "slice")


@query(
    "recency_source_weights",
    "SELECT event_id, round(CASE WHEN event_type = 'view' THEN 0.5 ELSE 1.0 END * (1 + 0.4 * row_number() OVER (ORDER BY ts, event_id) / count(*) OVER ()), 6) + 0.0 AS weight FROM events",
)
def recency_source_weights(spark, sf):
    rows = _events(spark, sf).select("event_id", "ts", "event_type")
    return rp.source_weights(rows, ["ts", "event_id"], F.col("event_type") == "view", 0.5, 1.0, 0.4).select("event_id", rnd("weight").alias("weight"))


@query(
    "recent_and_reference_windows",
    "SELECT event_type, CASE WHEN n <= 50 THEN 'recent' ELSE 'reference' END AS part, count(*) AS rows, min(ts) AS first_at FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100 GROUP BY ALL",
)
def recent_and_reference_windows(spark, sf):
    rows = _events(spark, sf).select("event_type", "event_id", F.col("ts").alias("observed_at"))
    return windowed(rows, ["event_type"], 50, tie="event_id").groupBy("event_type", F.when(F.col("recent"), "recent").otherwise("reference").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("observed_at").alias("first_at")
    )


@query(
    "metric_previous_change",
    """SELECT event_id, lag(numeric_value) OVER w AS previous_value, round(numeric_value - lag(numeric_value) OVER w + 1e-9, 6) + 0.0 AS value_change, round(numeric_value / nullif(lag(numeric_value) OVER w, 0) - 1, 6) + 0.0 AS value_change_pct
      FROM external WINDOW w AS (PARTITION BY source_name, data_type, symbol ORDER BY event_time, event_id)""",
    uses="external",
)
def metric_previous_change(spark, sf):
    out = cx.previous_change(b.external_events(spark, sf))
    return out.select("event_id", "previous_value", rnd(F.col("value_change") + 1e-9).alias("value_change"), rnd("value_change_pct").alias("value_change_pct"))


@query("top_events_per_group", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def top_events_per_group(spark, sf):
    rows = _events(spark, sf).select("event_type", "event_id", "value", "ts")
    return asof.latest_per_key(rows, ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 20).select("event_type", "event_id", "value")


@query("latest_tick_per_user", "SELECT user_id, last(event_id ORDER BY ts, event_id) AS event_id, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY user_id")
def latest_tick_per_user(spark, sf):
    order = F.struct("ts", "event_id")
    return _events(spark, sf).groupBy("user_id").agg(F.max_by("event_id", order).alias("event_id"), F.max_by("value", order).alias("value"))


@query("newest_bars_chronological", "SELECT symbol, open_time, close, row_number() OVER (ORDER BY open_time, symbol) AS place FROM (SELECT * FROM candles ORDER BY open_time DESC, symbol DESC LIMIT 500)", uses="ticks candles")
def newest_bars_chronological(spark, sf):
    newest = b.candles(spark, sf).orderBy(F.desc("open_time"), F.desc("symbol")).limit(500)
    place = F.row_number().over(W.orderBy("open_time", "symbol"))  # at most 500 rows
    return newest.select("symbol", "open_time", "close", place.cast("long").alias("place"))


@query("feature_importance_top", "SELECT p_brand AS feature, round(sum(p_retailprice) + 1e-7, 4) + 0.0 AS importance FROM part GROUP BY p_brand ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 80")
def feature_importance_top(spark, sf):
    return b.table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("s")).orderBy(F.desc("s"), "feature").limit(80).select(
        "feature", (F.round(F.col("s") + F.lit(1e-7), 4) + F.lit(0.0)).alias("importance")
    )


@query(
    "top_decile_selection",
    "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) WHERE n <= greatest(1, ceil(c * 0.1))",
)
def top_decile_selection(spark, sf):
    """The value at the decile edge comes from value counts; only its ties need a rank."""
    rows = _events(spark, sf).select("event_type", "event_id", "value")
    ranked = value_ranks(rows, ["event_type"], "value").select("event_type", "value", "upto", "total", "n")
    want = F.greatest(F.lit(1), F.ceil(F.col("total") * 0.1))
    above = F.col("total") - F.col("upto")
    reach = ranked.where(above < want).select("event_type", "value", (want - above).alias("room"), "n")
    hit = rows.join(reach, ["event_type", "value"])
    whole = hit.where(F.col("n") <= F.col("room"))
    edge = hit.where(F.col("n") > F.col("room")).withColumn("r", F.row_number().over(W.partitionBy("event_type", "value").orderBy("event_id"))).where(F.col("r") <= F.col("room"))
    return whole.select("event_type", "event_id", "value").unionByName(edge.select("event_type", "event_id", "value"))


@query("merged_day_files", "SELECT props AS line, min(event_id) AS seq FROM events GROUP BY props")
def merged_day_files(spark, sf):
    e = _events(spark, sf).select(F.col("props").alias("line"), F.col("event_id").alias("seq"))
    first, second = e.where(F.col("seq") % 2 == 0), e.where(F.col("seq") % 2 == 1)
    return rp.distinct_lines(first.unionByName(second))


@query("union_by_name_keep_last", "SELECT event_id, event_type, CASE WHEN event_type IN ('view', 'click') THEN value END AS value FROM events WHERE event_type <> 'error'")
def union_by_name_keep_last(spark, sf):
    e = _events(spark, sf)
    left = e.where(F.col("event_type").isin("signup", "purchase", "view")).select("event_id", "event_type", F.lit(1).alias("gen"))
    right = e.where(F.col("event_type").isin("view", "click")).select("event_id", "event_type", "value", F.lit(2).alias("gen"))
    both = left.unionByName(right, allowMissingColumns=True)
    return asof.latest_per_key(both, ["event_id"], [F.desc("gen")]).select("event_id", "event_type", "value")


@query("common_timestamps", "SELECT open_time FROM candles GROUP BY open_time HAVING count(DISTINCT symbol) >= 2 AND count(DISTINCT symbol) = 2", uses="ticks candles")
def common_timestamps(spark, sf):
    return rp.common_times(b.candles(spark, sf), "symbol", "open_time", 2)


@query(
    "trace_event_union",
    """SELECT 'd' || o_orderkey AS trace, 'order' AS stage, o_orderdate AS at, CAST(o_orderkey AS VARCHAR) AS id FROM orders UNION ALL SELECT 'd' || l_orderkey, 'fill', l_shipdate, CAST(l_partkey AS VARCHAR) FROM lineitem
      UNION ALL SELECT 'd' || o_orderkey, 'risk', o_orderdate, CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'""",
)
def trace_event_union(spark, sf):
    o = b.table(spark, sf, "orders").withColumn("trace_id", F.concat(F.lit("d"), F.col("o_orderkey").cast("string")))
    l = b.table(spark, sf, "lineitem").withColumn("trace_id", F.concat(F.lit("d"), F.col("l_orderkey").cast("string")))
    return rp.stage_events(
        {"order": (o, "o_orderdate", "o_orderkey"), "fill": (l, "l_shipdate", "l_partkey"), "risk": (o.where(F.col("o_orderstatus") == "F"), "o_orderdate", "o_custkey")}, "trace_id"
    )


@query(
    "decision_trace_list",
    """WITH f AS (SELECT 'd' || l_orderkey AS trace, 'fill' AS stage, l_shipdate AS at, CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_linestatus = 'F'),
      p AS (SELECT 'd' || o_orderkey AS trace, 'order' AS stage, o_orderdate AS at, CAST(o_custkey AS VARCHAR) AS id FROM orders)
      SELECT trace, last(stage ORDER BY "at", id) AS latest_stage, max("at") AS "at", count(*) AS events, 'timeline' AS kind FROM f GROUP BY trace
      UNION ALL SELECT trace, last(stage ORDER BY "at", id), max("at"), count(*), 'partial' FROM p WHERE trace NOT IN (SELECT trace FROM f) GROUP BY trace
      UNION ALL SELECT NULL, event_type, ts, 1, 'legacy' FROM events WHERE event_type = 'error'""",
)
def decision_trace_list(spark, sf):
    l = b.table(spark, sf, "lineitem").where(F.col("l_linestatus") == "F").select(
        F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("trace"), F.lit("fill").alias("stage"), F.col("l_shipdate").alias("at"), F.col("l_partkey").cast("string").alias("id")
    )
    o = b.table(spark, sf, "orders").select(
        F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("trace"), F.lit("order").alias("stage"), F.col("o_orderdate").alias("at"), F.col("o_custkey").cast("string").alias("id")
    )
    old = _events(spark, sf).where(F.col("event_type") == "error").select(F.lit(None).cast("string").alias("trace"), F.col("event_type").alias("latest_stage"), F.col("ts").alias("at"))
    return rp.timeline_traces(l, o, old)


@query(
    "live_bar_append",
    """WITH c AS (SELECT symbol, open_time, close FROM candles WHERE open_time < TIMESTAMP '2024-01-30'),
      n AS (SELECT symbol, max(open_time) AS open_time, last(close ORDER BY open_time) AS close FROM candles WHERE open_time >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY symbol)
      SELECT symbol, open_time, close, true AS is_closed FROM c UNION ALL SELECT n.symbol, n.open_time, n.close, false FROM n WHERE n.open_time > (SELECT max(open_time) FROM c WHERE c.symbol = n.symbol)""",
    uses="ticks candles",
)
def live_bar_append(spark, sf):
    c = b.candles(spark, sf).select("symbol", "open_time", "close")
    return rp.append_live(c.where(F.col("open_time") < F.expr("timestamp_ntz'2024-01-30'")), c.where(F.col("open_time") >= F.expr("timestamp_ntz'2024-01-29 12:00:00'")))


@query(
    "champion_by_scope",
    """WITH c AS (SELECT n_name AS champion, CASE WHEN n_nationkey % 5 = 0 THEN '*' ELSE CASE n_nationkey % 5 WHEN 1 THEN 'click' WHEN 2 THEN 'view' ELSE 'none' END END AS scope, TIMESTAMP '2024-01-01' + to_days(n_nationkey) AS a,
        CASE WHEN n_nationkey % 3 = 0 THEN TIMESTAMP '2024-01-04' + to_days(n_nationkey) END AS z FROM nation),
      h AS (SELECT e.event_id, champion, row_number() OVER (PARTITION BY e.event_id ORDER BY (scope <> '*') DESC, a DESC, champion) AS n FROM events e JOIN c ON (scope = e.event_type OR scope = '*') AND a <= e.ts AND (z IS NULL OR e.ts < z))
      SELECT e.event_id, h.champion FROM events e LEFT JOIN h ON h.event_id = e.event_id AND h.n = 1""",
)
def champion_by_scope(spark, sf):
    k = F.col("n_nationkey")
    days = lambda base: F.expr(f"timestamp_ntz'{base}'") + F.make_dt_interval(days=k)
    champions = b.table(spark, sf, "nation").select(
        F.col("n_name").alias("champion"), F.when(k % 5 == 0, "*").when(k % 5 == 1, "click").when(k % 5 == 2, "view").otherwise("none").alias("scope_symbol"),
        days("2024-01-01").alias("active_from"), F.when(k % 3 == 0, days("2024-01-04")).alias("active_to"),
    )
    rows = _events(spark, sf).select("event_id", F.col("event_type").alias("symbol"), "ts")
    return rp.scoped_champion(rows, champions, "ts", ["event_id"]).select("event_id", "champion")


@query(
    "annualisation_factor",
    """WITH g AS (SELECT event_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS gap FROM events)
      SELECT event_type, round(quantile_cont(gap, 0.5) FILTER (WHERE gap > 0), 3) + 0.0 AS median_gap, round(greatest(1, 365.25 * 86400e6 / quantile_cont(gap, 0.5) FILTER (WHERE gap > 0)), 6) + 0.0 AS annualization_factor FROM g GROUP BY event_type""",
)
def annualisation_factor(spark, sf):
    out = rp.annualisation(_events(spark, sf).select("event_type", "ts"), ["event_type"], "ts")
    return out.select("event_type", rnd("median_gap", 3).alias("median_gap"), rnd("annualization_factor").alias("annualization_factor"))


@query(
    "source_freshness",
    """SELECT provider, count(*) AS rows, max(published_at) AS latest, last(article_id ORDER BY published_at, article_id) AS latest_article, (epoch_us(TIMESTAMP '2024-01-01 18:00:00') - epoch_us(max(published_at))) / 1e6 > 7200 AS stale FROM articles GROUP BY provider""",
    uses="articles",
)
def source_freshness(spark, sf):
    now = F.expr("timestamp_ntz'2024-01-01 18:00:00'")
    return b.article_rows(spark, sf).groupBy("provider").agg(
        F.count(F.lit(1)).alias("rows"), F.max("published_at").alias("latest"), F.max_by("article_id", F.struct("published_at", "article_id")).alias("latest_article"),
        ((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max("published_at").cast("timestamp"))) / 1e6 > 7200).alias("stale"),
    )


@query(
    "symbol_catalogue",
    """WITH l AS (SELECT symbol, max(open_time) AS latest FROM candles GROUP BY symbol), s AS (SELECT symbol FROM candles UNION SELECT o_orderpriority FROM orders UNION SELECT c_mktsegment FROM customer)
      SELECT s.symbol, latest, coalesce(latest < TIMESTAMP '2024-01-30 23:30:00', true) AS stale FROM s LEFT JOIN l USING (symbol)""",
    uses="ticks candles",
)
def symbol_catalogue(spark, sf):
    c = b.candles(spark, sf)
    seen = c.select("symbol").union(b.table(spark, sf, "orders").select("o_orderpriority")).union(b.table(spark, sf, "customer").select("c_mktsegment")).distinct()
    latest = c.groupBy("symbol").agg(F.max("open_time").alias("latest"))
    return seen.join(latest, "symbol", "left").withColumn("stale", F.coalesce(F.col("latest") < F.expr("timestamp_ntz'2024-01-30 23:30:00'"), F.lit(True)))


@query(
    "replay_rewards",
    """WITH r AS (SELECT event_id, candle AS ret, least(candle, 0) AS dd FROM (SELECT event_id, (k - 50) / 5000 AS candle FROM ek))
      SELECT event_id, 'BUY' AS action, round(ret - 0.0008 + least(dd, 0) * 0.25, 9) + 0.0 AS reward FROM r UNION ALL SELECT event_id, 'HOLD', round(-abs(ret) * 0.15, 9) + 0.0 FROM r""",
    uses="ek",
)
def replay_rewards(spark, sf):
    ret = (_k() - 50.0) / 5000.0
    rows = _events(spark, sf).select("event_id", ret.alias("ret"), F.least(ret, F.lit(0.0)).alias("dd"))
    return labels.replay_rewards(rows, F.col("ret"), F.col("dd"), ["event_id"]).select("event_id", "action", rnd("reward", 9).alias("reward"))


@query(
    "experience_rewards",
    """WITH t AS (SELECT o_orderkey, sum((l_discount - 0.05) * l_extendedprice) AS pnl FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey)
      SELECT o.o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'BUY' END AS action, round(pnl + 1e-5, 3) + 0.0 AS reward FROM orders o LEFT JOIN t ON t.o_orderkey = o.o_orderkey""",
)
def experience_rewards(spark, sf):
    pnl = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum((F.col("l_discount") - 0.05) * F.col("l_extendedprice")).alias("pnl"))
    orders = b.table(spark, sf, "orders").withColumn("action", F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY"))
    out = orders.join(pnl, "o_orderkey", "left")
    return out.select("o_orderkey", "action", F.when(F.col("action") == "SELL", F.round(F.col("pnl") + F.lit(1e-5), 3) + F.lit(0.0)).alias("reward"))


_DER = [
    "crowd_long_account_pct", "crowd_short_account_pct", "crowd_long_short_ratio", "top_trader_long_account_pct", "top_trader_position_long_pct", "taker_buy_pressure",
    "taker_buy_sell_ratio", "open_interest_value", "open_interest_change", "funding_rate", "trader_crowd_score", "crowd_risk_score", "derivatives_recency_weight",
]
_AT = "2024-01-20 12:00:00"


@query(
    "derivatives_snapshot",
    f"""WITH e AS (SELECT event_id, 'S' || CAST(user_id % 40 AS VARCHAR) AS symbol, ts, value, k, ['global_long_short_account_ratio', 'top_long_short_account_ratio', 'top_long_short_position_ratio', 'taker_buy_sell_volume', 'open_interest_hist', 'open_interest', 'funding_rate'][event_id % 7 + 1] AS t
        FROM ek WHERE ts >= TIMESTAMP '{_AT}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{_AT}'),
      l AS (SELECT symbol, t, last(k ORDER BY ts, event_id) AS k, last(value ORDER BY ts, event_id) AS v, max(ts) AS ts FROM e GROUP BY ALL),
      w AS (SELECT symbol, max(k / 100) FILTER (WHERE t = 'global_long_short_account_ratio') AS lp, max(1 - k / 100) FILTER (WHERE t = 'global_long_short_account_ratio') AS sp, max(v) FILTER (WHERE t = 'global_long_short_account_ratio') AS r,
        max(k / 100) FILTER (WHERE t = 'top_long_short_account_ratio') AS tl, max(k / 100) FILTER (WHERE t = 'top_long_short_position_ratio') AS tp, max(k / 100) FILTER (WHERE t = 'taker_buy_sell_volume') AS tb, max(v) FILTER (WHERE t = 'taker_buy_sell_volume') AS tr,
        max(v) FILTER (WHERE t = 'open_interest_hist') AS oh, max(v) FILTER (WHERE t = 'open_interest') AS oi, max(k / 100000) FILTER (WHERE t = 'funding_rate') AS f, avg(greatest(0, least(1, 1 - (epoch_us(TIMESTAMP '{_AT}') - epoch_us(ts)) / 3.6e9 / 24))) AS rec FROM l GROUP BY symbol),
      o AS (SELECT symbol, max(value) FILTER (WHERE n = 1) AS a, max(value) FILTER (WHERE n = 2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE t IN ('open_interest_hist', 'open_interest')) GROUP BY symbol),
      x AS (SELECT w.*, coalesce(CASE WHEN o.b IS NOT NULL THEN o.a / nullif(o.b, 0) - 1 END, 0) AS moved, list_filter([CASE WHEN coalesce(lp, 0) <> 0 OR coalesce(sp, 0) <> 0 THEN greatest(-1, least(1, (coalesce(lp, 0) - coalesce(sp, 0)) * 2)) END, CASE WHEN coalesce(tl, 0) <> 0 THEN (tl - 0.5) * 2 END,
        CASE WHEN coalesce(tp, 0) <> 0 THEN (tp - 0.5) * 2 END, CASE WHEN coalesce(tb, 0) <> 0 THEN (tb - 0.5) * 2 END], lambda z: z IS NOT NULL) AS bs FROM w LEFT JOIN o USING (symbol)),
      y AS (SELECT symbol, coalesce(lp, 0) AS crowd_long_account_pct, coalesce(sp, 0) AS crowd_short_account_pct, coalesce(r, 0) AS crowd_long_short_ratio, coalesce(tl, 0) AS top_trader_long_account_pct, coalesce(tp, 0) AS top_trader_position_long_pct,
        coalesce(tb, 0) AS taker_buy_pressure, coalesce(tr, 0) AS taker_buy_sell_ratio, CASE WHEN coalesce(oh, 0) = 0 THEN coalesce(oi, 0) ELSE oh END AS open_interest_value, greatest(-1, least(1, moved)) AS open_interest_change, coalesce(f, 0) AS funding_rate,
        CASE WHEN len(bs) > 0 THEN list_avg(bs) ELSE 0 END AS trader_crowd_score, least(1, coalesce(list_max(list_transform(bs, lambda z: abs(z))), 0) * 0.45 + abs(greatest(-1, least(1, coalesce(f, 0) / 0.0005))) * 0.35 + abs(moved) * 1.6) AS crowd_risk_score, rec AS derivatives_recency_weight FROM x)
      SELECT symbol, {sql_round(_DER)} FROM y""",
    uses="ek",
)
def derivatives_snapshot(spark, sf):
    kinds = F.array(*[F.lit(t) for t in cx.DERIVATIVE_TYPES])
    k, v = _k(), F.col("value")
    rows = _events(spark, sf).select(
        "event_id", F.concat(F.lit("S"), (F.col("user_id") % 40).cast("string")).alias("symbol"), F.col("ts").alias("event_time"),
        F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("data_type"), v.alias("numeric_value"),
        F.create_map(
            F.lit("long_account_pct"), k / 100, F.lit("short_account_pct"), 1 - k / 100, F.lit("long_short_ratio"), v, F.lit("buy_pressure"), k / 100, F.lit("buy_sell_ratio"), v,
            F.lit("sum_open_interest_value"), v, F.lit("open_interest"), v, F.lit("funding_rate"), k / 100000,
        ).alias("payload"),
    )
    out = cx.derivatives_snapshot(rows, F.expr(f"timestamp_ntz'{_AT}'"))
    return out.select("symbol", *[rnd(c).alias(c) for c in _DER])


_CTX_SYM = ["spot_activity_score", "spot_bid_ask_spread_pct", "liquidation_spike_score", "liquidation_total_usd_5m"]
_CTX_ALL = [
    "fear_greed_value", "global_market_cap_change_24h", "market_cap_change_24h", "total_volume_change_24h", "stablecoin_depeg_risk", "macro_risk_score",
    "regulation_risk_score", "security_risk_score", "world_risk_score", "etf_bullish_score",
]
_CTX = _CTX_SYM + _CTX_ALL


@query(
    "market_context_snapshot",
    f"""WITH e AS (SELECT event_id, 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, ts, [{", ".join(f"'{c}'" for c in _CTX)}][event_id % {len(_CTX)} + 1] AS t,
          CASE WHEN event_id % {len(_CTX)} = {_CTX.index("fear_greed_value")} THEN k ELSE (k - 50) / 500 END AS v FROM ek WHERE ts >= TIMESTAMP '{_AT}' - INTERVAL 48 HOURS AND ts <= TIMESTAMP '{_AT}'),
      s AS (SELECT DISTINCT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol FROM events),
      own AS (SELECT symbol, t, last(v ORDER BY ts, event_id) AS v, max(ts) AS ts FROM e GROUP BY ALL), gl AS (SELECT t, last(v ORDER BY ts, event_id) AS v, max(ts) AS ts FROM e GROUP BY t),
      p AS (SELECT s.symbol, {", ".join(f"coalesce((SELECT v FROM own o WHERE o.symbol = s.symbol AND t = '{c}'), (SELECT v FROM gl WHERE t = '{c}')) AS {c}, coalesce((SELECT ts FROM own o WHERE o.symbol = s.symbol AND t = '{c}'), (SELECT ts FROM gl WHERE t = '{c}')) AS {c}_at" for c in _CTX_SYM)},
        {", ".join(f"(SELECT v FROM gl WHERE t = '{c}') AS {c}, (SELECT ts FROM gl WHERE t = '{c}') AS {c}_at" for c in _CTX_ALL)} FROM s),
      q AS (SELECT *, CASE WHEN coalesce(fear_greed_value, 0) <> 0 THEN greatest(-1, least(1, (fear_greed_value - 50) / 50)) ELSE 0 END AS fear, greatest(-1, least(1, coalesce(global_market_cap_change_24h, market_cap_change_24h, 0) * 8 + coalesce(total_volume_change_24h, 0) * 2)) AS growth,
        greatest(0, least(1, coalesce(stablecoin_depeg_risk, 0) * 0.35 + coalesce(macro_risk_score, 0) * 0.20 + coalesce(regulation_risk_score, 0) * 0.15 + coalesce(security_risk_score, 0) * 0.15 + coalesce(world_risk_score, 0) * 0.15)) AS drag,
        greatest(-0.5, least(0.5, coalesce(spot_activity_score, 0) * 0.5 - coalesce(spot_bid_ask_spread_pct, 0) * 100)) AS liq, greatest(0, least(1, coalesce(liquidation_spike_score, 0) / 5)) AS shock FROM p)
      SELECT symbol, round(greatest(-1, least(1, fear * 0.25 + growth * 0.25 + liq * 0.10 + coalesce(etf_bullish_score, 0) * 0.2 - drag * 0.35 - shock * 0.1)), 6) + 0.0 AS market_regime_score,
        concat_ws(',', CASE WHEN fear_greed_value_at IS NULL OR fear_greed_value_at < TIMESTAMP '{_AT}' - INTERVAL 30 HOURS THEN 'fear_greed' END,
          CASE WHEN greatest(global_market_cap_change_24h_at, market_cap_change_24h_at) IS NULL OR greatest(global_market_cap_change_24h_at, market_cap_change_24h_at) < TIMESTAMP '{_AT}' - INTERVAL 12 HOURS THEN 'global_market' END,
          CASE WHEN spot_activity_score_at IS NULL OR spot_activity_score_at < TIMESTAMP '{_AT}' - INTERVAL 1 HOUR THEN 'spot_context' END, CASE WHEN liquidation_total_usd_5m_at IS NULL OR liquidation_total_usd_5m_at < TIMESTAMP '{_AT}' - INTERVAL 1 HOUR THEN 'liquidations' END,
          CASE WHEN stablecoin_depeg_risk_at IS NULL OR stablecoin_depeg_risk_at < TIMESTAMP '{_AT}' - INTERVAL 30 HOURS THEN 'stablecoin_risk' END, CASE WHEN macro_risk_score_at IS NULL OR macro_risk_score_at < TIMESTAMP '{_AT}' - INTERVAL 12 HOURS THEN 'macro_risk' END) AS stale_sources FROM q""",
    uses="ek",
)
def market_context_snapshot(spark, sf):
    n = len(_CTX)
    i = F.col("event_id")
    rows = _events(spark, sf).select(
        "event_id", F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), F.col("ts").alias("event_time"),
        F.element_at(F.array(*[F.lit(c) for c in _CTX]), (i % n + 1).cast("int")).alias("data_type"),
        F.when(i % n == _CTX.index("fear_greed_value"), _k()).otherwise((_k() - 50.0) / 500.0).alias("numeric_value"),
    )
    at = F.expr(f"timestamp_ntz'{_AT}'")
    out = cx.with_global_fallback(rows.select("symbol"), rows, at, 48, _CTX_SYM, _CTX_ALL)
    return out.select("symbol", rnd(cx.market_regime_score()).alias("market_regime_score"), F.array_join(cx.stale_sources(at, out.columns), ",").alias("stale_sources"))


@query(
    "safe_numeric_cast",
    """SELECT event_id, coalesce(try_cast(t AS DOUBLE), 0) AS value FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN event_type WHEN event_id % 5 = 2 THEN NULL ELSE CAST(value AS VARCHAR) END AS t FROM events)""",
)
def safe_numeric_cast(spark, sf):
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "").when(i % 5 == 1, F.col("event_type")).when(i % 5 > 2, F.col("value").cast("string"))
    return _events(spark, sf).select("event_id", nm.number_or(text).alias("value"))


@query(
    "finite_values",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN NULL ELSE value END AS value FROM events""",
)
def finite_values(spark, sf):
    i = F.col("event_id")
    x = F.when(i % 3 == 0, F.lit(float("nan"))).when(i % 3 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return _events(spark, sf).select("event_id", nm.finite(x).alias("value"))
