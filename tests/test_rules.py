"""Hand-made cases for quality, lifecycle, text and streaming rules."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.clock import recency_weight
from tidemark.operators import attribution as at, documents as dc, lifecycle as lc, news, quality

T = dt.datetime(2024, 1, 1, 12, 0)


def minute(n):
    return T + dt.timedelta(minutes=n)


def test_candle_feed_cases(spark):
    rows = [
        ("A", 0, minute(0), 10.0, 10.0, 10.0, 10.0, 1.0),
        ("B", 1, minute(0), 10.0, 10.0, 10.0, 10.0, 1.0),  # another symbol at the same time is fine
        ("A", 2, minute(0), 10.0, 11.0, 10.0, 11.0, 1.0),  # same bar, other values
        ("A", 3, minute(2), 22.0, 22.0, 22.0, 22.0, -1.0),  # a missing minute, a jump, a bad volume
        ("A", 4, minute(3), 22.0, 21.0, 22.0, 22.0, 1.0),  # high below close
    ]
    df = spark.createDataFrame(rows, "symbol string, seq long, open_time timestamp_ntz, open double, high double, low double, close double, volume double")
    now = F.lit(minute(21)).cast("timestamp_ntz")
    got = sorted((r["code"], r["seq"]) for r in quality.candle_issues(df, "seq", now, 60, outlier=0.5, stale_seconds=600.0).collect() if r["seq"] is not None)
    assert got == sorted([
        ("DUPLICATE_CANDLE", 2), ("REVISED_VALUE", 2), ("NON_MONOTONIC_TIMESTAMP", 2), ("MISSING_CANDLE_INTERVAL", 3), ("PRICE_OUTLIER", 3),
        ("NEGATIVE_VOLUME", 3), ("INVALID_OHLC", 4),
    ])
    stale = quality.candle_issues(df, "seq", now, 60, stale_seconds=600.0).where("code = 'STALE_FEED'").count()
    assert stale == 1


def test_unknown_time_weighs_a_quarter(spark):
    row = spark.range(1).select(recency_weight(F.lit(None).cast("timestamp_ntz"), F.lit(T).cast("timestamp_ntz")).alias("w")).first()
    assert row["w"] == 0.25


def test_news_counts_only_after_availability(spark):
    scored = spark.createDataFrame(
        [(1, "early", minute(-30), 1.0, 0.0, 0.8, [], []), (2, "late", minute(5), -1.0, 0.0, 0.8, [], [])],
        "article_id long, text string, available_at timestamp_ntz, sentiment_score double, risk_score double, confidence double, topics array<string>, affected_symbols array<string>",
    )
    symbols = spark.createDataFrame([("BTCUSDT",)], "symbol string")
    row = news.scored_snapshot(symbols, scored, F.lit(T).cast("timestamp_ntz")).first()
    assert row["sentiment_articles_used"] == 1 and row["sentiment_score"] == 1.0


def test_all_html_entities_decode_like_the_standard_library(spark):
    df = spark.createDataFrame([("<p>caf&eacute; &amp; bar</p><script>x()</script>&#8364;5",)], "h string")
    assert df.select(tx.clean_html(F.col("h"), every_entity=True).alias("t")).first()["t"] == "café & bar €5"


def test_missing_lineage_reconciles_through_the_residual(spark):
    one = spark.createDataFrame(
        [(1, 10.0, None, None, None, None, None, None, None)],
        "id long, realized_pnl double, fee double, gross_pnl double, explicit map<string,double>, fill_count long, slippage_cost double, booked_funding double, estimated_funding double",
    )
    row = at.decompose(one).first()
    assert row["fees"] is None and row["alpha_contribution"] is None and row["unexplained_residual"] == 10.0


def test_stated_counterfactual_leaves_alpha_unassigned(spark):
    one = spark.createDataFrame(
        [(1, 10.0, 1.0, 8.0, {"execution_contribution": 2.0}, 1, 0.5, None, -0.1)],
        "id long, realized_pnl double, fee double, gross_pnl double, explicit map<string,double>, fill_count long, slippage_cost double, booked_funding double, estimated_funding double",
    )
    row = at.decompose(one).first()
    assert row["alpha_contribution"] is None and row["execution_contribution"] == 2.0 and row["fees"] == -1.0
    # Amounts are decimals: the parts and the residual make up the total exactly.
    assert sum((row[c] or 0 for c in at.COMPONENTS), Decimal(0)) + row["unexplained_residual"] == Decimal(10)


def _exchanges(node, column):
    own = node.nodeName() == "Exchange" and f"{column}#" in node.output().toString()
    return own + sum(_exchanges(node.children().apply(i), column) for i in range(node.children().size()))


def _ledger(spark):
    make = spark.createDataFrame
    trades = make([(1, None, None, 5.0), (1, None, "d9", 6.0), (1, None, None, 7.0), (None, 2, None, 8.0), (None, None, None, 9.0)], "order_id long, risk_id long, trace_id string, amount double")
    orders = make([(1, 1, None, "d1"), (3, 3, 3, "d3")], "order_id long, risk_id long, target_id long, trace_id string")
    risks = make([(1, 1, "d1", 0.1, 0.1), (2, 2, "d2", 0.2, 0.1)], "risk_id long, target_id long, trace_id string, requested_exposure double, approved_exposure double")
    targets = make([(1, 0.1, "e1"), (2, 0.2, None)], "target_id long, requested_target_exposure double, ensemble_id string")
    ensembles = make([("e1", "d1", 1, "calm"), ("e2", "d2", 1, "old"), ("e3", "d2", 2, "new")], "ensemble_id string, trace_id string, generated_at int, regime string")
    fills = make([(1, "10", "0.5", None, "1"), (1, "10", "0.5", "2", None)], "order_id long, notional string, slippage string, funding string, funding_cash_flow string")
    return trades, orders, risks, targets, ensembles, fills


def test_lineage_of_trades_with_missing_and_own_keys(spark):
    out = at.link_lineage(*_ledger(spark))
    got = {r["amount"]: (r["order_id"], r["risk_id"], r["trace_id"], r["link_trace"], r["ensemble_id"], r["regime"], r["has_target"], r["fill_count"]) for r in out.collect()}
    assert got == {
        5.0: (1, 1, None, "d1", "e1", "calm", True, 2), 6.0: (1, 1, "d9", "d9", "e1", "calm", True, 2), 7.0: (1, 1, None, "d1", "e1", "calm", True, 2),
        8.0: (None, 2, None, "d2", "e3", "new", True, None), 9.0: (None, None, None, None, None, "unknown", None, None),
    }


def test_trades_are_shuffled_once_to_meet_their_lineage(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        linked = at.link_lineage(*_ledger(spark))
        assert _exchanges(linked._jdf.queryExecution().executedPlan(), "amount") == 1
        lineage = spark.createDataFrame([("e1", True, False)], "ensemble_id string, complete boolean, provider_complete boolean")
        parts = linked.selectExpr("*", "cast(1 as decimal(20,8)) as fees", "cast(null as decimal(20,8)) as funding", "cast(amount as decimal(20,8)) as total_paper_pnl")
        covered = at.coverage(parts, lineage)
        assert _exchanges(covered._jdf.queryExecution().executedPlan(), "total_paper_pnl") == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    got = {r["evidence"]: (r["covered_trade_count"], r["trade_count"], r["absolute_pnl_ratio"]) for r in covered.collect()}
    assert got["model_signal_lineage"] == (3, 5, 18 / 35) and got["external_ai_status"] == (0, 5, 0.0) and got["execution_fill"] == (3, 5, 18 / 35)


def test_children_are_deleted_before_parents():
    order = lc.delete_order({"trades": ["orders"], "orders": ["signals"], "signals": [], "fills": ["orders"]})
    assert order.index("trades") < order.index("orders") < order.index("signals") and order.index("fills") < order.index("orders")


def test_nothing_is_deleted_while_the_export_is_wrong(spark):
    bad = spark.createDataFrame([("events", "ROW_COUNT_MISMATCH")], "table_name string, error string")
    df = spark.createDataFrame([(1, T)], "id long, ts timestamp_ntz")
    with pytest.raises(RuntimeError):
        lc.delete_range({"events": (df, "ts")}, lc.Slice(T, minute(5)), {}, [], bad)
    left = lc.delete_range({"events": (df, "ts")}, lc.Slice(T, minute(5)), {}, [], bad.limit(0))
    assert left["events"].count() == 0


def test_same_hash_with_other_text_is_reported(spark):
    df = spark.createDataFrame([("h", "a"), ("h", "b"), ("g", "c"), ("g", "c")], "hash string, identity string")
    assert [r["hash"] for r in dc.hash_collisions(df, "hash", "identity").collect()] == ["h"]


def test_document_parts_keep_equal_times_together(spark):
    rows = [(i, minute(i // 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz")
    out = dc.partition_by_time(df, "at").groupBy("at").agg(F.countDistinct("part").alias("n")).where("n > 1").count()
    assert out == 0


def test_disjunctive_article_dedup(spark):
    schema = "id long, source string, provider string, url string, title string, published_at timestamp_ntz"
    stored = spark.createDataFrame([(1, "s", "p", "u1", "t1", T)], schema)
    fresh = spark.createDataFrame(
        [(2, "s", "x", "u1", "t2", T), (3, "y", "p", "u1", "t3", T), (4, "y", "p", "u9", "t1", T), (5, "y", "p", "u5", "t5", T), (6, "y", "q", "u5", "t6", T)], schema
    )
    assert [r["id"] for r in dc.new_articles(fresh, stored, "id").collect()] == [5]
