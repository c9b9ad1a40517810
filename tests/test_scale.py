"""What the large tables need of a plan: rows spread over tasks, narrow rows where rows are sorted."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import ensemble as en

T = dt.datetime(2024, 1, 1)


def _signals(spark):
    rows = [(1, f"s{i}", f, q, T) for i, (f, q) in enumerate([("a", 0.9), ("b", 0.8), ("a", 0.7), (None, 0.6), (None, 0.5)])] + [(None, "x", "a", 0.4, T)]
    df = spark.createDataFrame(rows, "decision_id long, signal_id string, family string, confidence double, generated_at timestamp_ntz")
    return df.withColumns({
        "valid_until": F.expr("generated_at + interval 5 minutes"), "decided_at": F.col("generated_at"), "lifecycle_status": F.lit("PAPER"), "health_status": F.lit("HEALTHY"),
        "direction": F.lit("LONG"), "recent_performance": F.lit(0.0), "uncertainty": F.lit(0.0), "liquidity_score": F.lit(1.0), "strength": F.lit(1.0), "wide": F.lit("w"),
    })


def test_signals_are_weighed_without_gathering_whole_rows(spark):
    pairs = spark.createDataFrame([("a", "b", 0.65)], "left_family string, right_family string, correlation double")
    out = en.signal_weights(_signals(spark), pairs, threshold=0.3)
    got = {r["signal_id"]: (r["correlation_penalty"] if r["correlation_penalty"] is None else round(r["correlation_penalty"], 9), r["wide"]) for r in out.collect()}
    assert got["s0"] == (None, "w") and got["s1"][0] == 0.5 and got["s2"][0] == 0.5
    # Families without a name are one family; a decision without a number is one as well.
    assert got["s3"][0] is None and got["s4"][0] == 0.0 and got["x"][0] is None
    plan = en.signal_weights(_signals(spark), None, threshold=0.3).select("decision_id", "weight")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "collect_list(struct" not in plan


def test_a_small_events_file_is_dealt_before_much_work_a_row(spark, tmp_path):
    from tidemark.plans import bindings, scoring

    one = [(i, T, i, "click", 1.0, '{"k": 3}') for i in range(40)]
    spark.createDataFrame(one, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    for rows in (scoring.feature_bank(spark, str(tmp_path)), bindings.observation_rows(spark, str(tmp_path))):
        assert rows.rdd.getNumPartitions() >= cores and rows.count() == 40


def test_a_filter_on_what_texts_say_does_not_split_them_again(spark, tmp_path):
    from tidemark.plans import library

    docs = [(1, "exchange hack drained bridge, breach and exploit", "en", "s", 9), (2, "exchange hack drained bridge, breach and exploit", "en", "s", 9), (3, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = library.student_dataset_rows(spark, str(tmp_path))
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert 1 in [r["article_id"] for r in out.collect()]


def test_tokens_are_counted_where_their_texts_lie(spark):
    from tests.test_rules import _exchanges
    from tidemark.operators import documents as dc

    docs = spark.createDataFrame([(1, "red red blue"), (1, "red"), (2, None), (None, "blue")], "id long, text string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled",)}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        table = dc.token_table(docs, "id", "text")
        assert _exchanges(table._jdf.queryExecution().executedPlan(), "token") == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, table.collect()), key=str) == [(1, "blue", 1), (1, "red", 3), (None, "blue", 1)]
    taught = docs.where("id = 1 and text <> 'red'").selectExpr("id", "text", "'x' as a").unionByName(docs.where("id is null").selectExpr("5 as id", "text", "'y' as a"))
    got = dc.TextStudent(taught, "id", "text", ["a"]).predict(docs.where("id = 1"), "id", "text").collect()
    assert {(r["task"], r["predicted"]) for r in got} == {("a", "x")}


class _State(list):
    """Stands in for a list or value of the state and counts the calls."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def appendList(self, rows):
        self.calls += 1
        self.extend(rows)

    def get(self):
        self.calls += 1
        return iter(self)

    def exists(self):
        return bool(self)

    def update(self, value):
        self[:] = [value]


def test_a_batch_of_candles_is_one_call_of_the_state():
    import pandas as pd

    from tidemark.streaming.maturity import _FirstCandle

    class Handle:
        def __init__(self):
            self.held = {}

        def getListState(self, name, kind):
            return self.held.setdefault(name, _State())

        getValueState = getMapState = getListState

        def registerTimer(self, at):
            pass

    handle, worker = Handle(), _FirstCandle(100, "bigint")
    worker.init(handle)
    frame = lambda rows: pd.DataFrame(rows, columns=["is_signal", "signal_id", "generated", "due", "closed", "close"])
    first = frame([(True, 7, 0, 10, 0, 0.0)] + [(False, 0, 0, 0, t, 5.0 + t) for t in range(12, 60)])
    later = frame([(False, 0, 0, 0, 12, 3.0), (False, 0, 0, 0, 12, 4.0)])
    for part in (first, later):
        list(worker.handleInputRows(("a", 0), iter([part]), None))
    assert handle.held["candles"].calls == 2
    out = pd.concat(worker.handleExpiredTimer(("a", 0), None, None))
    assert out[["signal_id", "close"]].values.tolist() == [[7, 3.0]] and not handle.held["candles"]


def test_a_batch_of_klines_is_several_files(spark, tmp_path, monkeypatch):
    from tidemark.plans import streams

    monkeypatch.setattr(streams, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    one = [(i, T + dt.timedelta(seconds=i), i, "click", float(i), '{"k": 3}') for i in range(120)]
    spark.createDataFrame(one, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["open_time"].minute, r["close"], r["updates"]) for r in streams.stream_kline_upsert(spark, str(tmp_path)).collect()}
    # The last closed message of a minute counts, the one with an even number.
    assert got == {(0, 58.0, 60), (1, 118.0, 60)}
    assert len(list((tmp_path / "kline-parts").glob("part-*"))) > 3


def test_two_scorers_share_a_worker_and_its_texts(spark):
    import pandas as pd

    from tidemark.functions import scorer

    load = lambda: lambda texts: pd.DataFrame({"n": texts.str.len().astype("float64")})
    one = scorer.text_scorer("scale-one", load, {"n": "double"})
    scorer.register(spark, "scale_two", load, {"n": "double"})
    out = spark.createDataFrame([("abc",), (None,)], "text string").select(one("text").alias("a"), F.expr("scale_two(text)").alias("b"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["a"]["n"], r["b"]["n"]) for r in out.collect()] == [(3.0, 3.0), (None, None)]
