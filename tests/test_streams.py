"""Streams over a table that is a folder of part files, over one file, and over nothing."""

import shutil

from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.streaming import flows

SF = "/root/testdata/sf0.001"


def test_folder_and_file_give_the_same_bars(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/folder/events.parquet")
    (tmp_path / "file").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "file" / "events.parquet")
    bars = [sorted(map(tuple, catalog.run("stream_tumbling_bars", spark, f"{tmp_path}/{kind}").collect())) for kind in ("folder", "file")]
    assert bars[0] == bars[1] and bars[0]


def test_no_input_gives_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    stream = flows.read_events(spark, str(tmp_path)).select("event_id", F.col("event_type").alias("source"))
    assert flows.drain(stream, "append", [], "none").count() == 0


def _ticks(spark, path, batches):
    """Files that a stream takes one by one, in this order."""
    import time

    for rows in batches:
        frame = spark.createDataFrame(rows, "kind string, id long, at timestamp, close double").coalesce(1)
        frame.write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by their age


def _labels(spark, path, state, out):
    from tidemark.streaming import maturity

    source = lambda: spark.readStream.schema("kind string, id long, at timestamp, close double").option("maxFilesPerTrigger", 1).parquet(path)
    signals = source().where("kind = 's'").select(F.col("id").alias("signal_id"), F.lit("X").alias("symbol"), F.col("at").alias("generated_at"))
    candles = source().where("kind = 'c'").select(F.lit("X").alias("symbol"), F.col("at").alias("close_time"), "close")
    made = maturity.matured_labels(signals, candles, "1 hour", "10 minutes", "5 minutes")
    save = lambda batch, number: flows.save_batch(out, batch, number)
    made.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return sorted((r["signal_id"], r["close"]) for r in spark.read.parquet(out).collect())


def test_first_candle_once_over_batches_late_rows_and_a_restart(spark, tmp_path):
    import datetime as dt

    from tidemark.streaming import maturity

    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    m = lambda minutes: start + dt.timedelta(minutes=minutes)
    path, state, out = (f"{tmp_path}/{n}" for n in ("in", "state", "out"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", maturity.STATE_STORE)
    try:
        _ticks(spark, path, [
            [("s", 1, m(0), None), ("s", 2, m(4), None), ("s", 3, m(30), None), ("c", 0, m(59), 59.0)],
            [("c", 0, m(66), 66.0), ("c", 0, m(62), 62.0)],  # 62 comes after 66, but is the first for signal 1
            [("c", 0, m(86), 86.0), ("s", 4, m(80), None)],
        ])
        first = _labels(spark, path, state, out)
        assert first == [(1, 62.0), (2, 66.0)]
        # A candle far behind the watermark comes too late; signal 3 has none in its ten minutes; signal 4 gets the earlier of two.
        _ticks(spark, path, [[("c", 0, m(61), 61.0), ("c", 0, m(141), 141.0), ("c", 0, m(140), 140.0)], [("c", 0, m(200), 200.0)]])
        again = _labels(spark, path, state, out)
        assert again == [(1, 62.0), (2, 66.0), (4, 140.0)]
        assert _labels(spark, path, state, out) == again
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_klines_merge_over_restarts_and_replays(spark, tmp_path):
    import datetime as dt

    from tidemark.operators import daytable

    t = dt.datetime(2024, 1, 1, 23, 59, tzinfo=dt.timezone.utc)
    schema = "symbol string, interval string, open_time timestamp, event_time timestamp, close double, is_closed boolean"
    bar = lambda k, e, close, closed: ("X", "1m", t + dt.timedelta(minutes=k), t + dt.timedelta(minutes=k, seconds=e), close, closed)
    path, state, base = (f"{tmp_path}/{n}" for n in ("in", "state", "table"))
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    write([bar(0, 10, 1.0, False), bar(0, 60, 2.0, True), bar(1, 5, 3.0, False)])
    flows.run_merge(stream(), base, state, "open_time", flows.upsert_klines)
    write([bar(0, 50, 9.0, False), bar(1, 30, 4.0, False)])
    flows.run_merge(stream(), base, state, "open_time", flows.upsert_klines)
    flows.run_merge(stream(), base, state, "open_time", flows.upsert_klines)
    got = lambda: sorted((r["close"], r["is_closed"], r["updates"]) for r in daytable.current(spark, base).collect())
    assert got() == [(2.0, True, 3), (4.0, False, 2)]
    batch = spark.createDataFrame([bar(0, 50, 9.0, False), bar(1, 30, 4.0, False)], schema)
    daytable.merge_batch(base, "open_time", flows.upsert_klines, batch, 1)  # delivered once more
    assert got() == [(2.0, True, 3), (4.0, False, 2)]


def test_a_repeated_batch_doubles_nothing(spark, tmp_path):
    for _ in range(2):
        flows.save_batch(str(tmp_path), spark.range(5).toDF("id"), 3)
    assert spark.read.parquet(str(tmp_path)).count() == 5
