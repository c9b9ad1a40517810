"""Day tables, bundles, the cursor, and the lake scan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bundles, cursor, daytable

DAY = dt.datetime(2024, 3, 1)


def rows(spark, hours, value=1.0):
    data = [(h, DAY + dt.timedelta(hours=h), value) for h in hours]
    return spark.createDataFrame(data, "id int, event_time timestamp_ntz, v double")


def ids(df):
    return sorted(r["id"] for r in df.collect()) if df is not None else []


def keep(batch, held):
    return batch if held is None else held.join(batch.select("id"), "id", "left_anti").unionByName(batch)


def test_a_write_that_comes_again_changes_nothing(spark, tmp_path):
    base = str(tmp_path)
    assert daytable.current(spark, base) is None
    daytable.merge_batch(base, "event_time", keep, rows(spark, range(0, 30)), 0)
    for _ in range(2):
        assert daytable.merge_batch(base, "event_time", keep, rows(spark, range(20, 50), 2.0), 1) == ["2024-03-01", "2024-03-02", "2024-03-03"]
    out = daytable.current(spark, base)
    assert ids(out) == list(range(50)) and out.where("v = 2").count() == 30
    # The first write again, late: later ones still count.
    daytable.merge_batch(base, "event_time", keep, rows(spark, range(0, 30)), 0)
    assert daytable.current(spark, base).where("v = 2").count() == 30
    assert ids(daytable.current(spark, base, before=1)) == list(range(30))


def test_a_write_without_its_list_of_days_does_not_count(spark, tmp_path):
    base = str(tmp_path)
    daytable.merge_batch(base, "event_time", keep, rows(spark, range(5)), 0)
    daytable.merge_batch(base, "event_time", keep, rows(spark, range(5, 9)), 1)
    (tmp_path / "batch=1" / "_days").rename(tmp_path / "elsewhere")
    assert ids(daytable.current(spark, base)) == list(range(5))
    daytable.merge_batch(base, "event_time", keep, rows(spark, range(5, 9)), 1)
    assert ids(daytable.current(spark, base)) == list(range(9))


def test_days_can_go(spark, tmp_path):
    base = str(tmp_path)
    daytable.write_days(base, "event_time", rows(spark, range(0, 48)), ["2024-03-01", "2024-03-02"], 1)
    daytable.write_days(base, "event_time", rows(spark, []), ["2024-03-02"], 2)
    assert ids(daytable.current(spark, base)) == list(range(24))


def test_half_days_written_twice_give_whole_days(spark, tmp_path):
    table = bundles.Table(rows(spark, range(0, 72)), ("id",))
    base, today = str(tmp_path), dt.date(2024, 3, 3)
    hour = lambda h: DAY + dt.timedelta(hours=h)
    for a, b in ((0, 36), (30, 60), (0, 36)):
        told = bundles.write_bundle(spark, base, {"t": table, "timeless": bundles.Table(spark.range(3), ("id",))}, hour(a), hour(b), today)
    facts = {(r["table_name"], str(r["day"])): r for r in told.collect()}
    assert {k: r["rows"] for k, r in facts.items()} == {("t", "2024-03-01"): 24, ("t", "2024-03-02"): 24, ("t", "2024-03-03"): 12}
    assert facts["t", "2024-03-03"]["status"] == "unfinished" and facts["t", "2024-03-01"]["status"] == "finished"
    assert facts["t", "2024-03-02"]["first_time"] == hour(24) and facts["t", "2024-03-02"]["last_time"] == hour(47)
    assert ids(bundles.read_table(spark, base, "t")) == list(range(60))


def test_only_finished_days(spark, tmp_path):
    table = bundles.Table(rows(spark, range(0, 72)), ("id",))
    told = bundles.write_bundle(spark, str(tmp_path), {"t": table}, DAY, DAY + dt.timedelta(days=3), dt.date(2024, 3, 2), include_unfinished=False)
    assert [(r["rows"], r["status"]) for r in told.collect()] == [(24, "finished")]


def test_slices_leave_out_the_cache_and_open_candles(spark):
    data = [(i, DAY + dt.timedelta(hours=i), s, c) for i, (s, c) in enumerate([("feed", True), (bundles.CACHE_SOURCE, True), (None, True), ("feed", False), ("feed", None)])]
    df = spark.createDataFrame(data, "id int, open_time timestamp_ntz, source_name string, is_closed boolean")
    assert bundles.first_time_column(df.columns) == "open_time" and bundles.first_time_column(["created_at", "event_time"]) == "event_time"
    assert bundles.first_time_column(["x"]) is None
    assert ids(bundles.table_slice(df, "open_time", DAY, DAY + dt.timedelta(hours=9))) == [0, 2]
    assert bundles.bounds({"a": bundles.Table(df, ("id",)), "b": bundles.Table(spark.range(1), ("id",))}) == (DAY, DAY + dt.timedelta(hours=4))


def test_lake_scan_prunes_folders_and_tells_the_file(spark, tmp_path):
    for name in ("t", "u"):
        rows(spark, range(0, 96)).withColumn("day", F.to_date("event_time")).withColumn("table", F.lit(name)).write.mode("append").partitionBy("table", "day").parquet(str(tmp_path))
    found = bundles.scan_lake(spark, str(tmp_path), "t", dt.date(2024, 3, 2), dt.date(2024, 3, 3))
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "table" in filters and "day" in filters and ">= 2024-03-02" in filters
    assert ids(found) == list(range(24, 72))
    assert all("/table=t/day=2024-03-0" in r["file"] and r["file_row"] >= 0 for r in found.collect())
    rows(spark, range(0, 48)).withColumn("day", F.to_date("event_time")).withColumn("table", F.lit("t")).write.partitionBy("table", "day").json(f"{tmp_path}/json", compression="gzip")
    lines = bundles.scan_lake(spark, f"{tmp_path}/json", "t", dt.date(2024, 3, 2), dt.date(2024, 3, 2), "id int, event_time timestamp_ntz, v double", "json")
    assert ids(lines) == list(range(24, 48)) and lines.where("file LIKE '%.json.gz'").count() == 24


def build(source):
    """Each row with the value two days later: depends on days ahead."""
    later = source.select(F.col("id").alias("i2"), F.col("v").alias("later"))
    return source.join(later, F.col("i2") == F.col("id") + 48, "left").drop("i2")


def run(source, base, version="v1"):
    return cursor.rebuild(source, "event_time", base, build, "event_time", before=0, after=2, dataset_version=version, feature_version="f", label_time="event_time")


def test_rebuild_touches_changed_days_and_their_halo(spark, tmp_path):
    base = str(tmp_path)
    whole = rows(spark, range(0, 240))
    days, n = run(whole, base)
    assert (len(days), n) == (12, 240)
    assert run(whole, base) == ([], 0)
    at, state = cursor.Cursor(spark, f"{base}/cursor").read()
    assert at == 1 and state.total_rows == 240 and cursor.new_rows(state, state) == 0
    other = whole.withColumn("v", F.when(F.col("id") == 130, 9.0).otherwise(F.col("v")))
    days, n = run(other, base)
    assert [str(d) for d in days] == ["2024-03-04", "2024-03-05", "2024-03-06"] and n == 72
    same = lambda df: sorted(map(tuple, df.select("id", "v", "later").collect()), key=repr)
    assert same(daytable.current(spark, f"{base}/rows")) == same(build(other))
    shorter = other.where("id < 200")  # a day goes, another loses rows
    run(shorter, base)
    assert same(daytable.current(spark, f"{base}/rows")) == same(build(shorter))
    assert run(shorter, base, "v2")[1] == 200


def test_two_runs_cannot_both_move_the_cursor(spark, tmp_path):
    c = cursor.Cursor(spark, str(tmp_path))
    first = cursor.Snapshot("v1", "f", 5)
    assert c.read() == (0, None) and c.commit(first, 0) == 1
    with pytest.raises(cursor.Conflict):
        c.commit(first, 0)
    (tmp_path / "state-2.json").write_text("{half")
    assert c.read() == (1, first)
    assert c.commit(cursor.Snapshot("v1", "f", 9), 1) == 3 and c.read()[1].total_rows == 9
    assert cursor.new_rows(cursor.Snapshot("v2", "f", 4), first) == 4 and cursor.new_rows(cursor.Snapshot("v1", "f", 4), first) == 0
    with pytest.raises(ValueError):
        cursor.Snapshot(" ", "f", 1)
