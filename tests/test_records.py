"""Stored records: feeds, observation files, windows, gates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, records as rc

T0 = dt.datetime(2024, 1, 1)


def test_atom_links(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed><entry><title> A  b </title><link rel="self" href="s"/><link href="https://x/1"/><updated>2024-01-02T03:04:05Z</updated><summary>sum</summary></entry>'
        "<entry><title>C</title><id>urn:2</id></entry><entry><title> </title><id>urn:3</id></entry><entry><title>D</title></entry></feed>"
    )
    got = sorted((r["title"], r["url"], r["raw_text"], r["published_at"] is None) for r in rc.read_atom(spark, str(tmp_path)).collect())
    assert got == [("A b", "https://x/1", " A  b  sum", False), ("C", "urn:2", "C", True)] or got == [("A b", "https://x/1", "A  b sum", False), ("C", "urn:2", "C", True)]


def test_other_observations_are_refused(spark, tmp_path):
    path = str(tmp_path / "oos")
    rows = spark.createDataFrame([(1, 0.5, None), (2, float("inf"), "x"), (2, float("inf"), "x")], "id int, v double, t string")
    assert rc.write_observations(rows, path)["rows"] == 3
    before = sorted(p.name for p in (tmp_path / "oos").iterdir())
    rc.write_observations(rows.repartition(3), path)
    assert sorted(p.name for p in (tmp_path / "oos").iterdir()) == before
    other = rows.withColumn("v", F.when(F.col("id") == 1, 0.6).otherwise(F.col("v")))
    with pytest.raises(FileExistsError):
        rc.write_observations(other, path)
    rc.write_observations(other, path, overwrite=True)
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ['{"id":1,"t":null,"v":0.6}'] + ['{"id":2,"t":"x","v":null}'] * 2


def test_overlapping_windows_give_each_article_once(spark):
    rows = [(1, 0, "u1", "a", T0), (2, 0, "u1", "b", T0), (1, 1, "", "t", T0), (2, 5, None, "t", T0), (2, 6, "", "t", T0 + dt.timedelta(hours=1)), (1, 2, " ", None, T0), (2, 9, "u2", None, T0)]
    found = rc.window_articles(spark.createDataFrame(rows, "window int, place int, url string, title string, published_at timestamp_ntz")).collect()
    assert sorted((r["window"], r["place"]) for r in found) == [(1, 0), (1, 1), (2, 6), (2, 9)]
    assert len({r["article_id"] for r in found}) == 4


def test_gate_and_advice(spark):
    good = ("good", 0.1, 100, 0.1, 1.5, 0.5, 3, 500, 80_000, 10.0)
    busy = ("busy", 0.2, 400, 0.1, None, 0.5, 3, 500, 80_000, 2.0)
    schema = "candidate string, net_return_after_fees double, number_of_trades int, max_drawdown double, profit_factor double, simulated_win_rate double, longest_losing_streak int, test_rows int, labeled_rows int, dataset_days double"
    got = {r["candidate"]: r for r in rc.gate(spark.createDataFrame([good, busy], schema)).collect()}
    assert got["good"]["passed"] and got["good"]["score"] == 100.0 and got["good"]["readiness"] == "B"
    assert got["busy"]["failures"] == ["profit_factor_too_low"] and abs(got["busy"]["score"] - (500 / 6 - 10)) < 1e-9
    tell = lambda rows: rc.advice(rc.gate(spark.createDataFrame(rows, schema)), F.col("dataset_days")).first()["advice"]
    assert tell([good, busy]) == []
    assert tell([busy]) == ["NO_CANDIDATE_PASSED", "COLLECT_MORE_DAYS", "BEST_FAILED:profit_factor_too_low", "TRADES_TOO_OFTEN"]


def test_registries_in_one_layout(spark):
    a = spark.createDataFrame([(7, "BTC", T0)], "candidate_id int, symbol string, observed_at timestamp_ntz")
    b = spark.createDataFrame([("x", True, None)], "id string, approved boolean, created_at timestamp_ntz")
    got = {r["record_type"]: r for r in rc.research_records({"a": a, "b": b, "none": b.limit(0)}).collect()}
    assert set(got) == {"a", "b"} and got["a"]["id"] == got["a"]["candidate_id"] == "7" and got["a"]["created_at"] == T0 and got["b"]["approved"] is True


def test_row_texts_tell_nulls_and_separators_apart(spark):
    facts = lambda rows: quality.manifest_facts({"t": (spark.createDataFrame(rows, "a string, b string, at timestamp_ntz"), "at", None, ["a", "b"])}).first()["content_hash"]
    hashes = [facts([(a, b, T0)]) for a, b in ((None, ""), ("", None), ("", ""), ("x|y", "z"), ("x", "y|z"), ("x\\", "|z"), ("x", "|z"), ("\\N", ""))]
    assert len(set(hashes)) == len(hashes)
    assert facts([("1", "2", T0), ("3", "4", T0)]) == facts([("3", "4", T0), ("1", "2", T0)])


def test_continuity(spark):
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("X", i, minute(m)) for i, m in enumerate([0, 1, 1, 4, 3, 5])] + [("Y", 0, minute(0))]
    got = quality.continuity(spark.createDataFrame(rows, "symbol string, seq int, open_time timestamp_ntz"), "seq", 60).collect()
    assert [tuple(r) for r in got] == [("X", 2, 2, 3)]
