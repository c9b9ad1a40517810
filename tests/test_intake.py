"""Missing history, rows of unknown shape, scorers, money, and path labels."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import money, scorer
from tidemark.functions import text as tx
from tidemark.operators import coverage, paths
from tidemark.sources import permissive

T0 = dt.datetime(2024, 1, 1)
at = lambda minutes: T0 + dt.timedelta(minutes=minutes)


def candles(spark, held):
    return spark.createDataFrame([(s, at(m), True) for s, m in held], "symbol string, open_time timestamp_ntz, is_closed boolean")


def test_a_year_long_gap_is_one_run(spark):
    year = 366 * 1440
    held = candles(spark, [("X", 0), ("X", year), ("Y", 5)])
    symbols = spark.createDataFrame([("X",), ("Y",), ("Z",)], "symbol string")
    runs = coverage.gap_runs(held, symbols, T0, at(year + 1))
    got = sorted((r["symbol"], r["first_missing"], r["last_missing"], r["missing"]) for r in runs.collect())
    assert got == [("X", at(1), at(year - 1), year - 1), ("Y", at(0), at(4), 5), ("Y", at(6), at(year), year - 5), ("Z", at(0), at(year), year + 1)]
    assert coverage.missing_bars(runs.where("symbol = 'X'")).agg(F.count(F.lit(1)), F.countDistinct("open_time"), F.min("open_time"), F.max("open_time")).first()[:] == (
        year - 1, year - 1, at(1), at(year - 1))
    told = {r["symbol"]: (r["available"], r["status"], r["runs"]) for r in coverage.coverage(runs, symbols, T0, at(year + 1), 2).collect()}
    assert told == {"X": (2, "ready", 1), "Y": (1, "partial", 2), "Z": (0, "partial", 1)}


def test_runs_over_blocks_doubles_open_and_outside_bars(spark):
    pick = random.Random(4)
    minutes = sorted(pick.sample(range(3000), 1900))
    held = candles(spark, [("X", m) for m in minutes] + [("X", minutes[3]), ("X", -5), ("X", 3005)]).unionByName(
        spark.createDataFrame([("X", at(next(m for m in range(3000) if m not in minutes)), False)], "symbol string, open_time timestamp_ntz, is_closed boolean"))
    runs = coverage.gap_runs(held, held.select("symbol"), T0, at(3000), width_seconds=3600)
    missing = sorted(r["open_time"] for r in coverage.missing_bars(runs).collect())
    assert missing == [at(m) for m in range(3000) if m not in set(minutes)]
    assert coverage.gap_runs(candles(spark, []), candles(spark, []), T0, at(9)).count() == 0


def test_a_fill_inserts_only_what_is_absent(spark):
    held = candles(spark, [("X", 1), ("X", 2)])
    fetched = candles(spark, [("X", m) for m in (0, 1, 2, 3, 3, 9)] + [("Y", 1)])
    got = sorted((r["symbol"], r["open_time"]) for r in coverage.absent_only(fetched, held, T0, at(9)).collect())
    assert got == [("X", at(0)), ("X", at(3)), ("Y", at(1))]


def test_bad_rows_are_kept(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": {"c": [true]}}\n\n  \nnot json\n[1]\n"text"\n{"a": "x"}\n')
    rows = permissive.json_lines(spark, str(tmp_path / "a.jsonl"))
    got = permissive.typed(rows, {"a": ("$.a", "int"), "c": ("$.b.c[0]", "boolean")}).collect()
    assert sorted(map(repr, [(r["a"], r["c"], r["bad_record"]) for r in got])) == sorted(map(repr, [(1, True, None), (None, None, "not json"), (None, None, "[1]"), (None, None, '"text"'), (None, None, None)]))
    for name, text in (("good", ' [{"a": 1},\n {"a": 2}, 7]'), ("half", '[{"a": 3}'), ("object", '{"a": 4}'), ("none", "[]")):
        (tmp_path / f"{name}.json").write_text(text)
    arrays = permissive.json_array(spark, str(tmp_path / "*.json"))
    got = permissive.typed(arrays, {"a": ("$.a", "int")}).collect()
    assert sorted(map(repr, [(r["a"], r["bad_record"]) for r in got])) == sorted(map(repr, [(1, None), (2, None), (None, "7"), (None, '[{"a": 3}'), (None, '{"a": 4}')]))


def test_csv_cells_have_the_type_of_their_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"{""x"": [1, 2]}"\n2,TRUE\n3,{oops\n4,\n5,plain\n6,[1]\n7\n8,a,b\n')
    rows = permissive.csv_cells(spark, str(tmp_path / "a.csv"))
    got = {r["k"]: r for r in rows.select(F.try_variant_get("k", "$", "string").alias("k"), F.schema_of_variant("v").alias("kind"), F.try_variant_get("v", "$.x[1]", "int").alias("x"), "bad_record").collect()}
    assert got["1"]["kind"].startswith("OBJECT") and got["1"]["x"] == 2
    assert [got[k]["kind"] for k in "2356"] == ["BOOLEAN", "STRING", "STRING", "ARRAY<BIGINT>"]
    assert got["4"]["kind"] is None and got["7"]["bad_record"] == "7" and got["8"]["bad_record"] == "8,a,b" and got["1"]["bad_record"] is None


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os

        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda texts: pd.DataFrame({"n": texts.str.len().astype("float64")})

    score = scorer.text_scorer(f"lengths-{log}", load, {"n": "double"})
    rows = spark.range(0, 4000, 1, 16).select(F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("t"))
    for _ in range(3):
        out = rows.select("t", score("t")["n"].alias("n")).collect()
    assert all(r["n"] == (None if r["t"] is None else len(r["t"])) for r in out)
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) <= 8  # far fewer than 3 x 16 tasks
    scorer.register(spark, "text_length", load, {"n": "double"})
    assert spark.sql("SELECT text_length('four').n AS n").first()["n"] == 4.0


def test_a_scorer_with_wrong_answers_is_refused(spark):
    score = scorer.text_scorer("bad", lambda: lambda texts: pd.DataFrame({"m": [1.0] * len(texts)}), {"n": "double"})
    with pytest.raises(Exception, match="scorer bad"):
        spark.range(3).select(score(F.col("id").cast("string"))).collect()


def test_the_default_scorer_is_the_lexicon(spark):
    rows = spark.createDataFrame([("bitcoin rally and adoption after etf approval",), ("exchange hack, funds stolen",), ("",)], "low string")
    ours = scorer.score_news(rows, "low").select("sentiment_score", "risk_score", "impact_score").collect()
    plain = tx.offline_sentiment("low")
    assert ours == rows.select(*[plain[c].alias(c) for c in ("sentiment_score", "risk_score", "impact_score")]).collect()
    first = F.struct(F.lit(0.8).alias("positive"), F.lit(0.1).alias("negative"), F.lit(0.1).alias("neutral"))
    second = F.struct(F.lit(0.2).alias("bullish"), F.lit(0.6).alias("bearish"), F.lit(0.2).alias("neutral"))
    mixed = scorer.score_news(rows, "low", first, second).collect()
    assert [round(r["sentiment_score"], 9) for r in mixed] == [round(0.7 * 0.55 - 0.4 * 0.45, 9)] * 3
    assert [r["risk_score"] for r in mixed] == [0.6, 1.0, 0.6]
    alone = scorer.score_news(rows, "low", first).collect()
    assert [(round(r["sentiment_score"], 9), r["risk_score"]) for r in alone] == [(0.7, 0.1)] * 3


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("quantity, step, want", [("1.239", "0.01", "1.23"), ("0.999", "1", "0"), ("10", "2.5", "10"), ("-1", "1", None), ("1", "0", None)])
def test_quantities_are_rounded_down(spark, quantity, step, want):
    got = one(spark, money.round_down(F.lit(Decimal(quantity)), F.lit(Decimal(step))))
    assert got == (None if want is None else Decimal(want))


def test_money_is_exact(spark):
    lit = lambda v: F.lit(Decimal(v))
    assert one(spark, money.fill_price(lit("100"), F.lit("BUY"), lit("0.001"))) == Decimal("100.1")
    assert one(spark, money.fill_price(lit("100"), F.lit("sell"), lit("0.001"))) == Decimal("99.9")
    assert one(spark, money.fill_price(lit("100"), F.lit("HOLD"), lit("0.001"))) is None
    assert one(spark, money.gross_pnl(F.lit("LONG"), lit("100"), lit("110"), lit("2"))) == one(spark, money.gross_pnl(F.lit("SHORT"), lit("100"), lit("90"), lit("2"))) == Decimal(20)
    assert one(spark, money.amount(F.lit(float("nan")))) is None and one(spark, money.amount(F.lit(1e13))) is None and one(spark, money.amount(F.lit(float("inf")))) is None
    assert one(spark, money.cents(lit("2.005"))) == Decimal("2.01") and one(spark, money.cents(lit("-2.005"))) == Decimal("-2.01")
    cents = spark.range(1000).select(F.sum(money.amount(F.lit(0.1))).alias("s")).first()["s"]
    assert cents == Decimal(100)


def plain_path(decision, bars, minutes, now):
    """The contract bar by bar."""
    t, price, atr, side = decision
    until = t + dt.timedelta(minutes=minutes)
    if until > now:
        return None
    seen = [b for b in bars if t < b[0] <= until]
    s = -1 if side == "SHORT" else 1
    touch, seconds, walked = "none", None, []
    for b in seen:
        walked.append(b)
        bad = b[3] <= price - 1.5 * atr if s == 1 else b[2] >= price + 1.5 * atr
        good = b[2] >= price + 2.5 * atr if s == 1 else b[3] <= price - 2.5 * atr
        if bad or good:
            touch, seconds = "stop" if bad else "target", (b[0] - t).total_seconds()
            break
    if not seen:
        return (0, None, None, None, "none", None)
    high, low = max(b[2] for b in walked), min(b[3] for b in walked)
    up, down = (high / price - 1, low / price - 1) if s == 1 else (1 - low / price, 1 - high / price)
    return (len(seen), s * (seen[-1][1] / price - 1), up, down, touch, seconds)


@pytest.mark.parametrize("width", [86400, 7 * 86400])
def test_path_labels_equal_a_walk_over_the_bars(spark, width):
    rng = np.random.default_rng(6)
    bars, price = {"A": [], "B": []}, 100.0
    for i in range(2500):
        if rng.random() < 0.3:
            continue
        price *= 1 + rng.normal() * 0.002
        spread = abs(rng.normal()) * 0.2
        bars["A" if i % 3 else "B"].append((at(i), price, price + spread, price - spread))
    # One bar that touches both barriers, and a gap without bars.
    bars["B"] = [b for b in bars["B"] if not 900 < (b[0] - T0).total_seconds() / 60 < 1000] + [(at(2600), 100.0, 500.0, 1.0)]
    asked = [(s, at(int(m)), 100.0 + rng.normal(), float(abs(rng.normal()) + 0.1), side) for s in "AB" for m in rng.integers(0, 2600, 60) for side in ("LONG", "SHORT")]
    asked += [("B", at(2595), 100.0, 1.0, "LONG"), ("A", at(5), 0.0, 1.0, "LONG"), ("A", at(5), 100.0, None, "LONG"), ("C", at(5), 100.0, 1.0, "LONG")]
    asked = list({(s, t, side): (s, t, p, a, side) for s, t, p, a, side in asked}.values())
    frame = spark.createDataFrame(asked, "symbol string, as_of timestamp_ntz, price double, atr double, side string").repartition(3)
    held = spark.createDataFrame([(s, *b) for s, rows in bars.items() for b in rows], "symbol string, close_time timestamp_ntz, close double, high double, low double").repartition(3)
    got = {(r["symbol"], r["as_of"], r["side"], r["horizon"]): tuple(r[4:]) for r in paths.path_labels(frame, held, width_seconds=width).collect()}
    want = {}
    for s, t, p, a, side in asked:
        for minutes in paths.HORIZONS:
            made = plain_path((t, p, a, side), bars.get(s, []), minutes, at(2600)) if p and a else None
            if made is not None:
                want[s, t, side, minutes] = made
    assert set(got) == set(want)
    for k, w in want.items():
        n, ret, up, down, touch, seconds = w
        assert got[k][0] == n and got[k][4] == touch
        np.testing.assert_allclose([x if x is not None else -9 for x in (got[k][1], got[k][2], got[k][3], got[k][5])], [x if x is not None else -9 for x in (ret, up, down, seconds)], atol=1e-12)
    assert {w[4] for w in want.values()} == {"none", "stop", "target"}


def test_no_bars_give_no_labels(spark):
    frame = spark.createDataFrame([("A", T0, 1.0, 1.0, "LONG")], "symbol string, as_of timestamp_ntz, price double, atr double, side string")
    none = spark.createDataFrame([], "symbol string, close_time timestamp_ntz, close double, high double, low double")
    assert paths.path_labels(frame, none).count() == 0


@pytest.mark.parametrize("drift, regime", [(0.004, "LONG"), (-0.004, "SHORT"), (0.0, "NEUTRAL")])
def test_regimes_of_trends(spark, drift, regime):
    rows, price = [], 100.0
    for i in range(260):
        price *= 1 + drift
        rows.append(("X", at(60 * i), at(60 * i + 60), price * 1.001, price * 0.999, price))
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, close_time timestamp_ntz, high double, low double, close double")
    last = paths.hourly_regimes(df).orderBy(F.desc("as_of")).first()
    assert last["regime"] == regime and last["as_of"] == rows[-1][2]
    assert paths.hourly_regimes(df).orderBy("as_of").first()["regime"] == "NEUTRAL"
