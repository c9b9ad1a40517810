"""Block-wise primitives against plain folds over the same rows."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Window as W, functions as F

from tidemark.operators import asof, indicators, series
from tidemark.operators.ranks import average_rank, ks_distance, quantiles, value_ranks
from tidemark.operators.recurrence import linear_scan

START = dt.datetime(2024, 1, 1)


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out, t = [], {"A": 0, "B": 0}
    for i in range(n):
        key = "A" if rng.random() < 0.8 else "B"  # one key holds most rows
        t[key] += rng.choice([0, 1, 1, 7, 90])
        out.append((key, START + dt.timedelta(minutes=t[key]), i, round(rng.uniform(-1, 1), 3)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "k string, ts timestamp_ntz, seq long, x double")


def ordered(data):
    return {k: sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2])) for k in {r[0] for r in data}}


def test_positions_and_running_match_a_fold(spark):
    data = rows()
    blocks = series.range_blocks(frame(spark, data), ["k"], ["ts", "seq"])
    got = series.running(
        series.positions(blocks, ["k"], ["ts", "seq"]), ["k"], ["ts", "seq"], {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}
    ).collect()
    assert blocks.select(series.BLOCK).distinct().count() > 2
    want = {}
    for k, part in ordered(data).items():
        total, top = 0.0, -math.inf
        for pos, r in enumerate(part):
            total, top = total + r[3], max(top, r[3])
            want[r[2]] = (pos, total, top)
    assert len(got) == len(data)
    for r in got:
        pos, total, top = want[r["seq"]]
        assert r["pos"] == pos and math.isclose(r["s"], total, abs_tol=1e-9) and r["m"] == top


def test_lag_and_last_cross_block_borders(spark):
    data = rows()
    blocks = series.range_blocks(frame(spark, data), ["k"], ["ts", "seq"])
    lagged = series.lag_across(blocks, ["k"], ["ts", "seq"], {"before": F.col("x")})
    last = series.running_last(
        series.range_blocks(frame(spark, data), ["k"], ["ts", "seq"]), ["k"], [F.col("ts"), F.col("seq")], F.when(F.col("x") > 0.5, F.col("x")), "big"
    )
    before = {r["seq"]: r["before"] for r in lagged.collect()}
    big = {r["seq"]: r["big"] for r in last.collect()}
    for part in ordered(data).values():
        seen = None
        for i, r in enumerate(part):
            assert before[r[2]] == (part[i - 1][3] if i else None)
            seen = r[3] if r[3] > 0.5 else seen
            assert big[r[2]] == seen


def test_linear_scan_equals_the_naive_fold(spark):
    data = [(k, t, s, x, 0.0 if s % 13 == 0 else 0.7) for k, t, s, x in rows()]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, seq long, x double, a double")
    got = {r["seq"]: r["y"] for r in linear_scan(series.range_blocks(df, ["k"], ["ts", "seq"]), ["k"], ["ts", "seq"], "a", "x", "y").collect()}
    for part in ordered(data).values():
        y = 0.0
        for r in part:
            y = r[4] * y + r[3]
            assert math.isclose(got[r[2]], y, abs_tol=1e-12)


def brute_asof(left, right, direction, exact=True, tolerance=None):
    out = {}
    for k, t, s, _ in left:
        back = [r for r in right if r[0] == k and (r[1] <= t if exact else r[1] < t)]
        fwd = [r for r in right if r[0] == k and (r[1] >= t if exact else r[1] > t)]
        b = max(back, key=lambda r: (r[1], r[2]), default=None)
        f = min(fwd, key=lambda r: (r[1], -r[2]), default=None)
        f = max((r for r in fwd if r[1] == f[1]), key=lambda r: r[2]) if f and False else (min(fwd, key=lambda r: (r[1], r[2])) if fwd else None)
        if direction == "nearest":
            pick = b if f is None or (b is not None and t - b[1] <= f[1] - t) else f
        else:
            pick = b if direction == "backward" else f
        if pick is not None and tolerance is not None and abs(pick[1] - t) > tolerance:
            pick = None
        out[s] = pick[2] if pick else None
    return out


def test_asof_directions_ties_and_tolerance(spark):
    data = rows(240)
    left, right = data[::2], data[1::2]
    l, r = frame(spark, left), frame(spark, right).withColumnRenamed("seq", "rid")
    for width in (None, 3600):
        for direction in ("backward", "forward", "nearest"):
            got = asof.asof_join(l, r, ["k"], "ts", "ts", {"rid": "rid"}, direction=direction, tie=["rid"], width_seconds=width,
                                 tolerance_seconds=1800 if direction == "nearest" else None)
            want = brute_asof(left, right, direction, tolerance=dt.timedelta(seconds=1800) if direction == "nearest" else None)
            assert {x["seq"]: x["rid"] for x in got.collect()} == want, (direction, width)
    strict = asof.asof_join(l, r, ["k"], "ts", "ts", {"rid": "rid"}, allow_exact=False, tie=["rid"])
    assert {x["seq"]: x["rid"] for x in strict.collect()} == brute_asof(left, right, "backward", exact=False)


def test_interval_sums_include_both_ends(spark):
    data = rows(300)
    left, right = data[::3], data
    got = asof.interval_sums(
        frame(spark, left), frame(spark, right).select("k", "ts", F.col("x").alias("v")), ["k"], "ts", "ts", 1800, {"n": F.lit(1), "s": F.col("v")},
        {"d": F.col("v")}, tau_seconds=600.0,
    ).collect()
    assert len(got) == len(left)
    for r in got:
        inside = [x for x in right if x[0] == r["k"] and r["ts"] - dt.timedelta(seconds=1800) <= x[1] <= r["ts"]]
        assert round(r["n"]) == len(inside)
        assert math.isclose(r["s"], sum(x[3] for x in inside), abs_tol=1e-9)
        decayed = sum(x[3] * math.exp(-(r["ts"] - x[1]).total_seconds() / 600.0) for x in inside)
        assert math.isclose(r["d"], decayed, abs_tol=1e-9)


def test_ranks_quantiles_and_ks(spark):
    data = rows(300)
    df = frame(spark, data).withColumn("x", F.round("x", 1))
    ranked = value_ranks(df, ["k"], "x")
    got = {(r["k"], r["x"]): r["r"] for r in ranked.select("k", "x", average_rank().alias("r")).collect()}
    pdf = df.toPandas()
    pdf["r"] = pdf.groupby("k")["x"].rank()
    assert all(math.isclose(got[k, x], r) for k, x, r in zip(pdf.k, pdf.x, pdf.r))
    q = {r["k"]: r["p"] for r in quantiles(ranked, ["k"], "x", {"p": 0.3}).collect()}
    for k, part in pdf.groupby("k"):
        assert math.isclose(q[k], np.quantile(part.x, 0.3), abs_tol=1e-12)
    ks = {r["k"]: r["ks_distance"] for r in ks_distance(df, ["k"], "x", F.col("seq") < 150).collect()}
    for k, part in pdf.groupby("k"):
        a, b = part[part.seq < 150].x, part[part.seq >= 150].x
        assert math.isclose(ks[k], max(abs((a <= v).mean() - (b <= v).mean()) for v in part.x), abs_tol=1e-12)


def test_exponential_mean_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    n = 5000
    close = np.cumsum(rng.normal(0, 1, n)) + 200
    data = [("A", START + dt.timedelta(minutes=i), START + dt.timedelta(minutes=i, seconds=59), float(c), float(c) + 1, float(c) - 1, 1.0 + i % 7) for i, c in enumerate(close)]
    candles = spark.createDataFrame(data, "symbol string, open_time timestamp_ntz, close_time timestamp_ntz, close double, high double, low double, volume double")
    got = indicators.offline_features(candles).orderBy("pos").toPandas()
    assert len(got) == n
    c = pd.Series(close)
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    signal = macd.ewm(span=9, adjust=False).mean()
    np.testing.assert_allclose(got.macd_pct, macd / c, atol=1e-12)
    np.testing.assert_allclose(got.macd_signal_pct, signal / c, atol=1e-12)
    np.testing.assert_allclose(got.ema_20_distance_pct, c / c.ewm(span=20, adjust=False).mean() - 1, atol=1e-12)
    np.testing.assert_allclose(got.volatility, c.pct_change().rolling(20, min_periods=2).std().fillna(0), atol=1e-12)


def test_left_rows_without_time_or_key_stay(spark):
    left = spark.createDataFrame(
        [("A", START, 1), (None, START, 2), ("A", None, 3), ("B", START, 4)], "k string, ts timestamp_ntz, seq long"
    )
    right = spark.createDataFrame([("A", START, 0.5), (None, START, 0.7)], "k string, at timestamp_ntz, x double")
    got = asof.asof_join(left, right, ["k"], "ts", "at", {"found": "x"}, matched_time="seen").collect()
    assert sorted((r["seq"], r["found"]) for r in got) == [(1, 0.5), (2, None), (3, None), (4, None)]


def test_null_keys_are_a_series_of_their_own(spark):
    data = [(None if r[0] == "B" else r[0], *r[1:]) for r in rows(120)]
    blocks = series.range_blocks(frame(spark, data), ["k"], ["ts", "seq"])
    got = series.running(series.positions(blocks, ["k"], ["ts", "seq"]), ["k"], ["ts", "seq"], {"n": ("count", F.col("x"))}).collect()
    assert len(got) == 120 and all(r["n"] == r["pos"] + 1 for r in got)
