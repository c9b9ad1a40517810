"""Folds and fits against plain Python and numpy."""

import bisect
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev, fit, folds, independence as ind

START = dt.datetime(2024, 1, 1)


def cohort_rows(n=90, seed=1):
    rng = random.Random(seed)
    out, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 2])  # several rows share a timestamp
        ts = START + dt.timedelta(hours=t)
        out.append((i, ts, ts + dt.timedelta(hours=rng.choice([1, 2, 6]))))
    return out


def plain_walk(rows, train, purge, validation, embargo, test, step, expanding):
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    n = len(order)

    def cohort(b):
        if b <= 0 or b >= n:
            return b
        while b < n and order[b][1] == order[b - 1][1]:
            b += 1
        return b

    out, end = {}, min(n, train)
    number = 0
    while end < n:
        vs = cohort(min(n, end + purge))
        if vs >= n:
            break
        ve = cohort(min(n, vs + validation))
        ts = cohort(min(n, ve + embargo))
        if ts >= n:
            break
        te = cohort(min(n, ts + test))
        begin = 0 if expanding else max(0, end - train)
        for i, r in enumerate(order):
            role = None
            if begin <= i < end:
                role = "purged" if r[2] > order[ts][1] else "train"
            elif end <= i < vs:
                role = "purged"
            elif vs <= i < ve:
                role = "validation"
            elif ve <= i < ts:
                role = "embargoed"
            elif ts <= i < te:
                role = "test"
            if role:
                out[number, r[0]] = role
        number += 1
        following = cohort(min(n, end + step))
        if following <= end:
            break
        end = following
    return out


@pytest.mark.parametrize("expanding", [True, False])
def test_walk_forward_roles_keep_cohorts(spark, expanding):
    rows = cohort_rows()
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, label_end timestamp_ntz")
    plan = folds.walk_forward_folds(df, "ts", train=30, test=9, validation=5, step=10, purge=2, embargo=3, expanding=expanding)
    got = folds.fold_roles(folds.with_positions(df, "ts", "seq"), plan, "label_end").collect()
    want = plain_walk(rows, 30, 2, 5, 3, 9, 10, expanding)
    assert len(plan) >= 3
    assert {(r["fold"], r["seq"]): r["role"] for r in got} == want


def test_no_training_label_reaches_its_test_block(spark):
    df = spark.createDataFrame(cohort_rows(), "seq long, ts timestamp_ntz, label_end timestamp_ntz")
    plan = folds.walk_forward_folds(df, "ts", train=30, test=9, step=10)
    roles = folds.fold_roles(folds.with_positions(df, "ts", "seq"), plan, "label_end")
    first = roles.where("role = 'test'").groupBy("fold").agg(F.min("ts").alias("t"))
    assert roles.where("role = 'train'").join(first, "fold").where("label_end > t").count() == 0


def data(n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3)) * [1.0, 5.0, 0.1] + [0.0, 2.0, 3.0]
    y = 0.65 * x[:, 0] - 0.03 * x[:, 1] + 2.0 * x[:, 2] + rng.normal(0, 0.05, n)
    y[::37] += 8.0
    return x, y


def numpy_fit(x, y, alpha, rounds=0, delta=1.35):
    mean, scale = x.mean(0), x.std(0)
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.eye(4) * alpha
    penalty[0, 0] = 0

    def solve(w):
        return np.linalg.pinv(design.T @ (design * w[:, None]) + penalty) @ design.T @ (w * y)

    beta = solve(np.ones(len(y)))
    for _ in range(rounds):
        r = y - design @ beta
        mad = np.median(np.abs(r - np.median(r)))
        limit = delta * max(1.4826 * mad, r.std() * 0.1, 1e-12)
        beta = solve(np.where(np.abs(r) <= limit, 1.0, limit / np.maximum(np.abs(r), 1e-12)))
    return beta[1:] / scale, beta[0] - mean @ (beta[1:] / scale)


def table(spark, x, y):
    return spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")


def test_ridge_matches_numpy(spark):
    x, y = data()
    model = fit.fit_ridge(table(spark, x, y), ["a", "b", "c"], "y", 2.5)
    coef, intercept = numpy_fit(x, y, 2.5)
    np.testing.assert_allclose(model.coefficients, coef, atol=1e-9)
    assert abs(model.intercept - intercept) < 1e-8


def test_huber_matches_numpy(spark):
    x, y = data()
    model = fit.fit_huber(table(spark, x, y), ["a", "b", "c"], "y", 1.0, rounds=3)
    coef, intercept = numpy_fit(x, y, 1.0, rounds=3)
    np.testing.assert_allclose(model.coefficients, coef, atol=1e-7)
    assert abs(model.intercept - intercept) < 1e-6


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_gram_equals_sql_sums_and_numpy(spark, parts):
    """Nulls and NaN leave a row out; a null group is a group; the partitioning is of no account."""
    x, y = data(100)
    rows = [(*map(float, a), float(t), i % 3 if i % 10 else None, 1.0 + i % 4) for i, (a, t) in enumerate(zip(x, y))]
    rows += [(None, 1.0, 1.0, 1.0, 0, 1.0), (1.0, float("nan"), 1.0, 1.0, 1, 1.0), (1.0, 1.0, 1.0, None, None, 1.0), (1.0, 1.0, 1.0, 1.0, 2, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, g int, w double").repartition(parts)
    got = fit.gram(df, ["a", "b", "c"], "y", "g", "w")
    assert set(got) == {0, 1, 2, None}
    clean = df.where("a IS NOT NULL AND NOT isnan(b) AND y IS NOT NULL AND w IS NOT NULL")
    names = ["1", "a", "b", "c", "y"]
    sums = clean.groupBy("g").agg(*[F.expr(f"sum(w * {p} * {q})").alias(f"{i}_{j}") for i, p in enumerate(names) for j, q in enumerate(names)])
    for r in sums.collect():
        np.testing.assert_allclose(got[r["g"]], [[r[f"{i}_{j}"] for j in range(5)] for i in range(5)], atol=1e-9)
        held = [q for q in rows[:100] if q[4] == r["g"]]
        design = np.array([[1.0, *q[:4]] for q in held])
        np.testing.assert_allclose(got[r["g"]], design.T @ (design * np.array([q[5] for q in held])[:, None]), atol=1e-9)


def test_ruin_keeps_equity_at_zero(spark):
    obs = [("s", START + dt.timedelta(hours=i), i, 1.0, r, None, 0.0, None) for i, r in enumerate([0.1, -1.5, 0.5])]
    df = spark.createDataFrame(obs, "k string, timestamp timestamp_ntz, seq long, prediction double, actual_return double, position double, transaction_cost double, holding_seconds double")
    row = ev.evaluate(df, ["k"]).first()
    assert row["total_return"] == -1.0 and row["maximum_drawdown"] == 1.0


def test_undefined_metrics_are_null(spark):
    obs = [("s", START, 0, 1.0, 0.1, None, 0.0, None)]
    df = spark.createDataFrame(obs, "k string, timestamp timestamp_ntz, seq long, prediction double, actual_return double, position double, transaction_cost double, holding_seconds double")
    row = ev.evaluate(df, ["k"]).first()
    assert row["sharpe_ratio"] is None and row["information_coefficient"] is None and row["profit_factor"] is None
    assert row["average_holding_time_seconds"] == 1.0 and row["annualization_factor"] == 1.0


def test_components_of_a_long_chain(spark):
    nodes = spark.range(40).select(F.format_string("n%02d", "id").alias("node"))
    edges = spark.range(30).select(F.format_string("n%02d", "id").alias("a"), F.format_string("n%02d", F.col("id") + 1).alias("b"))
    got = {r["node"]: r["label"] for r in ind.connected_groups(nodes, edges).collect()}
    assert {got[f"n{i:02d}"] for i in range(31)} == {"n00"}
    assert all(got[f"n{i:02d}"] == f"n{i:02d}" for i in range(31, 40))


def sparse_times(n=3000, seed=5):
    """Minutes with ties, closed nights and a long gap."""
    rng, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 0, 1, 2, 7]) + (600 if rng.random() < 0.02 else 0) + (20_000 if i == n // 2 else 0)
        out.append(at)
    return out


def plain_duration_walk(times, train, purge, validation, embargo, test, step):
    """The walk by durations (in minutes) over sorted times, as positions."""
    n = len(times)

    def skip(start, window):
        if not window or start >= n:
            return min(start, n)
        return max(start, bisect.bisect_left(times, times[start] + window))

    def end(p):
        return p if p <= 0 or p >= n else bisect.bisect_right(times, times[p - 1])

    out, train_end = [], skip(0, train)
    while 0 < train_end < n:
        vs = end(skip(train_end, purge))
        ve = end(skip(vs, validation))
        ts = end(skip(ve, embargo))
        if vs >= n or ts >= n:
            break
        out.append((train_end, vs, ve, ts, end(skip(ts, test)), times[ts]))
        train_end = end(skip(train_end, step))
    return out


@pytest.mark.parametrize("small_pages", [False, True])
def test_a_walk_of_many_folds_is_planned_in_few_jobs(spark, monkeypatch, small_pages):
    if small_pages:
        monkeypatch.setattr(folds.Timeline, "LEAST", 64)
        monkeypatch.setattr(folds.Timeline, "ROUND", 8)
    times = sparse_times()
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(minutes=m),) for m in times], "ts timestamp_ntz")
    minutes = lambda m: dt.timedelta(minutes=m)
    context = spark.sparkContext
    context.setJobGroup("walk", "walk")
    try:
        plan = folds.walk_forward_folds(
            df, "ts", train=minutes(2000), test=minutes(400), validation=minutes(150), step=minutes(400), purge=minutes(30), embargo=minutes(20)
        )
        jobs = len(context.statusTracker().getJobIdsForGroup("walk"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    want = plain_duration_walk(times, 2000, 30, 150, 20, 400, 400)
    zero = int(start.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    got = [(f.train_end, f.validation_start, f.validation_end, f.test_start, f.test_end, (f.test_time - zero) // 60_000_000) for f in plan]
    assert len(want) > 50 and got == want
    assert small_pages or jobs < 40


def test_candidates_are_scored_by_the_folds_whose_test_covers_a_row(spark):
    rng = np.random.default_rng(4)
    n = 300
    x, y = rng.normal(0, 1, n), rng.normal(0, 1, n)
    rows = spark.createDataFrame(
        [(i, float(x[i]) if i % 50 else None, float(y[i]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i + 5) if i % 7 else None) for i in range(n)],
        "pos long, x double, target double, label_end timestamp_ntz",
    )
    at = lambda p: 1_704_067_200_000_000 + p * 60_000_000
    plan = [folds.Fold(k, max(0, 20 * k - 40), 100 + 20 * k, 100 + 20 * k, 100 + 20 * k, 102 + 20 * k, 152 + 20 * k, at(102 + 20 * k)) for k in range(7)]
    grid, _ = fit.candidate_grid({"a": ["x"]}, ["x"], alphas=[1.0])
    scored = fit.score_candidates(rows, plan, grid, "target", "label_end")
    assert "lambda" not in scored._jdf.queryExecution().toString()
    got = {(r["fold"], r["pos"]): r["prediction"] for r in scored.collect()}
    filled = np.where(np.arange(n) % 50 == 0, 0.0, x)
    want = {}
    for f in plan:
        train = [p for p in range(f.train_start, f.train_end) if p % 7 == 0 or at(p + 5) <= f.test_time]
        mean, scale = filled[train].mean(), filled[train].std()
        z = (filled[train] - mean) / scale
        slope = (z * (y[train] - y[train].mean())).sum() / (len(train) + 1.0)
        for p in range(f.test_start, min(n, f.test_end)):
            want[f.number, p] = y[train].mean() + slope * (filled[p] - mean) / scale
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
