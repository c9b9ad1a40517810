"""Fold callbacks and tree ensembles against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fit, foldfit, folds, trees

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def placed(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a, b = rng.normal(size=2)
        ts = START + dt.timedelta(hours=i)
        rows.append((i, ts, ts + dt.timedelta(hours=int(rng.integers(1, 12))), float(a), float(b), float(2 * a - b + rng.normal() * 0.1)))
    df = spark.createDataFrame(rows, "seq long, timestamp timestamp_ntz, known timestamp_ntz, a double, b double, y double")
    plan = folds.walk_forward_folds(df, "timestamp", train=dt.timedelta(days=5), test=dt.timedelta(days=3), validation=dt.timedelta(days=1))
    return folds.with_positions(df, "timestamp", "seq"), plan, rows


def test_estimator_scores_equal_numpy_per_fold(placed):
    table, plan, rows = placed
    assert len(plan) >= 3
    scores = foldfit.out_of_fold(table, plan, "known", estimator=lambda: foldfit.Ridge(("a", "b"), "y", 2.0), workers=3)
    got = {(r["fold"], r["seq"]): r["prediction"] for r in scores.collect()}
    data = np.array([[r[3], r[4], r[5]] for r in rows])
    expected = 0
    for f in plan:
        ends = START + dt.timedelta(hours=f.test_start)
        train = [i for i in range(f.train_start, f.train_end) if rows[i][2] <= ends]
        x, y = data[train, :2], data[train, 2]
        mean, scale = x.mean(axis=0), x.std(axis=0)
        design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        beta = np.linalg.solve(design.T @ design + np.diag([0, 2.0, 2.0]), design.T @ y)
        for i in range(f.test_start, f.test_end):
            expected += 1
            assert abs(got[f.number, i] - (beta[0] + ((data[i, :2] - mean) / scale) @ beta[1:])) < 1e-9
    assert len(got) == expected


def test_training_labels_are_known_at_the_start_of_the_test(placed):
    table, plan, rows = placed
    seen = {}

    def step(train, validation, test):
        first = test.agg(F.min("timestamp").alias("t")).first()["t"]
        seen[first] = train.agg(F.max("known").alias("k"), F.max("timestamp").alias("t")).first()
        assert validation.where(F.col("timestamp") >= F.lit(first)).count() == 0
        return test.withColumns({"prediction": F.lit(0.5), "position": F.lit(1.0)})

    out = foldfit.out_of_fold(table, plan, "known", fit_predict=step)
    assert len(seen) == len(plan) and all(k["k"] <= t and k["t"] < t for t, k in seen.items())
    assert out.where("position = 1 AND transaction_cost IS NULL").count() == out.count()


def test_a_failing_callback_names_its_fold(placed):
    table, plan, _ = placed
    third = START + dt.timedelta(hours=plan[2].test_start)

    def step(train, validation, test):
        if test.agg(F.min("timestamp").alias("t")).first()["t"] == third:
            raise ValueError("no luck")
        return test.withColumn("prediction", F.lit(1.0))

    with pytest.raises(foldfit.FoldError, match="fold 2: no luck") as error:
        foldfit.out_of_fold(table, plan, "known", fit_predict=step, workers=1)
    assert error.value.fold == 2


@pytest.mark.parametrize("bad, reason", [
    (lambda t: t, "no column prediction"), (lambda t: t.limit(3).withColumn("prediction", F.lit(1.0)), "3 predictions"),
    (lambda t: t.withColumn("prediction", F.lit(float("nan"))), "not finite"), (lambda t: t.withColumns({"prediction": F.lit(1.0), "position": F.lit(float("inf"))}), "position"),
])
def test_wrong_answers_are_refused(placed, bad, reason):
    table, plan, _ = placed
    with pytest.raises(foldfit.FoldError, match=reason):
        foldfit.out_of_fold(table, plan[:1], "known", fit_predict=lambda train, validation, test: bad(test))


def test_one_of_estimator_and_function(placed):
    table, plan, _ = placed
    with pytest.raises(ValueError):
        foldfit.out_of_fold(table, plan, "known")
    with pytest.raises(ValueError):
        foldfit.out_of_fold(table, [], "known", estimator=lambda: foldfit.Ridge(("a",), "y"))


def split_by_brute_force(x, y, w):
    """The feature and the two sides of the split that leaves the least weighted squared error."""
    best = None
    for f in range(x.shape[1]):
        for value in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= value
            loss = sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in (left, ~left))
            if best is None or loss < best[0] - 1e-12:
                best = (loss, f, left)
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_split_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 20, size=(120, 3)).astype(float)
    y = np.where(x[:, seed % 3] > 8, 3.0, 1.0) + rng.normal(size=120) * 0.3
    w = rng.choice([0.5, 1.0, 4.0], size=120)
    df = spark.createDataFrame([(*map(float, r), float(t), float(q)) for r, t, q in zip(x, y, w)], "a double, b double, c double, y double, w double")
    stump = trees.Ensemble(("a", "b", "c"), "y", "tree", depth=1, weight="w").fit(df)
    scored = {tuple(r[:3]): r["p"] for r in stump.predict(df, "p").select("a", "b", "c", "p").collect()}
    _, feature, left = split_by_brute_force(x, y, w)
    means = np.average(y[left], weights=w[left]), np.average(y[~left], weights=w[~left])
    ours = np.array([scored[tuple(r)] for r in x])
    np.testing.assert_allclose(ours, np.where(left, *means), atol=1e-9)
    assert stump.model.stages[-1].featureImportances[feature] == 1.0


def test_specialists_and_the_global_model(spark, tmp_path):
    """Two regimes with opposite laws: each specialist learns its own, a regime with few rows falls back to the global model."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        x = float(rng.normal())
        regime = "up" if i % 5 < 2 else "down" if i % 5 < 4 else "rare" if i % 50 == 4 else "none"
        sign = {"up": 1.0, "down": -1.0, "rare": 0.0, "none": 0.2}[regime]
        rows.append((i, x, regime, sign * x, 1.0 if i % 3 else None))
    df = spark.createDataFrame(rows, "i int, x double, kind string, y double, z double")
    train, test = df.where("i < 900"), df.where("i >= 900")
    order = ["up", "down", "rare", "never"]
    masks = {r: F.col("kind") == r for r in order}
    estimator = trees.Ensemble(("x", "z"), "y", "boosting", trees=8, depth=3, rate=0.5)
    ready, facts = trees.fit_specialists(train, test, masks, order, estimator, str(tmp_path), least_train=100, least_test=25)
    assert ready == ["up", "down"]
    told = {r["regime"]: (r["status"], r["train_rows"], r["test_rows"]) for r in facts.collect()}
    assert told["up"] == ("trained", 360, 120) and told["rare"] == ("skipped_too_few_rows", 18, 6) and told["never"][1:] == (0, 0)
    scored = trees.score_with_specialists(test, masks, order, ready, estimator, str(tmp_path))
    error = lambda c: F.sqrt(F.avg(F.pow(F.col("y") - F.col(c), 2)))
    by = {r["kind"]: r for r in scored.groupBy("kind").agg(error("prediction").alias("own"), error("global_prediction").alias("whole"), F.max("model").alias("model")).collect()}
    assert by["up"]["own"] < 0.3 < by["up"]["whole"] and by["down"]["own"] < 0.3 < by["down"]["whole"]
    assert by["up"]["model"] == "up" and by["rare"]["model"] == by["none"]["model"] == trees.GLOBAL
    assert by["rare"]["own"] == by["rare"]["whole"] and scored.count() == 300


def test_prediction_over_expressions(spark):
    model = fit.LinearModel(("a", "b"), (2.0, 3.0), 1.0)
    row = spark.range(1).select(F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b")).select(model.predict_over({"b": F.coalesce("b", F.lit(0.0))}).alias("p")).first()
    assert row["p"] == 3.0
