"""Linear fits from sufficient statistics, and candidate grids over folds."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import finite
from tidemark.operators.folds import Fold
from tidemark.operators.ranks import quantiles, value_ranks
from tidemark.operators.series import micros
from tidemark.session import checkpointed

@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def predict(self) -> Column:
        return self.predict_over({})

    def predict_over(self, values: Mapping[str, Column]) -> Column:
        """The prediction with some features given by expressions."""
        value = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients):
            value = value + values.get(name, F.col(name)) * F.lit(weight)
        return value


def gram(df: DataFrame, features: Sequence[str], target: str, group: str, weight: str | None = None) -> dict:
    """Weighted second moments of (1, features, target) per ``group`` value.

    A row with a null or NaN feature, target or weight is left out of all of them; rows
    whose group is null are a group of their own.  The sums are made by numpy in the tasks,
    whatever the number of features.  The result
    holds (p + 2)^2 numbers per group; the groups are folds or model scopes, never rows.
    """
    columns = ["__one", *features, target]
    staged = df.select(
        F.col(group).alias("__g"),
        F.lit(1.0).alias("__one"),
        *[F.col(c).cast("double").alias(c) for c in [*features, target]],
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"),
    ).dropna(subset=[*features, target, "__w"])
    size = len(columns)
    out: dict = {}

    def partial(batches: Iterable[pa.RecordBatch]):
        totals: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("__g").type
            codes = pc.dictionary_encode(batch.column("__g"), null_encoding="encode")
            at = codes.indices.to_numpy()
            x = np.column_stack([batch.column(c).to_numpy() for c in columns])
            weighted = x * batch.column("__w").to_numpy()[:, None]
            for k, g in enumerate(codes.dictionary.to_pylist()):
                mine = at == k
                totals[g] = totals.get(g, 0.0) + weighted[mine].T @ x[mine]
        if totals:
            i, j = np.indices((size, size))
            cells = size * size
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g in totals for _ in range(cells)], kind), *[pa.array(np.tile(v.ravel(), len(totals)), pa.int32()) for v in (i, j)],
                 pa.array(np.concatenate([m.ravel() for m in totals.values()]))],
                ["__g", "i", "j", "v"],
            )

    kind = dict(staged.dtypes)["__g"]
    long = staged.mapInArrow(partial, f"__g {kind}, i int, j int, v double")
    for row in long.groupBy("__g", "i", "j").agg(F.sum("v").alias("v")).collect():
        out.setdefault(row["__g"], np.zeros((size, size)))[row["i"], row["j"]] = row["v"]
    return out


def solve_ridge(moments: np.ndarray, base: np.ndarray, features: Sequence[str], alpha: float) -> LinearModel:
    """Ridge on features standardised by the *unweighted* moments ``base``.

    The intercept carries no penalty.  Both matrices are ordered (1, features, target).
    """
    p = len(features)
    n = base[0, 0]
    means = base[0, 1 : p + 1] / n
    scales = np.sqrt(np.maximum(np.diag(base)[1 : p + 1] / n - means**2, 0.0))
    # A constant column leaves only rounding noise in the second moment.
    scales = np.where(scales > 1e-9 * np.maximum(np.abs(means), 1.0), scales, 1.0)
    change = np.eye(p + 1)
    change[1:, 0] = -means / scales
    change[1:, 1:] = np.diag(1.0 / scales)
    inner = change @ moments[: p + 1, : p + 1] @ change.T
    right = change @ moments[: p + 1, p + 1]
    penalty = np.eye(p + 1) * alpha
    penalty[0, 0] = 0.0
    beta = np.linalg.pinv(inner + penalty) @ right
    raw = beta[1:] / scales
    return LinearModel(tuple(features), tuple(float(v) for v in raw), float(beta[0] - means @ raw))


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float) -> LinearModel:
    m = gram(df.withColumn("__g1", F.lit(0)), features, target, "__g1")[0]
    return solve_ridge(m, m, features, alpha)


def fit_huber(
    df: DataFrame, features: Sequence[str], target: str, alpha: float, delta: float = 1.35, rounds: int = 12
) -> LinearModel:
    """Ridge with Huber weights: each round is one weighted aggregate plus two exact medians."""
    rows = checkpointed(df.select(*features, target).withColumn("__g1", F.lit(0)))
    base = gram(rows, features, target, "__g1")[0]
    model = solve_ridge(base, base, features, alpha)
    for _ in range(rounds):
        residual = F.col(target) - model.predict()
        scored = rows.withColumn("__r", residual)
        median = _median(scored.select("__g1", "__r"))
        mad = _median(scored.select("__g1", F.abs(F.col("__r") - median).alias("__r")))
        spread = scored.agg(F.stddev_pop("__r").alias("s")).first()["s"]
        limit = delta * max(1.4826 * mad, spread * 0.1, 1e-12)
        size = F.abs("__r")
        weighted = scored.withColumn(
            "__w1", F.when(size <= limit, 1.0).otherwise(F.lit(limit) / F.greatest(size, F.lit(1e-12)))
        )
        moments = gram(weighted, features, target, "__g1", "__w1")[0]
        following = solve_ridge(moments, base, features, alpha)
        moved = max(
            (abs(a - b) for a, b in zip((*following.coefficients, following.intercept), (*model.coefficients, model.intercept))),
            default=0.0,
        )
        model = following
        if moved < 1e-12:
            break
    return model


def _median(values: DataFrame) -> float:
    ranked = value_ranks(values, ["__g1"], "__r")
    return quantiles(ranked, ["__g1"], "__r", {"m": 0.5}).first()["m"]


def gradient_descent(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    start: Mapping[str, float] | None = None,
    intercept: float = 0.0,
    epochs: int = 500,
    rate: float = 0.05,
) -> LinearModel:
    """Continue a linear model by full-batch gradient steps.

    The squared-error gradient is a function of the second moments, so the data
    are read once and the epochs run on a (p + 1)-sized matrix.  Coefficients of
    ``start`` are aligned by name.
    """
    m = gram(df.withColumn("__g1", F.lit(0)), features, target, "__g1")[0]
    n, p = m[0, 0], len(features)
    inner, right = m[: p + 1, : p + 1] / n, m[: p + 1, p + 1] / n
    beta = np.array([intercept, *[(start or {}).get(f, 0.0) for f in features]])
    for _ in range(epochs):
        beta = beta - rate * 2.0 * (inner @ beta - right)
    return LinearModel(tuple(features), tuple(float(v) for v in beta[1:]), float(beta[0]))


def usable_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one finite value, in the given order; one aggregate."""
    row = df.agg(*[F.max(finite(F.col(c).try_cast("double")).isNotNull()).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"c{i}"]]


def fingerprint(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Candidate:
    family: str
    features: tuple[str, ...]
    alpha: float
    algorithm: str = "ridge"
    id: str = field(default="")


def candidate_grid(
    families: Mapping[str, Sequence[str] | None],
    usable: Sequence[str],
    alphas: Sequence[float] = (0.1, 1.0, 10.0),
    robust: frozenset[str] = frozenset(),
    widest: int | None = None,
) -> tuple[list[Candidate], list[str]]:
    """Families x penalties with stable ids; families without usable columns are reported."""
    out, missing = [], []
    for family, declared in families.items():
        columns = tuple(usable[:widest]) if declared is None else tuple(c for c in declared if c in set(usable))
        if not columns:
            missing.append(family)
            continue
        algorithm = "huber_ridge" if family in robust else "ridge"
        for alpha in sorted(set(float(a) for a in alphas)):
            key = fingerprint({"family": family, "features": columns, "algorithm": algorithm, "alpha": alpha})[:12]
            out.append(Candidate(family, columns, alpha, algorithm, f"{family}-{algorithm}-{key}"))
    return out, missing


def _entry_folds(rows: DataFrame, folds: list[Fold], label_end: str) -> DataFrame:
    """The range of folds each row trains in.

    Training starts once both the fold's edge and its test time have passed the
    row, and ends when a rolling start passes it; all are monotone in the fold.
    """
    starts, ends, times = (np.array([getattr(f, n) for f in folds], dtype=np.int64) for n in ("train_start", "train_end", "test_time"))
    numbers = np.array([f.number for f in folds], dtype=np.int64)

    @F.pandas_udf("first_fold long, last_fold long")
    def span(pos: pd.Series, late: pd.Series) -> pd.DataFrame:
        p = pos.to_numpy()
        first = np.maximum(np.searchsorted(ends, p, "right"), np.searchsorted(times, late.to_numpy(), "left"))
        last = np.searchsorted(starts, p, "right") - 1
        trains = first <= last
        first, last = (pd.Series(numbers[np.where(trains, at, 0)]).where(trains) for at in (first, last))
        return pd.DataFrame({"first_fold": first.astype("Int64"), "last_fold": last.astype("Int64")})

    if not folds:
        return rows.withColumns({"first_fold": F.lit(0), "last_fold": F.lit(0)}).where(F.lit(False))
    # Said to be non-deterministic, so that the filter does not have it evaluated again.
    late = F.coalesce(micros(label_end), F.lit(-(2**63)).cast("long"))
    return rows.withColumn("__in", span.asNondeterministic()("pos", late)).where(F.col("__in.first_fold").isNotNull()).select(
        "*", F.col("__in.first_fold").alias("first_fold"), F.col("__in.last_fold").alias("last_fold")
    ).drop("__in")


def fold_grams(rows: DataFrame, folds: list[Fold], features: Sequence[str], target: str, label_end: str) -> dict[int, np.ndarray]:
    """Training moments of every fold from one pass over the rows."""
    entered = _entry_folds(rows, folds, label_end)
    tagged = entered.withColumn("__span", F.col("first_fold") * 100000 + F.col("last_fold"))
    spans = gram(tagged, features, target, "__span")
    out = {}
    for f in folds:
        parts = [m for span, m in spans.items() if span // 100000 <= f.number <= span % 100000]
        if parts:
            out[f.number] = sum(parts)
    return out


def score_candidates(
    rows: DataFrame, folds: list[Fold], candidates: Sequence[Candidate], target: str, label_end: str
) -> DataFrame:
    """Out-of-sample predictions of every candidate, refitted per fold.

    Ridge candidates share one moments pass over all folds; each is solved on its
    slice of the matrix.  Robust candidates need their own reweighting rounds.
    """
    features = list(dict.fromkeys(c for cand in candidates for c in cand.features))
    filled = rows.select("*", *[F.coalesce(finite(c), F.lit(0.0)).alias(f"x_{i}") for i, c in enumerate(features)])
    names = [f"x_{i}" for i in range(len(features))]
    moments = fold_grams(filled, folds, names, target, label_end)
    ready = [f for f in folds if f.number in moments]
    models = []
    for cand in candidates:
        spots = [features.index(c) for c in cand.features]
        picked = [0, *[s + 1 for s in spots], len(features) + 1]
        for f in ready:
            m = moments[f.number][np.ix_(picked, picked)]
            if cand.algorithm == "huber_ridge":
                train = _entry_folds(filled, [f], label_end)
                model = fit_huber(train, [names[s] for s in spots], target, cand.alpha)
            else:
                model = solve_ridge(m, m, [names[s] for s in spots], cand.alpha)
            slopes = [0.0] * len(features)
            for s, w in zip(spots, model.coefficients):
                slopes[s] = w
            models.append((cand, f, model.intercept, slopes))
    # The edges of the test ranges cut the positions into segments; a segment's models are rows of a small table.
    edges = sorted({e for f in ready for e in (f.test_start, f.test_end)})
    weights = [f"__w_{i}" for i in range(len(features))]
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [
            (s + 1, c.id, c.family, f.number, b0, *ws)
            for c, f, b0, ws in models
            for s in range(bisect_left(edges, f.test_start), bisect_left(edges, f.test_end))
        ],
        ", ".join(["__segment long, candidate_id string, candidate_family string, fold int, __b double", *[f"{w} double" for w in weights]]),
    )
    bounds = np.array(edges, dtype=np.int64)

    @F.pandas_udf("long")
    def segment(pos: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, pos.to_numpy(), "right"))

    out = filled.withColumn("__segment", segment.asNondeterministic()("pos")).join(F.broadcast(table), "__segment")
    dot = F.lit(0.0)
    for name, weight in zip(names, weights):
        dot = dot + F.col(name) * F.col(weight)
    return out.select(*rows.columns, "candidate_id", "candidate_family", "fold", (F.col("__b") + dot).alias("prediction"))


def rank_candidates(metrics: DataFrame) -> DataFrame:
    """Best first by rank key; undefined metrics sort last."""
    return metrics.orderBy(
        F.desc_nulls_last("information_coefficient"),
        F.desc_nulls_last("net_expectancy"),
        F.desc_nulls_last("directional_hit_rate"),
        F.asc_nulls_last("root_mean_squared_error"),
        F.desc("candidate_id"),
    )
