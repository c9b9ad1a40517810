"""Weighted tree ensembles, and one specialist per regime beside a global model.

Trees are grown by Spark ML from histograms of binned features, aggregated over all
partitions.  A row's regime is the first of the regimes that hold for it.  A specialist learns
from all training rows of its regime; it is used for the test rows of that regime, and
the global model for all others.  Fitted pipelines are written to the shared folder, one per
regime, and read from there to score.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import finite
from tidemark.session import checkpointed

GLOBAL = "global"


@dataclass(frozen=True)
class Ensemble:
    """A tree ensemble as an estimator of ``operators.foldfit``; null and NaN features count as zero."""

    features: tuple[str, ...]
    target: str
    algorithm: str = "boosting"
    trees: int = 20
    depth: int = 5
    rate: float = 0.1
    least_rows: int = 1
    bins: int = 64
    weight: str | None = None
    seed: int = 42

    def _regressor(self):
        common = dict(featuresCol="__features", labelCol=self.target, predictionCol="prediction", maxDepth=self.depth, maxBins=self.bins, minInstancesPerNode=self.least_rows, seed=self.seed)
        if self.weight:
            common["weightCol"] = self.weight
        if self.algorithm == "boosting":
            return GBTRegressor(maxIter=self.trees, stepSize=self.rate, **common)
        if self.algorithm == "forest":
            return RandomForestRegressor(numTrees=self.trees, **common)
        if self.algorithm == "tree":
            return DecisionTreeRegressor(**common)
        raise ValueError(f"unknown algorithm {self.algorithm}")

    def filled(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"__f_{f}": F.coalesce(finite(f), F.lit(0.0)) for f in self.features})

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> "Fitted":
        stages = [VectorAssembler(inputCols=[f"__f_{f}" for f in self.features], outputCol="__features"), self._regressor()]
        known = train.where(finite(self.target).isNotNull())
        if self.weight:
            known = known.where(F.col(self.weight) > 0)
        return Fitted(self, Pipeline(stages=stages).fit(self.filled(known).drop("prediction")))


@dataclass(frozen=True)
class Fitted:
    estimator: Ensemble
    model: PipelineModel

    def predict(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        scored = self.model.transform(self.estimator.filled(rows).drop("prediction"))
        return scored.drop("__features", *[f"__f_{f}" for f in self.estimator.features]).withColumnRenamed("prediction", name)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(estimator: Ensemble, path: str) -> "Fitted":
        return Fitted(estimator, PipelineModel.load(path))


def first_regime(masks: Mapping[str, Column], order: Sequence[str]) -> Column:
    """The first regime of ``order`` that holds for the row, else null."""
    return F.coalesce(*[F.when(masks[r], F.lit(r)) for r in order if r in masks])


def regime_counts(train: DataFrame, test: DataFrame, masks: Mapping[str, Column], order: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Rows that train each regime's specialist and test rows that it would score: one aggregate a side."""
    a = train.agg(*[F.count_if(masks[r]).alias(r) for r in order]).first()
    b = {r["regime"]: r["n"] for r in test.groupBy(first_regime(masks, order).alias("regime")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {r: (a[r], b.get(r, 0)) for r in order}


def fit_specialists(
    train: DataFrame, test: DataFrame, masks: Mapping[str, Column], order: Sequence[str], estimator: Ensemble, path: str, least_train: int = 300, least_test: int = 25, workers: int = 3
) -> tuple[list[str], DataFrame]:
    """Fits and saves the global model and a specialist for each regime with enough rows.

    Gives the regimes that have one, and regime, status, train_rows and test_rows for all.
    At most ``workers`` models are fitted at a time.
    """
    train = checkpointed(train)
    counts = regime_counts(train, test, masks, order)
    ready = [r for r in order if counts[r][0] >= least_train and counts[r][1] >= least_test]

    def one(regime: str) -> None:
        rows = train if regime == GLOBAL else train.where(masks[regime])
        estimator.fit(rows).save(f"{path}/{regime}")

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        list(pool.map(inheritable_thread_target(train.sparkSession)(one), [GLOBAL, *ready]))
    facts = [(r, "trained" if r in ready else "skipped_too_few_rows", *counts[r]) for r in order]
    return ready, train.sparkSession.createDataFrame(facts, "regime string, status string, train_rows long, test_rows long")


def score_with_specialists(rows: DataFrame, masks: Mapping[str, Column], order: Sequence[str], ready: Sequence[str], estimator: Ensemble, path: str) -> DataFrame:
    """``rows`` with regime, prediction, global_prediction and model (which one made the prediction).

    Every model is an expression over the feature vector, so the rows are read once; a
    row takes the prediction of its regime's specialist, if there is one.
    """
    out = rows.withColumn("regime", first_regime(masks, order))
    out = Fitted.load(estimator, f"{path}/{GLOBAL}").predict(out, "global_prediction")
    for r in ready:
        out = Fitted.load(estimator, f"{path}/{r}").predict(out, f"__by_{r}")
    own = F.coalesce(*[F.when(F.col("regime") == r, F.col(f"__by_{r}")) for r in ready], F.col("global_prediction"))
    model = F.when(F.col("regime").isin(*ready), F.col("regime")).otherwise(GLOBAL)
    return out.withColumns({"prediction": own, "model": model}).drop(*[f"__by_{r}" for r in ready])
