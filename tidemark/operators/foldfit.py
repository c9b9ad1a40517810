"""Models fitted fold by fold, each fold's data as DataFrames.

A model is anything with ``fit(train, validation)`` that gives something with
``predict(test)``; or one function of the three frames.  Folds are fitted by concurrent
jobs, a bounded number at a time, each in a job group of its own.  The rows are numbered
and written once; a fold's parts are filters on that table, so no row is copied per fold
and no fold has to fit into one task.  Every fold writes its scores to the shared folder;
together they are one frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Protocol

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numeric import finite
from tidemark.operators.fit import LinearModel, fit_ridge
from tidemark.operators.folds import Fold
from tidemark.operators.series import micros
from tidemark.session import checkpointed, scratch_path


class Model(Protocol):
    def predict(self, test: DataFrame) -> DataFrame:
        """``test`` with a column ``prediction``, and ``position`` or ``transaction_cost`` if the model sets them."""


class Estimator(Protocol):
    def fit(self, train: DataFrame, validation: DataFrame) -> Model: ...


FitPredict = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


class FoldError(RuntimeError):
    """What went wrong in a fold, with its number."""

    def __init__(self, fold: int, reason: object) -> None:
        super().__init__(f"fold {fold}: {reason}")
        self.fold = fold


@dataclass(frozen=True)
class Ridge:
    """Ridge regression as an estimator; null and NaN features count as zero."""

    features: tuple[str, ...]
    target: str
    alpha: float = 1.0

    def _filled(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f: F.coalesce(finite(f), F.lit(0.0)) for f in self.features})

    def fit(self, train: DataFrame, validation: DataFrame) -> "_Fitted":
        return _Fitted(self, fit_ridge(self._filled(train), self.features, self.target, self.alpha))


@dataclass(frozen=True)
class _Fitted:
    estimator: Ridge
    model: LinearModel

    def predict(self, test: DataFrame) -> DataFrame:
        return test.withColumn("prediction", self.model.predict_over({f: F.coalesce(finite(f), F.lit(0.0)) for f in self.model.features}))


def parts(placed: DataFrame, fold: Fold, label_end: str | None, pos: str = "pos") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and test rows of a fold: filters on the numbered rows; training labels are known at the test's start."""
    p = F.col(pos)
    within = lambda a, b: placed.where((p >= a) & (p < b))
    train = within(fold.train_start, fold.train_end)
    if label_end:
        late = micros(label_end)
        train = train.where(late.isNull() | (late <= fold.test_time))
    return train, within(fold.validation_start, fold.validation_end), within(fold.test_start, fold.test_end)


def _checked(scores: DataFrame, test: DataFrame, fold: int, path: str) -> None:
    if "prediction" not in scores.columns:
        raise FoldError(fold, "the model gave no column prediction")
    extra = [c for c in ("position", "transaction_cost") if c in scores.columns]
    optional = [F.col(c).cast("double").alias(c) if c in extra else F.lit(None).cast("double").alias(c) for c in ("position", "transaction_cost")]
    given = [c for c in test.columns if c not in ("prediction", "position", "transaction_cost", "fold")]
    scores.select(*given, F.col("prediction").cast("double").alias("prediction"), *optional, F.lit(fold).alias("fold")).write.parquet(path)
    stored = test.sparkSession.read.parquet(path)
    wrong = F.count_if(finite("prediction").isNull())
    told = stored.agg(F.count(F.lit(1)).alias("n"), wrong.alias("wrong"), *[F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in extra]).first()
    expected = test.count()
    if told["n"] != expected:
        raise FoldError(fold, f"{told['n']} predictions for {expected} test rows")
    for name in ("wrong", *extra):
        if told[name]:
            raise FoldError(fold, f"{told[name]} values of {'prediction' if name == 'wrong' else name} are not finite")


def out_of_fold(
    placed: DataFrame,
    folds: Sequence[Fold],
    label_end: str | None,
    estimator: Callable[[], Estimator] | None = None,
    fit_predict: FitPredict | None = None,
    workers: int = 4,
) -> DataFrame:
    """The test rows of every fold with prediction, position, transaction_cost (null unless set) and fold.

    ``placed`` comes from ``folds.with_positions``.  One of ``estimator`` (makes a fresh
    one for each fold) and ``fit_predict`` must be given.  At most ``workers`` folds run at
    a time.  The first fold that fails ends the others, and the error names it; so do
    too few or too many rows, and predictions that are null or not finite.
    """
    if (estimator is None) == (fit_predict is None):
        raise ValueError("give either an estimator or a function")
    if not folds:
        raise ValueError("there are no folds")
    spark = placed.sparkSession
    rows = checkpointed(placed)
    base = scratch_path(spark, "folds")
    context = spark.sparkContext

    def one(fold: Fold) -> str:
        context.setJobGroup(f"{base}-{fold.number}", f"fold {fold.number}", interruptOnCancel=True)
        train, validation, test = parts(rows, fold, label_end)
        path = f"{base}/fold-{fold.number}"
        try:
            scores = fit_predict(train, validation, test) if fit_predict else estimator().fit(train, validation).predict(test)
            _checked(scores, test, fold.number, path)
        except FoldError:
            raise
        except Exception as error:
            raise FoldError(fold.number, error) from error
        return path

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        running = {pool.submit(inheritable_thread_target(spark)(one), f): f for f in folds}
        done, rest = wait(running, return_when=FIRST_EXCEPTION)
        failed = [f for f in done if f.exception()]
        if failed:
            for future in rest:
                future.cancel()
            for fold in running.values():
                context.cancelJobGroup(f"{base}-{fold.number}")
            raise failed[0].exception()
    return spark.read.parquet(*[f.result() for f in running])
