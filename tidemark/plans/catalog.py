"""All registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.registry import QUERIES, SQL

_MODULES = (
    "market",
    "research",
    "learning",
    "newsroom",
    "health",
    "scoring",
    "ledger",
    "desk",
    "library",
    "dataset",
    "feeds",
    "streams",
    "lookups",
    "models",
    "handoff",
    "paths",
    "intake",
    "records",
)

for _module in _MODULES:
    importlib.import_module(f"tidemark.plans.{_module}")


def _prepared(fn):
    @wraps(fn)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return call


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(QUERIES[name])(spark, sf_dir)
