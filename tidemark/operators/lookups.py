"""Lookups with a fallback, unions of records, and loaders with a fallback column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.asof import latest_per_key
from tidemark.operators.series import meet, range_blocks, running


def usable_candles(candles: DataFrame, least: int = 2) -> DataFrame:
    """Closed candles; a symbol with fewer than ``least`` of them keeps all rows, with ``quality`` false."""
    closed = F.coalesce(F.col("is_closed"), F.lit(False))
    enough = candles.groupBy("symbol").agg((F.count_if(closed) >= least).alias("quality"))
    return meet(candles, enough, ["symbol"]).where(closed | ~F.col("quality"))


def with_parent(rows: DataFrame, parents: DataFrame, key: str, take: Mapping[str, str]) -> DataFrame:
    """Rows beside their parent (an event and its article), or nulls where there is none."""
    side = parents.select(F.col(key).alias("__key"), *[F.col(c).alias(n) for n, c in take.items()])
    return rows.join(side, F.col(key) == F.col("__key"), "left").drop("__key")


def predictions_and_signals(predictions: DataFrame, signals: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The latest prediction of each model with its signals, and signals of no known prediction."""
    latest = latest_per_key(predictions, ["model"], order)
    known = latest.join(signals.where("prediction_id IS NOT NULL"), "prediction_id", "left")
    lonely = signals.join(predictions.select("prediction_id").distinct(), "prediction_id", "left_anti")
    return known.unionByName(lonely, allowMissingColumns=True)


def lineage(decisions: DataFrame, records: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The newest record of a decision's trace and symbol, else of its symbol; ``lineage_match`` says which."""
    same = latest_per_key(records, ["trace", "symbol"], order).select("trace", "symbol", F.col("record_id").alias("__same"))
    newest = latest_per_key(records, ["symbol"], order).select("symbol", F.col("record_id").alias("__newest"))
    both = decisions.join(same, ["trace", "symbol"], "left").join(newest, "symbol", "left")
    return both.withColumns({"record_id": F.coalesce("__same", "__newest"), "lineage_match": F.col("__same").isNotNull()}).drop("__same", "__newest")


def model_versions(predictions: DataFrame, versions: DataFrame, natural: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The version a prediction names, else the newest one with its natural key."""
    by_id = versions.select(F.col("version_id").alias("__id"), F.col("version_id").alias("__named"))
    by_key = latest_per_key(versions, natural, order).select(*natural, F.col("version_id").alias("__newest"))
    both = predictions.join(by_id, F.col("version_id") == F.col("__id"), "left").join(by_key, list(natural), "left")
    return both.withColumn("found_version", F.coalesce("__named", "__newest")).drop("__id", "__named", "__newest")


def newest_with(rows: DataFrame, other: DataFrame, key: str, order: Sequence[Column], n: int, how: str = "left") -> DataFrame:
    """The ``n`` newest rows, a bounded report, with what belongs to them."""
    return rows.orderBy(*order).limit(n).join(other, key, how)


def days_of(frames: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Days that occur in any of the frames, and in which."""
    parts = [df.select(F.to_date(day).alias("day"), F.lit(name).alias("source")) for name, (df, day) in frames.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.where("day IS NOT NULL").groupBy("day").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def newest_of_each_kind(kinds: Mapping[str, DataFrame], n: int) -> DataFrame:
    """The ``n`` newest records (id, at, label) of every kind on one time axis."""
    parts = [df.orderBy(F.desc("at"), F.desc("id")).limit(n).select(F.lit(kind).alias("kind"), "id", "at", "label") for kind, df in kinds.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def labelled_rows(rows: DataFrame, features: Sequence[str], target: str, fallback: str) -> DataFrame:
    """Model input: the target or else its fallback column; rows with neither go."""
    return rows.select(*features, F.coalesce(target, fallback).alias("target")).where("target IS NOT NULL")


def drawdowns(rows: DataFrame, key: str, order: Sequence[str], change: Column) -> DataFrame:
    """Running total of ``change`` per key and its fall below the highest total so far (start included)."""
    blocks = range_blocks(rows.withColumn("__change", change), [key], order)
    totals = running(blocks, [key], order, {"equity": ("sum", F.col("__change"))})
    peaks = running(totals, [key], order, {"peak": ("max", F.greatest("equity", F.lit(0).cast(totals.schema["equity"].dataType)))})
    return peaks.withColumn("drawdown", F.col("peak") - F.col("equity")).drop("__change", "__block")
