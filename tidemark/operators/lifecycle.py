"""Retention, compaction, archiving and incremental hand-off of stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.asof import latest_per_key


def retained(df: DataFrame, time: str, cutoff: Column, keep: Column | None = None) -> DataFrame:
    """Rows that survive a retention cutoff."""
    stays = (F.col(time) >= cutoff) | F.col(time).isNull()
    return df.where(stays if keep is None else stays | keep)


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last write per key wins; keys compare null-safe because grouping does."""
    both = current.unionByName(incoming, allowMissingColumns=True)
    return latest_per_key(both, keys, [F.col(version).desc()])


def first_per_hour(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """Keep each key's first row of every UTC hour."""
    hour = df.withColumn("__h", F.date_trunc("hour", time))
    return latest_per_key(hour, [*keys, "__h"], [F.col(time), F.col(tie)]).drop("__h")


def compact_payload(values: str, metadata: str) -> dict[str, Column]:
    """Payload maps without the model echo and the debug keys."""
    # Keys dropped by compaction.
    debug = ["news_context", "derivatives_context", "debug", "raw_news_context"]
    return {
        values: F.map_filter(values, lambda k, x: k != "final_ai_input"),
        metadata: F.map_filter(metadata, lambda k, x: ~k.isin(debug)),
    }


def blank_where(df: DataFrame, present: DataFrame, key: str, column: str, old: Column) -> DataFrame:
    """Null ``column`` on old rows whose key is in ``present``."""
    marked = df.join(present.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    gone = old & F.coalesce("__hit", F.lit(False))
    return marked.withColumn(column, F.when(~gone, F.col(column))).drop("__hit")


def detach(df: DataFrame, expired: DataFrame, reference: str, key: str) -> DataFrame:
    """Null references to expired parents."""
    gone = expired.select(F.col(key).alias(reference)).distinct().withColumn("__gone", F.lit(True))
    return df.join(gone, reference, "left").withColumn(reference, F.when(F.col("__gone").isNull(), F.col(reference))).drop("__gone")


@dataclass(frozen=True)
class Slice:
    """A half-open time range of one hand-off."""

    start: object
    end: object


def next_slice(bounds: DataFrame, last_cutoff, now) -> Slice | None:
    """[last cutoff or earliest time, the current minute); ``bounds`` has one row per table."""
    end = now.replace(second=0, microsecond=0)
    start = last_cutoff or bounds.agg(F.min("first_timestamp").alias("t")).first()["t"]
    return Slice(start, end) if start is not None and start < end else None


def in_slice(df: DataFrame, time: str, part: Slice) -> DataFrame:
    return df.where((F.col(time) >= F.lit(part.start)) & (F.col(time) < F.lit(part.end)))


def write_days(df: DataFrame, path: str, time: str, fmt: str = "parquet", keys: Sequence[str] = ()) -> None:
    """Write day partitions, replacing exactly the days present.

    Rows are spread over (day, key hash) before the write, so a day is a handful
    of files and a busy day is not one task.
    """
    out = df.withColumn("day", F.to_date(time))
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c in keys] or df.columns[:1]), F.lit(16))
    writer = out.repartition(F.col("day"), spread).write.mode("overwrite").partitionBy("day").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer.option("header", True).option("compression", "gzip").csv(path)
    elif fmt == "json":
        writer.option("compression", "gzip").json(path)
    else:
        writer.parquet(path)


def archive_then_trim(spark: SparkSession, df: DataFrame, time: str, cutoff: Column, archive: str) -> tuple[DataFrame, int]:
    """Archive rows before the cutoff, verify the copy, then return the rest.

    Raises before anything is dropped when the archive does not hold every row.
    """
    old = df.where(F.col(time) < cutoff)
    write_days(old, archive, time)
    expected, written = old.count(), spark.read.parquet(archive).where(F.col(time) < cutoff).count()
    if expected != written:
        raise RuntimeError(f"archive holds {written} of {expected} rows; nothing was removed")
    return df.where((F.col(time) >= cutoff) | F.col(time).isNull()), expected


def delete_order(parents: Mapping[str, Sequence[str]]) -> list[str]:
    """Tables with children first; ``parents`` maps a table to the tables it refers to."""
    order: list[str] = []
    left = set(parents)
    while left:
        free = sorted(t for t in left if not any(t in parents[o] for o in left if o != t))
        step = free or [min(left)]
        order += step
        left -= set(step)
    return order


def delete_range(tables: Mapping[str, tuple[DataFrame, str]], part: Slice, parents: Mapping[str, Sequence[str]], kept: Sequence[str], mismatches: DataFrame) -> dict[str, DataFrame]:
    """Remaining rows per table after an exported range is dropped, children first.

    Nothing is dropped while the export still has a mismatch.
    """
    if mismatches.limit(1).count():
        raise RuntimeError("the export does not match its manifest; nothing was removed")
    out = {}
    for name in delete_order({t: [p for p in parents.get(t, ()) if p in tables] for t in tables}):
        df, time = tables[name]
        inside = (F.col(time) >= F.lit(part.start)) & (F.col(time) < F.lit(part.end))
        out[name] = df if name in kept else df.where(~inside | F.col(time).isNull())
    return out
