"""Every time-stamped table of a store, by day: one write per table, counted while it is written.

A bundle holds ``table=NAME`` day tables (see ``daytable``).  Writing a range again, or one that overlaps,
merges with the days that are there: rows are told by their keys, and the incoming one wins.
Rows and bounds of a (table, day) are observed by the write itself; the manifest keeps the newest
facts of each.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tidemark.operators import daytable
from tidemark.operators.asof import latest_per_key

#: Names of time columns, in the order in which a table's own is chosen.
TIME_COLUMNS = (
    "event_time", "open_time", "as_of", "generated_at", "observed_at", "timestamp", "candle_close_time", "available_at", "filled_at", "started_at",
    "active_from", "created_at", "updated_at",
)
#: Fixed value: the source of candles that were fetched only to warm up a strategy.
CACHE_SOURCE = "strategy_history_cache"
#: Days whose facts are observed in one write.
SPAN_DAYS = 31
_MANIFEST = "table_name string, day date, rows long, first_time timestamp_ntz, last_time timestamp_ntz, status string, batch int"


@dataclass(frozen=True)
class Table:
    rows: DataFrame
    keys: tuple[str, ...]
    time: str | None = None

    def clock(self) -> str | None:
        return self.time or first_time_column(self.rows.columns)


def first_time_column(columns: Sequence[str], names: Sequence[str] = TIME_COLUMNS) -> str | None:
    return next((n for n in names if n in columns), None)


def table_slice(rows: DataFrame, time: str, start: dt.datetime, end: dt.datetime, source: str = "source_name", excluded: str = CACHE_SOURCE) -> DataFrame:
    """Rows of [start, end); those of the excluded source and open candles stay out, rows without a source stay in."""
    out = rows.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))
    if source in rows.columns:
        out = out.where(~F.col(source).eqNullSafe(F.lit(excluded)))
    if "is_closed" in rows.columns:
        out = out.where(F.coalesce("is_closed", F.lit(False)))
    return out


def bounds(tables: Mapping[str, Table]) -> tuple[dt.datetime, dt.datetime] | None:
    """First and last time over all tables that have one: an aggregate each."""
    found = [t.rows.agg(F.min(t.clock()).alias("a"), F.max(t.clock()).alias("b")).first() for t in tables.values() if t.clock()]
    times = [v for r in found for v in r if v is not None]
    return (min(times), max(times)) if times else None


def _spans(start: dt.datetime, end: dt.datetime) -> Iterator[tuple[dt.datetime, dt.datetime, list[dt.date]]]:
    """The range in pieces of at most ``SPAN_DAYS`` calendar days."""
    while start < end:
        stop = min(end, dt.datetime.combine(start.date() + dt.timedelta(days=SPAN_DAYS), dt.time()))
        last = (stop - dt.timedelta(microseconds=1)).date()
        yield start, stop, [start.date() + dt.timedelta(days=i) for i in range((last - start.date()).days + 1)]
        start = stop


def _merged(keys: Sequence[str], incoming: DataFrame, held: DataFrame | None) -> DataFrame:
    if held is None:
        return incoming
    both = incoming.withColumn("__age", F.lit(0)).unionByName(held.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, list(keys) or incoming.columns, [F.col("__age")]).drop("__age")


def _observed(rows: DataFrame, time: str, days: Sequence[dt.date], into: Observation) -> DataFrame:
    day = F.to_date(time)
    facts = []
    for i, d in enumerate(days):
        here = F.when(day == F.lit(d), F.col(time))
        facts += [F.count(here).alias(f"n{i}"), F.min(here).cast("timestamp_ntz").alias(f"a{i}"), F.max(here).cast("timestamp_ntz").alias(f"b{i}")]
    return rows.observe(into, *facts)


def _told(seen: Observation) -> dict | None:
    """What a write observed; None if its input was known to be empty, and the observation left out of the plan with it."""
    try:
        return seen.get
    except Py4JJavaError as error:
        if "assertion failed" in str(error):
            return None
        raise


def write_bundle(
    spark: SparkSession, base: str, tables: Mapping[str, Table], start: dt.datetime, end: dt.datetime, today: dt.date, include_unfinished: bool = True
) -> DataFrame:
    """Writes the tables' rows of [start, end) by day, merged with the days that are there; gives the manifest.

    A day is finished when it lies before ``today``; with ``include_unfinished`` off the others are left
    out.  A table without a time column is left out.  Facts are those of the whole merged day.
    """
    if not include_unfinished:
        end = min(end, dt.datetime.combine(today, dt.time()))
    facts: list[tuple] = []
    number = max([0, *(int(p.rsplit("=", 1)[1]) for p in daytable.listing(spark, f"{base}/manifest/batch=*"))]) + 1
    for name, table in tables.items():
        time = table.clock()
        if time is None:
            continue
        folder = f"{base}/table={name}"
        for k, (a, b, days) in enumerate(_spans(start, end)):
            seen = Observation()
            merge = lambda new, held: _observed(_merged(table.keys, new, held), time, days, seen)  # noqa: E731,B023
            write = number * 1000 + k
            daytable.merge_batch(folder, time, merge, table_slice(table.rows, time, a, b), write, [d.isoformat() for d in days])
            told = _told(seen)
            stored = daytable.current(spark, folder, [d.isoformat() for d in days])
            # A write that had to run tasks again may have told rows twice; files tell their rows without being read.
            n = stored.count() if stored is not None else 0
            if told is None or n != sum(told[f"n{i}"] for i in range(len(days))):
                again = stored.groupBy(F.to_date(time).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("a"), F.max(time).alias("b")) if n else None
                by_day = {r["d"]: r for r in again.collect()} if n else {}
                told = {f"{c}{i}": by_day[d][c] if d in by_day else (0 if c == "n" else None) for i, d in enumerate(days) for c in "nab"}
            facts += [
                (name, d, told[f"n{i}"], told[f"a{i}"], told[f"b{i}"], "finished" if d < today else "unfinished", write)
                for i, d in enumerate(days) if told[f"n{i}"]
            ]
    spark.createDataFrame(facts, _MANIFEST).write.mode("overwrite").parquet(f"{base}/manifest/batch={number}")
    return manifest(spark, base)


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """The newest facts of every (table, day)."""
    paths = daytable.listing(spark, f"{base}/manifest/batch=*")
    rows = spark.read.schema(_MANIFEST).parquet(*paths) if paths else spark.createDataFrame([], _MANIFEST)
    return latest_per_key(rows, ["table_name", "day"], [F.col("batch").desc()])


def read_table(spark: SparkSession, base: str, name: str, days: Sequence[str] | None = None) -> DataFrame | None:
    found = daytable.current(spark, f"{base}/table={name}", days)
    return found.drop("batch") if found is not None else None


def scan_lake(spark: SparkSession, root: str, table: str, first: dt.date, last: dt.date, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Rows of one table over the day folders ``table=X/day=D`` from first to last, with their file and, of Parquet, their row in it.

    Table and days are partition columns, so folders outside are never listed as input.
    """
    reader = spark.read.schema(f"{schema}, table string, day date") if schema else spark.read
    rows = reader.format(fmt).load(root)
    lineage = [F.col("_metadata.file_path").alias("file")] + ([F.col("_metadata.row_index").alias("file_row")] if fmt == "parquet" else [])
    return rows.where((F.col("table") == table) & (F.col("day") >= F.lit(first)) & (F.col("day") <= F.lit(last))).select("*", *lineage)
