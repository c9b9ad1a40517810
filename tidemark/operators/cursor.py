"""A durable position in a growing data set, and the rebuild of what changed since.

The position is a row of numbered states in a folder; a new state is the creation of the next
number's file, which fails if someone else made it first.  Changes are found by comparing
each day's row count and sum of row hashes with those of the last state.  Only the days whose
output a changed day can touch are computed again, from their own rows and a halo of days.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import daytable
from tidemark.session import checkpointed


class Conflict(RuntimeError):
    """Another run moved the cursor since it was read."""


@dataclass(frozen=True)
class Snapshot:
    """What is known of a labelled data set at a moment."""

    dataset_version: str
    feature_version: str
    total_rows: int
    newest_label_time: str | None = None
    facts: str | None = None

    def __post_init__(self) -> None:
        if not self.dataset_version.strip() or not self.feature_version.strip():
            raise ValueError("dataset and feature version cannot be empty")
        if self.total_rows < 0:
            raise ValueError("the number of rows cannot be negative")


class Cursor:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _numbers(self) -> list[int]:
        return sorted(int(p.rsplit("state-", 1)[1].split(".")[0]) for p in daytable.listing(self.spark, f"{self.folder}/state-*.json"))

    def read(self) -> tuple[int, Snapshot | None]:
        """The number and content of the newest whole state; 0 and None before the first."""
        for number in reversed(self._numbers()):
            try:
                return number, Snapshot(**json.loads(daytable.read_text(self.spark, f"{self.folder}/state-{number}.json")))
            except ValueError:  # its writer was lost half way
                continue
        return 0, None

    def commit(self, snapshot: Snapshot, expected: int) -> int:
        """Makes ``snapshot`` the state after ``expected``; raises Conflict if there is a newer one."""
        if self.read()[0] != expected:
            raise Conflict(f"the cursor is past {expected}")
        number = max([expected, *self._numbers()]) + 1
        try:
            daytable.create_text(self.spark, f"{self.folder}/state-{number}.json", json.dumps(asdict(snapshot), sort_keys=True))
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                raise Conflict(f"state {number} was made by another run") from error
            raise
        return number


def new_rows(snapshot: Snapshot, state: Snapshot | None) -> int:
    """Rows beyond the cursor; another data set version starts afresh."""
    if state is None or state.dataset_version != snapshot.dataset_version:
        return snapshot.total_rows
    return max(0, snapshot.total_rows - state.total_rows)


def day_facts(rows: DataFrame, time: str) -> DataFrame:
    """day, n, sum: the sum of 64-bit hashes of whole rows does not depend on their order, and tells nulls from empty texts."""
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in sorted(rows.columns)]
    return rows.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*marked).cast("decimal(38,0)")).alias("sum"))


def changed_days(now: DataFrame, before: DataFrame) -> list[dt.date]:
    """Days that came, went, or hold other rows than before."""
    old = before.select(F.col("day").alias("old_day"), F.col("n").alias("old_n"), F.col("sum").alias("old_sum"))
    both = now.join(old, F.col("day").eqNullSafe(F.col("old_day")), "full")
    other = ~F.col("n").eqNullSafe(F.col("old_n")) | ~F.col("sum").eqNullSafe(F.col("old_sum"))
    return sorted(r["d"] for r in both.where(other).select(F.coalesce("day", "old_day").alias("d")).collect() if r["d"] is not None)


def _ranges(days: Sequence[dt.date]) -> list[tuple[dt.date, dt.date]]:
    out: list[tuple[dt.date, dt.date]] = []
    for d in sorted(set(days)):
        if out and (d - out[-1][1]).days <= 1:
            out[-1] = (out[-1][0], d)
        else:
            out.append((d, d))
    return out


def _within(time: str, days: Sequence[dt.date]):
    """The rows of some days as ranges of time, which reach the scan."""
    at = F.lit(False)
    for a, b in _ranges(days):
        start, end = (dt.datetime.combine(x, dt.time()) for x in (a, b + dt.timedelta(days=1)))
        at = at | ((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))
    return at


def rebuild(
    source: DataFrame,
    time: str,
    base: str,
    build: Callable[[DataFrame], DataFrame],
    output_time: str,
    before: int,
    after: int,
    dataset_version: str,
    feature_version: str,
    label_time: str | None = None,
) -> tuple[list[dt.date], int]:
    """Brings the day table ``base/rows`` up to date with ``source``; gives the days and rows written.

    An output row of a day depends on source rows from ``before`` days back to ``after`` days ahead.
    ``build`` gets the source rows that the outdated days need and may give more days; those are not
    written.  An unchanged source writes nothing and leaves the cursor.  The table is written before
    the cursor moves: a run that is lost between leaves days that the next run writes again.
    """
    spark = source.sparkSession
    cursor = Cursor(spark, f"{base}/cursor")
    number, state = cursor.read()
    facts = checkpointed(day_facts(source, time))
    whole = facts.agg(F.sum("n").alias("n")).first()["n"] or 0
    if state is None or state.dataset_version != dataset_version or state.feature_version != feature_version:
        days = sorted(r["day"] for r in facts.select("day").collect() if r["day"] is not None)
        if state is not None:
            days = sorted({*days, *(dt.date.fromisoformat(d) for d in daytable.versions(spark, f"{base}/rows"))})
    else:
        days = changed_days(facts, spark.read.parquet(state.facts))
    if not days:
        return [], 0
    touched = sorted({d + dt.timedelta(days=i) for d in days for i in range(-after, before + 1)})
    needed = sorted({d + dt.timedelta(days=i) for d in touched for i in range(-before, after + 1)})
    out = build(source.where(_within(time, needed))).where(_within(output_time, touched))
    write = number + 1
    daytable.write_days(f"{base}/rows", output_time, out, [d.isoformat() for d in touched], write)
    written = daytable.current(spark, f"{base}/rows", [d.isoformat() for d in touched])
    rows = written.count() if written is not None else 0
    newest = written.agg(F.max(label_time).cast("string").alias("t")).first()["t"] if written is not None and label_time else None
    kept = f"{base}/facts/state-{write}-{dt.datetime.now(dt.timezone.utc):%Y%m%d%H%M%S%f}"
    facts.write.parquet(kept)
    cursor.commit(Snapshot(dataset_version, feature_version, int(whole), newest or (state.newest_label_time if state else None), kept), number)
    return touched, rows
