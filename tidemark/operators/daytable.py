"""Tables kept by day, whose writes can be repeated without a trace.

A table is a folder of numbered writes, ``batch=N/day=D``.  A write replaces whole days; all other
days stay what the writes before it made them.  It counts from the moment its list of days,
``batch=N/_days``, is there, which is written last.  A write that comes again under its number, after a
restart or a lost driver, starts from the same earlier writes and takes the same place.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

Merge = Callable[[DataFrame, DataFrame | None], DataFrame]


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, pattern: str) -> list[str]:
    at, files = _filesystem(spark, pattern)
    return [status.getPath().toString() for status in files.globStatus(at) or []]


def read_text(spark: SparkSession, path: str) -> str:
    at, files = _filesystem(spark, path)
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """Writes a small file; without ``overwrite`` it is an error if there is one already."""
    at, files = _filesystem(spark, path)
    stream = files.create(at, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def writes(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the finished writes, ascending."""
    return sorted(int(p.rsplit("/batch=", 1)[1].split("/")[0]) for p in listing(spark, f"{base}/batch=*/_days"))


def versions(spark: SparkSession, base: str, before: int | None = None) -> dict[str, int]:
    """The newest finished write of each day, of writes numbered below ``before``."""
    out: dict[str, int] = {}
    for number in writes(spark, base):
        if before is None or number < before:
            out.update(dict.fromkeys(json.loads(read_text(spark, f"{base}/batch={number}/_days")), number))
    return out


def current(spark: SparkSession, base: str, days: Sequence[str] | None = None, before: int | None = None) -> DataFrame | None:
    """The rows as of the last finished write (or before one), of some days or all, with the number of the write; None if there are none."""
    wanted = {f"/batch={n}/day={d}" for d, n in versions(spark, base, before).items() if days is None or d in set(days)}
    # A day whose rows all went has no folder.
    paths = [p for p in listing(spark, f"{base}/batch=*/day=*") if "/batch=" + p.rsplit("/batch=", 1)[1] in wanted]
    return spark.read.option("basePath", base).parquet(*sorted(paths)).drop("day") if paths else None


def write_days(base: str, time: str, rows: DataFrame, days: Sequence[str], number: int) -> None:
    """Makes ``rows`` the content of ``days``; rows are spread over (day, hash), so a busy day is several files.  Rows without a time are left out."""
    spark = rows.sparkSession
    first = [c for c in rows.columns if c != time][:1]
    out = rows.withColumn("day", F.date_format(time, "yyyy-MM-dd")).where("day IS NOT NULL")
    spread = F.pmod(F.xxhash64(time, *first), F.lit(8))
    out.repartition(F.col("day"), spread).write.mode("overwrite").partitionBy("day").parquet(f"{base}/batch={number}")
    create_text(spark, f"{base}/batch={number}/_days", json.dumps(sorted(days)), overwrite=True)


def merge_batch(base: str, time: str, merge: Merge, batch: DataFrame, number: int, days: Sequence[str] | None = None) -> list[str]:
    """Merges a batch into the days that it touches, and gives them.

    ``merge`` gets the batch and the rows that earlier writes left in those days (None if
    there are none).  With ``days`` given the batch is read once, else a second time
    from memory or disk to learn its days.
    """
    spark = batch.sparkSession
    held_batch = batch if days is not None else batch.persist()
    try:
        if days is None:
            named = held_batch.select(F.date_format(time, "yyyy-MM-dd").alias("day")).where("day IS NOT NULL").distinct()
            days = sorted(r["day"] for r in named.collect())  # days, not rows
        if not days:
            return []
        held = current(spark, base, days, number)
        write_days(base, time, merge(held_batch, held.drop("batch") if held is not None else None), days, number)
    finally:
        if held_batch is not batch or batch.is_cached:
            batch.unpersist()
    return list(days)
