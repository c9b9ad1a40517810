"""Which bars a store lacks, as runs, as bars, and as a verdict per symbol."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators.series import micros, numbered, row_halo, drop_halo, BLOCK

WEEK = 7 * 86400
_RUN = "first_missing", "last_missing", "missing"


def _at(us):
    return F.timestamp_micros(us).cast("timestamp_ntz")


def in_range(candles: DataFrame, start: dt.datetime, end: dt.datetime, time: str = "open_time") -> DataFrame:
    """Closed bars of the half-open range, once each."""
    held = candles.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))
    if "is_closed" in candles.columns:
        held = held.where(F.coalesce("is_closed", F.lit(False)))
    return held.select("symbol", time).distinct()


def gap_runs(candles: DataFrame, symbols: DataFrame, start: dt.datetime, end: dt.datetime, seconds: int = 60, width_seconds: int = WEEK) -> DataFrame:
    """symbol, first_missing, last_missing, missing: runs of absent bars of [start, end), however long, as one row each.

    ``start`` and ``end`` lie on the grid of ``seconds``; bars off the grid are an error of their
    own and count with the bar they fall into.  A symbol of ``symbols`` without any bar has one run.  Work is by
    blocks of time with the next row as halo; beginnings and ends come from one aggregate.
    """
    step = seconds * 1_000_000
    first, last = (int((x - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for x in (start, end))
    slot = F.floor((micros("open_time") - first) / step).cast("long")
    held = in_range(candles, start, end).select("symbol", "open_time", slot.alias("slot")).dropDuplicates(["symbol", "slot"])
    placed = row_halo(numbered(held, ["symbol"], ["open_time"], width_seconds, "open_time"), after=1)
    following = F.lead("slot").over(W.partitionBy("symbol", BLOCK).orderBy("pos"))
    inner = drop_halo(placed.withColumn("next_slot", following)).where(F.col("next_slot") > F.col("slot") + 1).select(
        "symbol", (F.col("slot") + 1).alias("a"), (F.col("next_slot") - 1).alias("b")
    )
    slots = (last - first) // step
    ends = symbols.select("symbol").distinct().join(held.groupBy("symbol").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")), "symbol", "left")
    sides = F.when(F.col("lo").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(slots - 1).cast("long").alias("b")))).otherwise(
        F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("lo") - 1).alias("b")), F.struct((F.col("hi") + 1).alias("a"), F.lit(slots - 1).cast("long").alias("b")))
    )
    outer = ends.select("symbol", F.explode(sides).alias("s")).select("symbol", "s.a", "s.b").where("a <= b")
    place = lambda c: _at(F.lit(first) + F.col(c) * step)
    return inner.unionByName(outer).select("symbol", place("a").alias("first_missing"), place("b").alias("last_missing"), (F.col("b") - F.col("a") + 1).alias("missing"))


def missing_bars(runs: DataFrame, seconds: int = 60) -> DataFrame:
    """symbol, open_time of every absent bar: made inside the runs only, which are dealt anew first, so that a long run is not one task's tail."""
    step = F.expr(f"interval {seconds} seconds")
    # Long runs in pieces of a thousand bars.
    piece = 1000
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("missing") - 1) / piece)))
    parts = runs.withColumn("__k", cut).repartition("symbol", "__k")
    begin = _at(micros("first_missing") + F.col("__k") * (piece * seconds * 1_000_000))
    stop = F.least(F.col("last_missing"), _at(micros("first_missing") + (F.col("__k") * piece + piece - 1) * (seconds * 1_000_000)))
    return parts.select("symbol", F.explode(F.sequence(begin, stop, step)).alias("open_time"))


def coverage(runs: DataFrame, symbols: DataFrame, start: dt.datetime, end: dt.datetime, target: int, seconds: int = 60) -> DataFrame:
    """symbol, expected, available, missing, runs, longest_run, status: ready with ``target`` bars, else partial.  Arithmetic on the runs; no bar is counted."""
    expected = int((end - start).total_seconds()) // seconds
    sums = runs.groupBy("symbol").agg(F.sum("missing").alias("missing"), F.count(F.lit(1)).alias("runs"), F.max("missing").alias("longest_run"))
    out = symbols.select("symbol").distinct().join(sums, "symbol", "left").na.fill(0, ["missing", "runs", "longest_run"])
    available = F.lit(expected).cast("long") - F.col("missing")
    return out.select(
        "symbol", F.lit(expected).cast("long").alias("expected"), available.alias("available"), "missing", "runs", "longest_run",
        F.when(available >= target, "ready").otherwise("partial").alias("status"),
    )


def absent_only(incoming: DataFrame, stored: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Fetched bars of [start, end) that the store lacks, once each: what a fill may insert."""
    fresh = incoming.where((F.col("open_time") >= F.lit(start)) & (F.col("open_time") < F.lit(end))).dropDuplicates(["symbol", "open_time"])
    return fresh.join(stored.select("symbol", "open_time"), ["symbol", "open_time"], "left_anti")
