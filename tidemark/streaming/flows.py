"""Structured Streaming versions of the live feeds.

State is bounded everywhere: watermarks drop keys, windows and pending signals
once they cannot change any more.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.asof import latest_per_key
from tidemark.operators.daytable import Merge, merge_batch
from tidemark.session import scratch_path


def tumbling_bars(ticks: DataFrame, width: str, lateness: str = "10 minutes", tie: str | None = None) -> DataFrame:
    """OHLCV bars per symbol; a bar is final when the watermark passes its end.  ``tie`` orders ticks of one time."""
    order = F.struct("ts", tie) if tie else F.col("ts")
    return ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trades"),
    ).select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "trades")


def liquidation_windows(orders: DataFrame, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding long/short notional, total and imbalance; longs are liquidated by SELL orders."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("notional"))), F.lit(0.0))
    out = orders.withWatermark("event_time", "5 minutes").groupBy("symbol", F.window("event_time", length, slide).alias("w")).agg(
        side("SELL").alias("long_usd"), side("BUY").alias("short_usd"), F.count(F.lit(1)).alias("events")
    )
    total = F.col("long_usd") + F.col("short_usd")
    return out.select(
        "symbol", F.col("w.end").alias("window_end"), "long_usd", "short_usd", total.alias("total_usd"),
        F.when(total > 0, (F.col("short_usd") - F.col("long_usd")) / F.when(total > 0, total)).otherwise(0.0).alias("imbalance"), "events",
    )


def liquidation_spikes(windows: DataFrame, floor: float = 50_000.0) -> DataFrame:
    """Growth over the previous window's total, bounded to 0..10.

    Windows are one row per (symbol, slide step), so the previous one is found by
    an equi join on the step before.
    """
    before = windows.select("symbol", (F.col("window_end") + F.expr("interval 1 minute")).alias("window_end"), F.col("total_usd").alias("previous_total"))
    out = windows.join(before, ["symbol", "window_end"], "left")
    grown = F.col("total_usd") / F.greatest(F.coalesce("previous_total", F.lit(0.0)), F.lit(floor)) - 1.0
    return out.withColumn("spike_score", F.greatest(F.lit(0.0), F.least(F.lit(10.0), grown)))


def unique_articles(articles: DataFrame, lateness: str = "7 days") -> DataFrame:
    """First arrival of each (source, url); keys leave the state after the watermark."""
    return articles.withWatermark("available_at", lateness).dropDuplicatesWithinWatermark(["source", "url"])


def upsert_klines(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Last message wins per bar; a closed message removes the live one and is never replaced by it.

    ``updates`` counts the messages of a bar; one aggregate, map-side combined.
    """
    new = batch.withColumn("updates", F.lit(1).cast("long"))
    keyed = new if stored is None else stored.unionByName(new)
    keys = ["symbol", "interval", "open_time"]
    rest = [c for c in keyed.columns if c not in (*keys, "updates")]
    newest = F.max_by(F.struct(*rest), F.struct("is_closed", "event_time", "close")).alias("__newest")
    return keyed.groupBy(*keys).agg(newest, F.sum("updates").alias("updates")).select(*keys, "__newest.*", "updates")


def late_or_changed(rows: DataFrame, known: DataFrame, fingerprint: str) -> DataFrame:
    """Rows whose fingerprint has not been seen: new or corrected labels."""
    return rows.join(known.select(fingerprint).distinct(), fingerprint, "left_anti")


def fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical JSON of the named columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, with zoned times as watermarks need them."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A stream takes folders: the table's own, or that of a table of one file.
    stream = spark.readStream.schema(schema)
    raw = stream.parquet(path) if _is_folder(spark, path) else stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    files = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    return bool(files) and not files[0]["path"].endswith("/events.parquet")


def drain(stream: DataFrame, mode: str, keys: Sequence[str], name: str) -> DataFrame:
    """Run a stream over all available input into a table and read it back.

    Every micro-batch overwrites the folder of its number, so a batch that comes again
    doubles nothing.  In update mode the newest version per key is returned.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    save_batch(out, spark.createDataFrame([], stream.schema), -1)  # also when no batch comes
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(partial(save_batch, out)).start()
    query.awaitTermination()
    got = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])).parquet(out)
    if mode == "update":
        got = latest_per_key(got, keys, [F.col("__batch").desc()])
    return got.drop("__batch")


def save_batch(out: str, batch: DataFrame, number: int) -> None:
    batch.write.mode("overwrite").parquet(f"{out}/__batch={number}")


def run_merge(stream: DataFrame, base: str, state: str, time: str, merge: Merge) -> None:
    """Merges all available input into a day table, batch by batch; run again with the same ``state`` it goes on where it ended."""
    step = lambda batch, number: merge_batch(base, time, merge, batch, number)
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
