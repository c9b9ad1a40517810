"""Bundles by day, lake scans and incremental data sets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import bundles, cursor, daytable, labels
from tidemark.plans import bindings as b
from tidemark.plans.market import _LABELS
from tidemark.plans.registry import NUDGE, SQL, common, query, rnd, rnd_nudged, sql_round
from tidemark.session import scratch_path

_START, _MIDDLE, _END = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 10, 12), dt.datetime(2024, 1, 20, 6)
_TODAY = dt.date(2024, 1, 20)


def _store(spark, sf) -> dict[str, bundles.Table]:
    """Four tables with clocks of their own; every seventh candle is a cached one, every fifth still open."""
    minute = F.minute("open_time")
    cached = b.candles(spark, sf).withColumn("source_name", F.when(minute % 7 == 0, bundles.CACHE_SOURCE).when(minute % 7 == 1, "feed"))
    candles = cached.withColumn("is_closed", minute % 5 != 0).select("symbol", "open_time", "close", "source_name", "is_closed")
    events = b.table(spark, sf, "events").select("event_id", F.col("ts").alias("event_time"), "value")
    articles = b.article_rows(spark, sf).select("article_id", "available_at", "source", F.length("text").alias("size"))
    signals = b.observation_rows(spark, sf).select("seq", "timestamp", "symbol", "prediction", F.col("label_available_time").alias("created_at"))
    return {
        "candles": bundles.Table(candles, ("symbol", "open_time")), "events": bundles.Table(events, ("event_id",)),
        "articles": bundles.Table(articles, ("article_id",)), "signals": bundles.Table(signals, ("seq",)),
        "regions": bundles.Table(b.table(spark, sf, "region"), ("r_regionkey",)),
    }


common(
    "store",
    """SELECT 'candles' AS table_name, open_time AS t FROM candles WHERE minute(open_time) % 7 <> 0 AND minute(open_time) % 5 <> 0
    UNION ALL SELECT 'events', ts FROM events UNION ALL SELECT 'articles', available_at FROM articles UNION ALL SELECT 'signals', timestamp FROM observations""",
)


@query(
    "bundle_manifest",
    f"""SELECT table_name, CAST(t AS DATE) AS day, count(*) AS rows, min(t) AS first_time, max(t) AS last_time, CASE WHEN CAST(t AS DATE) < DATE '{_TODAY}' THEN 'finished' ELSE 'unfinished' END AS status
      FROM store WHERE t >= TIMESTAMP '{_START}' AND t < TIMESTAMP '{_END}' GROUP BY ALL""",
    uses="ticks candles articles observations store",
)
def bundle_manifest(spark, sf):
    """Two ranges that share half a day, written one after the other: facts of whole days, as the writes observed them."""
    base = scratch_path(spark, "bundle")
    tables = _store(spark, sf)
    bundles.write_bundle(spark, base, tables, _START, _MIDDLE + dt.timedelta(hours=6), _TODAY)
    found = bundles.write_bundle(spark, base, tables, _MIDDLE, _END, _TODAY)
    return found.select("table_name", "day", "rows", "first_time", "last_time", "status")


@query(
    "bundle_finished_days",
    f"SELECT event_id, ts AS event_time, value FROM events WHERE ts >= TIMESTAMP '{_START}' AND ts < TIMESTAMP '{_TODAY}'",
)
def bundle_finished_days(spark, sf):
    """The events of a bundle of finished days; the day that goes on is left out."""
    base = scratch_path(spark, "finished")
    tables = {"events": _store(spark, sf)["events"]}
    bundles.write_bundle(spark, base, tables, _START, _END, _TODAY, include_unfinished=False)
    return bundles.read_table(spark, base, "events")


@query(
    "lake_day_scan",
    """SELECT event_id, CAST(ts AS DATE) AS day, 'table=events/day=' || strftime(ts, '%Y-%m-%d') AS folder, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS file_row
      FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""",
)
def lake_day_scan(spark, sf):
    """One table of a lake over eight days, each row with its folder and its place in the file."""
    root = scratch_path(spark, "lake")
    events = b.table(spark, sf, "events").select("event_id", "value", "ts", F.to_date("ts").alias("day"))
    events.repartition("day").sortWithinPartitions("day", "event_id").withColumn("table", F.lit("events")).write.partitionBy("table", "day").parquet(root)
    other = b.article_rows(spark, sf).select(F.col("article_id").alias("event_id"), F.lit(0.0).alias("value"), F.col("available_at").alias("ts"))
    other.withColumn("day", F.to_date("ts")).withColumn("table", F.lit("articles")).write.mode("append").partitionBy("table", "day").parquet(root)
    found = bundles.scan_lake(spark, root, "events", dt.date(2024, 1, 5), dt.date(2024, 1, 12))
    return found.select("event_id", "day", F.regexp_extract("file", "(table=[^/]+/day=[^/]+)/", 1).alias("folder"), "file_row")


_FEE = 0.0004


def replayed_rows(candles: DataFrame) -> DataFrame:
    """Labels of every candle and what each action would have earned: one data set row per action."""
    made = labels.labels_by_time(candles.withColumn("as_of", F.col("close_time")), _FEE)
    known = made.where("target_future_return_15m IS NOT NULL AND target_max_drawdown_1h IS NOT NULL")
    return labels.replay_rewards(known, F.col("target_future_return_15m"), F.col("target_max_drawdown_1h"), ["symbol", "as_of", "target_future_return_15m"], _FEE)


def dataset_job(spark, candles: DataFrame, base: str, dataset_version: str = "v1") -> tuple[list[dt.date], int]:
    """Labels, replay and export of what changed since the last run; labels look two days ahead at most."""
    return cursor.rebuild(candles, "open_time", base, replayed_rows, "as_of", before=0, after=2, dataset_version=dataset_version, feature_version="labels-1", label_time="as_of")


@query(
    "incremental_dataset_rows",
    f"""WITH l AS ({SQL['labels_time_offsets'].replace('symbol, as_of, ' + sql_round(_LABELS), '*')}),
      k AS (SELECT *, round(target_future_return_15m, 6) + 0.0 AS shown FROM l WHERE target_future_return_15m IS NOT NULL AND target_max_drawdown_1h IS NOT NULL)
      SELECT symbol, as_of, shown AS target_future_return_15m, 'BUY' AS action, round(target_future_return_15m - {2 * _FEE} + least(target_max_drawdown_1h, 0) * 0.25 + {NUDGE}, 5) + 0.0 AS reward FROM k
      UNION ALL SELECT symbol, as_of, shown, 'HOLD', round(-abs(target_future_return_15m) * 0.15 + {NUDGE}, 5) + 0.0 FROM k""",
)
def incremental_dataset_rows(spark, sf):
    """A first run on part of the candles, one of them wrong; a second on all; a third that finds nothing to do."""
    base = scratch_path(spark, "dataset")
    candles = b.candles(spark, sf)
    wrong = F.col("open_time").between(dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 8, 12))
    early = candles.where(F.col("open_time") < F.lit(dt.datetime(2024, 1, 25))).withColumn("close", F.when(wrong, F.col("close") * 1.5).otherwise(F.col("close")))
    for rows in (early, candles, candles):
        written = dataset_job(spark, rows, base)
    if written != ([], 0):
        raise RuntimeError(f"an unchanged snapshot wrote {written[1]} rows")
    out = daytable.current(spark, f"{base}/rows")
    return out.select("symbol", "as_of", rnd("target_future_return_15m").alias("target_future_return_15m"), "action", rnd_nudged("reward", 5).alias("reward"))
