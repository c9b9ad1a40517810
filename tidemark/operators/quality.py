"""Data-quality checks that return issue rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import finite
from tidemark.operators.series import BLOCK, lag_across, micros, range_blocks, running_last


def _issue(code: str, severity: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def candle_issues(
    candles: DataFrame, seq: str, now: Column, interval_seconds: int, outlier: float = 0.50, stale_seconds: float | None = None,
) -> DataFrame:
    """Issues of a candle feed in arrival order ``seq``.

    Columns of the result: code, severity, symbol, seq, open_time, estimated_missing.
    """
    dated = candles.where(F.col("open_time").isNotNull())
    undated = candles.where(F.col("open_time").isNull()).select(
        F.lit("MISSING_TIMESTAMP").alias("code"), F.lit("ERROR").alias("severity"), "symbol", F.col(seq).alias("seq"), "open_time",
        F.lit(None).cast("long").alias("estimated_missing"),
    )
    arrived = lag_across(
        range_blocks(dated, ["symbol"], [seq]), ["symbol"], [seq],
        {"p_time": F.col("open_time"), "p_good": F.when(F.col("close") > 0, F.col("close"))},
    )
    arrived = range_or_keep(arrived, seq)
    known = running_last(arrived, ["symbol"], [F.col(seq)], F.col("p_good"), "prior_close")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    row_codes = F.array_compact(
        F.array(
            _issue("NON_MONOTONIC_TIMESTAMP", "ERROR", F.col("open_time") <= F.col("p_time")),
            _issue("FUTURE_TIMESTAMP", "ERROR", F.col("open_time") > now + F.expr("interval 5 seconds")),
            _issue(
                "INVALID_OHLC", "ERROR",
                (F.least("open", "high", "low", "close") < 0) | (F.col("high") < top) | (F.col("low") > bottom) | (F.col("high") < F.col("low")),
            ),
            _issue("NEGATIVE_VOLUME", "ERROR", F.col("volume") < 0),
            _issue(
                "PRICE_OUTLIER", "WARNING",
                (F.col("close") > 0) & (F.col("prior_close") > 0) & (F.abs(F.col("close") / F.when(F.col("prior_close") > 0, F.col("prior_close")) - 1.0) > outlier),
            ),
        )
    )
    by_row = known.withColumn("i", F.explode(row_codes)).select(
        "i.code", "i.severity", "symbol", F.col(seq).alias("seq"), "open_time", F.lit(None).cast("long").alias("estimated_missing")
    )
    timed = lag_across(
        range_blocks(dated, ["symbol"], ["open_time", seq]), ["symbol"], ["open_time", seq],
        {"p_time": F.col("open_time"), "p_values": F.struct("open", "high", "low", "close", "volume")},
    )
    same = F.col("open_time") == F.col("p_time")
    gap = (micros("open_time") - micros("p_time")) / 1e6
    step = float(interval_seconds)
    time_codes = F.array_compact(
        F.array(
            _issue("DUPLICATE_CANDLE", "ERROR", same),
            _issue("REVISED_VALUE", "WARNING", same & (F.struct("open", "high", "low", "close", "volume") != F.col("p_values"))),
            _issue("MISSING_CANDLE_INTERVAL", "WARNING", gap > 1.5 * step),
        )
    )
    by_time = timed.withColumn("i", F.explode(time_codes)).select(
        "i.code", "i.severity", "symbol", F.col(seq).alias("seq"), "open_time",
        F.when(F.col("i.code") == "MISSING_CANDLE_INTERVAL", F.greatest(F.bround(gap / step).cast("long") - 1, F.lit(1))).alias("estimated_missing"),
    )
    out = by_row.unionByName(by_time).unionByName(undated)
    if stale_seconds is not None:
        newest = dated.agg(F.max("open_time").alias("open_time"))
        stale = newest.where(
            F.col("open_time").isNull() | ((micros(now) - micros("open_time")) / 1e6 > stale_seconds)
        ).select(
            F.lit("STALE_FEED").alias("code"), F.lit("ERROR").alias("severity"), F.lit(None).cast("string").alias("symbol"),
            F.lit(None).cast("long").alias("seq"), "open_time", F.lit(None).cast("long").alias("estimated_missing"),
        )
        out = out.unionByName(stale)
    return out


def range_or_keep(df: DataFrame, seq: str) -> DataFrame:
    """Rows that already carry a block column keep it."""
    return df if BLOCK in df.columns else range_blocks(df, ["symbol"], [seq])


def candle_gaps(candles: DataFrame, interval_seconds: int, seq: str | None = None) -> DataFrame:
    """Missing stretches of each series with the estimated number of bars."""
    order = ["open_time", *([seq] if seq else [])]
    timed = lag_across(range_blocks(candles, ["symbol"], order), ["symbol"], order, {"gap_from": F.col("open_time")})
    gap = (micros("open_time") - micros("gap_from")) / 1e6
    return timed.where(gap > 1.5 * interval_seconds).select(
        "symbol", "gap_from", F.col("open_time").alias("gap_to"),
        F.greatest(F.bround(gap / interval_seconds).cast("long") - 1, F.lit(1)).alias("estimated_missing"),
    )


def feature_issues(
    rows: DataFrame, key: str, values: str, required: Sequence[str], allowed: Sequence[str], reference: DataFrame | None = None,
    max_z: float = 6.0, provider: str | None = None,
) -> DataFrame:
    """Issues of feature maps: missing, outside the schema, not finite, far from training.

    ``reference`` has one row per feature (feature, mean, std); feature names are
    a registry of bounded size.
    """
    present = F.map_keys(F.map_filter(values, lambda k, x: x.isNotNull()))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), present))
    extra = F.array_sort(F.array_except(F.map_keys(values), F.array(*[F.lit(a) for a in allowed])))
    none = F.lit(None).cast("string")
    cells = [
        F.when(F.size(missing) > 0, _cell("MISSING_REQUIRED_FEATURES", "ERROR", F.array_join(missing, ","))),
        F.when(F.size(extra) > 0, _cell("SCHEMA_DRIFT", "WARNING", F.array_join(extra, ","))),
    ]
    if provider:
        cells.append(F.when(F.col(provider).isNull() | (F.col(provider) == ""), _cell("MISSING_PROVIDER_DATA", "WARNING", none)))
    out = rows.select(key, F.explode(F.array_compact(F.array(*cells))).alias("i")).select(key, "i.*")
    if reference is not None:
        # The reference has one row per registered feature; size is the schema's.
        long = rows.select(key, F.explode(values).alias("feature", "v")).where(F.col("v").isNotNull())
        met = long.join(reference, "feature")
        bad = finite("v").isNull() | finite("mean").isNull() | finite("std").isNull()
        far = ~bad & (F.col("std") > 0) & (F.abs(F.col("v") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")) > max_z)
        code = F.when(bad, F.struct(F.lit("NON_FINITE_FEATURE").alias("code"), F.lit("ERROR").alias("severity"))).when(
            far, F.struct(F.lit("FEATURE_OUTLIER").alias("code"), F.lit("WARNING").alias("severity"))
        )
        out = out.unionByName(
            met.withColumn("i", code).where(F.col("i").isNotNull()).select(key, "i.code", "i.severity", F.col("feature").alias("detail"))
        )
    return out


def _cell(code: str, severity: str, detail: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail"))


def news_availability_issues(articles: DataFrame, key: str, available: Column, decision: Column) -> DataFrame:
    code = F.when(available.isNull(), "MISSING_AVAILABILITY_TIME").when(available > decision, "FUTURE_NEWS_LEAKAGE")
    return articles.select(key, code.alias("code")).where(F.col("code").isNotNull())


def snapshot_check(features: DataFrame, key: str, available: Column, decision: Column, freshness_hours: str, required: Mapping[str, Column]) -> DataFrame:
    """Usable snapshots: availability, missing inputs and per-source ages in seconds."""
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in required.items()]))
    ages = F.map_filter(
        F.transform_values(freshness_hours, lambda k, h: F.greatest(h * 3600.0, F.lit(0.0))), lambda k, s: s.isNotNull()
    )
    return features.select(
        key, (available > decision).alias("leaks"), missing.alias("missing_required"), ages.alias("freshness_seconds"),
        F.array_max(F.map_values(ages)).alias("oldest_seconds"),
    )


def manifest_facts(
    tables: Mapping[str, tuple[DataFrame, str, str | None, Sequence[str]]]
) -> DataFrame:
    """Rows, time range, symbols and an order-free content hash per table.

    The hash is the sum of 60-bit row digests, as text: a decimal sum cannot overflow.  In a row's text a
    null is a mark of its own, and separators inside values are escaped, so different rows have different texts.

    Each table is read once with map-side aggregation.  ``tables`` maps a name to
    (rows, time column, symbol column, hashed columns).
    """
    parts = None
    for name, (df, time, symbol, columns) in tables.items():
        escaped = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        digest = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(escaped(c), F.lit("\\N")) for c in columns])), 1, 15), 16, 10).cast("long")
        one = df.agg(
            F.count(F.lit(1)).alias("row_count"), F.min(time).alias("first_timestamp"), F.max(time).alias("last_timestamp"),
            (F.countDistinct(symbol) if symbol else F.lit(0).cast("long")).alias("symbols"),
            F.coalesce(F.sum(digest.cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("content_hash"),
        ).select(F.lit(name).alias("table_name"), "*")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def continuity(rows: DataFrame, seq: str, seconds: int, time: str = "open_time") -> DataFrame:
    """Per symbol, in the order of ``seq``: rows that are not later than the one before, gaps of more than one and a half steps, and intervals missing in them."""
    blocks = range_blocks(rows.select("symbol", seq, time), ["symbol"], [seq])
    step = (micros(time) - micros("__p")) / 1e6
    moved = lag_across(blocks, ["symbol"], [seq], {"__p": F.col(time)}).where("__p IS NOT NULL").withColumn("__s", step)
    gap = F.col("__s") > seconds * 1.5
    lost = F.greatest(F.round(F.col("__s") / seconds) - 1, F.lit(1.0))
    return moved.groupBy("symbol").agg(
        F.count_if(F.col("__s") <= 0).alias("order_errors"), F.count_if(gap).alias("gaps"), F.coalesce(F.sum(F.when(gap, lost)), F.lit(0.0)).cast("long").alias("missing_intervals")
    )


def manifest_mismatches(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences between stated and recomputed facts, one row per broken fact."""
    left = manifest.select("table_name", F.struct(*[c for c in manifest.columns if c != "table_name"]).alias("m"))
    right = actual.select("table_name", F.struct(*[c for c in actual.columns if c != "table_name"]).alias("a"))
    both = left.join(right, "table_name", "full_outer")
    checks = F.array_compact(
        F.array(
            F.when(F.col("m").isNull(), "NOT_IN_MANIFEST"), F.when(F.col("a").isNull(), "MISSING_TABLE"),
            F.when(F.col("m.row_count") != F.col("a.row_count"), "ROW_COUNT_MISMATCH"),
            F.when(F.col("m.first_timestamp") != F.col("a.first_timestamp"), "FIRST_TIMESTAMP_MISMATCH"),
            F.when(F.col("m.last_timestamp") != F.col("a.last_timestamp"), "LAST_TIMESTAMP_MISMATCH"),
            F.when(F.col("m.content_hash") != F.col("a.content_hash"), "CHECKSUM_MISMATCH"),
        )
    )
    return both.select("table_name", F.explode(checks).alias("error"))


def manifest_issues(manifests: DataFrame) -> DataFrame:
    """Problems of manifest rows (manifest_id, row_counts, checksums, writers_closed, unfinished_days, mode)."""
    split = F.coalesce(F.col("mode") == "daily_split", F.lit(False))
    codes = F.array_compact(
        F.array(
            F.when(F.col("row_counts").isNull(), "MISSING_ROW_COUNTS"),
            F.when(~split & F.col("checksums").isNull(), "MISSING_FILE_CHECKSUMS"),
            F.when(~split & ~F.coalesce(F.col("writers_closed"), F.lit(False)), "UNCONFIRMED_FILE_CLOSE"),
            F.when(F.coalesce(F.size("unfinished_days"), F.lit(0)) > 0, "INCOMPLETE_DAILY_BUNDLE"),
        )
    )
    return manifests.select("manifest_id", F.explode(codes).alias("code"))


def dataset_report(rows: DataFrame, fee_rate: float = 0.0004) -> DataFrame:
    """One-row quality report of a labelled dataset, leakage computed from the clocks."""
    flag = lambda c: F.avg(c.cast("double"))
    dup = rows.groupBy("symbol", "as_of").agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.sum("extra").alias("duplicate_rows"))
    main = rows.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count("target_trade_quality_score").alias("labeled_rows"),
        ((F.max(micros("as_of")) - F.min(micros("as_of"))) / 86400e6).alias("date_range_days"),
        F.countDistinct("symbol").alias("symbols"),
        flag((F.abs("sentiment_score") + F.abs("risk_score") + F.abs("impact_score")) == 0).alias("news_zero_pct"),
        (flag(F.col("article_count_used") > 0) * 100).alias("news_coverage_percentage"),
        (flag(F.col("external_event_count_24h") > 0) * 100).alias("external_coverage_percentage"),
        F.count(F.when(F.col("target_direction_15m") > 0, 1)).alias("rows_up"),
        F.count(F.when(F.col("target_direction_15m") < 0, 1)).alias("rows_down"),
        F.count(F.when(F.col("target_direction_15m") == 0, 1)).alias("rows_flat"),
        F.coalesce(F.max(F.col("inputs_available_at") > F.col("as_of")), F.lit(False)).alias("future_leakage_detected"),
    )
    # Both sides are single rows.
    both = main.withColumn("__one", F.lit(0)).join(dup.withColumn("__one", F.lit(0)), "__one").drop("__one")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("news_zero_pct") > 0.80, "TOO_MANY_ZERO_NEWS_ROWS"), F.when(F.col("labeled_rows") < 1000, "FEW_LABELED_ROWS"),
            F.when(F.col("date_range_days") < 2, "SHORT_DATE_RANGE"), F.when(F.col("duplicate_rows") > 0, "DUPLICATE_ROWS"),
        )
    )
    return both.withColumn("warnings", warnings)
