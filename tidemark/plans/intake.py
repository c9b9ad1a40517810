"""Missing history, rows of unknown shape, and exchangeable text scorers."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import scorer
from tidemark.operators import coverage
from tidemark.plans import bindings as b
from tidemark.plans.registry import common, query, rnd
from tidemark.session import scratch_path
from tidemark.sources import permissive

_FROM, _TO = dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 9)
_BARS = (_TO - _FROM) // dt.timedelta(minutes=1)

common(
    "gap_runs",
    f"""WITH h AS (SELECT symbol, open_time FROM candles WHERE open_time >= TIMESTAMP '{_FROM}' AND open_time < TIMESTAMP '{_TO}'),
      s AS (SELECT DISTINCT symbol FROM candles UNION SELECT 'never'),
      m AS (SELECT symbol, t AS open_time FROM s, generate_series(TIMESTAMP '{_FROM}', TIMESTAMP '{_TO}' - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE) g(t) WHERE (symbol, t) NOT IN (SELECT (symbol, open_time) FROM h)),
      g AS (SELECT *, open_time - to_minutes(row_number() OVER (PARTITION BY symbol ORDER BY open_time)) AS k FROM m)
    SELECT symbol, min(open_time) AS first_missing, max(open_time) AS last_missing, count(*) AS missing FROM g GROUP BY symbol, k""",
)


def _symbols(spark, sf) -> DataFrame:
    return b.candles(spark, sf).select("symbol").distinct().union(spark.createDataFrame([("never",)], "symbol string"))


def _runs(spark, sf) -> DataFrame:
    return coverage.gap_runs(b.candles(spark, sf), _symbols(spark, sf), _FROM, _TO)


@query("candle_gap_runs", "SELECT * FROM gap_runs", uses="ticks candles gap_runs")
def candle_gap_runs(spark, sf):
    return _runs(spark, sf)


@query(
    "candle_missing_bars",
    "SELECT symbol, unnest(generate_series(first_missing, last_missing, INTERVAL 1 MINUTE)) AS open_time FROM gap_runs",
    uses="ticks candles gap_runs",
)
def candle_missing_bars(spark, sf):
    return coverage.missing_bars(_runs(spark, sf))


@query(
    "candle_coverage",
    f"""SELECT symbol, CAST({_BARS} AS BIGINT) AS expected, CAST({_BARS} - coalesce(sum(missing), 0) AS BIGINT) AS available, CAST(coalesce(sum(missing), 0) AS BIGINT) AS missing, count(missing) AS runs, coalesce(max(missing), 0) AS longest_run,
      CASE WHEN {_BARS} - coalesce(sum(missing), 0) >= 200 THEN 'ready' ELSE 'partial' END AS status FROM gap_runs GROUP BY symbol""",
    uses="ticks candles gap_runs",
)
def candle_coverage(spark, sf):
    return coverage.coverage(_runs(spark, sf), _symbols(spark, sf), _FROM, _TO, 200)


@query(
    "history_fill",
    f"SELECT symbol, open_time, close FROM candles WHERE open_time >= TIMESTAMP '{_FROM}' AND open_time < TIMESTAMP '{_TO}' AND minute(open_time) % 3 = 0",
    uses="ticks candles",
)
def history_fill(spark, sf):
    """Fetched bars, some of them twice, of which only those absent from the store go in."""
    candles = b.candles(spark, sf).select("symbol", "open_time", "close")
    held = candles.where(F.minute("open_time") % 3 != 0)
    return coverage.absent_only(candles.unionByName(candles), held, _FROM, _TO)


def _text(column) -> F.Column:
    return F.col(column).cast("string") if isinstance(column, str) else column.cast("string")


def _objects() -> F.Column:
    """An event as a JSON object with a nested list."""
    inner = F.struct(F.col("user_id").alias("user"), F.array(F.col("event_id"), F.col("event_id") + 1).alias("pair"))
    return F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value"), inner.alias("inner")))


_FIELDS = {"id": ("$.id", "bigint"), "kind": ("$.kind", "string"), "value": ("$.value", "double"), "user": ("$.inner.user", "bigint"), "second": ("$.inner.pair[1]", "bigint"), "none": ("$.absent", "int")}


@query(
    "json_line_variants",
    """SELECT CASE WHEN ok THEN event_id END AS id, CASE WHEN ok THEN event_type END AS kind, CASE WHEN ok THEN value END AS value, CASE WHEN ok THEN user_id END AS user, CASE WHEN ok THEN event_id + 1 END AS second,
      CAST(NULL AS INTEGER) AS none, CASE WHEN event_id % 13 = 0 THEN '{"id": ' || event_id WHEN event_id % 17 = 0 THEN '[' || event_id || ']' END AS bad_record FROM (SELECT *, event_id % 13 <> 0 AND event_id % 17 <> 0 AS ok FROM events)""",
)
def json_line_variants(spark, sf):
    path = scratch_path(spark, "lines")
    i = F.col("event_id")
    line = F.when(i % 13 == 0, F.concat(F.lit('{"id": '), _text("event_id"))).when(i % 17 == 0, F.concat(F.lit("["), _text("event_id"), F.lit("]"))).otherwise(_objects())
    b.table(spark, sf, "events").select(line.alias("value")).write.option("compression", "gzip").text(path)
    return permissive.typed(permissive.json_lines(spark, path), _FIELDS)


@query(
    "json_array_variants",
    """WITH e AS (SELECT *, event_id // 400 AS file FROM events)
      SELECT event_id AS id, event_type AS kind, value, user_id AS user, event_id + 1 AS second, CAST(NULL AS INTEGER) AS none, false AS broken FROM e WHERE file % 5 <> 3 AND event_id % 19 <> 0
      UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true FROM e WHERE file % 5 <> 3 AND event_id % 19 = 0
      UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true FROM e WHERE file % 5 = 3 GROUP BY file""",
)
def json_array_variants(spark, sf):
    """Arrays of four hundred elements; every nineteenth element is a number, every fifth file ends too early."""
    path = scratch_path(spark, "arrays")
    i = F.col("event_id")
    item = F.when(i % 19 == 0, _text("event_id")).otherwise(_objects())
    files = b.table(spark, sf, "events").groupBy(F.floor(i / 400).alias("file")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    end = F.when(F.col("file") % 5 == 3, "").otherwise("]")
    # One array a file: lines of a file would be one text when read whole.
    files.select("file", F.concat(F.lit("["), "items", end).alias("value")).write.partitionBy("file").text(path)
    out = permissive.typed(permissive.json_array(spark, path), _FIELDS)
    return out.select(*_FIELDS, F.col("bad_record").isNotNull().alias("broken"))


@query(
    "csv_cell_variants",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id END AS user, CASE WHEN event_id % 4 = 1 THEN event_id END AS first_of_list, CASE WHEN event_id % 4 = 2 THEN event_id % 8 = 2 END AS flag,
      CASE WHEN event_id % 4 = 3 THEN '{broken ' || event_id END AS text FROM events""",
)
def csv_cell_variants(spark, sf):
    """One column of objects, lists, booleans and texts that only look like JSON."""
    path = scratch_path(spark, "cells")
    i = F.col("event_id")
    held = (
        F.when(i % 4 == 0, F.to_json(F.struct(F.col("user_id").alias("user")))).when(i % 4 == 1, F.to_json(F.array(i, i + 1)))
        .when(i % 4 == 2, F.when(i % 8 == 2, "True").otherwise("FALSE")).otherwise(F.concat(F.lit("{broken "), _text("event_id")))
    )
    b.table(spark, sf, "events").select("event_id", held.alias("cell")).write.option("header", True).option("escape", '"').csv(path)
    rows = permissive.csv_cells(spark, path)
    get = lambda p, kind: F.try_variant_get("cell", p, kind)
    kind = F.schema_of_variant("cell")
    return rows.select(
        F.try_variant_get("event_id", "$", "string").cast("long").alias("event_id"), get("$.user", "bigint").alias("user"), get("$[0]", "bigint").alias("first_of_list"),
        F.when(kind == "BOOLEAN", get("$", "boolean")).alias("flag"), F.when(kind == "STRING", get("$", "string")).alias("text"),
    )


def _letters(one: str, other: str, names: tuple[str, str, str]):
    """A model that needs loading in name only: shares of two letters, and the rest."""

    def load() -> scorer.Model:
        def model(texts: pd.Series) -> pd.DataFrame:
            n = texts.str.len().clip(lower=1)
            a, c = texts.str.count(one) / n, texts.str.count(other) / n
            return pd.DataFrame({names[0]: a, names[1]: c, names[2]: 1 - a - c})

        return model

    return load


def _share(letter: str) -> str:
    return f"(length(text) - length(replace(text, '{letter}', ''))) / greatest(length(text), 1)"


@query(
    "pluggable_text_scores",
    f"""WITH s AS (SELECT doc_id, {_share('a')} AS p, {_share('e')} AS n, {_share('i')} AS u, {_share('o')} AS d, CASE WHEN contains(text, 'ban') THEN 0.3 ELSE 0.0 END AS topic FROM documents),
      m AS (SELECT *, greatest(-1, least(1, greatest(-1, least(1, p - n)) * 0.55 + greatest(-1, least(1, u - d)) * 0.45)) AS mixed, greatest(p, n, 1 - p - n) AS ca, greatest(u, d, 1 - u - d) AS cb FROM s)
      SELECT doc_id, round(mixed, 6) + 0.0 AS sentiment_score, round(greatest(ca, cb), 6) + 0.0 AS sentiment_confidence, round(least(1, greatest(n, d, topic)), 6) + 0.0 AS risk_score, round(greatest(abs(mixed), ca * 0.5, cb * 0.5), 6) + 0.0 AS impact_score FROM m""",
)
def pluggable_text_scores(spark, sf):
    """Two exchangeable models over whole texts, one as a column function and one from SQL, and their blend."""
    first = scorer.text_scorer("letters-ae", _letters("a", "e", ("positive", "negative", "neutral")), dict.fromkeys(("positive", "negative", "neutral"), "double"))
    scorer.register(spark, "letters_io", _letters("i", "o", ("bullish", "bearish", "neutral")), dict.fromkeys(("bullish", "bearish", "neutral"), "double"))
    rows = b.table(spark, sf, "documents").select("doc_id", "text").withColumn("topic", F.when(F.col("text").contains("ban"), 0.3).otherwise(0.0))
    out = scorer.smart_scores(rows, first("text"), F.expr("letters_io(text)"), {"topic": F.col("topic")})
    return out.select("doc_id", *[rnd(c).alias(c) for c in ("sentiment_score", "sentiment_confidence", "risk_score", "impact_score")])
