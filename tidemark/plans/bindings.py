"""The given tables seen as market, news and ledger tables (and the same in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.bars import resample_ticks
from tidemark.plans.registry import common


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it is stored; files are split by ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows stored in fewer splits than there are cores (a small file) dealt evenly, ahead of work on whole texts or much work a row; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        "event_id",
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("quantity"),
    )


common(
    "ticks",
    """
SELECT event_type AS symbol, ts, event_id, value AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity
FROM events
""",
)


def candles(spark: SparkSession, sf_dir: str, seconds: int = 60) -> DataFrame:
    """One-minute candles of the tick table; unique per (symbol, open_time)."""
    return resample_ticks(ticks(spark, sf_dir), seconds, tie="event_id").withColumn("is_closed", F.lit(True))


common(
    "candles",
    """
SELECT symbol, date_trunc('minute', ts) AS open_time,
       first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts, event_id) AS close, sum(quantity) AS volume, count(*) AS trades,
       date_trunc('minute', ts) + INTERVAL '59.999 seconds' AS close_time, true AS is_closed
FROM ticks GROUP BY symbol, date_trunc('minute', ts)
""",
)


def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: published a minute apart, usable seven minutes later."""
    published = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id, 0)")
    return (
        dealt(table(spark, sf_dir, "documents"))
        .withColumn("published_at", published)
        .select(
            F.col("doc_id").alias("article_id"),
            "source",
            F.col("lang").alias("provider"),
            "text",
            "n_chars",
            "published_at",
            (F.col("published_at") + F.expr("interval 7 minutes")).alias("available_at"),
        )
    )


common(
    "articles",
    """
SELECT doc_id AS article_id, source, lang AS provider, text, n_chars,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS published_at,
       TIMESTAMP '2024-01-01 00:07:00' + to_minutes(doc_id) AS available_at
FROM documents
""",
)


def external_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as long metric facts; a null symbol means market wide."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.lit("feed").alias("source_name"),
        F.col("event_type").alias("data_type"),
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string"))).alias(
            "symbol"
        ),
        F.col("ts").alias("event_time"),
        F.col("value").alias("numeric_value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


common(
    "external",
    """
SELECT event_id, 'feed' AS source_name, event_type AS data_type,
       CASE WHEN user_id % 10 <> 0 THEN 'S' || CAST(user_id % 10 AS VARCHAR) END AS symbol,
       ts AS event_time, value AS numeric_value,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
FROM events
""",
)


def observation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evaluated signals: a forecast, the outcome and its cost."""
    k = F.get_json_object("props", "$.k").cast("double")
    return dealt(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")).select(
        F.col("event_id").alias("seq"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("symbol"),
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model_family"),
        F.when(k < 30, "calm").when(k < 60, "trend").when(k < 90, "stress").alias("regime"),
        (((F.col("event_id") * 37) % 201 - 100) / F.lit(10000.0)).alias("prediction"),
        ((k - 50.0) / 5000.0).alias("actual_return"),
        F.lit(None).cast("double").alias("position"),
        (F.lit(0.0004) + F.col("value") * 1e-7).alias("transaction_cost"),
        F.lit(None).cast("double").alias("holding_seconds"),
        F.when(F.col("user_id") % 3 == 0, True).when(F.col("user_id") % 3 == 1, False).alias("external_ai_available"),
        (F.col("ts") - F.expr("interval 5 seconds")).alias("available_to_model_time"),
        (F.col("ts") + F.expr("interval 15 minutes")).alias("label_available_time"),
    )


common(
    "observations",
    """
SELECT event_id AS seq, ts AS timestamp, event_type AS symbol, 'm' || CAST(user_id % 4 AS VARCHAR) AS model_family,
       CASE WHEN k < 30 THEN 'calm' WHEN k < 60 THEN 'trend' WHEN k < 90 THEN 'stress' END AS regime,
       CAST((event_id * 37) % 201 - 100 AS DOUBLE) / 10000 AS prediction, (k - 50) / 5000 AS actual_return,
       CAST(0.0004 AS DOUBLE) + value * CAST(1e-7 AS DOUBLE) AS transaction_cost,
       CASE WHEN user_id % 3 = 0 THEN true WHEN user_id % 3 = 1 THEN false END AS external_ai_available,
       ts - INTERVAL 5 SECONDS AS available_to_model_time, ts + INTERVAL 15 MINUTES AS label_available_time
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
""",
)


# Invented headlines, so that the keyword rules meet words they know.
HEADLINES = [
    "Bitcoin rally sets record as spot ETF approved", "Exchange hack drains bridge wallet, funds stolen",
    "Fed cuts rates as inflation eases, dollar falls", "SEC sues exchange over lawsuit and regulation breach",
    "Ethereum upgrade: validator staking growth of 12.5%", "Solana halts after exploit, 1,250 users hit",
    "Ripple partnership expands adoption", "False rumor: team denies hack, not hacked", "Stablecoin depeg fear, tether reserve probe",
    "Liquidation cascade wipes 300 million", "Quiet market day", "Bankruptcy filing shocks, war sanction risk 7%",
]


def news_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with an invented title and the document as body."""
    titles = F.array(*[F.lit(h) for h in HEADLINES])
    return (
        article_rows(spark, sf_dir)
        .withColumn("title", F.element_at(titles, (F.col("article_id") % len(HEADLINES) + 1).cast("int")))
        .withColumn("text", F.concat_ws("\n", "title", "text"))
    )


common(
    "news",
    "SELECT a.* REPLACE (list_extract([" + ", ".join("'" + h.replace("'", "''") + "'" for h in HEADLINES)
    + f"], CAST(article_id % {len(HEADLINES)} + 1 AS INTEGER)) || chr(10) || text AS text), "
    + "list_extract([" + ", ".join("'" + h.replace("'", "''") + "'" for h in HEADLINES)
    + f"], CAST(article_id % {len(HEADLINES)} + 1 AS INTEGER)) AS title FROM articles a",
)

MARKET = {"click": "BTCUSDT", "view": "ETHUSDT", "purchase": "SOLUSDT", "signup": "BNBUSDT", "error": "DOGEUSDT"}


def market_symbol(column: str = "symbol"):
    pairs = [F.lit(x) for item in MARKET.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.col(column))


common("market", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in MARKET.items()) + ") m(kind, symbol)")
