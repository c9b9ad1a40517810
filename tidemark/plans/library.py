"""Labelled-document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import text as tx
from tidemark.operators import documents as dc
from tidemark.plans import bindings as b
from tidemark.plans.newsroom import structured_articles
from tidemark.plans.registry import common, query, rnd
from tidemark.session import checkpointed

common("taught", "SELECT doc_id, text, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM documents JOIN labels USING (doc_id)")
common(
    "taught_tokens",
    "SELECT quality, toxic, token, count(*) AS n FROM (SELECT quality, toxic, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token FROM taught) GROUP BY ALL",
)
common("vocab", "SELECT token FROM taught_tokens GROUP BY token ORDER BY sum(n) DESC, token")
common(
    "tcounts",
    """SELECT task, label, token, sum(n) AS n FROM (SELECT 'quality' AS task, quality AS label, token, n FROM taught_tokens UNION ALL SELECT 'toxic', toxic, token, n FROM taught_tokens) WHERE token IN (SELECT token FROM vocab) GROUP BY ALL""",
)
common(
    "tfacts",
    """SELECT r.task, r.label, r.rows, CAST(coalesce(t.n, 0) AS BIGINT) AS token_total, (SELECT count(*) FROM vocab) AS vocabulary_size, CAST(sum(r.rows) OVER (PARTITION BY r.task) AS BIGINT) AS task_rows, count(*) OVER (PARTITION BY r.task) AS labels
FROM (SELECT 'quality' AS task, quality AS label, count(*) AS rows FROM taught GROUP BY quality UNION ALL SELECT 'toxic', toxic, count(*) FROM taught GROUP BY toxic) r LEFT JOIN (SELECT task, label, sum(n) AS n FROM tcounts GROUP BY ALL) t ON t.task = r.task AND t.label = r.label""",
)
common(
    "tscores",
    """SELECT doc_id, task, label, ln((rows + 1) / (task_rows + labels)) + coalesce(gain, 0) - size * ln(greatest(1, token_total + vocabulary_size)) AS score FROM (
  SELECT d.doc_id, d.size, f.*, g.gain FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS size FROM documents) d CROSS JOIN tfacts f
  LEFT JOIN (SELECT x.doc_id, c.task, c.label, sum(x.n * ln(c.n + 1)) AS gain FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token FROM documents) GROUP BY ALL) x JOIN tcounts c ON c.token = x.token GROUP BY ALL) g
    ON g.doc_id = d.doc_id AND g.task = f.task AND g.label = f.label)""",
)


def _student(spark, sf) -> dc.TextStudent:
    docs = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id")
    return dc.TextStudent(docs, "doc_id", "text", ["quality", "toxic"])


@query("text_student_facts", "SELECT * FROM tfacts", uses="taught taught_tokens vocab tcounts tfacts")
def text_student_facts(spark, sf):
    return _student(spark, sf).facts()


@query("text_student_token_counts", "SELECT task, label, token, CAST(n AS BIGINT) AS n FROM tcounts", uses="taught taught_tokens vocab tcounts")
def text_student_token_counts(spark, sf):
    return _student(spark, sf).token_counts


_ST = "taught taught_tokens vocab tcounts tfacts tscores"


@query(
    "text_student_predictions",
    """SELECT doc_id, task, label AS predicted, round(p, 6) + 0.0 AS probability FROM (
      SELECT doc_id, task, label, 1 / sum(exp(score - top)) OVER (PARTITION BY doc_id, task) AS p, row_number() OVER (PARTITION BY doc_id, task ORDER BY score DESC, label) AS r
      FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, task) AS top FROM tscores)) WHERE r = 1""",
    uses=_ST,
)
def text_student_predictions(spark, sf):
    out = _student(spark, sf).predict(b.table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", "task", "predicted", rnd("probability").alias("probability"))


@query(
    "text_student_accuracy",
    """WITH p AS (SELECT doc_id, task, label, row_number() OVER (PARTITION BY doc_id, task ORDER BY score DESC, label) AS r FROM tscores)
      SELECT task, count(*) AS rows, round(avg(CAST(p.label = CASE task WHEN 'quality' THEN quality ELSE toxic END AS DOUBLE)), 6) + 0.0 AS accuracy,
        round(avg(abs(CAST(p.label AS DOUBLE) - CAST(CASE task WHEN 'quality' THEN quality ELSE toxic END AS DOUBLE))), 6) + 0.0 AS mean_absolute_error FROM p JOIN taught USING (doc_id) WHERE r = 1 GROUP BY task""",
    uses=_ST,
)
def text_student_accuracy(spark, sf):
    docs = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id")
    out = _student(spark, sf).predict(docs, "doc_id", "text").join(b.table(spark, sf, "labels"), "doc_id")
    truth = F.when(F.col("task") == "quality", F.col("quality")).otherwise(F.col("toxic"))
    return out.groupBy("task").agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.avg((F.col("predicted") == truth.cast("string")).cast("double"))).alias("accuracy"),
        rnd(F.avg(F.abs(F.col("predicted").cast("double") - truth))).alias("mean_absolute_error"),
    )


@query(
    "label_keywords",
    """SELECT quality, token, n FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, token) AS r FROM (SELECT quality, token, CAST(sum(n) AS BIGINT) AS n FROM taught_tokens GROUP BY ALL)) WHERE r <= 12""",
    uses="taught taught_tokens",
)
def label_keywords(spark, sf):
    docs = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id").withColumn("quality", F.col("quality").cast("string"))
    return dc.label_keywords(docs, "doc_id", "text", "quality").select("quality", "token", "n")


def _hashed(spark, sf) -> DataFrame:
    docs = b.article_rows(spark, sf)
    return docs.select("article_id", "text", F.date_trunc("hour", "available_at").cast("timestamp_ntz").alias("available_hour"), F.sha2(F.trim("text"), 256).alias("content_hash"))


common("hashed", "SELECT article_id, text, date_trunc('hour', available_at) AS available_hour, sha256(trim(text, ' ')) AS content_hash FROM articles")


@query(
    "documents_first_seen",
    "SELECT article_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY available_hour, article_id) AS n FROM hashed) WHERE n = 1",
    uses="articles hashed",
)
def documents_first_seen(spark, sf):
    return dc.first_seen(_hashed(spark, sf), "content_hash", "available_hour", ["article_id"]).select("article_id", "content_hash")


@query(
    "content_identity_hashes",
    "SELECT article_id, sha256(CASE WHEN contains(text, chr(10) || chr(10)) THEN trim(substr(text, 1, instr(text, chr(10) || chr(10)) - 1), ' ') || chr(10) || trim(substr(text, instr(text, chr(10) || chr(10)) + 2), ' ') ELSE trim(text, ' ') END) AS identity FROM articles",
    uses="articles",
)
def content_identity_hashes(spark, sf):
    return b.article_rows(spark, sf).select("article_id", dc.content_identity(F.col("text")).alias("identity"))


@query(
    "content_hash_collisions",
    """SELECT declared, count(*) AS rows FROM (SELECT n_chars AS declared, sha256(text) AS h FROM articles) GROUP BY declared HAVING count(DISTINCT h) > 1""",
    uses="articles",
)
def content_hash_collisions(spark, sf):
    docs = b.article_rows(spark, sf).select(F.col("n_chars").alias("declared"), F.sha2("text", 256).alias("h"))
    return dc.hash_collisions(docs, "declared", "h")


@query(
    "chronological_document_parts",
    """WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY available_hour, article_id) AS n FROM hashed) WHERE n = 1),
      e AS (SELECT available_hour AS t, sum(count(*)) OVER (ORDER BY available_hour) AS x, sum(count(*)) OVER () AS total FROM u GROUP BY available_hour),
      s AS (SELECT a.x AS a, b.x AS b, abs(a.x - 0.7 * a.total) + abs(b.x - a.x - 0.15 * a.total) + abs(a.total - b.x - 0.15 * a.total) AS score FROM e a JOIN e b ON a.x < b.x AND b.x < a.total),
      m AS (SELECT a, b FROM s ORDER BY score, a, b LIMIT 1)
      SELECT u.article_id, CASE WHEN e.x <= m.a THEN 'train' WHEN e.x <= m.b THEN 'validation' ELSE 'holdout' END AS part FROM u JOIN e ON e.t = u.available_hour, m""",
    uses="articles hashed",
)
def chronological_document_parts(spark, sf):
    unique = dc.first_seen(_hashed(spark, sf).drop("text"), "content_hash", "available_hour", ["article_id"])
    return dc.partition_by_time(unique, "available_hour").select("article_id", "part")


def _label_rows(spark, sf) -> DataFrame:
    """Teacher labels as a stored table: written once, so that the checks read
    plain columns instead of re-deriving the labels for every rule."""
    i = F.col("article_id")
    rows = checkpointed(structured_articles(spark, sf))
    return rows.select(
        "article_id", "title", "text", F.when(i % 17 == 0, "not a number").otherwise(F.col("sentiment").cast("string")).alias("sentiment"),
        (F.col("severity") + F.when(i % 19 == 0, 1.0).otherwise(0.0)).alias("severity"), "importance", "novelty", "confidence",
        F.when(i % 23 == 0, "gossip").otherwise(F.upper("event_type")).alias("event_type"), F.when(i % 29 == 0, "positive").otherwise(F.col("direction")).alias("direction"),
        F.when(i % 31 == 0, "near-term").otherwise(F.col("time_horizon")).alias("time_horizon"),
        F.when(i % 2 == 0, F.array(F.lit("9999"))).otherwise(tx.numbers(F.col("title"))).alias("claim_numbers"),
        F.transform("affected_assets", lambda a: F.when(i % 13 == 0, F.concat(F.lower(a), F.lit("/usdt"))).when(i % 37 == 0, F.concat(a, F.lit("!"))).otherwise(a)).alias("affected_assets"),
    )


@query(
    "label_validation_rejects",
    """WITH r AS (SELECT article_id, text, severity, confidence, regexp_extract_all(text, '(^|[^A-Za-z0-9_])([-+]?\\d+(?:,\\d{3})*(?:\\.\\d+)?%?)', 2) AS nums FROM structured)
      SELECT article_id, concat_ws('; ', CASE WHEN article_id % 17 = 0 THEN 'sentiment must be numeric' END, CASE WHEN article_id % 19 = 0 THEN 'severity must be between 0.0 and 1.0' END, CASE WHEN article_id % 23 = 0 THEN 'event_type is not allowed' END,
        CASE WHEN confidence < 0.5 THEN 'confidence is below the configured minimum' END, CASE WHEN article_id % 2 = 0 AND NOT list_contains(list_transform(nums, lambda v: rtrim(replace(v, ',', ''), '%')), '9999') THEN 'claims state unverified numbers' END) AS reasons
      FROM r WHERE article_id % 17 = 0 OR article_id % 19 = 0 OR article_id % 23 = 0 OR confidence < 0.5 OR (article_id % 2 = 0 AND NOT list_contains(list_transform(nums, lambda v: rtrim(replace(v, ',', ''), '%')), '9999'))""",
    uses="articles news structured",
)
def label_validation_rejects(spark, sf):
    rows = _label_rows(spark, sf).withColumn("reasons", dc.label_rejects(0.5, True))
    return rows.where(F.size("reasons") > 0).select("article_id", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "structured_event_normaliser",
    """SELECT article_id, CASE WHEN article_id % 23 = 0 THEN 'gossip' ELSE event_type END AS event_type, CASE WHEN article_id % 29 = 0 THEN 'bullish' ELSE direction END AS direction, CASE WHEN article_id % 31 = 0 THEN 'short_term' ELSE time_horizon END AS time_horizon,
      coalesce(array_to_string(list_transform(affected_assets, lambda a: CASE WHEN article_id % 13 = 0 THEN a || 'USDT' WHEN article_id % 37 = 0 THEN NULL ELSE a END), ','), '') AS assets,
      CASE WHEN article_id % 37 = 0 AND article_id % 13 <> 0 AND len(affected_assets) > 0 THEN 'invalid asset symbol' ELSE '' END AS asset_reasons FROM structured""",
    uses="articles news structured",
)
def structured_event_normaliser(spark, sf):
    out = dc.normal_event(_label_rows(spark, sf))
    return out.select(
        "article_id", "event_type", "direction", "time_horizon", F.array_join("assets", ",").alias("assets"), F.array_join("asset_reasons", ",").alias("asset_reasons")
    )


@query(
    "student_dataset_rows",
    """WITH r AS (SELECT h.article_id, h.content_hash, s.confidence FROM hashed h JOIN structured s USING (article_id) WHERE s.confidence >= 0.45)
      SELECT article_id, content_hash, round(CAST(confidence AS DOUBLE), 6) + 0.0 AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY article_id) AS n FROM r) WHERE n = 1""",
    uses="articles news structured hashed",
)
def student_dataset_rows(spark, sf):
    # Written once, two numbers a row: a filter on what is derived would be pushed down to the texts, where it splits them again for each list of words.
    sure = checkpointed(structured_articles(spark, sf).select("article_id", "confidence"))
    rows = _hashed(spark, sf).drop("text").join(sure, "article_id").where(F.col("confidence") >= 0.45)
    return dc.first_seen(rows, "content_hash", "article_id", []).select("article_id", "content_hash", rnd("confidence").alias("confidence"))


@query(
    "source_homogeneity",
    "SELECT 'provider' AS field, count(DISTINCT provider) AS versions, min(provider) AS first_version, count(DISTINCT provider) = 1 AS homogeneous FROM articles UNION ALL SELECT 'model', count(DISTINCT source), min(source), count(DISTINCT source) = 1 FROM articles",
    uses="articles",
)
def source_homogeneity(spark, sf):
    return dc.homogeneous(b.article_rows(spark, sf), {"provider": "provider", "model": "source"})


@query(
    "article_dedup",
    """WITH d AS (SELECT article_id, source, provider, 'u' || CAST(article_id % 300 AS VARCHAR) AS url, 't' || CAST(article_id % 350 AS VARCHAR) AS title, published_at FROM articles),
      old AS (SELECT * FROM d WHERE article_id < 100), fresh AS (SELECT * FROM d WHERE article_id >= 100),
      n AS (SELECT f.* FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE (o.source = f.source AND o.url = f.url) OR (o.provider = f.provider AND o.url = f.url) OR (o.provider = f.provider AND o.title = f.title AND o.published_at = f.published_at)))
      SELECT article_id FROM (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY article_id) AS a, row_number() OVER (PARTITION BY provider, url ORDER BY article_id) AS b FROM n) WHERE a = 1 AND b = 1""",
    uses="articles",
)
def article_dedup(spark, sf):
    i = F.col("article_id")
    d = b.article_rows(spark, sf).select(
        "article_id", "source", "provider", F.concat(F.lit("u"), (i % 300).cast("string")).alias("url"), F.concat(F.lit("t"), (i % 350).cast("string")).alias("title"), "published_at"
    )
    return dc.new_articles(d.where(i >= 100), d.where(i < 100), "article_id").select("article_id")
