"""Split, fold, fit, candidate and independence queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import fit, folds, independence as ind
from tidemark.plans import bindings as b
from tidemark.plans.registry import common, query, rnd, sql_round
from tidemark.session import checkpointed


def research_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as labelled feature rows with a linear target plus a bounded disturbance."""
    k = F.get_json_object("props", "$.k").cast("double")
    x1, x2, x3 = k / 100.0, F.col("value") / 500.0, (F.col("user_id") % 50) / F.lit(50.0)
    noise = ((F.col("event_id") * 7919) % 101 - 50) / F.lit(5000.0)
    return b.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").alias("timestamp"), F.col("event_type").alias("symbol"),
        x1.alias("price_change"), x2.alias("volatility"), x3.alias("risk_score"),
        (0.065 * x1 - 0.03 * x2 + noise).alias("target"),
        (F.col("ts") + F.expr("interval 15 minutes")).alias("label_available_time"),
    )


common(
    "research_rows",
    """
SELECT event_id AS seq, ts AS timestamp, event_type AS symbol, k / 100 AS price_change, value / 500 AS volatility,
  CAST(user_id % 50 AS DOUBLE) / 50 AS risk_score,
  CAST(0.065 AS DOUBLE) * k / 100 - CAST(0.03 AS DOUBLE) * value / 500 + CAST((event_id * 7919) % 101 - 50 AS DOUBLE) / 5000 AS target,
  ts + INTERVAL 15 MINUTES AS label_available_time
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
""",
)


@query(
    "chronological_split",
    """WITH r AS (SELECT event_id, date_trunc('hour', ts) AS hour FROM events),
      o AS (SELECT *, row_number() OVER (ORDER BY hour, event_id) AS rn, count(*) OVER () AS n FROM r),
      e1 AS (SELECT max(rn) AS a FROM o WHERE hour = (SELECT hour FROM o WHERE rn = greatest(1, CAST(floor(n * 0.6) AS BIGINT)))),
      e2 AS (SELECT max(rn) AS b FROM o WHERE hour = (SELECT hour FROM o, e1 WHERE rn = greatest(a, CAST(floor(n * 0.8) AS BIGINT))))
      SELECT event_id, CASE WHEN rn <= a THEN 'train' WHEN rn <= b THEN 'validation' ELSE 'test' END AS split FROM o, e1, e2""",
)
def chronological_split(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return folds.chronological_split(rows, "hour", "event_id").select("event_id", "split")


def _fold_summary(df):
    return df.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.sum("seq").alias("seq_sum"),
    ).select(F.col("fold").cast("long").alias("fold"), "role", "rows", "first_ts", "last_ts", "seq_sum")


@query(
    "purged_folds",
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY timestamp, seq) - 1 AS pos, count(*) OVER () AS n FROM research_rows),
      f AS (SELECT i AS fold, n - (n - 100) // 5 * 5 + i * ((n - 100) // 5) AS s, (n - 100) // 5 AS size FROM (SELECT any_value(n) AS n FROM o), range(5) r(i)),
      t AS (SELECT f.*, o.timestamp AS tt FROM f JOIN o ON o.pos = f.s),
      x AS (SELECT fold, CASE WHEN pos >= s THEN 'test' WHEN label_available_time > tt THEN 'purged' WHEN s - pos <= 40 THEN 'embargoed'
          WHEN tt - timestamp <= INTERVAL 4 HOURS THEN 'purged' ELSE 'train' END AS role, o.timestamp, o.seq
        FROM t JOIN o ON o.pos < s + size),
      kept AS (SELECT fold AS old, row_number() OVER (ORDER BY fold) - 1 AS fold FROM (SELECT fold FROM x WHERE role = 'train' GROUP BY fold HAVING count(*) >= 100))
      SELECT kept.fold, role, count(*) AS rows, min(timestamp) AS first_ts, max(timestamp) AS last_ts, CAST(sum(seq) AS BIGINT) AS seq_sum FROM x JOIN kept ON kept.old = x.fold GROUP BY kept.fold, role""",
    uses="research_rows",
)
def purged_folds(spark, sf):
    rows = research_rows(spark, sf)
    return _fold_summary(
        folds.purged_folds(rows, "timestamp", "seq", "label_available_time", 5, 100, purge=dt.timedelta(hours=4), embargo=40)
    )


_WALK = dict(
    train=dt.timedelta(days=10), validation=dt.timedelta(days=1), test=dt.timedelta(days=3), step=dt.timedelta(days=3),
    purge=dt.timedelta(hours=2), embargo=dt.timedelta(hours=1),
)


def _walk_sql(train_from: str) -> str:
    return f"""WITH RECURSIVE o AS (SELECT seq, timestamp, label_available_time FROM research_rows),
      f AS (
        SELECT 0 AS fold, (SELECT min(timestamp) FROM o WHERE timestamp >= (SELECT min(timestamp) FROM o) + INTERVAL 10 DAYS) AS te
        UNION ALL
        SELECT fold + 1, (SELECT min(timestamp) FROM o WHERE timestamp >= f.te + INTERVAL 3 DAYS) FROM f WHERE f.te IS NOT NULL
      ),
      g AS (SELECT fold, te, (SELECT min(timestamp) FROM o WHERE timestamp >= te + INTERVAL 2 HOURS) AS vs,
        (SELECT max(timestamp) FROM o WHERE timestamp < te) AS last_train FROM f WHERE te IS NOT NULL),
      h AS (SELECT *, (SELECT min(timestamp) FROM o WHERE timestamp >= vs + INTERVAL 1 DAY) AS ve FROM g WHERE vs IS NOT NULL),
      j AS (SELECT *, (SELECT min(timestamp) FROM o WHERE timestamp >= ve + INTERVAL 1 HOUR) AS tst FROM h WHERE ve IS NOT NULL),
      k AS (SELECT *, tst + INTERVAL 3 DAYS AS tend FROM j WHERE tst IS NOT NULL),
      x AS (SELECT fold, o.timestamp, o.seq, CASE
          WHEN o.timestamp < te THEN CASE WHEN NOT ({train_from}) THEN NULL WHEN label_available_time > tst THEN 'purged' ELSE 'train' END
          WHEN o.timestamp < vs THEN 'purged' WHEN o.timestamp < ve THEN 'validation' WHEN o.timestamp < tst THEN 'embargoed'
          WHEN o.timestamp < tend THEN 'test' END AS role FROM k CROSS JOIN o)
      SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS rows, min(timestamp) AS first_ts, max(timestamp) AS last_ts, CAST(sum(seq) AS BIGINT) AS seq_sum
      FROM x WHERE role IS NOT NULL GROUP BY fold, role"""


@query("walk_forward_expanding", _walk_sql("true"), uses="research_rows")
def walk_forward_expanding(spark, sf):
    rows = research_rows(spark, sf)
    plan = folds.walk_forward_folds(rows, "timestamp", **_WALK)
    return _fold_summary(folds.fold_roles(folds.with_positions(rows, "timestamp", "seq"), plan, "label_available_time"))


@query("walk_forward_rolling", _walk_sql("o.timestamp >= last_train - INTERVAL 10 DAYS"), uses="research_rows")
def walk_forward_rolling(spark, sf):
    rows = research_rows(spark, sf)
    plan = folds.walk_forward_folds(rows, "timestamp", expanding=False, **_WALK)
    return _fold_summary(folds.fold_roles(folds.with_positions(rows, "timestamp", "seq"), plan, "label_available_time"))


@query(
    "purge_before_period",
    """SELECT seq, timestamp FROM research_rows WHERE timestamp < TIMESTAMP '2024-01-20' AND label_available_time <= TIMESTAMP '2024-01-20'""",
    uses="research_rows",
)
def purge_before_period(spark, sf):
    start = F.expr("timestamp_ntz'2024-01-20'")
    rows = research_rows(spark, sf).where(F.col("timestamp") < start)
    return folds.purge_before(rows, "label_available_time", start).select("seq", "timestamp")


_FEATURES = ["price_change", "volatility", "risk_score"]


def _model_rows(spark, model) -> DataFrame:
    return [*zip(model.features, model.coefficients), ("intercept", model.intercept)]


def _scored(rows: DataFrame, model) -> DataFrame:
    terms = F.array(*[F.struct(F.lit(n).alias("term"), F.lit(v).alias("value")) for n, v in _model_rows(None, model)])
    error = F.col("target") - model.predict()
    stats = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")
    )
    return stats.withColumn("t", F.explode(terms)).select(
        F.col("t.term").alias("term"), rnd("t.value").alias("value"), "rows", rnd("mae").alias("mae"), rnd("rmse").alias("rmse")
    )


@query(
    "ridge_fit",
    """WITH m AS (SELECT count(*) AS n, avg(price_change) AS m1, avg(volatility) AS m2, avg(target) AS my,
        stddev_pop(price_change) AS s1, stddev_pop(volatility) AS s2 FROM research_rows),
      g AS (SELECT any_value(n) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, any_value(s1) AS s1, any_value(s2) AS s2,
        sum((price_change - m1) / s1 * (volatility - m2) / s2) AS c12, sum((price_change - m1) / s1 * (target - my)) AS c1y,
        sum((volatility - m2) / s2 * (target - my)) AS c2y FROM research_rows, m),
      s AS (SELECT *, (n + 1.0) * (n + 1.0) - c12 * c12 AS det FROM g),
      w AS (SELECT *, (c1y * (n + 1.0) - c12 * c2y) / det / s1 AS w1, (c2y * (n + 1.0) - c12 * c1y) / det / s2 AS w2 FROM s),
      c AS (SELECT w1, w2, my - w1 * m1 - w2 * m2 AS b0 FROM w),
      e AS (SELECT count(*) AS rows, avg(abs(target - b0 - w1 * price_change - w2 * volatility)) AS mae,
        sqrt(avg((target - b0 - w1 * price_change - w2 * volatility) ** 2)) AS rmse FROM research_rows, c)
      SELECT t.term, round(t.value, 6) + 0.0 AS value, rows, round(mae, 6) + 0.0 AS mae, round(rmse, 6) + 0.0 AS rmse FROM e,
      (SELECT 'price_change' AS term, w1 AS value FROM c UNION ALL SELECT 'volatility', w2 FROM c UNION ALL SELECT 'intercept', b0 FROM c) t""",
    uses="research_rows",
)
def ridge_fit(spark, sf):
    rows = research_rows(spark, sf)
    return _scored(rows, fit.fit_ridge(rows, _FEATURES[:2], "target", 1.0))


@query(
    "gradient_descent_fit",
    """WITH RECURSIVE m AS (SELECT avg(price_change) AS a1, avg(volatility) AS a2, avg(target) AS ay, avg(price_change * price_change) AS a11,
        avg(price_change * volatility) AS a12, avg(volatility * volatility) AS a22, avg(price_change * target) AS a1y, avg(volatility * target) AS a2y FROM research_rows),
      d AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS w1, CAST(0.01 AS DOUBLE) AS w2
        UNION ALL SELECT k + 1, b0 - 0.1 * (b0 + w1 * a1 + w2 * a2 - ay), w1 - 0.1 * (b0 * a1 + w1 * a11 + w2 * a12 - a1y),
          w2 - 0.1 * (b0 * a2 + w1 * a12 + w2 * a22 - a2y) FROM d, m WHERE k < 500),
      c AS (SELECT * FROM d WHERE k = 500),
      e AS (SELECT count(*) AS rows, avg(abs(target - b0 - w1 * price_change - w2 * volatility)) AS mae,
        sqrt(avg((target - b0 - w1 * price_change - w2 * volatility) ** 2)) AS rmse FROM research_rows, c)
      SELECT t.term, round(t.value, 6) + 0.0 AS value, rows, round(mae, 6) + 0.0 AS mae, round(rmse, 6) + 0.0 AS rmse FROM e,
      (SELECT 'price_change' AS term, w1 AS value FROM c UNION ALL SELECT 'volatility', w2 FROM c UNION ALL SELECT 'intercept', b0 FROM c) t""",
    uses="research_rows",
)
def gradient_descent_fit(spark, sf):
    rows = research_rows(spark, sf)
    return _scored(rows, fit.gradient_descent(rows, _FEATURES[:2], "target", start={"volatility": 0.01}))


@query("huber_fit")
def huber_fit(spark, sf):
    rows = research_rows(spark, sf)
    return _scored(rows, fit.fit_huber(rows, _FEATURES, "target", 1.0))


@query(
    "observed_numeric_features",
    """SELECT name AS feature FROM (SELECT unnest([{'name': 'price_change', 'n': count(*) FILTER (WHERE isfinite(price_change))}, {'name': 'volatility', 'n': count(*) FILTER (WHERE isfinite(volatility))},
        {'name': 'name_text', 'n': count(TRY_CAST(symbol AS DOUBLE))}, {'name': 'symbol_rank', 'n': count(TRY_CAST(CAST(length(symbol) AS VARCHAR) AS DOUBLE))}, {'name': 'empty', 'n': 0}], recursive := true) FROM research_rows) WHERE n > 0""",
    uses="research_rows",
)
def observed_numeric_features(spark, sf):
    rows = research_rows(spark, sf).select(
        "price_change", "volatility", F.col("symbol").alias("name_text"), F.length("symbol").cast("string").alias("symbol_rank"),
        F.lit(None).cast("double").alias("empty"),
    )
    found = fit.usable_features(rows, rows.columns)
    return spark.createDataFrame([(c,) for c in found], "feature string")


_FAMILIES = {
    "momentum": ["price_change"], "volatility": ["volatility", "risk_score"], "baseline": None, "missing": ["not_there"],
}


def _candidate_scores(spark, sf) -> DataFrame:
    rows = research_rows(spark, sf)
    usable = fit.usable_features(rows, _FEATURES)
    grid, _ = fit.candidate_grid(_FAMILIES, usable)
    plan = folds.walk_forward_folds(rows, "timestamp", **_WALK)
    # Numbered once: the moments and every pass over the scores start from these rows.  A row becomes as many as there
    # are candidates, so they are dealt over all tasks, in runs of neighbours.
    runs = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(folds.with_positions(rows, "timestamp", "seq").repartition(runs, F.floor(F.col("pos") / 8192)))
    return fit.score_candidates(placed, plan, grid, "target", "label_available_time")


@query("candidate_grid_ranking")
def candidate_grid_ranking(spark, sf):
    scored = _candidate_scores(spark, sf)
    obs = scored.select(
        "candidate_id", "seq", "timestamp", "prediction", F.col("target").alias("actual_return"),
        F.lit(None).cast("double").alias("position"), F.lit(0.0008).alias("transaction_cost"), F.lit(300.0).alias("holding_seconds"),
    )
    metrics = ev.evaluate(obs, ["candidate_id"], horizon_seconds=300.0)
    error = F.col("target") - F.col("prediction")
    errors = scored.groupBy("candidate_id").agg(
        F.avg(F.abs(error)).alias("mean_absolute_error"), F.sqrt(F.avg(error * error)).alias("root_mean_squared_error")
    )
    return fit.rank_candidates(metrics.join(errors, "candidate_id")).select(
        "candidate_id", "observation_count", rnd("information_coefficient").alias("information_coefficient"),
        rnd("net_expectancy").alias("net_expectancy"), rnd("directional_hit_rate").alias("directional_hit_rate"),
        rnd("root_mean_squared_error").alias("root_mean_squared_error"), rnd("mean_absolute_error").alias("mean_absolute_error"),
    )


#: The registered signals, in the order in which they came.
_SIGNALS = ["s0", "s1", "s2", "s3", "s4"]


def signal_rows(spark, sf):
    """Observations as signals on an hourly grid."""
    return b.observation_rows(spark, sf).withColumn("signal_id", F.concat(F.lit("s"), (F.col("seq") % 5).cast("string"))).withColumn(
        "timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
    )


common(
    "signal_series",
    """
SELECT signal_id, timestamp, avg(prediction) AS prediction, avg(position) AS position, avg(pnl) AS pnl, avg(drawdown) AS drawdown FROM (
  SELECT *, 1 - exp(leq - greatest(0, max(leq) OVER (PARTITION BY signal_id ORDER BY timestamp, seq))) AS drawdown FROM (
    SELECT *, sum(ln(1 + pnl)) OVER (PARTITION BY signal_id ORDER BY timestamp, seq) AS leq FROM (
      SELECT 's' || CAST(seq % 5 AS VARCHAR) AS signal_id, date_trunc('hour', timestamp) AS timestamp, seq, prediction,
        CAST(sign(prediction) AS DOUBLE) AS position, sign(prediction) * actual_return - transaction_cost AS pnl FROM observations)))
GROUP BY signal_id, timestamp
""",
)

_PAIR_VALUES = [
    "prediction_correlation", "position_correlation", "pnl_correlation", "drawdown_correlation", "trade_overlap", "feature_overlap",
    "maximum_absolute_correlation",
]
_PAIRS_SQL = f"""
    fam AS (SELECT signal_id, CASE WHEN signal_id IN ('s0', 's1') THEN ['price', 'news'] WHEN signal_id = 's2' THEN ['price', 'flow'] ELSE ['macro', signal_id] END AS ff
      FROM (SELECT DISTINCT signal_id FROM signal_series)),
    pr AS (SELECT l.signal_id AS left_signal_id, r.signal_id AS right_signal_id, count(*) AS aligned_observations,
      corr(l.prediction, r.prediction) AS prediction_correlation, corr(l.position, r.position) AS position_correlation,
      corr(l.pnl, r.pnl) AS pnl_correlation, corr(l.drawdown, r.drawdown) AS drawdown_correlation,
      count(*) FILTER (WHERE l.position <> 0 AND r.position <> 0) AS both_n
      FROM signal_series l JOIN signal_series r ON l.timestamp = r.timestamp AND l.signal_id < r.signal_id GROUP BY ALL),
    ac AS (SELECT signal_id, count(*) FILTER (WHERE position <> 0) AS n FROM signal_series GROUP BY signal_id),
    o AS (SELECT pr.*, both_n / (a.n + c.n - both_n) AS trade_overlap,
      len(list_intersect(f.ff, g.ff)) / len(list_distinct(list_concat(f.ff, g.ff))) AS feature_overlap,
      greatest(abs(prediction_correlation), abs(position_correlation), abs(pnl_correlation), abs(drawdown_correlation)) AS maximum_absolute_correlation
      FROM pr JOIN ac a ON a.signal_id = left_signal_id JOIN ac c ON c.signal_id = right_signal_id
      JOIN fam f ON f.signal_id = left_signal_id JOIN fam g ON g.signal_id = right_signal_id)"""


def _families(spark, sf):
    s = F.col("signal_id")
    return signal_rows(spark, sf).select("signal_id").distinct().select(
        "signal_id",
        F.when(s.isin("s0", "s1"), F.array(F.lit("price"), F.lit("news"))).when(s == "s2", F.array(F.lit("price"), F.lit("flow")))
        .otherwise(F.array(F.lit("macro"), s)).alias("feature_families"),
    )


def _pairs(spark, sf):
    series = ind.by_timestamp(signal_rows(spark, sf))
    return ind.pair_correlations(series, _families(spark, sf))


@query(
    "signal_independence_pairs",
    f"WITH {_PAIRS_SQL} SELECT left_signal_id, right_signal_id, aligned_observations, {sql_round(_PAIR_VALUES)} FROM o",
    uses="observations signal_series",
)
def signal_independence_pairs(spark, sf):
    return _pairs(spark, sf).select(
        "left_signal_id", "right_signal_id", "aligned_observations", *[rnd(c).alias(c) for c in _PAIR_VALUES]
    )


@query(
    "correlated_signal_groups",
    f"""WITH RECURSIVE {_PAIRS_SQL},
      e AS (SELECT left_signal_id AS a, right_signal_id AS b FROM o WHERE maximum_absolute_correlation >= 0.15 OR feature_overlap >= 0.15),
      l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT signal_id, signal_id FROM fam),
      r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
      g AS (SELECT a AS signal_id, min(b) AS group_id FROM r GROUP BY a)
      SELECT group_id, signal_id, count(*) OVER (PARTITION BY group_id) AS members FROM g QUALIFY count(*) OVER (PARTITION BY group_id) > 1""",
    uses="observations signal_series",
)
def correlated_signal_groups(spark, sf):
    return ind.correlated_groups(_pairs(spark, sf), threshold=0.15)


@query(
    "saturation_curve",
    f"""WITH w AS (SELECT timestamp, {", ".join(f"max(pnl) FILTER (WHERE signal_id = '{i}') AS p_{i}" for i in _SIGNALS)} FROM signal_series GROUP BY timestamp HAVING count(*) = {len(_SIGNALS)}),
      s AS ({" UNION ALL ".join(f"SELECT timestamp, {n} AS k, CAST({'(' + ' + '.join(f'p_{i}' for i in _SIGNALS[:n]) + f') / {n}' if n else '0'} AS DOUBLE) AS r FROM w" for n in range(len(_SIGNALS) + 1))}),
      q AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY k ORDER BY timestamp) AS leq FROM s),
      d AS (SELECT *, 1 - exp(leq - greatest(0, max(leq) OVER (PARTITION BY k ORDER BY timestamp))) AS dd FROM q),
      m AS (SELECT k AS signal_count, count(*) AS observation_count, avg(r) AS net_expectancy, exp(sum(ln(1 + r))) - 1 AS total_return,
        avg(r) / nullif(stddev_samp(r), 0) * sqrt(365.25 * 24) AS sharpe_ratio, max(dd) AS maximum_drawdown FROM d GROUP BY k),
      g AS (SELECT *, net_expectancy - lag(net_expectancy) OVER w AS mn, sharpe_ratio - lag(sharpe_ratio) OVER w AS ms, total_return - lag(total_return) OVER w AS mt
        FROM m WINDOW w AS (ORDER BY signal_count))
      SELECT signal_count, observation_count, round(net_expectancy, 6) + 0.0 AS net_expectancy, round(total_return, 6) + 0.0 AS total_return, round(sharpe_ratio, 6) + 0.0 AS sharpe_ratio,
        round(maximum_drawdown, 6) + 0.0 AS maximum_drawdown, round(mn, 6) + 0.0 AS marginal_net_expectancy, round(ms, 6) + 0.0 AS marginal_sharpe_ratio,
        round(mt, 6) + 0.0 AS marginal_total_return, signal_count > 0 AND (mn IS NULL OR mn <= 0) AS saturated,
        coalesce(signal_count > 1 AND mn < lag(mn) OVER (ORDER BY signal_count), false) AS diminishing_return FROM g""",
    uses="observations signal_series",
)
def saturation_curve(spark, sf):
    series = ind.by_timestamp(signal_rows(spark, sf))
    out = ind.saturation_curve(series, _SIGNALS, horizon_seconds=3600.0)
    values = ["net_expectancy", "total_return", "sharpe_ratio", "maximum_drawdown", "marginal_net_expectancy", "marginal_sharpe_ratio", "marginal_total_return"]
    return out.select(
        "signal_count", "observation_count", *[rnd(v).alias(v) for v in values], "saturated",
        F.coalesce("diminishing_return", F.lit(False)).alias("diminishing_return"),
    )
