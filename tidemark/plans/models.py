"""Models fitted per fold and per regime, and what acting on them would have given."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import scores as sc
from tidemark.operators import foldfit, folds, reports as rp, trees
from tidemark.plans import bindings as b
from tidemark.plans.desk import _SIM, _simulate_sql
from tidemark.plans.learning import _FEATURES, _WALK, _walk_sql, research_rows
from tidemark.plans.registry import common, query, rnd, sql_round
from tidemark.plans.scoring import _MASKS, regimes
from tidemark.session import scratch_path

_FOLD_SQL = _walk_sql("true").replace("SELECT CAST(fold AS BIGINT) AS fold, role, count(*)", "@@").split("@@")[0].rstrip()

_FOLD_RIDGE = (
    _FOLD_SQL
    + """,
      z AS (SELECT x.fold, x.role, r.* FROM x JOIN research_rows r ON r.seq = x.seq WHERE x.role IN ('train', 'test')),
      m AS (SELECT fold, count(*) AS n, avg(price_change) AS m1, avg(volatility) AS m2, avg(target) AS my, stddev_pop(price_change) AS s1, stddev_pop(volatility) AS s2
        FROM z WHERE role = 'train' GROUP BY fold),
      gg AS (SELECT z.fold, any_value(n) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, any_value(s1) AS s1, any_value(s2) AS s2,
        sum((price_change - m1) / s1 * (volatility - m2) / s2) AS c12, sum((price_change - m1) / s1 * (target - my)) AS c1y, sum((volatility - m2) / s2 * (target - my)) AS c2y
        FROM z JOIN m ON m.fold = z.fold WHERE role = 'train' GROUP BY z.fold),
      dd AS (SELECT *, (n + 1.0) * (n + 1.0) - c12 * c12 AS det FROM gg),
      w AS (SELECT *, (c1y * (n + 1.0) - c12 * c2y) / det / s1 AS w1, (c2y * (n + 1.0) - c12 * c1y) / det / s2 AS w2 FROM dd),
      p AS (SELECT z.fold, n, z.seq, target, my - w1 * m1 - w2 * m2 + w1 * price_change + w2 * volatility AS prediction FROM z JOIN w ON w.fold = z.fold WHERE role = 'test')
      """
)


def _placed(spark, sf):
    rows = research_rows(spark, sf)
    plan = folds.walk_forward_folds(rows, "timestamp", **_WALK)
    return folds.with_positions(rows, "timestamp", "seq"), plan


@query(
    "fold_estimator_scores",
    _FOLD_RIDGE + "SELECT fold, count(*) AS test_rows, round(avg(abs(target - prediction)), 6) + 0.0 AS mae, round(sqrt(avg((target - prediction) ** 2)), 6) + 0.0 AS rmse, round(avg(prediction), 6) + 0.0 AS mean_prediction FROM p GROUP BY fold",
    uses="research_rows",
)
def fold_estimator_scores(spark, sf):
    placed, plan = _placed(spark, sf)
    scores = foldfit.out_of_fold(placed, plan, "label_available_time", estimator=lambda: foldfit.Ridge(tuple(_FEATURES[:2]), "target", 1.0))
    error = F.col("target") - F.col("prediction")
    return scores.groupBy("fold").agg(
        F.count(F.lit(1)).alias("test_rows"), rnd(F.avg(F.abs(error))).alias("mae"), rnd(F.sqrt(F.avg(error * error))).alias("rmse"), rnd(F.avg("prediction")).alias("mean_prediction")
    )


@query(
    "fold_callback_predictions",
    _FOLD_SQL
    + """,
      y AS (SELECT x.fold, r.symbol, avg(r.target) AS mean_target FROM x JOIN research_rows r ON r.seq = x.seq WHERE x.role = 'train' GROUP BY x.fold, r.symbol),
      v AS (SELECT x.fold, avg(r.target) AS bias FROM x JOIN research_rows r ON r.seq = x.seq WHERE x.role = 'validation' GROUP BY x.fold)
      SELECT x.fold, r.seq, round(mean_target / 2 + bias / 2, 9) + 0.0 AS prediction FROM x JOIN research_rows r ON r.seq = x.seq JOIN y ON y.fold = x.fold AND y.symbol = r.symbol JOIN v ON v.fold = x.fold WHERE x.role = 'test'""",
    uses="research_rows",
)
def fold_callback_predictions(spark, sf):
    """A function of the three parts: the symbol's mean outcome in training, half way to the mean of validation."""

    def step(train: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
        means = train.groupBy("symbol").agg(F.avg("target").alias("__m"))
        bias = validation.agg(F.avg("target").alias("b")).first()["b"]
        return test.join(means, "symbol").withColumn("prediction", F.col("__m") / 2 + F.lit(bias) / 2).drop("__m")

    placed, plan = _placed(spark, sf)
    scores = foldfit.out_of_fold(placed, plan, "label_available_time", fit_predict=step)
    return scores.select("fold", "seq", rnd("prediction", 9).alias("prediction"))


_MASK_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _MASKS.items()) + "], lambda z: z IS NOT NULL)"
_ORDER = ", ".join(f"'{r}'" for r in _MASKS)

common("judged", "SELECT g.event_id, g.ts, o.seq, o.prediction AS p, o.actual_return AS y, g.* EXCLUDE (event_id, ts) FROM regimes_offline g JOIN observations o ON o.seq = g.event_id")


def judged_rows(spark, sf) -> DataFrame:
    """Observations with the regime scores of their moment."""
    seen = b.observation_rows(spark, sf).select(F.col("seq").alias("event_id"), "seq", "prediction", F.col("actual_return").alias("realized"))
    return regimes(spark, sf, False).join(seen, "event_id")


@query(
    "simulated_returns_by_regime",
    f"""WITH src AS (SELECT unnest({_MASK_LIST}) AS active, ts, seq, p, y FROM judged), sizes AS (SELECT active AS regime, count(*) AS all_rows FROM src GROUP BY active),
      known AS (SELECT unnest([{_ORDER}]) AS regime), {_simulate_sql('active', 'src').replace('SELECT m.active,', 'SELECT m.active AS regime,').replace('SELECT m.active AS regime,', ', sim AS (SELECT m.active AS regime,', 1)})
      SELECT k.regime, coalesce(all_rows, 0) AS rows, CASE WHEN coalesce(all_rows, 0) < 25 THEN 'too_few_rows' ELSE 'evaluated' END AS status,
        {", ".join(f"CASE WHEN all_rows >= 25 THEN {c} END AS {c}" for c in ["number_of_trades", "skipped_no_trade_count", "long_trade_count", "short_trade_count", "longest_losing_streak", *_SIM])}
      FROM known k LEFT JOIN sizes USING (regime) LEFT JOIN sim USING (regime)""",
    uses="observations bank regimes_offline judged",
)
def simulated_returns_by_regime(spark, sf):
    rows = judged_rows(spark, sf).select("ts", "seq", "prediction", "realized", F.explode(sc.active_regimes()).alias("regime"))
    return rp.simulate_by_group(rows, "regime", sc.REGIME_ORDER, ["ts", "seq"], 0.0004, 0.002, slippage=0.0002).select(
        "regime", "rows", "status", "number_of_trades", "skipped_no_trade_count", "long_trade_count", "short_trade_count", "longest_losing_streak", *[rnd(c).alias(c) for c in _SIM]
    )


_TREE_FEATURES = ("trend_score", "candle_return_5m", "volatility", "volume_change", "price_change", "risk_score", "rsi_14", "funding_rate")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first three quarters in time train, the rest tests; equal times stay together."""
    marked = folds.chronological_split(rows, "ts", "event_id", train=0.75, validation=0.0)
    return marked.where("split = 'train'").drop("split"), marked.where("split = 'test'").drop("split")


def _specialists(spark, sf) -> tuple[DataFrame, DataFrame]:
    train, test = _split(judged_rows(spark, sf).withColumn("target", F.col("realized") + F.col("price_change") * 0.1))
    weighted = rp.source_weights(train, ["ts", "event_id"], F.col("symbol") == "view", 0.5, 1.0, 0.4)
    estimator = trees.Ensemble(_TREE_FEATURES, "target", "boosting", trees=5, depth=3, weight="weight")
    path = scratch_path(spark, "specialists")
    masks = sc.regime_masks()
    ready, facts = trees.fit_specialists(weighted, test, masks, sc.REGIME_ORDER, estimator, path)
    return trees.score_with_specialists(test, masks, sc.REGIME_ORDER, ready, estimator, path), facts


@query(
    "specialist_regime_rows",
    f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM judged),
      e AS (SELECT max(rn) AS a FROM o WHERE ts = (SELECT ts FROM o WHERE rn = greatest(1, CAST(floor(n * 0.75) AS BIGINT)))),
      c AS (SELECT *, {_MASK_LIST} AS active, rn <= a AS training FROM o, e),
      t AS (SELECT unnest(active) AS regime, count(*) AS train_rows FROM c WHERE training GROUP BY 1), s AS (SELECT active[1] AS regime, count(*) AS test_rows FROM c WHERE NOT training GROUP BY 1)
      SELECT regime, coalesce(train_rows, 0) AS train_rows, coalesce(test_rows, 0) AS test_rows, CASE WHEN coalesce(train_rows, 0) < 300 OR coalesce(test_rows, 0) < 25 THEN 'skipped_too_few_rows' ELSE 'trained' END AS status
      FROM (SELECT unnest([{_ORDER}]) AS regime) LEFT JOIN t USING (regime) LEFT JOIN s USING (regime)""",
    uses="observations bank regimes_offline judged",
)
def specialist_regime_rows(spark, sf):
    train, test = _split(judged_rows(spark, sf))
    counts = trees.regime_counts(train, test, sc.regime_masks(), sc.REGIME_ORDER)
    few = lambda a, c: "skipped_too_few_rows" if a < 300 or c < 25 else "trained"
    return spark.createDataFrame([(r, a, c, few(a, c)) for r, (a, c) in counts.items()], "regime string, train_rows long, test_rows long, status string")


@query("specialist_regime_errors")
def specialist_regime_errors(spark, sf):
    """Held-out error per regime, of the models in use and of the global one alone."""
    scored, facts = _specialists(spark, sf)
    gap = lambda c: F.sqrt(F.avg(F.pow(F.col("target") - F.col(c), 2)))
    spread = F.stddev_pop("target")
    errors = scored.groupBy(F.coalesce("regime", F.lit("none")).alias("regime"), "model").agg(
        F.count(F.lit(1)).alias("rows"), rnd(gap("prediction")).alias("rmse"), rnd(gap("global_prediction")).alias("global_rmse"), rnd(spread).alias("target_deviation")
    )
    return errors.join(facts.select("regime", "status", "train_rows"), "regime", "left")
