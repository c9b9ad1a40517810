"""Stored records as their readers want them: feeds, observation files, shadow lists, rewards, verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.numeric import finite, zero
from tidemark.functions.scores import readiness_rank
from tidemark.functions.text import squeeze
from tidemark.operators.asof import asof_join, latest_per_key

#: The columns in which a registry may keep a field of the common record.
RECORD_FIELDS = {
    "id": ("id", "candidate_id", "evaluation_id", "promotion_decision_id", "assignment_id", "paper_sandbox_account_id"),
    "symbol": ("symbol",), "account_id": ("paper_account_id", "account_id"), "candidate_id": ("candidate_id",), "name": ("name",), "model_id": ("model_id",),
    "model_version": ("model_version", "version"), "model_family": ("model_family", "signal_family"),
    "lifecycle_status": ("lifecycle_status", "lifecycle_state", "status", "action"), "health_status": ("health_status",), "approved": ("approved",), "reason": ("reason", "notes"),
    "created_at": ("created_at", "generated_at", "observed_at", "evaluated_at", "active_from", "requested_at"),
}


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """title, url, published_at, raw_text of Atom entries; the link is an attribute, of several the alternate one, else the id."""
    link = "link array<struct<_href: string, _rel: string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(f"title string, {link}, id string, published string, updated string, summary string, content string").load(path)
    usual = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    href = F.coalesce(F.get(usual, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"], F.col("id"))
    url = F.trim(href)
    when = F.try_to_timestamp(F.coalesce("published", "updated"))
    return raw.where((F.trim("title") != "") & (F.coalesce(url, F.lit("")) != "")).select(
        squeeze(F.col("title")).alias("title"), url.alias("url"), when.alias("published_at"), F.concat_ws(" ", "title", F.coalesce("summary", "content")).alias("raw_text")
    )


def write_observations(rows: DataFrame, path: str, overwrite: bool = False) -> dict[str, object]:
    """Rows as canonical JSON lines (keys in order, no non-finite numbers); a second write of other rows is refused.

    Files are told apart by their number of lines and the sum of the lines' hashes, which do not depend on how
    the rows are dealt over files.  The same rows again leave the files as they are.
    """
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    cells = [(finite(c) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in sorted(rows.columns)]
    lines = rows.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))
    facts = lambda df: df.agg(F.count(F.lit(1)).alias("rows"), zero(F.sum(F.xxhash64("value").cast("decimal(38,0)"))).alias("sum")).first()
    new = facts(lines)
    try:
        old = facts(spark.read.text(path))
    except Exception as error:  # there is nothing yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = None
    if old is not None and tuple(old) != tuple(new) and not overwrite:
        raise FileExistsError(f"refusing to replace different observations: {path}")
    if old is None or tuple(old) != tuple(new):
        lines.write.mode("overwrite").option("compression", "gzip").text(path)
    return {"path": path, "rows": new["rows"], "format": "jsonl", "contract": "evaluation_observation_v1"}


def window_articles(found: DataFrame, window: str = "window", place: str = "place") -> DataFrame:
    """Articles fetched for overlapping windows, each once: the first window and place that has its url, or its title and time.

    Rows with neither url nor title are left out.  article_id is a digest of that key.
    """
    url, title = (F.trim(F.coalesce(c, F.lit(""))) for c in ("url", "title"))
    key = F.when(url != "", url).otherwise(F.concat(title, F.lit(":"), F.coalesce(F.col("published_at").cast("string"), F.lit(""))))
    keyed = found.where((url != "") | (title != "")).withColumn("__key", key)
    first = latest_per_key(keyed, ["__key"], [F.col(window).asc(), F.col(place).asc()])
    return first.withColumn("article_id", F.sha2("__key", 256)).drop("__key")


def shadow_list(shadows: DataFrame, models: DataFrame, ensembles: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` shadow predictions with their model and the newest ensemble of their trace, both if known."""
    newest = shadows.orderBy(F.desc("generated_at"), F.desc("shadow_id")).limit(n)
    traces = ensembles.join(F.broadcast(newest.select("trace_id").distinct()), "trace_id", "left_semi")  # at most n traces
    latest = latest_per_key(traces, ["trace_id"], [F.desc("generated_at"), F.desc("ensemble_id")]).select(
        "trace_id", "ensemble_id", F.col("decision_status").alias("ensemble_status"), "combined_expected_return"
    )
    return newest.join(models, "model_version_id", "left").join(latest, "trace_id", "left")


def research_records(registries: Mapping[str, DataFrame], n: int = 100) -> DataFrame:
    """The newest ``n`` rows of every registry in one layout; what a registry lacks is null."""
    out = None
    for kind, rows in registries.items():
        cells = []
        for field, names in RECORD_FIELDS.items():
            have = [F.col(c) for c in names if c in rows.columns]
            target = "timestamp_ntz" if field == "created_at" else "boolean" if field == "approved" else "string"
            cells.append((F.coalesce(*have) if have else F.lit(None)).cast(target).alias(field))
        one = rows.select(F.lit(kind).alias("record_type"), *cells).orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(n)
        out = one if out is None else out.unionByName(one)
    return out


def horizon_rewards(experiences: DataFrame, candles: DataFrame, equity: DataFrame, horizons: Sequence[int] = (5, 15, 60), least_notional: float = 10.0) -> DataFrame:
    """Reward of an experience per horizon in minutes, once a candle at or after it is known.

    ``experiences`` has experience_id, symbol, created_at, action, status, entry_price, notional, fee, realized_pnl;
    ``candles`` symbol, open_time, close; ``equity`` marked_at, drawdown.  The price is the first candle's at or
    after the horizon, the drawdown that of the first mark from there on.  All horizons go through one pass each.
    """
    h = F.explode(F.array(*[F.lit(x) for x in horizons])).alias("horizon")
    due = (F.col("created_at") + F.make_dt_interval(mins=F.col("horizon"))).alias("due")
    asked = experiences.where("entry_price > 0").select("*", h).select("*", due)
    priced = asof_join(asked, candles, ["symbol"], "due", "open_time", {"future_price": "close"}, direction="forward").where("future_price IS NOT NULL")
    marked = asof_join(
        priced.withColumn("__all", F.lit(0)), equity.withColumn("__all", F.lit(0)), ["__all"], "due", "marked_at", {"drawdown": "drawdown"}, direction="forward"
    ).drop("__all")
    act = F.upper("action")
    side = F.when(act == "BUY", 1.0).when(act.isin("SELL", "CLOSE"), -1.0).otherwise(0.0)
    change = (F.col("future_price") - F.col("entry_price")) / F.when(F.col("entry_price") != 0, F.col("entry_price"))
    notional = zero(F.col("notional"))
    penalty = F.abs(F.least(zero(F.col("drawdown")), F.lit(0.0))) * F.greatest(notional, F.lit(least_notional))
    out = marked.withColumns({"price_change": change, "movement_pnl": change * notional * side, "drawdown_penalty": penalty})
    gain = F.col("movement_pnl") + zero(F.col("realized_pnl")) - zero(F.col("fee")) - F.col("drawdown_penalty")
    return out.withColumn("reward", F.when(F.col("status") == "FILLED", gain).otherwise(0.0))


def linear_evaluation(rows: DataFrame, prediction: Column, target: str) -> DataFrame:
    """rows, mse, mae and the share of rows whose prediction has the sign of the outcome."""
    p, y = finite(prediction), finite(target)
    known = p.isNotNull() & y.isNotNull()
    error = F.when(known, p - y)
    return rows.agg(
        F.count(error).alias("rows"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"),
        F.avg(F.when(known, (F.signum(p) == F.signum(y)).cast("double"))).alias("sign_agreement"),
    )


def split_labels(rows: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected labels; every row is in one of them, a rejected one with its reasons."""
    judged = rows.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


#: Hard checks of the gate as (failure, metric, bound, whether the metric must be at least the bound).
HARD_CHECKS = (
    ("net_return_not_positive", "net_return_after_fees", 0.0, True), ("too_few_trades", "number_of_trades", 25.0, True), ("max_drawdown_too_high", "max_drawdown", 0.20, False),
    ("profit_factor_too_low", "profit_factor", 1.05, True), ("win_rate_too_low", "simulated_win_rate", 0.42, True), ("losing_streak_too_long", "longest_losing_streak", 12.0, False),
)


def gate(candidates: DataFrame, checks: Sequence[tuple[str, str, float, bool]] = HARD_CHECKS, best: str = "net_return_after_fees") -> DataFrame:
    """Candidates with failures, passed, score (0 to 100) and readiness; unknown metrics fail their check.

    The score is the share of checks passed, and ten points off for trading on more than 70 % of the rows.
    """
    value = lambda m: finite(F.col(m))
    ok = lambda m, b, up: F.coalesce(value(m) >= b if up else value(m) <= b, F.lit(False))
    failures = F.array_compact(F.array(*[F.when(~ok(m, b, up), F.lit(name)) for name, m, b, up in checks]))
    busy = F.coalesce(F.col("number_of_trades") > F.col("test_rows") * 0.70, F.lit(False))
    out = candidates.withColumn("failures", failures).withColumn("trades_too_often", busy)
    share = 100.0 * (len(checks) - F.size("failures")) / len(checks)
    return out.withColumns({
        "passed": F.size("failures") == 0, "score": F.greatest(F.lit(0.0), share - F.when(busy, 10.0).otherwise(0.0)),
        "readiness": readiness_rank(F.col("labeled_rows"), F.col("dataset_days")),
    })


def advice(gated: DataFrame, days: Column, best: str = "net_return_after_fees") -> DataFrame:
    """What to tell when no candidate passes: one row of messages, empty as soon as one does."""
    top = gated.agg(
        F.coalesce(F.bool_or("passed"), F.lit(False)).alias("any"), F.max(days).alias("days"), F.max_by(F.struct("failures", "trades_too_often"), F.struct(best, "candidate")).alias("b")
    )
    messages = F.array_compact(F.array(
        F.lit("NO_CANDIDATE_PASSED"), F.when(F.col("days") < 3, "COLLECT_MORE_DAYS"), F.when(F.size("b.failures") > 0, F.concat(F.lit("BEST_FAILED:"), F.concat_ws("|", "b.failures"))),
        F.when(F.col("b.trades_too_often"), "TRADES_TOO_OFTEN"),
    ))
    return top.select(F.when(F.col("any"), F.array().cast("array<string>")).otherwise(messages).alias("advice"))
