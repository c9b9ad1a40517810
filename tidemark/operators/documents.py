"""Labelled documents: a count-based text classifier, checks and time partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.numeric import finite
from tidemark.functions.text import numbers, plain_numbers, token_list
from tidemark.operators.asof import latest_per_key
from tidemark.operators.ranks import value_ranks


def token_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Occurrences of each token per document (whole text)."""
    dealt = docs.select(key, text).repartition(key)  # whole texts are fewer bytes than their tokens
    return dealt.select(key, F.explode(token_list(F.col(text), 2)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


class TextStudent:
    """Multinomial naive Bayes with add-one smoothing.

    Training is three aggregates.  All tokens count unless ``vocabulary`` keeps the most
    frequent ones; tables of tokens are joined without a hint, by their size.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, tasks: Sequence[str], vocabulary: int | None = None) -> None:
        labelled = docs.select(key, text, *[F.col(t).cast("string").alias(t) for t in tasks])
        tokens = labelled.select(*tasks, F.explode(token_list(F.col(text), 2)).alias("token"))
        by_labels = tokens.groupBy(*tasks, "token").agg(F.count(F.lit(1)).alias("n"))
        self.vocabulary, kept = by_labels.groupBy("token").agg(F.sum("n").alias("n")), by_labels
        if vocabulary is not None:
            self.vocabulary = self.vocabulary.orderBy(F.desc("n"), "token").limit(vocabulary)
            kept = by_labels.join(self.vocabulary.select("token"), "token", "left_semi")

        def stacked(df: DataFrame, extra: Sequence[str]) -> DataFrame:
            cells = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("label")) for t in tasks])
            return df.select(*extra, F.explode(cells).alias("c")).select(*extra, "c.task", "c.label").where(F.col("label").isNotNull())

        self.token_counts = stacked(kept, ["token", "n"]).groupBy("task", "label", "token").agg(F.sum("n").alias("n"))
        self.label_counts = stacked(labelled, []).groupBy("task", "label").agg(F.count(F.lit(1)).alias("rows"))
        self.tasks = list(tasks)

    def facts(self) -> DataFrame:
        """Rows and token totals per task and label, with the vocabulary size."""
        totals = self.token_counts.groupBy("task", "label").agg(F.sum("n").alias("token_total"))
        size = self.vocabulary.agg(F.count(F.lit(1)).alias("vocabulary_size")).withColumn("__one", F.lit(0))
        out = self.label_counts.join(totals, ["task", "label"], "left").withColumn("__one", F.lit(0))
        w = W.partitionBy("task")
        return out.join(size, "__one").select(
            "task", "label", "rows", F.coalesce("token_total", F.lit(0)).alias("token_total"), "vocabulary_size",
            F.sum("rows").over(w).alias("task_rows"), F.count(F.lit(1)).over(w).alias("labels"),
        )

    def predict(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """Best label and its probability per (document, task).

        A token outside the vocabulary adds the same log term as an unseen one,
        so only the token total enters for those.
        """
        facts = self.facts().withColumn(
            "denominator", F.greatest(F.lit(1), F.col("token_total") + F.col("vocabulary_size")).cast("double")
        ).withColumn("prior", F.log((F.col("rows") + 1) / (F.col("task_rows") + F.col("labels"))))
        # One column of gains per (task, label): a token of a document is one row throughout.
        cells = [(r["task"], r["label"]) for r in self.label_counts.select("task", "label").collect()]
        logs = self.token_counts.groupBy("token").agg(
            *[F.max(F.when((F.col("task") == t) & (F.col("label") == v), F.log(F.col("n") + 1.0))).alias(f"__g{i}") for i, (t, v) in enumerate(cells)]
        )
        sums = [F.sum(F.col("n") * F.col(f"__g{i}")).alias(f"__g{i}") for i in range(len(cells))]
        gains = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(v).alias("label"), F.col(f"__g{i}").alias("gain")) for i, (t, v) in enumerate(cells)])
        seen = token_table(docs, key, text).join(logs, "token").groupBy(key).agg(*sums).select(key, F.inline(gains)) if cells else None
        counted = docs.groupBy(key).agg(F.sum(F.when(F.col(text).isNotNull(), F.size(token_list(F.col(text), 2)))).alias("size"))
        sizes = docs.select(key).join(counted, key, "left").select(key, F.coalesce("size", F.lit(0)).alias("size"), F.lit(0).alias("__one"))
        # One row per (task, label): a handful.
        grid = sizes.join(F.broadcast(facts.withColumn("__one", F.lit(0))), "__one").drop("__one")
        grid = grid.join(seen, [key, "task", "label"], "left") if cells else grid.withColumn("gain", F.lit(None).cast("double"))
        scored = grid.withColumn(
            "score", F.col("prior") + F.coalesce("gain", F.lit(0.0)) - F.col("size") * F.log("denominator")
        )
        w = W.partitionBy(key, "task")
        soft = scored.withColumn("top", F.max("score").over(w)).withColumn("e", F.exp(F.col("score") - F.col("top")))
        best = soft.withColumn("p", F.col("e") / F.sum("e").over(w)).withColumn(
            "rank", F.row_number().over(w.orderBy(F.desc("score"), "label"))
        )
        return best.where(F.col("rank") == 1).select(key, "task", F.col("label").alias("predicted"), F.col("p").alias("probability"))


def label_keywords(docs: DataFrame, key: str, text: str, label: str, most: int = 12) -> DataFrame:
    """The most frequent tokens of each label."""
    counts = docs.select(label, F.explode(token_list(F.col(text), 2)).alias("token")).groupBy(label, "token").agg(F.count(F.lit(1)).alias("n"))
    return latest_per_key(counts, [label], [F.col("n").desc(), F.col("token")], most)


def content_identity(text: Column) -> Column:
    """SHA-256 of the trimmed title and body (split at the first blank line)."""
    parts = F.split(text, "\n\n", 2)
    pair = F.concat_ws("\n", F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1))))
    return F.sha2(F.when(F.size(parts) > 1, pair).otherwise(F.trim(text)), 256)


def hash_collisions(docs: DataFrame, content_hash: str, identity: str) -> DataFrame:
    """Declared hashes that cover more than one content."""
    return (
        docs.groupBy(content_hash).agg(F.min(identity).alias("__a"), F.max(identity).alias("__b"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("__a") != F.col("__b")).select(content_hash, "rows")
    )


def first_seen(docs: DataFrame, content_hash: str, time: str, tie: Sequence[str]) -> DataFrame:
    """Earliest row per content hash."""
    return latest_per_key(docs, [content_hash], [F.col(time), *[F.col(t) for t in tie]])


def partition_by_time(docs: DataFrame, time: str, fractions: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """Chronological train/validation/holdout parts that never split a timestamp.

    Among all cohort ends the two boundaries minimise the summed distance to the
    wanted sizes; for every first boundary only the two ends around the second
    target can be best, so the search is one aggregate over the cohort table.
    """
    stamps = docs.select(F.col(time).alias("t")).withColumn("__all", F.lit(0))
    ends = value_ranks(stamps, ["__all"], "t").select("t", "upto", "smaller", "total")
    following = ends.select(F.col("smaller").alias("upto"), F.col("upto").alias("next_end"))
    total = ends.agg(F.max("total").alias("n")).first()["n"]
    if not total:
        raise ValueError("no rows to partition")
    goal = total * (fractions[0] + fractions[1])
    inner = ends.where(F.col("upto") < total)
    edge = inner.agg(
        F.max("upto").alias("last"), F.min(F.when(F.col("upto") >= goal, F.col("upto"))).alias("above"),
        F.max(F.when(F.col("upto") < goal, F.col("upto"))).alias("below"), F.count(F.lit(1)).alias("k"),
    ).first()
    if edge["k"] < 2:
        raise ValueError("at least three distinct timestamps are needed")
    pivot = edge["above"] if edge["above"] is not None else edge["last"]
    before = edge["below"] if edge["below"] is not None else pivot
    firsts = inner.join(following, "upto").where(F.col("next_end") < total)
    seconds = F.array(F.greatest("next_end", F.lit(pivot)), F.greatest("next_end", F.lit(before)))
    options = firsts.select(F.col("upto").alias("a"), F.explode(F.array_distinct(seconds)).alias("b")).where(F.col("b") < total)
    score = (
        F.abs(F.col("a") - total * fractions[0]) + F.abs(F.col("b") - F.col("a") - total * fractions[1]) + F.abs(total - F.col("b") - total * fractions[2])
    )
    best = options.agg(F.min(F.struct(score.alias("s"), "a", "b")).alias("m")).first()["m"]
    marks = ends.agg(
        F.min(F.when(F.col("smaller") >= best["a"], F.col("t"))).alias("v"), F.min(F.when(F.col("smaller") >= best["b"], F.col("t"))).alias("h")
    ).first()
    return docs.withColumn(
        "part", F.when(F.col(time) < F.lit(marks["v"]), "train").when(F.col(time) < F.lit(marks["h"]), "validation").otherwise("holdout")
    )


# Allowed labels and aliases of structured events.
EVENT_TYPES = [
    "adoption", "exchange", "funding", "liquidation", "macro", "market_move", "market_structure", "partnership", "product",
    "protocol", "regulatory", "rumor", "security_incident", "stablecoin", "tokenomics", "other",
]
DIRECTIONS = ["bullish", "bearish", "neutral", "mixed"]
HORIZONS = ["immediate", "short_term", "medium_term", "long_term", "unknown"]
ALIASES = {
    "positive": "bullish", "negative": "bearish", "none": "neutral", "near_term": "short_term", "nearterm": "short_term",
    "mid_term": "medium_term", "longterm": "long_term",
}
BOUNDS = {"sentiment": (-1.0, 1.0), "severity": (0.0, 1.0), "importance": (0.0, 1.0), "novelty": (0.0, 1.0), "confidence": (0.0, 1.0)}


def normal_label(value: Column) -> Column:
    text = F.translate(F.lower(F.trim(value)), "- ", "__")
    out = text
    for old, new in ALIASES.items():
        out = F.when(text == old, new).otherwise(out)
    return out


def normal_asset(value: Column) -> Column:
    """Upper-case symbol without separators; null when it is not one."""
    text = F.regexp_replace(F.upper(F.trim(value)), "[/-]", "")
    return F.when(F.rlike(text, F.lit("^[A-Z][A-Z0-9]{1,14}$")), text)


def label_rejects(min_confidence: float = 0.0, reject_unverified: bool = False, claims: str = "claim_numbers", text: str = "text") -> Column:
    """Reasons why a structured label is refused; empty when it is valid."""
    reasons = []
    for name, (low, high) in BOUNDS.items():
        x = finite(F.col(name).try_cast("double"))
        reasons.append(F.when(x.isNull(), F.lit(f"{name} must be numeric")).when((x < low) | (x > high), F.lit(f"{name} must be between {low} and {high}")))
    for name, allowed in (("event_type", EVENT_TYPES), ("direction", DIRECTIONS), ("time_horizon", HORIZONS)):
        reasons.append(F.when(~F.coalesce(normal_label(F.col(name)).isin(*allowed), F.lit(False)), F.lit(f"{name} is not allowed")))
    reasons.append(F.when(F.col("confidence").try_cast("double") < min_confidence, F.lit("confidence is below the configured minimum")))
    if reject_unverified:
        missing = F.array_except(plain_numbers(F.col(claims)), plain_numbers(numbers(F.col(text))))
        reasons.append(F.when(F.size(missing) > 0, F.lit("claims state unverified numbers")))
    return F.array_compact(F.array(*reasons))


def normal_event(df: DataFrame, most_assets: int = 20) -> DataFrame:
    """Aliases resolved, assets cleaned and de-duplicated, list limits as reject reasons."""
    assets = F.array_distinct(F.transform("affected_assets", lambda a: normal_asset(a)))
    out = df.withColumn("assets", assets)
    for name in ("event_type", "direction", "time_horizon"):
        out = out.withColumn(name, normal_label(F.col(name)))
    bad = F.array_compact(
        F.array(
            F.when(F.exists("assets", lambda a: a.isNull()), F.lit("invalid asset symbol")),
            F.when(F.size("affected_assets") > most_assets, F.lit("too many assets")),
        )
    )
    return out.withColumn("asset_reasons", bad)


def homogeneous(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Distinct count per source column and whether the set may be trained on as one."""
    cells = [F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("v")) for n, c in columns.items()]
    return df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.field").agg(
        F.countDistinct("c.v").alias("versions"), F.min("c.v").alias("first_version")
    ).withColumn("homogeneous", F.col("versions") == 1)


def new_articles(incoming: DataFrame, stored: DataFrame, seq: str) -> DataFrame:
    """Incoming articles not stored under any of the three identities, first of each kept.

    The disjunction is three equi anti joins, so no pair of articles is compared.
    """
    identities = (["source", "url"], ["provider", "url"], ["provider", "title", "published_at"])
    out = incoming
    for keys in identities:
        out = out.join(stored.select(*keys).distinct(), keys, "left_anti")
    firsts = {tuple(keys): out.groupBy(*keys).agg(F.min(seq).alias("__first")) for keys in identities[:2]}
    for keys, first in firsts.items():
        out = out.join(first, list(keys)).where(F.col(seq) == F.col("__first")).drop("__first")
    return out
