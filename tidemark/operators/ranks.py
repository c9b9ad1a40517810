"""Exact ranks and quantiles from value counts.

Equal values are counted before the shuffle and the distinct values are ordered
in balanced blocks, so neither a hot group nor a hot value lands in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.series import BLOCK, range_blocks, running


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Per distinct value: its count ``n``, the number of smaller rows, the group total."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    )
    blocks = range_blocks(counts, keys, [value])
    totals = blocks.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = running(blocks, keys, [value], {"upto": ("sum", F.col("n"))})
    return (
        ranked.join(totals, list(keys))
        .withColumn("smaller", F.col("upto") - F.col("n"))
        .drop(BLOCK)
    )


def average_rank() -> Column:
    """One-based rank with ties sharing their mean rank."""
    return F.col("smaller") + (F.col("n") + 1) / 2.0


def quantiles(ranked: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of the ``value_ranks`` output."""

    def at(place: Column) -> Column:
        here = (F.col("smaller") <= place) & (place < F.col("upto"))
        return F.max(F.when(here, F.col(value).cast("double")))

    aggregates = []
    for name, p in probs.items():
        spot = (F.col("total") - 1) * F.lit(float(p))
        aggregates += [
            at(F.floor(spot)).alias(f"__lo_{name}"),
            at(F.ceil(spot)).alias(f"__hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"__fr_{name}"),
        ]
    grouped = ranked.groupBy(*keys).agg(*aggregates)
    return grouped.select(
        *keys,
        *[
            (F.col(f"__lo_{n}") * (1.0 - F.col(f"__fr_{n}")) + F.col(f"__hi_{n}") * F.col(f"__fr_{n}")).alias(n)
            for n in probs
        ],
    )


def ks_distance(df: DataFrame, keys: Sequence[str], value: str, is_recent: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per key, null under two values a side."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.when(is_recent, 1)).alias("a"), F.count(F.when(~is_recent, 1)).alias("b")
    )
    blocks = range_blocks(counts, keys, [value])
    totals = blocks.groupBy(*keys).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    steps = running(
        blocks, keys, [value], {"ca": ("sum", F.col("a")), "cb": ("sum", F.col("b"))}
    ).join(totals, list(keys))
    gap = F.when((F.col("ta") >= 2) & (F.col("tb") >= 2), F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb")))
    return steps.groupBy(*keys).agg(F.max(gap).alias("ks_distance"))
