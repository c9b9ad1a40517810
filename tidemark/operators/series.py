"""Ordered-series primitives that never put one whole key into one task.

A window over ``PARTITION BY symbol`` sends a symbol to a single task, however
long its history.  Everything here works on *blocks* instead: consecutive runs
of a key's rows.  A computation is local to a block, plus

* a halo -- the neighbouring rows a bounded frame reaches into, or
* a carry -- one summary row per block, prefix-combined per key.

Blocks come from time (``time_block``; bounded when the rows are unique per key
and time step, as candles are) or from a range partitioning over the full sort
order (``range_blocks``; balanced for any distribution).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import checkpointed

BLOCK = "__block"
HALO = "__halo"


def micros(column: Column | str) -> Column:
    """Epoch microseconds of a timestamp with or without a zone."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def time_block(time: Column | str, width_seconds: int) -> Column:
    return F.floor(micros(time) / F.lit(width_seconds * 1_000_000)).cast("long")


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cut the rows into balanced runs of the full (keys, order) sort.

    The run number is the range partition, so a key holding a third of all rows
    spreads over a third of the partitions.  Range bounds are sampled, therefore
    the labelled rows are checkpointed before anything reads them twice.  The number
    of runs is given, so adaptive execution does not put them together again.
    """
    runs = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(runs, *[F.col(c) for c in (*keys, *order)])
    return checkpointed(ranged.withColumn(BLOCK, F.spark_partition_id().cast("long")))


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which null keys meet, with the keys of ``left``."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    return left.join(renamed, on).drop(*[f"__r_{k}" for k in keys])


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str = BLOCK, name: str = "pos"
) -> DataFrame:
    """Zero-based row number per key, from block-local numbers and block sizes."""
    local = df.withColumn(
        "__rn", F.row_number().over(W.partitionBy(*keys, block).orderBy(*order)).cast("long")
    )
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, block)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, block, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    )
    return (
        meet(local, offsets, [*keys, block])
        .withColumn(name, F.col("__off") + F.col("__rn") - 1)
        .drop("__off", "__rn")
    )


def row_halo(
    df: DataFrame, before: int = 0, after: int = 0, rows: int = 8192, pos: str = "pos"
) -> DataFrame:
    """Re-block by position, lending each block the rows its frames reach into.

    ``before``/``after`` may not exceed ``rows``: a frame then touches at most
    the adjacent block on each side.
    """
    if max(before, after) > rows:
        raise ValueError("halo larger than the block")
    home = F.floor(F.col(pos) / rows).cast("long")
    inside = F.col(pos) % rows
    targets = F.array_compact(
        F.array(
            F.when(F.lit(True), F.struct(home.alias("b"), F.lit(False).alias("h"))),
            F.when(
                (inside >= rows - before) if before else F.lit(False),
                F.struct((home + 1).alias("b"), F.lit(True).alias("h")),
            ),
            F.when(
                ((inside < after) & (home > 0)) if after else F.lit(False),
                F.struct((home - 1).alias("b"), F.lit(True).alias("h")),
            ),
        )
    )
    spread = df.drop(BLOCK).withColumn("__target", F.explode(targets))
    return (
        spread.withColumn(BLOCK, F.col("__target.b"))
        .withColumn(HALO, F.col("__target.h"))
        .drop("__target")
    )


def time_halo(
    df: DataFrame, time: str, width_seconds: int, before_seconds: int = 0, after_seconds: int = 0
) -> DataFrame:
    """Time blocks with the neighbouring rows a time-range frame reaches into."""
    if max(before_seconds, after_seconds) > width_seconds:
        raise ValueError("halo larger than the block")
    width = width_seconds * 1_000_000
    home = F.floor(micros(time) / F.lit(width)).cast("long")
    inside = F.pmod(micros(time), F.lit(width))
    targets = F.array_compact(
        F.array(
            F.when(F.lit(True), F.struct(home.alias("b"), F.lit(False).alias("h"))),
            F.when(
                (inside >= width - before_seconds * 1_000_000) if before_seconds else F.lit(False),
                F.struct((home + 1).alias("b"), F.lit(True).alias("h")),
            ),
            F.when(
                (inside <= after_seconds * 1_000_000) if after_seconds else F.lit(False),
                F.struct((home - 1).alias("b"), F.lit(True).alias("h")),
            ),
        )
    )
    return (
        df.withColumn("__target", F.explode(targets))
        .withColumn(BLOCK, F.col("__target.b"))
        .withColumn(HALO, F.col("__target.h"))
        .drop("__target")
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(HALO, BLOCK)


_COMBINE = {
    "sum": lambda carry, here: F.when(carry.isNull(), here).otherwise(carry + F.coalesce(here, carry * 0)),
    "count": lambda carry, here: F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0)),
    "max": lambda carry, here: F.greatest(carry, here),
    "min": lambda carry, here: F.least(carry, here),
}
_AGGREGATE = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_ROLL_UP = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    specs: Mapping[str, tuple[str, Column]],
    block: str = BLOCK,
    include_current: bool = True,
) -> DataFrame:
    """Running sum/count/max/min from the start of each key up to each row.

    One pass windows inside the blocks; the block totals are aggregated with
    map-side combine and only those totals are windowed per key.
    """
    staged = df.select("*", *[expr.alias(f"__v_{name}") for name, (_, expr) in specs.items()])
    totals = staged.groupBy(*keys, block).agg(
        *[_AGGREGATE[kind](f"__v_{name}").alias(f"__t_{name}") for name, (kind, _) in specs.items()]
    )
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select(
        *keys,
        block,
        *[_ROLL_UP[kind](f"__t_{name}").over(before).alias(f"__c_{name}") for name, (kind, _) in specs.items()],
    )
    local = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0 if include_current else -1
    )
    here = staged.select(
        "*", *[_AGGREGATE[kind](f"__v_{name}").over(local).alias(f"__l_{name}") for name, (kind, _) in specs.items()]
    )
    joined = meet(here, carries, [*keys, block])
    out = joined.select(
        *[c for c in df.columns],
        *[
            _COMBINE[kind](F.col(f"__c_{name}"), F.col(f"__l_{name}")).alias(name)
            for name, (kind, _) in specs.items()
        ],
    )
    return out


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    block: str = BLOCK,
    forward: bool = False,
) -> DataFrame:
    """Latest non-null ``value`` at or before each row (after it, if ``forward``).

    ``order`` lists Columns that are *descending* in ``forward`` mode; the block
    order is then followed backwards as well, so each direction is one linear
    pass.
    """
    local = W.partitionBy(*keys, block).orderBy(*order)
    here = df.withColumn("__v", value).select(
        "*",
        F.last("__v", ignorenulls=True).over(local.rowsBetween(W.unboundedPreceding, 0)).alias("__here"),
        F.lead(F.lit(1)).over(local).alias("__more"),
    )
    block_order = F.col(block).desc() if forward else F.col(block).asc()
    before = W.partitionBy(*keys).orderBy(block_order).rowsBetween(W.unboundedPreceding, -1)
    carries = here.where(F.col("__more").isNull()).select(
        *keys, block, F.last("__here", ignorenulls=True).over(before).alias("__carry")
    )
    return (
        meet(here, carries, [*keys, block])
        .withColumn(name, F.coalesce("__here", "__carry"))
        .drop("__v", "__here", "__more", "__carry")
    )


def ema(value: Column, span: int, window: W, index: Column, seed: Column) -> Column:
    """Exponential mean with weight 2/(span+1), started at the series' first value.

    The recurrence is written as a scaled running sum, so it stays a built-in
    window aggregate.  ``index`` counts rows inside the block (halo included) and
    ``seed`` marks the first row of the whole series.  A halo of ``ema_halo(span)``
    rows makes the part before the block smaller than double precision.
    """
    alpha = 2.0 / (span + 1.0)
    keep = 1.0 - alpha
    weight = F.when(seed, F.lit(1.0)).otherwise(F.lit(alpha))
    scaled = value * weight * F.pow(F.lit(keep), -index)
    return F.pow(F.lit(keep), index) * F.sum(scaled).over(window.rowsBetween(W.unboundedPreceding, 0))


def numbered(df: DataFrame, keys: Iterable[str], order: Sequence[str], width_seconds: int, time: str) -> DataFrame:
    """``positions`` over time blocks: the usual start for candle series."""
    return positions(df.withColumn(BLOCK, time_block(time, width_seconds)), list(keys), order).drop(BLOCK)


def lag_across(
    blocks: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column], block: str = BLOCK
) -> DataFrame:
    """Previous row's values per key over block boundaries.

    Inside a block it is a plain lag; a block's first row takes the last row of
    the key's block before, of which only one row per block is shuffled.
    """
    inside = W.partitionBy(*keys, block).orderBy(*order)
    packed = F.struct(*[e.alias(n) for n, e in values.items()])
    here = blocks.withColumn("__pack", packed).select(
        "*", F.lag("__pack").over(inside).alias("__prev"), F.lead(F.lit(1)).over(inside).alias("__more")
    )
    seam = W.partitionBy(*keys).orderBy(block)
    ends = here.where(F.col("__more").isNull()).select(*keys, block, F.lag("__pack").over(seam).alias("__seam"))
    out = meet(here, ends, [*keys, block]).withColumn("__prev", F.coalesce("__prev", "__seam"))
    return out.select(*blocks.columns, *[F.col(f"__prev.{n}").alias(n) for n in values])
