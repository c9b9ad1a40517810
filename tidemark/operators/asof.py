"""As-of joins and trailing-interval sums without pairing rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.series import BLOCK, micros, range_blocks, running, running_last, time_block


def _one_way(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    take: Mapping[str, str],
    forward: bool,
    allow_exact: bool,
    tie: Sequence[str],
    width_seconds: int | None,
    out: str,
) -> DataFrame:
    keys = [f"__k{i}" for i in range(len(by))]
    payload = F.struct(
        F.col(right_on).alias("__time"), *[F.col(source).alias(name) for name, source in take.items()]
    )
    tie_struct = F.struct(*[F.col(c) for c in tie]) if tie else F.struct(F.lit(0).alias("z"))
    # Side decides who sorts first at equal times: the row that is looked up must
    # already have been passed (exact match allowed) or not yet (exact match off).
    left_side = 1 if allow_exact else -1
    right_rows = right.select(
        *[F.col(b).alias(k) for b, k in zip(by, keys)],
        F.col(right_on).alias("__t"),
        F.lit(0).alias("__side"),
        tie_struct.alias("__tie"),
        F.lit(0).cast("long").alias("__spread"),
        payload.alias("__r"),
    )
    types = {f.name: f.dataType for f in right_rows.schema.fields}
    left_rows = left.select(
        *[F.col(b).alias(k) for b, k in zip(by, keys)],
        F.col(left_on).alias("__t"),
        F.lit(-left_side if forward else left_side).alias("__side"),
        F.lit(None).cast(types["__tie"]).alias("__tie"),
        F.xxhash64(*[F.col(c) for c in left.columns if not _is_map(left, c)]).alias("__spread"),
        F.lit(None).cast(types["__r"]).alias("__r"),
        F.struct(*left.columns).alias("__l"),
    )
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    both = both.where(F.col("__t").isNotNull())
    order = ["__t", "__side", "__tie", "__spread"]
    if width_seconds is None:
        both = range_blocks(both, keys, order)
    else:
        both = both.withColumn(BLOCK, time_block("__t", width_seconds))
    direction = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
    found = running_last(both, keys, direction, F.col("__r"), out, forward=forward)
    return found.where(F.col("__l").isNotNull()).select("__l.*", out)


def _is_map(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("map", "variant")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    take: Mapping[str, str],
    direction: str = "backward",
    allow_exact: bool = True,
    tolerance_seconds: float | None = None,
    tie: Sequence[str] = (),
    width_seconds: int | None = None,
    matched_time: str | None = None,
) -> DataFrame:
    """Attach to each left row the right row nearest in time for the same key.

    ``take`` maps output names to right columns.  ``tie`` orders right rows that
    share a time; the last (first, looking forward) wins.  ``nearest`` prefers the
    earlier row when both sides are equally far.  ``width_seconds`` gives time
    blocks for regular series; otherwise the rows are range partitioned, so hot
    keys and bursts are split.  Left rows without a time or a key match nothing.
    """
    nowhere = F.col(left_on).isNull()
    for name in by:
        nowhere = nowhere | F.col(name).isNull()
    unmatched, left = left.where(nowhere), left.where(~nowhere)
    types = {f.name: f.dataType for f in right.schema.fields}
    blank = [F.lit(None).cast(types[source]).alias(name) for name, source in take.items()]
    if matched_time:
        blank.append(F.lit(None).cast(types[right_on]).alias(matched_time))
    args = (by, left_on, right_on, take)
    rest = (allow_exact, tie, width_seconds)
    if direction == "nearest":
        back = _one_way(left, right, *args, False, *rest, "__b")
        both = _one_way(back, right, *args, True, *rest, "__f")
        here = micros(left_on)
        gap_back = here - micros(F.col("__b.__time"))
        gap_fwd = micros(F.col("__f.__time")) - here
        pick_forward = F.col("__b").isNull() | (gap_fwd < gap_back)
        found = both.withColumn("__m", F.when(pick_forward, F.col("__f")).otherwise(F.col("__b"))).drop("__b", "__f")
    elif direction in ("backward", "forward"):
        found = _one_way(left, right, *args, direction == "forward", *rest, "__m")
    else:
        raise ValueError(f"unknown direction {direction!r}")
    match: Column = F.col("__m")
    if tolerance_seconds is not None:
        far = F.abs(micros(F.col("__m.__time")) - micros(left_on)) > int(tolerance_seconds * 1_000_000)
        match = F.when(~far, match)
    found = found.withColumn("__m", match)
    columns = [F.col(f"__m.{name}").alias(name) for name in take]
    if matched_time:
        columns.append(F.col("__m.__time").alias(matched_time))
    found = found.select(*[F.col(c) for c in left.columns], *columns)
    return found.unionByName(unmatched.select(*[F.col(c) for c in left.columns], *blank))


def interval_sums(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    length_seconds: int,
    sums: Mapping[str, Column],
    decayed: Mapping[str, Column] | None = None,
    tau_seconds: float | None = None,
    slices: int = 16,
    newest: str | None = None,
) -> DataFrame:
    """Sums over right rows with ``t - length <= time <= t`` for every left row.

    Time is cut into buckets as long as the interval, so an interval is the tail
    of one bucket plus the head of the next.  Both are running sums *inside* a
    bucket; no pairs are formed and no long prefix loses precision.  Right rows
    of one (key, instant) are added up before the shuffle and buckets are sliced,
    so a hot key, bucket or instant is spread.  ``decayed`` values are weighted
    by ``exp(-age/tau)``, which factors over bucket starts.  ``newest`` names a column for
    the epoch microseconds of the newest right row of the interval, a running maximum of the same pass.
    """
    decayed = dict(decayed or {})
    length = length_seconds * 1_000_000
    tau = (tau_seconds or 1.0) * 1_000_000.0
    keys = [f"__k{i}" for i in range(len(by))]
    at = micros(right_on)
    growth = F.exp(F.pmod(at, F.lit(length)) / F.lit(tau))
    names = [*sums, *decayed]
    events = (
        right.where(F.col(right_on).isNotNull())
        .select(
            *[F.col(b).alias(k) for b, k in zip(by, keys)],
            at.alias("__t"),
            *[expr.cast("double").alias(name) for name, expr in sums.items()],
            *[(expr.cast("double") * growth).alias(name) for name, expr in decayed.items()],
        )
        .groupBy(*keys, "__t")
        .agg(*[F.sum(name).alias(name) for name in names])
        .withColumn("__side", F.lit(0))
        .withColumn("__bucket", F.floor(F.col("__t") / length))
    )
    points = left.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], micros(left_on).alias("__at")).distinct()
    ends = points.select(
        *keys,
        "__at",
        F.explode(
            F.array(
                F.struct(F.col("__at").alias("t"), F.lit(1).alias("side")),
                F.struct((F.col("__at") - length).alias("t"), F.lit(-1).alias("side")),
            )
        ).alias("__e"),
    ).select(
        *keys,
        "__at",
        F.col("__e.t").alias("__t"),
        F.col("__e.side").alias("__side"),
        F.floor(F.col("__e.t") / length).alias("__bucket"),
    )
    rows = events.unionByName(ends, allowMissingColumns=True).withColumn(
        BLOCK, F.floor(F.pmod(F.col("__t"), F.lit(length)) * slices / length).cast("long")
    )
    series = [*keys, "__bucket"]
    heads = running(
        rows, series, ["__t", "__side"],
        {f"__p_{n}": ("sum", F.coalesce(F.col(n), F.lit(0.0))) for n in names}
        | ({"__pt": ("max", F.when(F.col("__side") == 0, F.col("__t")))} if newest else {}),
    ).where(F.col("__side") != 0)
    totals = events.groupBy(*series).agg(*[F.sum(n).alias(f"__b_{n}") for n in names], *([F.max("__t").alias("__bt")] if newest else []))
    heads = heads.drop(*names).join(totals, series, "left")
    fade = F.exp(-(F.col("__at") - F.col("__bucket") * length) / F.lit(tau))

    def part(name: str) -> Column:
        total = F.coalesce(F.col(f"__b_{name}"), F.lit(0.0))
        value = F.when(F.col("__side") > 0, F.col(f"__p_{name}")).otherwise(total - F.col(f"__p_{name}"))
        return value * fade if name in decayed else value

    # The newest of the head, else that of the tail, whose bucket is the one before.
    last = [F.max(F.when(F.col("__side") > 0, F.col("__pt")).when(F.col("__bt") >= F.col("__t"), F.col("__bt"))).alias(newest)] if newest else []
    answers = heads.groupBy(*keys, "__at").agg(*[F.sum(part(n)).alias(n) for n in names], *last)
    tagged = left.withColumn("__at", micros(left_on))
    for source, key in zip(by, keys):
        tagged = tagged.withColumn(key, F.col(source))
    return tagged.join(answers, [*keys, "__at"], "left").drop(*keys, "__at")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The ``n`` newest rows per key.  For small ``n`` Spark also ranks before the shuffle; a large one moves all rows."""
    return (
        df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        .where(F.col("__rank") <= n)
        .drop("__rank")
    )
