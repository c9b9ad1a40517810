"""Chronological splits, purged folds and walk-forward folds.

Only fold boundaries and a bounded part of the timestamp counts reach the driver: the
edges of their pages and the pages a boundary falls into (``Timeline``).  Rows then take
their fold roles from literal boundaries in a map-only pass.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ranks import value_ranks
from tidemark.operators.series import BLOCK, micros, positions, range_blocks
from tidemark.session import checkpointed

Window = int | dt.timedelta


class _Enough(Exception):
    """As many pages are asked for as one round reads."""


class Timeline:
    """Answers position and time questions about a column of timestamps.

    The timestamp counts are cut into pages of neighbouring positions, of which the driver
    holds the edges (at most ``PAGES`` of them).  A question that the edges leave open is
    guessed between them, so that a walk goes on, and its page is read; a round reads up to
    ``ROUND`` pages, in the order in which they were met.  The result of a walk is taken
    once nothing in it was guessed.
    """

    PAGES = 16384
    LEAST = 1024
    ROUND = 256

    def __init__(self, df: DataFrame, time: str) -> None:
        counts = df.select(micros(time).alias("t")).withColumn("__all", F.lit(0))
        self._cohorts = checkpointed(value_ranks(counts, ["__all"], "t").select("t", "upto"))
        row = self._cohorts.agg(F.max("upto").alias("n")).first()
        self.count = int(row["n"] or 0)
        width = max(self.LEAST, math.ceil(self.count / self.PAGES))
        self._page = F.floor((F.col("upto") - 1) / F.lit(width)).cast("long")
        edges = self._cohorts.groupBy(self._page.alias("page")).agg(
            F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("upto").alias("u0"), F.max("upto").alias("u1")
        ).collect()
        table = np.array(sorted(tuple(e) for e in edges), dtype=np.int64).reshape(-1, 5)
        self._ids, self._t0, self._t1, self._u0, self._u1 = table.T
        self._pages: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._known: dict[tuple[str, int], int] = {}
        self._asked: dict[int, None] = {}

    def _get(self, kind: str, at: int) -> int:
        if (kind, at) in self._known:
            return self._known[kind, at]
        found, page, guess = getattr(self, f"_{kind}")(at)
        if found is None:
            if page not in self._asked and len(self._asked) == self.ROUND:
                raise _Enough
            self._asked[page] = None
            return guess
        self._known[kind, at] = int(found)
        return int(found)

    def _end(self, position: int):
        """The least end of a cohort at or behind ``position``."""
        i = int(np.searchsorted(self._u1, position, "left"))
        if self._u0[i] >= position:
            return self._u0[i], None, None
        if self._ids[i] in self._pages:
            upto = self._pages[self._ids[i]][1]
            return upto[np.searchsorted(upto, position, "left")], None, None
        return None, int(self._ids[i]), position

    def _time(self, position: int):
        """The timestamp of the row at ``position``."""
        i = int(np.searchsorted(self._u1, position, "right"))
        if i == len(self._u1):
            return self.count, None, None
        if self._u0[i] > position:
            return self._t0[i], None, None
        if self._ids[i] in self._pages:
            t, upto = self._pages[self._ids[i]]
            return t[np.searchsorted(upto, position, "right")], None, None
        share = (position - int(self._u0[i])) / max(1, int(self._u1[i] - self._u0[i]))
        return None, int(self._ids[i]), int(self._t0[i]) + int(share * int(self._t1[i] - self._t0[i]))

    def _first(self, when: int):
        """How many rows are earlier than ``when``."""
        i = int(np.searchsorted(self._t0, when, "left")) - 1
        if i < 0:
            return 0, None, None
        if self._t1[i] < when:
            return self._u1[i], None, None
        if self._ids[i] in self._pages:
            t, upto = self._pages[self._ids[i]]
            return upto[np.searchsorted(t, when, "left") - 1], None, None
        share = (when - int(self._t0[i])) / max(1, int(self._t1[i] - self._t0[i]))
        return None, int(self._ids[i]), int(self._u0[i]) + int(share * int(self._u1[i] - self._u0[i]))

    def cohort_end(self, position: int) -> int:
        """Move a boundary behind the rows that share its last row's timestamp."""
        if position <= 0 or position >= self.count:
            return position
        return self._get("end", position)

    def time_at(self, position: int) -> int:
        return self._get("time", position)

    def first_not_before(self, when: int) -> int:
        return self._get("first", when)

    def settle(self, compute: Callable[[], object]):
        """Run ``compute`` until none of its questions is open."""
        while True:
            self._asked.clear()
            result = None
            try:
                result = compute()
            except _Enough:
                pass
            if not self._asked:
                return result
            self._read(list(self._asked))

    def _read(self, pages: list[int]) -> None:
        found = self._cohorts.where(self._page.isin(pages)).select(self._page.alias("page"), "t", "upto").toArrow()
        page, t, upto = (found.column(c).to_numpy() for c in ("page", "t", "upto"))
        order = np.argsort(upto)
        page, t, upto = page[order], t[order], upto[order]
        # Answers are kept, so the pages of earlier rounds are not needed again.
        self._pages = {p: (t[page == p], upto[page == p]) for p in pages}

    def skip(self, start: int, window: Window) -> int:
        """First position after a row-count or duration window that begins at ``start``."""
        if not window or start >= self.count:
            return min(start, self.count)
        if isinstance(window, int):
            return min(self.count, start + window)
        return max(start, self.first_not_before(self.time_at(start) + _us(window)))

    def back(self, end: int, window: Window) -> int:
        if isinstance(window, int):
            return max(0, end - window)
        if end <= 0:
            return 0
        return min(end, self.first_not_before(self.time_at(end - 1) - _us(window)))


def _us(window: dt.timedelta) -> int:
    return window // dt.timedelta(microseconds=1)


def with_positions(df: DataFrame, time: str, seq: str) -> DataFrame:
    """Stable chronological row number over the whole table, in balanced blocks."""
    staged = df.withColumn("__all", F.lit(0))
    return positions(range_blocks(staged, ["__all"], [time, seq]), ["__all"], [time, seq]).drop("__all", BLOCK)


def chronological_split(
    df: DataFrame, time: str, seq: str, train: float = 0.6, validation: float = 0.2
) -> DataFrame:
    """Mark rows train/validation/test without separating equal timestamps."""
    line = Timeline(df, time)
    if line.count < 3:
        raise ValueError("a chronological split needs at least three rows")

    def bounds() -> tuple[int, int]:
        first = line.cohort_end(max(1, math.floor(line.count * train)))
        second = line.cohort_end(max(first, math.floor(line.count * (train + validation))))
        return first, first if validation == 0 else second

    train_end, validation_end = line.settle(bounds)
    if validation_end >= line.count:
        raise ValueError("the fractions leave no test rows")
    if validation > 0 and validation_end <= train_end:
        raise ValueError("the fractions leave no validation rows")
    # Both edges close a cohort, so the split is a comparison with two times and
    # rows need no number of their own.
    edges = line.settle(lambda: (line.time_at(train_end), line.time_at(validation_end)))
    at = micros(time)
    return df.withColumn(
        "split", F.when(at < edges[0], "train").when(at < edges[1], "validation").otherwise("test")
    )


@dataclass(frozen=True)
class Fold:
    number: int
    train_start: int
    train_end: int
    validation_start: int
    validation_end: int
    test_start: int
    test_end: int
    test_time: int


def walk_forward_folds(
    df: DataFrame,
    time: str,
    train: Window,
    test: Window,
    validation: Window = 0,
    step: Window | None = None,
    purge: Window = 0,
    embargo: Window = 0,
    expanding: bool = True,
) -> list[Fold]:
    line = Timeline(df, time)
    step = step or test

    def plan() -> list[Fold]:
        folds: list[Fold] = []
        train_end = line.skip(0, train)
        while 0 < train_end < line.count:
            validation_start = line.cohort_end(line.skip(train_end, purge))
            if validation_start >= line.count:
                break
            validation_end = line.cohort_end(line.skip(validation_start, validation))
            test_start = line.cohort_end(line.skip(validation_end, embargo))
            if test_start >= line.count:
                break
            test_end = line.cohort_end(line.skip(test_start, test))
            if test_end <= test_start:
                break
            start = 0 if expanding else line.back(train_end, train)
            folds.append(
                Fold(len(folds), start, train_end, validation_start, validation_end, test_start, test_end,
                     line.time_at(test_start))
            )
            following = line.cohort_end(line.skip(train_end, step))
            if following <= train_end:
                break
            train_end = following
        return folds

    return line.settle(plan)


def _fold_literal(folds: list[Fold]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(f.number).alias("fold"),
                *[F.lit(getattr(f, n)).cast("long").alias(n) for n in
                  ("train_start", "train_end", "validation_start", "validation_end", "test_start", "test_end", "test_time")],
            )
            for f in folds
        ]
    )


def fold_roles(rows: DataFrame, folds: list[Fold], label_end: str | None, pos: str = "pos") -> DataFrame:
    """One row per (row, fold) it plays a part in: train, purged, validation, embargoed, test."""
    p = F.col(pos)
    late = micros(label_end) if label_end else F.lit(None).cast("long")

    def role(f: Column) -> Column:
        return (
            F.when(
                (p >= f["train_start"]) & (p < f["train_end"]),
                F.when(late > f["test_time"], "purged").otherwise("train"),
            )
            .when((p >= f["train_end"]) & (p < f["validation_start"]), "purged")
            .when((p >= f["validation_start"]) & (p < f["validation_end"]), "validation")
            .when((p >= f["validation_end"]) & (p < f["test_start"]), "embargoed")
            .when((p >= f["test_start"]) & (p < f["test_end"]), "test")
        )

    if not folds:
        return rows.withColumn("fold", F.lit(0)).withColumn("role", F.lit("")).where(F.lit(False))
    parts = F.transform(_fold_literal(folds), lambda f: F.struct(f["fold"].alias("fold"), role(f).alias("role")))
    return (
        rows.withColumn("__p", F.explode(F.filter(parts, lambda x: x["role"].isNotNull())))
        .withColumn("fold", F.col("__p.fold"))
        .withColumn("role", F.col("__p.role"))
        .drop("__p")
    )


def purged_folds(
    df: DataFrame,
    time: str,
    seq: str,
    label_end: str,
    n_splits: int = 5,
    min_train: int = 1,
    test_size: int | None = None,
    purge: Window = 0,
    embargo: Window = 0,
) -> DataFrame:
    """Expanding folds with a purge of overlapping labels and gaps before the test block.

    A row is purged when its label ends inside the test block; else embargoed when
    within the embargo before it; else purged when within the purge gap.  Folds
    left with fewer than ``min_train`` training rows are dropped and the rest
    renumbered.
    """
    line = Timeline(df, time)
    n = line.count
    if n <= min_train:
        raise ValueError("not enough rows for the minimum training size")
    size = test_size or max(1, (n - min_train) // n_splits)
    first = max(n - size * n_splits, min_train)
    starts = list(range(first, n, size))
    times = line.settle(lambda: [line.time_at(s) for s in starts])
    at, late = micros(time), micros(label_end)
    rows = with_positions(df, time, seq)
    p = F.col("pos")

    def near(window: Window, start: Column, when: Column) -> Column:
        if not window:
            return F.lit(False)
        if isinstance(window, int):
            return start - p <= window
        return when - at <= _us(window)

    def role(f: Column) -> Column:
        return (
            F.when((p >= f["s"]) & (p < f["s"] + size), "test")
            .when(p >= f["s"] + size, None)
            .when(late > f["t"], "purged")
            .when(near(embargo, f["s"], f["t"]), "embargoed")
            .when(near(purge, f["s"], f["t"]), "purged")
            .otherwise("train")
        )

    table = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(t).cast("long").alias("t")) for s, t in zip(starts, times)])
    parts = F.transform(table, lambda f: F.struct(f["s"].alias("s"), role(f).alias("role")))
    spread = (
        rows.withColumn("__p", F.explode(F.filter(parts, lambda x: x["role"].isNotNull())))
        .withColumn("__s", F.col("__p.s"))
        .withColumn("role", F.col("__p.role"))
        .drop("__p")
    )
    # The number of training rows per candidate fold is at most len(starts) values.
    sizes = {
        r["__s"]: r["n"]
        for r in spread.where(F.col("role") == "train").groupBy("__s").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    kept = [s for s in starts if sizes.get(s, 0) >= min_train][:n_splits]
    number = F.coalesce(*[F.when(F.col("__s") == s, i) for i, s in enumerate(kept)], F.lit(-1))
    return spread.withColumn("fold", number).where(F.col("fold") >= 0).drop("__s")


def purge_before(df: DataFrame, label_end: str, next_start: Column) -> DataFrame:
    """Keep rows whose label is known when the next period starts."""
    return df.where(F.col(label_end) <= next_start)
