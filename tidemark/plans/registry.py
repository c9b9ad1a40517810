"""Where queries and their SQL counterparts are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COMMON: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Register a query; ``uses`` names shared CTEs the SQL text builds on."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_common(sql, uses)
        return fn

    return add


def common(name: str, text: str) -> None:
    COMMON[name] = text.strip()


def with_common(sql: str, uses: str) -> str:
    parts = [f"{name} AS (\n{COMMON[name]}\n)" for name in uses.split()]
    body = sql.strip()
    if not parts:
        return body
    head, recursive = "WITH ", body.upper().startswith("WITH RECURSIVE")
    if recursive:
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH "):
        return head + ",\n".join(parts) + ",\n" + body[5:]
    return head + ",\n".join(parts) + "\n" + body


def rnd(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero, so both engines print it alike."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


# Short decimals often end exactly half way between two rounded values, where the
# last bit of a double decides.  The nudge moves them off the half in both engines.
NUDGE = 1e-12


def rnd_nudged(column: Column | str, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)


def sql_nudged(values: list[str], digits: int = 6) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE) + {NUDGE}, {digits}) + 0.0 AS {v}" for v in values)


def rounded(df: DataFrame, keep: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[rnd(v, digits).alias(v) for v in values])


def sql_round(values: list[str], digits: int = 6) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE), {digits}) + 0.0 AS {v}" for v in values)
