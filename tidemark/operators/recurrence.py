"""Exact linear recurrences y = a * y_prev + b over blocks of a series."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.operators.series import BLOCK


def _fold(a, b, start: float):
    out = []
    y = start
    for x, z in zip(a, b):
        y = x * y + z
        out.append(y)
    return out, y


def linear_scan(
    blocks: DataFrame, keys: Sequence[str], order: Sequence[str], a: str, b: str, name: str, start: float = 0.0
) -> DataFrame:
    """Add ``name`` = a * previous + b, following ``order`` inside each key.

    ``blocks`` carries the block column of ``range_blocks``.  Each block is first
    reduced to its own map (slope, offset); the short list of maps per key gives
    every block its starting value; then each block is folded once more.  A long
    series therefore spreads over as many tasks as it has blocks.
    """
    keys, order = list(keys), list(order)
    key_fields = [blocks.schema[k] for k in keys]

    def squeeze(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        _, offset = _fold(pdf[a].to_numpy(), pdf[b].to_numpy(), 0.0)
        out = pdf[keys + [BLOCK]].iloc[:1].copy()
        out["__slope"] = float(pdf[a].prod())
        out["__offset"] = float(offset)
        return out

    map_schema = T.StructType(
        [*key_fields, T.StructField(BLOCK, T.LongType()), T.StructField("__slope", T.DoubleType()),
         T.StructField("__offset", T.DoubleType())]
    )
    maps = blocks.select(*keys, BLOCK, *order, a, b).groupBy(*keys, BLOCK).applyInPandas(squeeze, map_schema)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        ends, _ = _fold(pdf["__slope"].to_numpy(), pdf["__offset"].to_numpy(), start)
        out = pdf[keys + [BLOCK]].copy()
        out["__start"] = [start, *ends[:-1]]
        return out

    start_schema = T.StructType(
        [*key_fields, T.StructField(BLOCK, T.LongType()), T.StructField("__start", T.DoubleType())]
    )
    starts = maps.groupBy(*keys).applyInPandas(chain, start_schema)

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        values, _ = _fold(pdf[a].to_numpy(), pdf[b].to_numpy(), float(pdf["__start"].iloc[0]))
        pdf[name] = values
        return pdf.drop(columns=["__start"])

    joined = blocks.join(starts, [*keys, BLOCK])
    schema = T.StructType([*[f for f in joined.schema.fields if f.name != "__start"], T.StructField(name, T.DoubleType())])
    return joined.groupBy(*keys, BLOCK).applyInPandas(expand, schema).select(*blocks.columns, name)
