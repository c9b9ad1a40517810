"""Rows of unknown shape: JSON lines, JSON arrays, and CSV cells that hold JSON.

Cells are VARIANT values and get a type when they are read.  What cannot be parsed is kept as text in
``bad_record``; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BAD = "bad_record"


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """row variant, bad_record: a line each; blank lines are none.  A line that is no JSON object is bad."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "")
    return _told(lines, F.col("value"))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """row variant, bad_record: an element each of files that are one array.  A file that is no array, or an element that is no object, is bad."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    parsed = F.from_json("value", "array<variant>")
    whole = files.select("value", parsed.alias("items"), F.ltrim("value").startswith("[").alias("array"))
    good = F.col("array") & F.col("items").isNotNull()
    rows = whole.where(good).select(F.explode("items").alias("row"))
    kept = rows.select(F.when(_is_object("row"), F.col("row")).alias("row"), F.when(~_is_object("row"), F.to_json("row")).alias(BAD))
    return kept.unionByName(whole.where(~F.coalesce(good, F.lit(False))).select(F.lit(None).cast("variant").alias("row"), F.col("value").alias(BAD)))


def _is_object(column: str) -> Column:
    return F.coalesce(F.schema_of_variant(column).startswith("OBJECT"), F.lit(False))


def _told(lines: DataFrame, text: Column) -> DataFrame:
    parsed = lines.select(text.alias("value"), F.try_parse_json(text).alias("row"))
    return parsed.select(F.when(_is_object("row"), F.col("row")).alias("row"), F.when(~_is_object("row"), F.col("value")).alias(BAD))


def cell(text: Column) -> Column:
    """A CSV cell as a variant: JSON if it looks like an object or array and is one, true and false as booleans, else the text itself."""
    trimmed = F.trim(text)
    looks = trimmed.rlike(r"^[\[{]")
    lowered = F.lower(trimmed)
    as_text = F.to_variant_object(F.array(text))
    plain = F.variant_get(as_text, "$[0]", "variant")
    return (
        F.when(text.isNull(), F.lit(None).cast("variant")).when(lowered.isin("true", "false"), F.try_parse_json(lowered))
        .when(looks & F.try_parse_json(trimmed).isNotNull(), F.try_parse_json(trimmed)).otherwise(plain)
    )


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """The columns of CSV files with a header, each cell a variant; a line with too few or too many cells is in ``bad_record`` as well."""
    header = spark.read.option("header", True).option("escape", '"').option("recursiveFileLookup", True).csv(path)
    schema = ", ".join(f"`{c}` string" for c in header.columns)
    raw = spark.read.option("header", True).option("escape", '"').option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", BAD).schema(f"{schema}, {BAD} string").csv(path)
    return raw.select(*[cell(F.col(c)).alias(c) for c in header.columns], BAD)


def typed(rows: DataFrame, fields: Mapping[str, tuple[str, str]], row: str = "row") -> DataFrame:
    """Fields of a variant column by path and type, null where there is none or it does not fit; with ``bad_record``."""
    return rows.select(*[F.try_variant_get(row, path, kind).alias(name) for name, (path, kind) in fields.items()], BAD)
