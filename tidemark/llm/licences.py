"""Licence texts found by canonical digests, with DataFrame functions only.

A text is normalised: case, equivalent spellings, copyright lines, punctuation and
spacing.  The SHA-256 of what is left is joined to the digests of known licences, for
whole texts and for each of their lines, since notices stand within other text.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Short notices and licences by SPDX identifier.
KNOWN = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ],
}
#: Whole licences, as <SPDX identifier>[.<variant>].txt.
TEXTS = Path(__file__).parent / "licence_texts"
#: Titles that stand above licences whose text does not begin with one.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"], "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "Zlib": ["zlib License", "The zlib License"], "Unlicense": ["The Unlicense"],
}
#: What may follow the last term of a licence.
APPENDIX = re.compile(r"(?<=END OF TERMS AND CONDITIONS)\s.*", re.DOTALL)
#: Equivalent spellings, replaced in this order in lower-case text.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("https:", "http:"), ("copyright holder", "copyright owner"), ("&", " and ")]
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Known digests that are broadcast, about 10 MB; more are joined by shuffles.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """Normalised text; empty if nothing is left."""
    out = F.translate(text, UPPER, LOWER)
    for variant, usual in SPELLINGS:
        out = F.replace(out, F.lit(variant), F.lit(usual))
    return F.trim(F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, " "), PUNCTUATION, " "))


def digest(text: Column) -> Column:
    """The canonical digest; null for a text of which nothing is left."""
    plain = canonical(text)
    return F.when(plain != "", F.sha2(plain, 256))


def known_licences(spark: SparkSession) -> DataFrame:
    """Notices of ``KNOWN`` and the whole licences of ``TEXTS``."""
    notices = [(name, text) for name, texts in KNOWN.items() for text in texts]
    return spark.createDataFrame(notices + whole_licences(), "licence string, text string")


def whole_licences() -> list[tuple[str, str]]:
    """Each licence with and without title and appendix, as wrapped and with a line for each paragraph.

    How a text is wrapped matters only where a line of it begins like a copyright line.
    """
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = re.sub(r"\.[A-Z]\w*$", "", path.stem), path.read_text(encoding="utf-8")
        for body in dict.fromkeys([text, APPENDIX.sub("", text)]):
            for layout in (body, "\n\n".join(" ".join(part.split()) for part in re.split(r"\n\s*\n", body))):
                out.extend((name, title + layout) for title in ("", *[f"{t}\n\n" for t in TITLES.get(name, [])]))
    return out


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, text_licence, line_licences, licence_lines for every row of ``docs`` (doc_id, text).

    ``known`` has licence and text; a digest of several licences takes the first by
    name.  ``line_licences`` is the sorted array of those found in lines, each once, and
    ``licence_lines`` the number of such lines.  A null text, or one of which nothing is
    left, has a null digest and no licence.  Repeated rows have a row each.  Other
    columns are not read.
    """
    digests = known.select("licence", digest(F.col("text")).alias("digest")).where("digest IS NOT NULL").groupBy("digest").agg(F.min("licence").alias("licence"))
    if digests.count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    # The whole text first, then its lines; each is normalised once.
    plain = F.transform(F.concat(F.array(F.col("text")), F.split(F.coalesce("text", F.lit("")), "\n")), canonical)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    units = rows.select(
        "row", "doc_id", F.posexplode(F.transform(plain, lambda c: F.when(c != "", F.sha2(c, 256)))).alias("place", "digest")
    ).withColumn("whole", F.col("place") == 0)
    found = units.where("whole OR digest IS NOT NULL").join(digests, "digest", "left")
    line_hit = (~F.col("whole")) & F.col("licence").isNotNull()
    return found.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"), F.max(F.when(F.col("whole"), F.col("licence"))).alias("text_licence"),
        F.sort_array(F.collect_set(F.when(line_hit, F.col("licence")))).alias("line_licences"), F.count_if(line_hit).alias("licence_lines"),
    ).drop("row")
