"""Small fixtures: odd rows, clashing columns, empty tables, and the smallest given tables."""

import random

import pytest

SF = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own.
CLASHING = ("node", "same", "part", "row", "cls", "fold", "score", "weight", "letters", "worst", "segment", "copy", "digest", "unit", "tree", "kept", "in_0")


def _words(n: int, seed: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice("river stone maple cloud ember frost lantern meadow harbor quill").lower() + str(pick.randrange(400)) for _ in range(n))


def odd_rows() -> list[tuple]:
    long_text = _words(40_000, 1)
    plain = _words(120, 2)
    near = plain.replace(plain.split()[60], "changed")
    return [
        (1, plain, "en"), (2, plain, "en"), (2, plain, "en"), (3, near, "en"), (4, None, "en"), (5, "", None), (6, " \t\n ", "fr"), (None, plain, "fr"),
        (None, "nobody knows this text at all", "fr"), (7, "two words", "fr"), (8, "two words", None), (9, long_text, "en"), (10, long_text + " end", "en"),
        (11, "123 456 !!", "en"), (12, "é ü ß \U0001f600 <|endoftext|> it's 'tis\r\n\r\n  x", "de"), (2, "another text under a used id", "de"), (13, "A" * 5000, "en"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    frame = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string").repartition(3)
    for i, name in enumerate(CLASHING):
        frame = frame.selectExpr("*", f"{i} AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
