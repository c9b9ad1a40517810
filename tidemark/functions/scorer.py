"""Text scorers that can be exchanged: a model loaded once per worker, its scores as columns.

A scorer is a function that loads a model and a model is a function from a series of texts to a
frame of scores.  It runs over Arrow batches.  The lexicon needs neither: it is the default and
stays a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.numeric import clamp
from tidemark.functions.text import blended_sentiment, offline_sentiment

Model = Callable[[pd.Series], pd.DataFrame]
Loader = Callable[[], Model]

#: Models of this Python worker, by name; a worker serves many tasks.
_LOADED: dict[str, Model] = {}


def _model(name: str, load: Loader) -> Model:
    from tidemark.functions import scorer

    if name not in scorer._LOADED:
        scorer._LOADED[name] = load()
    return scorer._LOADED[name]


def text_scorer(name: str, load: Loader, scores: Mapping[str, str]):
    """A batch function from a text column to a struct of ``scores`` (name to type); null texts give null scores.

    ``name`` tells models apart in a worker: another model or version needs another name.  Scorers of the
    same rows share a worker and its batch of texts (functions over iterators would each need their own).
    """
    schema = ", ".join(f"{n} {t}" for n, t in scores.items())

    @F.pandas_udf(f"struct<{', '.join(f'{n}: {t}' for n, t in scores.items())}>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({n: pd.Series([None] * len(texts), dtype="object") for n in scores})
        known = texts.notna()
        if known.any():
            made = _model(name, load)(texts[known])
            missing = [n for n in scores if n not in made]
            if missing or len(made) != int(known.sum()):
                raise ValueError(f"scorer {name} gave {len(made)} rows for {int(known.sum())} texts, without {missing}: {schema} is needed")
            for n in scores:
                out.loc[known, n] = list(made[n])
        return out.infer_objects()

    return scored


def register(spark: SparkSession, name: str, load: Loader, scores: Mapping[str, str]) -> None:
    """Makes the scorer a function of SQL."""
    spark.udf.register(name, text_scorer(name, load, scores))


def smart_scores(rows: DataFrame, first: Column, second: Column, topics: Mapping[str, Column]) -> DataFrame:
    """``rows`` with the blend of two scorers' structs.

    ``first`` has positive, negative, neutral, ``second`` bullish, bearish, neutral.  Topics are columns of
    risks that are known from words; the largest risk counts.
    """
    out = rows.withColumns({"__a": first, "__b": second})
    a, b = F.col("__a.positive") - F.col("__a.negative"), F.col("__b.bullish") - F.col("__b.bearish")
    sure_a = F.greatest("__a.positive", "__a.negative", "__a.neutral")
    sure_b = F.greatest("__b.bullish", "__b.bearish", "__b.neutral")
    mixed = blended_sentiment(clamp(a), clamp(b))
    return out.withColumns({
        "sentiment_score": mixed, "sentiment_confidence": F.greatest(sure_a, sure_b),
        "risk_score": F.least(F.lit(1.0), F.greatest("__a.negative", "__b.bearish", *topics.values())),
        "impact_score": F.greatest(F.abs(mixed), sure_a * 0.5, sure_b * 0.5),
    }).drop("__a", "__b")


#: The risks known from words that a model's risk does not go below.
TOPIC_RISKS = ("regulation_risk_score", "security_risk_score", "war_risk_score")


def score_news(rows: DataFrame, lowered: str, first: Column | None = None, second: Column | None = None) -> DataFrame:
    """``rows`` with sentiment, confidence, risk, impact and topics.

    Without a scorer the lexicon's columns; with one its scores beside the lexicon's topics; with two
    their blend.  ``first`` is a struct of positive, negative, neutral, ``second`` of bullish, bearish, neutral.
    """
    rules = offline_sentiment(lowered)
    if first is None and second is None:
        return rows.withColumns(rules)
    scored = ("positive", "negative", "sentiment_score", "sentiment_confidence", "risk_score", "impact_score")
    out = rows.withColumns({c: v for c, v in rules.items() if c not in scored})
    if first is not None and second is not None:
        return smart_scores(out, first, second, {t: F.col(t) for t in TOPIC_RISKS})
    names = ("positive", "negative") if first is not None else ("bullish", "bearish")
    staged = out.withColumn("__s", first if first is not None else second)
    up, down = (F.col(f"__s.{n}") for n in names)
    sure = F.greatest(up, down, F.col("__s.neutral"))
    return staged.withColumns({"sentiment_score": clamp(up - down), "sentiment_confidence": sure, "risk_score": down, "impact_score": sure}).drop("__s")
