"""Text expressions: tokens, keyword scores, structured events, cleaning."""

from __future__ import annotations

import html
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tidemark.functions import lexicon as lx
from tidemark.functions.numeric import clamp


def words(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_list(text: Column, shortest: int = 1) -> Column:
    pattern = "[a-z0-9]+" if shortest == 1 else f"[a-z0-9]{{{shortest},}}"
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def token_set(text: Column, shortest: int = 1) -> Column:
    return F.array_distinct(token_list(text, shortest))


def token_hits(tokens: Column, vocabulary: Sequence[str]) -> Column:
    return F.size(F.array_intersect(tokens, words(vocabulary)))


def phrase_hits(lowered: Column, phrases: Sequence[str]) -> Column:
    total = F.lit(0)
    for phrase in phrases:
        total = total + F.contains(lowered, F.lit(phrase)).cast("int")
    return total


def any_phrase(lowered: Column, phrases: Sequence[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(lowered, F.lit(phrase))
    return hit


def labels_where(conditions: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))


def live_sentiment(lowered: str, tokens: str) -> dict[str, Column]:
    """Lexicon sentiment: tokens count one, phrases two, reassuring phrases take two back.

    ``lowered`` and ``tokens`` name prepared columns, so texts are scanned once.
    """
    low, toks = F.col(lowered), F.col(tokens)
    calm = phrase_hits(low, lx.LIVE_REDUCING_PHRASES)
    positive = token_hits(toks, lx.LIVE_POSITIVE) + 2 * phrase_hits(low, lx.LIVE_POSITIVE_PHRASES) + calm
    negative = token_hits(toks, lx.LIVE_NEGATIVE) + 2 * phrase_hits(low, lx.LIVE_NEGATIVE_PHRASES)
    risk = token_hits(toks, lx.LIVE_RISK) + phrase_hits(low, lx.LIVE_RISK_PHRASES)
    negative = F.greatest(negative - 2 * calm, F.lit(0))
    risk = F.greatest(risk - 2 * calm, F.lit(0))
    return {
        "positive": positive,
        "negative": negative,
        "risk_hits": risk,
        "topics": labels_where({t: F.arrays_overlap(toks, words(w)) for t, w in lx.LIVE_TOPICS.items()}),
        "affected_symbols": labels_where({s: F.arrays_overlap(toks, words(w)) for s, w in lx.LIVE_SYMBOLS.items()}),
    }


def live_sentiment_scores() -> dict[str, Column]:
    """Scores from the counts of ``live_sentiment``."""
    p, n = F.col("positive"), F.col("negative")
    score = clamp((p - n) / F.greatest(p + n, F.lit(1)))
    return {
        "sentiment_score": score,
        "risk_score": clamp(F.col("risk_hits") / 4.0, 0.0, 1.0),
        "sentiment_label": F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral"),
        "confidence": F.when(score != 0, F.least(F.abs(score), F.lit(0.75))).otherwise(0.5),
    }


def offline_sentiment(lowered: str) -> dict[str, Column]:
    """Substring sentiment and topic flags of the training variant."""
    low = F.col(lowered)
    positive = phrase_hits(low, lx.OFFLINE_POSITIVE)
    negative = phrase_hits(low, lx.OFFLINE_NEGATIVE)
    symbols = labels_where({s: any_phrase(low, w) for s, w in lx.OFFLINE_SYMBOLS.items()})
    macro = any_phrase(low, lx.OFFLINE_MACRO)
    regulation = any_phrase(low, lx.OFFLINE_REGULATION)
    security = any_phrase(low, lx.OFFLINE_SECURITY)
    flag = lambda c: c.cast("double")
    return {
        "positive": positive,
        "negative": negative,
        "affected_symbols": symbols,
        "sentiment_score": clamp((positive - negative) / 3.0),
        "sentiment_confidence": F.least(F.lit(1.0), 0.35 + 0.12 * (positive + negative + F.size(symbols))),
        "risk_score": F.least(F.lit(1.0), phrase_hits(low, lx.OFFLINE_RISK) / 4.0),
        "impact_score": F.least(
            F.lit(1.0),
            0.15 + 0.15 * F.size(symbols) + F.when(macro, 0.25).otherwise(0.0) + F.when(regulation, 0.2).otherwise(0.0),
        ),
        "macro_related": flag(macro),
        **{f"{s[:-4].lower()}_related": flag(any_phrase(low, w)) for s, w in lx.OFFLINE_SYMBOLS.items()},
        "regulation_risk_score": flag(regulation),
        "fed_risk_score": flag(any_phrase(low, lx.OFFLINE_FED)),
        "war_risk_score": flag(any_phrase(low, lx.OFFLINE_WAR)),
        "security_risk_score": flag(security),
        "exchange_hack_risk_score": flag(security & any_phrase(low, lx.OFFLINE_EXCHANGE)),
        "etf_bullish_score": flag(any_phrase(low, lx.OFFLINE_ETF)),
    }


def blended_sentiment(first: Column, second: Column) -> Column:
    """Weighted mix of two model scores (the pluggable-scorer path)."""
    return clamp(first * 0.55 + second * 0.45)


def event_words(tokens: Column) -> Column:
    """The few tokens that are in any list of the rule-based event; the lists are then sought among these, not among all of the text."""
    lists = [*lx.EVENT_TYPES.values(), lx.EVENT_POSITIVE, lx.EVENT_NEGATIVE, lx.EVENT_SEVERE]
    return F.array_intersect(tokens, words(dict.fromkeys(w for some in lists for w in some)))


def structured_event(lowered: str, tokens: str, duplicate: Column, listed: str) -> dict[str, Column]:
    """Counts behind the rule-based event: first columns, then ``structured_event_scores``; ``listed`` holds the ``event_words`` of the tokens."""
    low, toks = F.col(lowered), F.col(listed)
    hits = {t: token_hits(toks, w) for t, w in lx.EVENT_TYPES.items()}
    best = F.greatest(*hits.values())
    kind = F.coalesce(*[F.when((best > 0) & (h == best), F.lit(t)) for t, h in hits.items()], F.lit("other"))
    every = "|".join(k for w in lx.EVENT_ASSETS.values() for k in w)
    named = F.regexp_extract_all(low, F.lit(rf"\b({every})\b"), F.lit(1))
    return {
        "positive": token_hits(toks, lx.EVENT_POSITIVE),
        "negative": token_hits(toks, lx.EVENT_NEGATIVE),
        "severe": token_hits(toks, lx.EVENT_SEVERE),
        "event_hits": best,
        "event_type": kind,
        "word_count": F.size(F.col(tokens)),
        "is_duplicate": duplicate,
        "asset_names": named,
    }


def _asset_hits() -> Column:
    """Assets named in the text with how often, from the extracted names."""
    count = lambda w: F.size(F.filter("asset_names", lambda n: n.isin(*w)))
    cells = [F.struct(F.lit(a).alias("asset"), count(w).alias("hits")) for a, w in lx.EVENT_ASSETS.items()]
    return F.filter(F.array(*cells), lambda a: a["hits"] > 0)


def structured_event_scores() -> dict[str, Column]:
    p, n, severe, hits, n_words = (F.col(c) for c in ("positive", "negative", "severe", "event_hits", "word_count"))
    kind = F.col("event_type")
    sentiment = clamp((p - n) / F.greatest(F.lit(1), p + n))
    severity = clamp(0.10 + severe * 0.18 + F.when(kind == "security_incident", 0.08).otherwise(0.0), 0.0, 1.0)
    return {
        "sentiment": sentiment,
        "direction": F.when(sentiment > 0.15, "bullish").when(sentiment < -0.15, "bearish")
        .when((p > 0) & (n > 0), "mixed").otherwise("neutral"),
        "severity": severity,
        "importance": clamp(0.10 + hits * 0.13 + severe * 0.12 + F.least(n_words, F.lit(500)) / 4000.0, 0.0, 1.0),
        "novelty": clamp(F.when(F.col("is_duplicate"), 0.10).otherwise(0.35 + F.least(n_words, F.lit(400)) / 2000.0), 0.0, 1.0),
        "confidence": clamp(0.35 + F.least(p + n + hits, F.lit(6)) * 0.07, 0.0, 0.85),
        "time_horizon": F.when(severity >= 0.70, "immediate").when(kind.isin("macro", "regulatory", "protocol"), "medium_term")
        .when(kind == "other", "unknown").otherwise("short_term"),
        "affected_assets": F.transform(_asset_hits(), lambda a: a["asset"]),
        "asset_probabilities": F.transform(
            _asset_hits(),
            lambda a: F.struct(a["asset"].alias("asset"), clamp(0.45 + F.least(a["hits"], F.lit(4)) * 0.10, 0.05, 0.95).alias("p")),
        ),
    }


def source_reliability(
    source: Column, url: Column, published: Column, received: Column, token_count: Column, duplicate: Column
) -> Column:
    """How complete the evidence of an article is; not a judgement of the publisher."""
    name = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    value = (
        F.lit(0.30)
        + F.when((name != "") & ~name.isin("unknown", "untitled"), 0.15).otherwise(0.0)
        + F.when(F.startswith(F.lower(F.coalesce(url, F.lit(""))), F.lit("https://")), 0.10).otherwise(0.0)
        + F.when(published.isNotNull(), 0.08).otherwise(0.0)
        + F.when(received.isNotNull(), 0.07).otherwise(0.0)
        + F.least(token_count, F.lit(200)) / 1000.0
        - F.when(duplicate, 0.20).otherwise(0.0)
    )
    return clamp(value, 0.05, 0.95)


def sentences(text: Column) -> Column:
    return F.split(F.trim(text), r"(?<=[.!?])\s+")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({lx.NUMBER_PATTERN})"), F.lit(1))


def claims(text: Column, most: int | None = None, chars: int | None = None, figures: int | None = None) -> Column:
    """Sentences that state numbers, with their numbers; all of them unless limits are given."""
    found = F.transform(
        sentences(text),
        lambda s: F.struct(
            (F.substring(s, 1, chars) if chars else s).alias("claim"), (F.slice(numbers(s), 1, figures) if figures else numbers(s)).alias("numbers")
        ),
    )
    stating = F.filter(found, lambda c: F.size(c["numbers"]) > 0)
    return F.slice(stating, 1, most) if most else stating


def plain_numbers(values: Column) -> Column:
    return F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, ",", ""), "%+$", ""))


def unverified_numbers(claimed: Column, source_text: Column) -> Column:
    """Claimed numbers that do not occur in the source text."""
    return F.array_except(plain_numbers(claimed), plain_numbers(numbers(source_text)))


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


# Entities decoded inside the JVM; only texts with others go to the Python decoder.
_COMMON_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©",
    "&middot;": "·",
}


_OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|apos|nbsp|copy|middot|amp);)#?\w+;"


def decode_common_entities(text: Column) -> Column:
    """Common entities only; ``&amp;`` last, so that nothing is decoded twice."""
    out = text
    for name, char in _COMMON_ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def decode_entities(text: Column) -> Column:
    """All HTML entities, by name or number."""
    return F.coalesce(_unescape(F.when(F.regexp_like(text, F.lit(_OTHER_ENTITY)), text)), decode_common_entities(text))


def strip_markup(raw: Column) -> Column:
    """Text between tags; script, style, noscript and comments are dropped."""
    out = F.regexp_replace(raw, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"<[/!?a-zA-Z][^>]*>", " ")
    return F.when(F.contains(raw, F.lit("<")) & F.contains(raw, F.lit(">")), out).otherwise(raw)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def clean_html(text: Column, every_entity: bool = True) -> Column:
    """Plain text of an HTML snippet; without ``every_entity`` only common names are decoded."""
    return squeeze(strip_markup(decode_entities(text) if every_entity else decode_common_entities(text)))


def base_asset(symbol: Column) -> Column:
    """Symbol without its quote currency, if something remains."""
    upper = F.upper(symbol)
    out = upper
    for suffix in reversed(lx.QUOTE_SUFFIXES):
        fits = F.endswith(upper, F.lit(suffix)) & (F.length(upper) > len(suffix))
        out = F.when(fits, F.left(upper, F.length(upper) - len(suffix))).otherwise(out)
    return out
