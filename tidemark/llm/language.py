"""Language of a text by Kneser-Ney character models, with calibrated confidence and rejection.

Rows whose crc32(doc_id) mod 5 is 0 are held out.  Of the others, remainders 2 to 4
give the n-gram counts and remainder 1 the calibration: how often the best language
is right for a given evidence, and which cross-entropy a text of its language has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.arrays import text_slices
from tidemark.llm.charmodel import SLICE, CharModel, fitted, gram_counts, isotonic, symbols, usable

ORDER = 4
FOLDS = 5
NONE = "und"
#: Steps of log2(1 + evidence) over which confidence is calibrated.
BINS = 64
BINS_PER_DOUBLING = 4
#: Confidence below which a prediction is rejected, and deviations above the usual cross-entropy that are too many.
REJECT_BELOW = 0.5
DEVIATIONS = 8.0

_MEASURES = "letters long, best int, entropy double, evidence double"


def remainder(column: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


class _Measure:
    """Appends letters, the class of least cross-entropy (bits a symbol), that entropy, and the evidence for it."""

    def __init__(self, model, columns: list[str]) -> None:
        self.model, self.columns = model, columns

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: CharModel = self.model.value
        for batch in batches:
            for part in text_slices(batch, most=SLICE):
                letters, best, entropy, evidence = self._measured(model, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in self.columns], pa.array(letters, pa.int64()), pa.array(best, pa.int32()), pa.array(entropy), pa.array(evidence)],
                    [*self.columns, "letters", "best", "entropy", "evidence"],
                )

    @staticmethod
    def _measured(model: CharModel, texts: pa.Array) -> tuple[np.ndarray, ...]:
        found = symbols(texts, model.order)
        logs = model.log_probabilities(found).astype(np.float64)
        total = np.stack([np.bincount(found.text_of, logs[:, c], len(texts)) for c in range(model.classes)], axis=1)
        size = np.maximum(np.bincount(found.text_of, minlength=len(texts)), 1)
        entropies = -total / size[:, None] / np.log(2)
        best = entropies.argmin(axis=1)
        ordered = np.sort(entropies, axis=1)
        margin = ordered[:, 1] - ordered[:, 0] if model.classes > 1 else np.full(len(texts), np.inf)
        return found.letters, best, ordered[:, 0], np.minimum(margin * np.sqrt(size), 1e9)


def _bin(evidence: Column) -> Column:
    return F.least(F.floor(F.log2(1 + evidence) * BINS_PER_DOUBLING), F.lit(BINS - 1)).cast("int")


@dataclass
class LanguageModel:
    """A fitted model; ``confidence`` by bin of evidence, usual entropy and its spread by language."""

    languages: list[str]
    broadcast: object
    confidence: list[float]
    usual: list[float]
    spread: float
    wobble: float

    def measured(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
        return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(_Measure(self.broadcast, columns), f"{schema}, {_MEASURES}")

    def language(self) -> Column:
        return F.when(F.col("letters") > 0, F.element_at(F.array(*[F.lit(x) for x in self.languages]), F.col("best") + 1)).otherwise(NONE)

    def score(self) -> Column:
        table = F.array(*[F.lit(x) for x in self.confidence])
        return F.when(F.col("letters") > 0, F.element_at(table, _bin(F.col("evidence")) + 1)).otherwise(0.0)

    def rejected(self) -> Column:
        usual = F.element_at(F.array(*[F.lit(x) for x in self.usual]), F.col("best") + 1)
        ceiling = usual + DEVIATIONS * (self.wobble + self.spread / F.sqrt("letters"))
        return (F.col("letters") == 0) | (self.score() < REJECT_BELOW) | (F.col("entropy") > ceiling)


def fit(docs: DataFrame, order: int = ORDER) -> LanguageModel | None:
    """Learn from text and lang of ``docs`` (doc_id, text, lang); None if there is nothing to learn from."""
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL").withColumn("fold", remainder("doc_id", FOLDS))
    training = known.where(F.col("fold") >= 2)
    languages = sorted(r[0] for r in training.groupBy("lang").agg(F.count("text").alias("n")).where("n > 0").collect())
    if not languages:
        return None
    numbered = training.withColumn("cls", F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int") - 1)
    model = fitted(gram_counts(numbered, order), len(languages), order)
    if not usable(model):
        return None
    out = LanguageModel(languages, spark.sparkContext.broadcast(model), [1.0] * BINS, [0.0] * len(languages), 1.0, 1.0)
    seen = out.measured(known.where("fold = 1"), ["lang"]).where("letters > 0").withColumn("guess", out.language())
    out.confidence = _confidence(seen)
    _usual(out, seen)
    return out


def _confidence(seen: DataFrame) -> list[float]:
    """Share of right predictions by bin of evidence; a bin starts from one prediction that is right by half."""
    right = F.sum((F.col("guess") == F.col("lang")).cast("double"))
    rows = seen.groupBy(_bin(F.col("evidence")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), right.alias("right")).collect()
    n, good = np.ones(BINS), np.full(BINS, 0.5)
    for row in rows:
        n[row["bin"]] += row["n"]
        good[row["bin"]] += row["right"]
    return isotonic((good / n).tolist(), n.tolist())


def _usual(model: LanguageModel, seen: DataFrame) -> None:
    """Mean cross-entropy by language, its spread between texts, and the part of it that shrinks with length."""
    rows = seen.where("guess = lang").groupBy("best").agg(
        F.count(F.lit(1)).alias("n"), F.sum("entropy").alias("sum"), F.sum(F.col("entropy") ** 2).alias("squares"),
        F.sum(F.col("entropy") ** 2 * F.col("letters")).alias("a"), F.sum(F.col("entropy") * F.col("letters")).alias("b"), F.sum("letters").alias("c"),
    ).collect()
    n = sum(r["n"] for r in rows)
    if not n:
        model.usual = [float("inf")] * len(model.languages)
        return
    mean = sum(r["sum"] for r in rows) / n
    model.usual = [mean] * len(model.languages)
    for r in rows:
        model.usual[r["best"]] = r["sum"] / r["n"]
    inside = sum(r["squares"] - r["sum"] ** 2 / r["n"] for r in rows) / n
    scaled = sum(r["a"] - 2 * model.usual[r["best"]] * r["b"] + model.usual[r["best"]] ** 2 * r["c"] for r in rows) / n
    model.wobble, model.spread = max(inside, 0.0) ** 0.5 + 0.05, max(scaled, 0.0) ** 0.5 + 1.0


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, letters, rejected per row of ``docs`` (doc_id, text, lang).

    A null text or one without letters is ``und`` with score 0 and is rejected.  Rows
    with a null lang are predicted but not learned from, as are rows with a null
    doc_id, which count as held out.  If no row can be learned from, all rows are
    ``und``.  Repeated rows stay; other columns are not read.
    """
    model = model or fit(docs)
    held_out = F.coalesce(remainder("doc_id", FOLDS) == 0, F.lit(True)).alias("held_out")
    if model is None:
        return docs.select(
            "doc_id", held_out, F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(0).cast("long").alias("letters"), F.lit(True).alias("rejected")
        )
    return model.measured(docs, ["doc_id"]).select(
        "doc_id", held_out, model.language().alias("lang_pred"), model.score().alias("score"), "entropy", "letters", model.rejected().alias("rejected")
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns; all rows if nothing can be learned."""
    model = fit(docs)
    if model is None:
        return docs
    plain = docs.select(*[F.col(c).alias(c if c == "text" else f"in_{i}") for i, c in enumerate(docs.columns)])
    kept = model.measured(plain, plain.columns).where(~model.rejected())
    return kept.select(*[F.col(p).alias(c) for p, c in zip(plain.columns, docs.columns)])
