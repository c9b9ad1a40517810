"""Toxicity by class-conditional Kneser-Ney models over words.

As Kneser-Ney lower orders do, all counts count contexts: in how many different texts a
word occurs, so that a text that repeats a word says no more than one that does not.
Each class discounts its counts and backs off to one distribution that both share,
over all labelled texts.  A word that is rare everywhere is then about equally likely
in both classes.  (Texts without a label stay out of it: they would count for frequent
toxic words, which they hold too, but not for words of a single toxic text.)  A text is judged by its
length-normalised log-likelihood ratio, by that of its worst run of SPAN words and by
the ratio of its worst word, because one expression makes a long text toxic.  A
regression on labelled texts weighs the three, none of them against toxicity, and the
score is the share of toxic texts at their weighted sum.

Rows whose crc32(doc_id) mod 3 is 1 are held out.  All others with a label give the
counts.  A bounded sample of them also calibrates the score, each text by counts from
which its own are taken off.

Counts reach the tasks as sorted arrays of whole 64-bit word hashes, so no word takes
another's counts; they grow with the vocabulary of the labelled texts, 20 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.arrays import flat_bytes, text_slices, word_bytes, words
from tidemark.llm.charmodel import isotonic
from tidemark.llm.language import remainder
from tidemark.llm.tables import stored

FOLDS = 3
HELD_OUT = 1
TOXIC_FROM = 0.7
#: Labelled rows that calibrate the score, at most.
FIT_ROWS = 20_000
#: Words of a short span.
SPAN = 5
_FEATURES = ("whole", "span", "worst")
_ORDINARY, _TOXIC = 0, 1
_HELD = 1_000_000
#: ASCII that is not a letter.
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalpha())


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, first = words(*flat_bytes(pc.utf8_lower(pc.fill_null(column, ""))), word_bytes(_SEPARATORS))
    return hashes, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word: the number of ordinary texts, of toxic texts, and of all texts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for part in text_slices(batch):
            held.append(_slice_counts(part))
            if sum(len(k) for k, _ in held) > _HELD:
                held = [_added(held)]
                if len(held[0][0]) > _HELD // 2:
                    yield _rows(*held.pop())
    if held:
        yield _rows(*_added(held))


def _slice_counts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = _words(part.column("text"))
    text_of = np.repeat(np.arange(part.num_rows), np.diff(first))
    keys, inverse = np.unique(hashes, return_inverse=True)
    size = max(part.num_rows, 1)
    word, text = np.divmod(np.unique(inverse.astype(np.int64) * size + text_of), size)
    classes = part.column("cls").to_numpy(zero_copy_only=False)[text]
    counts = np.stack([np.bincount(word[mine], minlength=len(keys)) for mine in (classes == _ORDINARY, classes == _TOXIC, slice(None))], axis=1)
    return keys, counts


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    counts = np.concatenate([c for _, c in held])
    return keys, np.stack([np.bincount(inverse, counts[:, c], len(keys)).astype(np.int64) for c in range(3)], axis=1)


def _rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(counts[:, c].copy()) for c in range(3)]], ["word", "ordinary", "toxic", "texts"])


@dataclass
class Judge:
    """From the three ratios of a text to its score."""

    weights: list[float]
    limits: list[float]
    shares: list[float]

    def sums(self, features: np.ndarray) -> np.ndarray:
        return self.weights[0] + features @ np.array(self.weights[1:])

    def score(self, features: np.ndarray) -> np.ndarray:
        """Nine tenths calibrated step of the weighted sum, one tenth its logistic, which orders texts within a step."""
        sums = self.sums(features)
        step = np.array(self.shares)[np.maximum(np.searchsorted(self.limits, sums, "right") - 1, 0)]
        return 0.9 * step + 0.1 / (1 + np.exp(-np.clip(sums, -30, 30)))


@dataclass
class WordModel:
    """Word hashes in order, their counts (ordinary, toxic, texts), and the sums and discounts of a class."""

    keys: np.ndarray
    counts: np.ndarray
    totals: list[float]
    discounts: list[list[float]]
    spare: list[float]
    all_texts: float
    vocabulary: float

    def ratios(self, hashes: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Log-likelihood ratio, toxic against ordinary, of every word.

        ``own`` takes a counted text's own contribution off: per word, the class of its
        text and the number of different words there.
        """
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        seen = np.where((self.keys[at] == hashes)[:, None], self.counts[at], 0).astype(np.float64)
        totals, all_texts = self.totals, self.all_texts
        if own is not None:
            classes, kinds = own
            for c in (_ORDINARY, _TOXIC):
                seen[:, c] -= classes == c
            seen[:, 2] -= 1
            seen = np.maximum(seen, 0)
            totals, all_texts = [np.maximum(t - kinds * (classes == c), 1) for c, t in enumerate(totals)], np.maximum(all_texts - kinds, 0)
        shared = (seen[:, 2] + 0.5) / (all_texts + 0.5 * self.vocabulary + 0.5)
        logs = []
        for c in (_ORDINARY, _TOXIC):
            discount = np.array(self.discounts[c])[np.minimum(seen[:, c], 3).astype(np.int64)]
            logs.append(np.log(np.maximum(seen[:, c] - discount, 0) / totals[c] + self.spare[c] * shared))
        return logs[_TOXIC] - logs[_ORDINARY]


def discounts(kinds: list[int]) -> list[float]:
    """Discounts of counts 0, 1, 2 and more, from the number of words seen once to four times."""
    one, two, three, four = (max(k, 1) for k in kinds)
    y = one / (one + 2 * two)
    return [0.0, *[min(max(j - (j + 1) * y * b / a, 0.1), j - 0.05) for j, (a, b) in enumerate([(one, two), (two, three), (three, four)], 1)]]


def word_model(counted: DataFrame) -> WordModel | None:
    """From word, ordinary, toxic, texts; None if a class has no words."""
    names = ("ordinary", "toxic")
    sums = counted.agg(
        *[F.sum(c).alias(c) for c in names], F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("words"),
        *[F.count_if(F.col(c) == j).alias(f"{c}{j}") for c in names for j in (1, 2, 3, 4)], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in names],
    ).first()
    if not sums["ordinary"] or not sums["toxic"]:
        return None
    cut = [discounts([sums[f"{c}{j}"] for j in (1, 2, 3, 4)]) for c in names]
    spare = []
    for c, d in zip(names, cut):
        kinds = [sums[f"{c}1"], sums[f"{c}2"]]
        kinds.append(sums[f"{c}_kinds"] - sum(kinds))
        spare.append(sum(k * x for k, x in zip(kinds, d[1:])) / sums[c])
    rows = counted.select("word", *[F.least(F.col(c), F.lit(2**31 - 1)).cast("int").alias(c) for c in (*names, "texts")]).toArrow()
    keys = rows.column("word").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    counts = np.stack([rows.column(c).to_numpy()[order] for c in (*names, "texts")], axis=1)
    return WordModel(keys[order], counts, [float(sums[c]) for c in names], cut, spare, float(sums["texts"]), float(sums["words"]))


class _Compare:
    """Appends the three ratios of a text, and its score if there is a judge of them.

    With ``counted`` the texts are among those counted, and have their class in ``cls``.
    """

    def __init__(self, model, columns: list[str], counted: bool, judge: Judge) -> None:
        self.model, self.columns, self.counted, self.judge = model, columns, counted, judge

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                features = compared(self.model.value, part.column("text"), part.column("cls").to_numpy() if self.counted else None)
                added = [*features.T, self.judge.score(features)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in self.columns], *map(pa.array, added)], [*self.columns, *_FEATURES, "score"])


def compared(model: WordModel, texts: pa.Array, classes: np.ndarray | None = None) -> np.ndarray:
    """Per text the ratio a word of the whole, of its worst run of SPAN words, and of its worst word.

    A text of fewer words is one run; without words all are 0.  ``classes`` are given
    for texts that are counted.
    """
    hashes, first = _words(texts)
    out = np.zeros((len(texts), len(_FEATURES)))
    size = np.diff(first)
    filled = size > 0
    if filled.any():
        ratios = model.ratios(hashes, None if classes is None else _own(hashes, size, classes))
        begins = first[:-1][filled]
        out[filled, 0] = np.add.reduceat(ratios, begins) / size[filled]
        out[filled, 2] = np.maximum.reduceat(ratios, begins)
        out[:, 1] = out[:, 0]
        sums = np.concatenate([[0.0], np.cumsum(ratios)])
        means = np.full(len(ratios), -np.inf)
        ends = np.repeat(first[1:], size)
        inside = np.flatnonzero(np.arange(len(ratios)) + SPAN <= ends)
        means[inside] = (sums[inside + SPAN] - sums[inside]) / SPAN
        longer = size[filled] >= SPAN
        out[np.flatnonzero(filled)[longer], 1] = np.maximum.reduceat(means, begins)[longer]
    return out


def _own(hashes: np.ndarray, size: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: the class of its text, and the number of different words there."""
    text_of = np.repeat(np.arange(len(size)), size)
    _, word = np.unique(hashes, return_inverse=True)
    kinds = np.bincount(np.unique(word.astype(np.int64) * len(size) + text_of) % len(size), minlength=len(size))
    return classes[text_of], kinds[text_of]


def logistic(features: np.ndarray, labels: np.ndarray, steps: int = 50) -> list[float]:
    """Weights of a logistic regression with an intercept, by Newton steps with a small penalty."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3, *[1e-2] * features.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def weighed(features: np.ndarray, labels: np.ndarray) -> list[float]:
    """Weights of a logistic regression; a feature that would speak against toxicity gets 0."""
    used = list(range(features.shape[1]))
    while True:
        w = logistic(features[:, used], labels)
        worst = min(range(len(used)), key=lambda i: w[1 + i], default=None)
        if worst is None or w[1 + worst] >= 0:
            out = [w[0], *[0.0] * features.shape[1]]
            for i, j in enumerate(used):
                out[1 + j] = w[1 + i]
            return out
        del used[worst]


def steps_of(sums: np.ndarray, labels: np.ndarray, most: int = 256) -> tuple[list[float], list[float]]:
    """How often a text is toxic by its weighted sum: limits, and the share from each limit on."""
    order = np.argsort(sums, kind="stable")
    sums, labels = sums[order], labels[order]
    shares = np.array(isotonic(labels.tolist(), [1.0] * len(labels)))
    begins = np.flatnonzero(np.diff(shares, prepend=-1.0) > 0)
    sizes = np.diff([*begins, len(labels)])
    # Half a text of either label in each step; a limit lies midway between the steps' texts.
    smooth = np.maximum.accumulate((shares[begins] * sizes + 0.25) / (sizes + 0.5))
    limits = [-1e9, *[(sums[b - 1] + sums[b]) / 2 for b in begins[1:]]]
    return limits[-most:], smooth.tolist()[-most:]


@dataclass
class ToxicityModel:
    broadcast: object
    judge: Judge

    def measured(self, docs: DataFrame, columns: list[str], counted: bool = False) -> DataFrame:
        """``columns`` of all rows, the three ratios and the score, under the names of ``_FEATURES`` and score."""
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
        read = [*columns, "text", *(["cls"] if counted else [])]
        compare = _Compare(self.broadcast, columns, counted, self.judge)
        return docs.select(*dict.fromkeys(read)).mapInArrow(compare, f"{schema}, {', '.join(f'{c} double' for c in _FEATURES)}, score double")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """Learn from the text of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); None if a class is missing."""
    spark = docs.sparkSession
    fold = remainder("doc_id", FOLDS)
    marks = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold != HELD_OUT)
    texts = docs.select("doc_id", "text").where(fold != HELD_OUT)
    # One plan at every size: texts and labels meet by a shuffle, since labels have no bound.
    cls = F.when(F.col("toxic") > 0, _TOXIC).otherwise(_ORDINARY).cast("int").alias("cls")
    classed = texts.join(marks.hint("merge"), "doc_id").select("text", cls)
    counted = classed.mapInArrow(_count, "word long, ordinary long, toxic long, texts long")
    model = word_model(stored(counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("ordinary", "toxic", "texts")]), "words"))
    if model is None:
        return None
    out = ToxicityModel(spark.sparkContext.broadcast(model), Judge([-4.0, 0.0, 0.0, 1.0], [-1e9], [0.0]))
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(FIT_ROWS)
    sample = out.measured(texts.join(F.broadcast(chosen), "doc_id").select("text", cls), ["cls"], counted=True).toPandas()
    toxic = (sample["cls"] == _TOXIC).to_numpy().astype(float)
    if len(set(toxic)) == 2:
        features = sample[list(_FEATURES)].to_numpy()
        out.judge.weights = weighed(features, toxic)
        out.judge.limits, out.judge.shares = steps_of(out.judge.sums(features), toxic)
    return out


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic).

    A null text counts as empty; a text without words has ratios of 0.  Several labels
    of a doc_id count as toxic if one is; null labels do not count.  Rows with a null
    doc_id are held out.  Without a labelled text of each class every score is 0, and
    without both classes among the calibrating labels no text is predicted toxic.
    Repeated rows stay; other columns are not read.
    """
    held_out = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(True)).alias("held_out")
    model = fit(docs, labels)
    if model is None:
        return docs.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    return model.measured(docs, ["doc_id"]).select("doc_id", held_out, "score").withColumn(
        "predicted", (F.col("score") >= TOXIC_FROM).cast("int")
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = fit(docs, labels)
    if model is None:
        return docs
    plain = docs.select(*[F.col(c).alias(c if c == "text" else f"in_{i}") for i, c in enumerate(docs.columns)])
    kept = model.measured(plain, plain.columns).where(F.col("score") < TOXIC_FROM)
    return kept.select(*[F.col(p).alias(c) for p, c in zip(plain.columns, docs.columns)])
