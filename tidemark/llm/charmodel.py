"""Interpolated Kneser-Ney models over characters, one per class, in sorted hash arrays.

Counting is a Spark job: tasks count the n-grams of the highest order in numpy and
Spark adds them up; lower orders come from the higher one as continuation counts.
A model keeps, per order, the sorted ``bits``-bit hashes of its n-grams with one
log-probability per class, and the hashes of the contexts with one backoff weight
per class.  So it has at most orders x 2^bits rows, however large the corpus is;
that bound is what allows it to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.arrays import flat_bytes, mixed, text_slices
from tidemark.llm.tables import stored

BITS = 22
_STEP = np.uint64(0x5851F42D4C957F2D)
#: Bytes of text that are in hand at once; a symbol takes some 200 bytes of hashes, places and log-probabilities meanwhile.
SLICE = 250_000
#: Counts a task gathers before it hands them on.
_HELD = 600_000
#: Rows handed on together.
_ROWS = 100_000


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Lower-case code point of every letter, 0 for everything else."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


@dataclass
class Symbols:
    """Symbols of a slice: letters, single blanks between words, and ``order - 1`` blanks before each text."""

    codes: np.ndarray
    at: np.ndarray
    text_of: np.ndarray
    letters: np.ndarray


def symbols(column: pa.Array, order: int) -> Symbols:
    data, offsets = flat_bytes(column)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    borders = leads[offsets]
    codes = folded()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    texts = len(offsets) - 1
    places = np.repeat(borders[:-1], order - 1)
    codes = np.insert(codes, places, 0)
    pad = np.zeros(len(codes), bool)
    pad[places + np.arange(len(places))] = True
    text_of = np.repeat(np.arange(texts), np.diff(borders) + order - 1)
    keep = pad | (codes != 0)
    keep[1:] |= codes[:-1] != 0
    codes, pad, text_of = codes[keep], pad[keep], text_of[keep]
    at = np.flatnonzero(~pad)
    return Symbols(codes, at, text_of[at], np.bincount(text_of[codes != 0], minlength=texts))


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the 1-, 2-, ... ``order``-gram that ends at every place."""
    single = mixed(codes.astype(np.uint64) + np.uint64(1))
    out, factor = [single], np.uint64(1)
    for k in range(1, order):
        factor = np.uint64((int(factor) * int(_STEP)) & ((1 << 64) - 1))
        longer = out[-1].copy()
        longer[k:] += single[:-k] * factor
        out.append(longer)
    return out


def shortened(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(64 - bits)).astype(np.uint32)


class _Counter:
    """Counts n-grams of the highest order by class; rows (cls, gram, n)."""

    def __init__(self, order: int) -> None:
        self.order = order

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in text_slices(batch, most=SLICE):
                held.append(self._slice(part))
                if sum(len(h[0]) for h in held) > _HELD:
                    held = [_added(held)]
                    if len(held[0][0]) > _HELD // 2:
                        yield from self._rows(held.pop())
        if held:
            yield from self._rows(_added(held))

    def _slice(self, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        found = symbols(part.column("text"), self.order)
        classes = part.column("cls").to_numpy(zero_copy_only=False).astype(np.int32)[found.text_of]
        keys = gram_hashes(found.codes, self.order)[-1][found.at] + mixed(classes.astype(np.uint64) + np.uint64(77))
        keys, first, n = np.unique(keys, return_index=True, return_counts=True)
        places = found.at[first][:, None] + np.arange(1 - self.order, 1)
        grams = found.codes[places]
        grams[grams == 0] = 32
        return keys, classes[first], np.ascontiguousarray(grams, np.uint32).view(f"<U{self.order}").ravel(), n

    @staticmethod
    def _rows(counted: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(counted[0]), _ROWS):
            _, classes, grams, n = (x[begin : begin + _ROWS] for x in counted)
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), pa.array(grams.tolist(), pa.string()), pa.array(n, pa.int64())], ["cls", "gram", "n"])


def _added(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, classes, grams, n = zip(*held)
    keys, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    # One joined column at a time.
    return keys, np.concatenate(classes)[first], np.concatenate(grams)[first], np.bincount(inverse, np.concatenate(n), len(keys)).astype(np.int64)


class _Hasher:
    """(level, cls, gram, n) to hashed keys of the n-gram, its context and its suffix."""

    def __init__(self, bits: int) -> None:
        self.bits = bits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = batch.column("level").to_numpy()
            for level in np.unique(levels):
                part = batch.filter(pa.array(levels == level))
                codes = np.array(part.column("gram").to_pylist()).astype(f"<U{level}").view(np.uint32).reshape(-1, level).copy()
                codes[codes == 32] = 0
                keys = [shortened(_whole(c), self.bits).astype(np.int32) for c in (codes, codes[:, :-1], codes[:, 1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("level"), part.column("cls"), *[pa.array(k) for k in keys], part.column("n")], ["level", "cls", "gram", "context", "suffix", "n"]
                )


def _whole(codes: np.ndarray) -> np.ndarray:
    """The hash of each row's symbols, as ``gram_hashes`` gives it at the last one."""
    out, factor = np.zeros(len(codes), np.uint64), np.uint64(1)
    for k in range(codes.shape[1]):
        out += mixed(codes[:, -1 - k].astype(np.uint64) + np.uint64(1)) * factor
        factor = np.uint64((int(factor) * int(_STEP)) & ((1 << 64) - 1))
    return out


@dataclass
class Level:
    grams: np.ndarray
    scores: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray
    gram_at: np.ndarray | None = field(default=None, repr=False)

    def index(self, bits: int) -> None:
        """A table of where each n-gram stands, for the order at which every symbol is looked up."""
        if self.gram_at is None:
            self.gram_at = np.full(1 << bits, -1, np.int32)
            self.gram_at[self.grams] = np.arange(len(self.grams), dtype=np.int32)

    def gram_rows(self, hashes: np.ndarray) -> np.ndarray:
        return self.gram_at[hashes] if self.gram_at is not None else _found(self.grams, hashes)

    def context_rows(self, hashes: np.ndarray) -> np.ndarray:
        return _found(self.contexts, hashes)


def _found(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places in a sorted array, -1 for values that it lacks."""
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


@dataclass
class CharModel:
    """Log-probabilities (natural) by class; ``levels[k]`` holds the (k + 1)-grams."""

    levels: list[Level]
    classes: int
    unseen: float
    bits: int = BITS

    @property
    def order(self) -> int:
        return len(self.levels)

    def log_probabilities(self, found: Symbols) -> np.ndarray:
        """One row per counted symbol, one column per class."""
        hashes = gram_hashes(found.codes, self.order)
        out = np.zeros((len(found.at), self.classes), np.float32)
        left = np.arange(len(found.at))
        for k in range(self.order - 1, -1, -1):
            level = self.levels[k]
            if k == self.order - 1:
                level.index(self.bits)
            at = found.at[left]
            row = level.gram_rows(shortened(hashes[k][at], self.bits))
            known = row >= 0
            out[left[known]] += level.scores[row[known]]
            left, at = left[~known], at[~known]
            if not len(left):
                return out
            before = hashes[k - 1][at - 1] if k else np.zeros(len(at), np.uint64)
            row = level.context_rows(shortened(before, self.bits))
            known = row >= 0
            out[left[known]] += level.weights[row[known]]
        out[left] += np.float32(self.unseen)
        return out


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """cls, gram, n over the texts of ``docs`` (text, cls int)."""
    counted = docs.select("text", "cls").mapInArrow(_Counter(order), "cls int, gram string, n long")
    return counted.groupBy("cls", "gram").agg(F.sum("n").alias("n"))


def hashed_levels(counts: DataFrame, order: int, bits: int) -> DataFrame:
    """Counts of the highest order and continuation counts of the lower ones, by hash."""
    levels, current = [], stored(counts, "grams")
    for level in range(order, 0, -1):
        levels.append(current.select(F.lit(level).alias("level"), "cls", "gram", "n"))
        current = current.groupBy("cls", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    union = levels[0]
    for level in levels[1:]:
        union = union.unionByName(level)
    hashed = union.mapInArrow(_Hasher(bits), "level int, cls int, gram int, context int, suffix int, n long")
    return hashed.groupBy("level", "cls", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def fitted(counts: DataFrame, classes: int, order: int, shared_orders: int = 0, bits: int = BITS) -> CharModel:
    """A model of ``classes`` classes from (cls, gram, n).

    Up to ``shared_orders`` the counts of all classes, and of texts with a class
    number beyond them, are pooled: there all classes have one distribution.
    """
    rows = hashed_levels(counts, order, bits).toArrow()
    level, cls, gram, context, suffix, n = (rows.column(c).to_numpy() for c in ("level", "cls", "gram", "context", "suffix", "n"))
    levels: list[Level] = []
    letters = len(np.unique(gram[level == 1])) + 1
    for k in range(1, order + 1):
        mine = level == k
        if k > shared_orders:
            mine &= cls < classes
        grams, inverse = np.unique(gram[mine].astype(np.uint32), return_inverse=True)
        count = np.zeros((len(grams), classes))
        if k > shared_orders:
            np.add.at(count, (inverse, cls[mine]), n[mine])
        else:
            count += np.bincount(inverse, n[mine], len(grams))[:, None]
        of_gram = {c: np.zeros(len(grams), np.uint32) for c in ("context", "suffix")}
        of_gram["context"][inverse], of_gram["suffix"][inverse] = context[mine], suffix[mine]
        contexts, place = np.unique(of_gram["context"], return_inverse=True)
        total, kinds = np.zeros((len(contexts), classes)), np.zeros((len(contexts), classes))
        np.add.at(total, place, count)
        np.add.at(kinds, place, count > 0)
        once, twice = (count == 1).sum(axis=0), (count == 2).sum(axis=0)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
        if k == 1:
            lower = np.full(count.shape, 1 / letters)
        else:
            below = levels[-1]
            found = np.minimum(np.searchsorted(below.grams, of_gram["suffix"]), max(len(below.grams) - 1, 0))
            lower = np.exp(below.scores[found])
        spare = np.divide(discount * kinds, total, out=np.ones_like(total), where=total > 0)
        own = np.divide(np.maximum(count - discount, 0), total[place], out=np.zeros_like(count), where=total[place] > 0)
        levels.append(Level(grams, np.log(own + spare[place] * lower).astype(np.float32), contexts, np.log(spare).astype(np.float32)))
    return CharModel(levels, classes, float(-np.log(letters)), bits)


def usable(model: CharModel) -> bool:
    return all(len(level.grams) for level in model.levels)


def isotonic(values: Sequence[float], weights: Sequence[float]) -> list[float]:
    """The closest non-decreasing sequence, by pooling neighbours."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v, w, c = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + v * w) / (pools[-1][1] + w), pools[-1][1] + w, pools[-1][2] + c]
    return [v for v, _, c in pools for _ in range(int(c))]
