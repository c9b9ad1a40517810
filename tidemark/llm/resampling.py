"""Importance resampling towards a target distribution.

Words are counted in a fixed number of buckets, over all documents and over all target
texts.  The logarithm of the ratio of both shares is a bucket's gain; the gains are one
array, and a document's weight is the mean of the gains of its features, read from that
array.  A Gumbel variable drawn from a hash of the doc_id is added, so that the highest
scores are a sample without replacement in proportion to the weights.

The order comes from a distributed LSD radix sort.  The key is the score, descending, then
the doc_id; its digits are taken from the least significant one on.  A pass is a stable
counting sort: rows stand in blocks of consecutive places; the numbers of rows per digit
and block are added up to global offsets, and a row's new place is its offset plus its
rank among the rows of its digit in its block.  Every pass shuffles the rows once by block and
writes them; a block has a bounded number of rows, whatever the keys are.  The last
places are the ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.arrays import flat_bytes, text_slices, word_bytes, words
from tidemark.llm.decontaminate import SEPARATORS
from tidemark.llm.tables import stored

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Bits of a digit of the sort at most, and rows of a block.
DIGIT_BITS = 10
BLOCK_ROWS = 1 << 12
_INSIDE = word_bytes(SEPARATORS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words up to this length go through the table together, longer ones one by one.
_SHORT = 48


def _crc_table() -> np.ndarray:
    """The 256 steps of the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of every piece of ``data``, all pieces byte by byte at once."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros(len(starts), np.uint32)
    longer = int(np.searchsorted(-lengths[order], -_SHORT))
    for i in order[:longer]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    order = order[longer:]
    if len(order):
        begin, crc = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
        left = np.searchsorted(-lengths[order], -np.arange(int(lengths[order[0]])), side="left")
        for at, n in enumerate(left):
            crc[:n] = _TABLE[(crc[:n] ^ data[begin[:n] + at]) & 0xFF] ^ (crc[:n] >> 8)
        out[order] = ~crc
    return out


def buckets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word, and each text's first word."""
    data, offsets = flat_bytes(column)
    _, starts, ends, first = words(data, offsets, _INSIDE)
    return (crc32_of(_LOWER[data], starts, ends) % BUCKETS).astype(np.int64), first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in text_slices(batch):
            held += np.bincount(buckets_of(part.column("text"))[0], minlength=BUCKETS)
    filled = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(held[filled])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> list[int]:
    """Features per bucket over all rows; what comes to the driver is one number per bucket."""
    held = [0] * BUCKETS
    for r in texts.select("text").mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        held[r["bucket"]] = r["n"]
    return held


def gains(raw: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share over the smoothed raw share), per bucket."""
    s_all, t_all = float(sum(raw)), float(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(raw, target)], np.int64)


def gumbel(seed: int, doc_id: int) -> int:
    """floor(-1000 * ln(-ln u)) for the u of a document, from the first 32 bits of a sha256."""
    drawn = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def _scorer(gain: np.ndarray, seed: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                buckets, first = buckets_of(part.column("text"))
                sums = np.concatenate([[0], np.cumsum(gain[buckets])])
                n = np.diff(first)
                weight = (sums[first[1:]] - sums[first[:-1]]) // np.maximum(n, 1)
                ids = part.column("doc_id").to_pylist()
                score = [None if d is None else int(w) + gumbel(seed, d) for d, w in zip(ids, weight)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(weight.astype(np.int64)), pa.array(score, pa.int64())],
                    ["doc_id", "n_features", "weight", "score"],
                )

    return scored


def _pass(rows: DataFrame, key: Column, shift: int, bits: int) -> DataFrame:
    """One stable counting sort of ``rows`` (place, block, ...) by a digit of ``key``."""
    digit = F.shiftrightunsigned(key, shift).bitwiseAND((1 << bits) - 1).cast("int")
    dealt = rows.withColumn("digit", digit)
    here = dealt.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n"))
    totals = here.groupBy("digit").agg(F.sum("n").alias("n"))
    # At most 2^DIGIT_BITS rows in one task here, and the blocks of one digit there.
    before = F.coalesce(F.sum("n").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("digit", before.alias("start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = here.select("digit", "block", inside.alias("inside")).join(F.broadcast(starts), "digit").select("digit", "block", (F.col("start") + F.col("inside")).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")) - 1
    placed = dealt.withColumn("rank", rank).join(offsets, ["block", "digit"]).withColumn("place", F.col("offset") + F.col("rank"))
    return stored(placed.withColumn("block", F.expr(f"place div {BLOCK_ROWS}")).select(*rows.columns), "sorted")


def radix_sorted(rows: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """``rows`` with ``place`` = 0, 1, 2 ... in the order of ``keys`` (long column, descending?), the first one most significant.

    Rows alike in all keys stand in any order.  Keys must not be null.
    """
    numbered = stored(rows.withColumn("place", F.monotonically_increasing_id()), "unsorted")
    # Partitions as first blocks, cut into runs of at most BLOCK_ROWS.
    numbered = numbered.withColumn("block", F.expr(f"place div {BLOCK_ROWS}"))
    ends = numbered.agg(*[f(c).alias(f"{n}{i}") for i, (c, _) in enumerate(keys) for f, n in ((F.min, "low"), (F.max, "high"))]).first()
    for i, (column, descending) in reversed(list(enumerate(keys))):
        low, high = ends[f"low{i}"], ends[f"high{i}"]
        if low is None:
            break
        wide = max((high - low).bit_length(), 1)
        if wide < 64:
            key = F.lit(high) - F.col(column) if descending else F.col(column) - F.lit(low)
        else:  # the difference of two longs may not be one: all bits, the sign bit turned
            key = (F.bitwise_not(column) if descending else F.col(column)).bitwiseXOR(F.lit(-(1 << 63)))
        bits = math.ceil(wide / math.ceil(wide / DIGIT_BITS))
        for shift in range(0, wide, bits):
            numbered = _pass(numbered, key, shift, bits)
    return numbered.drop("block")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank, per row of ``docs`` (integer doc_id, text); ``target`` has the texts to be like.

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) with the
    highest scores get ranks 1, 2, 3 ..., ties to the smaller doc_id; rows that share
    doc_id and score come in any order.  A null or empty text has no features and
    weight 0.  A row without a doc_id has no hash, so no score and no rank, and is not
    among the N.  Without target texts all buckets count as empty there.  Other columns are
    not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scores = stored(docs.mapInArrow(_scorer(gain, seed), "doc_id long, n_features long, weight long, score long"), "scores")
    enters = F.col("score").isNotNull() & (F.col("n_features") >= least_words)
    entered = scores.where(enters)
    drawn = entered.count() * percent // 100
    ranked = radix_sorted(entered, [("score", True), ("doc_id", False)])
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(scores.where(~enters).select(*columns, F.lit(None).cast("long").alias("rank")))
