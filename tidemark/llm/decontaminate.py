"""Benchmark contamination over a positional inverted index of the documents.

The index is partitioned by document: a segment holds, for half a megabyte of text (or
one longer text), the sorted word hashes and for each the ascending positions at which it
occurs.  Segments are built by tasks and stored in the shared folder, in small pages and
row groups and compressed by the task, so that neither a writer nor a reader holds more than a few of them.
Documents stand ``GAP`` positions apart, so no match runs from one into the next.

Test windows are looked up in every segment: a window without a posting for one of its
words is out; the others start from the postings of their rarest word, shifted by its
offset, and are intersected with the shifted postings of the next rarest, and so on.
With ``slack`` a posting near the shifted place is enough (a proximity match).  At most
``CANDIDATES`` postings are intersected at a time.

Test texts are taken in blocks of bounded size, each broadcast by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.arrays import flat_bytes, text_slices, word_bytes, words
from tidemark.llm.tables import stored

WINDOW = 13
#: Hit words in a hundred that make a document contaminated.
PERCENT = 5
SLACK = 2
SEGMENT_BYTES = 500_000
BLOCK_BYTES = 4_000_000
#: Rows of the index are some hundred times wider than Parquet's writer expects, which looks at sizes after 100 of them.
STORAGE = {
    "parquet.block.size": "4194304", "parquet.block.size.row.check.min": "1", "parquet.page.size": "524288", "parquet.page.size.row.check.min": "1",
    "parquet.enable.dictionary": "false", "compression": "none",
}
_CODEC = pa.Codec("zstd", compression_level=1)
#: Windows whose words are ranked, and postings that are intersected, at a time.
RANKED = 1 << 14
CANDIDATES = 1 << 19
GAP = 64
#: ASCII that is neither digit nor letter, as bytes of lower-cased text.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_INSIDE = word_bytes(SEPARATORS)

_INDEX = "segment long, doc_ids array<{id}>, same array<long>, n_words array<long>, n_terms long, terms binary, counts binary, positions binary"


def squeezed(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, its numbers' first bytes first, then the second ones."""
    return _CODEC.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T), asbytes=True)


def unsqueezed(content: bytes, kind: type, size: int) -> np.ndarray:
    if not size:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(content, size * width), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


@dataclass
class Segment:
    terms: np.ndarray
    starts: np.ndarray
    positions: np.ndarray
    first: np.ndarray

    def columns(self) -> list[pa.Array]:
        """As stored: number of terms, their steps, how often each occurs, positions."""
        steps = np.diff(self.terms, prepend=self.terms.dtype.type(0))
        return [pa.array([len(self.terms)]), *[pa.array([squeezed(x)], pa.binary()) for x in (steps, np.diff(self.starts), self.positions)]]

    @staticmethod
    def stored(one: pa.RecordBatch, n_words: np.ndarray) -> Segment:
        size = one.column("n_terms")[0].as_py()
        terms, counts = (unsqueezed(one.column(c)[0].as_py(), kind, size) for c, kind in (("terms", np.uint64), ("counts", np.uint32)))
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)
        positions = unsqueezed(one.column("positions")[0].as_py(), np.uint32, int(starts[-1]))
        return Segment(np.cumsum(terms, dtype=np.uint64), starts, positions, first_positions(n_words))

    def packed(self) -> np.ndarray:
        """Term number and position of every posting in one sorted array."""
        counts = np.diff(self.starts.astype(np.int64))
        return (np.repeat(np.arange(len(self.terms), dtype=np.uint64), counts) << np.uint64(32)) | self.positions.astype(np.uint64)


def first_positions(n_words: np.ndarray) -> np.ndarray:
    """Where each document begins in its segment, and where one more would."""
    return np.concatenate([[GAP], GAP + np.cumsum(n_words + GAP)]).astype(np.int64)


def segment_of(texts: pa.Array) -> tuple[Segment, np.ndarray]:
    hashes, _, _, first = words(*flat_bytes(texts), _INSIDE)
    n_words = np.diff(first)
    begin = first_positions(n_words)
    places = np.arange(len(hashes)) + np.repeat(begin[:-1] - first[:-1], n_words)
    terms, inverse = np.unique(hashes, return_inverse=True)
    packed = np.sort((inverse.astype(np.uint64) << np.uint64(32)) | places.astype(np.uint64))
    starts = np.searchsorted(packed >> np.uint64(32), np.arange(len(terms) + 1, dtype=np.uint64)).astype(np.uint32)
    return Segment(terms, starts, (packed & np.uint64(0xFFFFFFFF)).astype(np.uint32), begin), n_words


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in text_slices(batch, most=SEGMENT_BYTES):
            segment, n_words = segment_of(part.column("text"))
            whole = pa.array([0, part.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), *[pa.ListArray.from_arrays(whole, part.column(c)) for c in ("doc_id", "same")],
                 pa.array([n_words], pa.list_(pa.int64())), *segment.columns()],
                ["segment", "doc_ids", "same", "n_words", "n_terms", "terms", "counts", "positions"],
            )
            number += 1


def positional_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text); ``same`` is a hash of the text, null for a null text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    same = F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("same")
    return stored(docs.select("doc_id", same, "text").mapInArrow(_index, _INDEX.format(id=kind)), "index", **STORAGE)


@dataclass
class Windows:
    """Windows of a block of test texts: first word, size and item of each, among the word numbers of all texts."""

    vocabulary: np.ndarray
    words: np.ndarray
    begin: np.ndarray
    sizes: np.ndarray
    item: np.ndarray
    items: list

    @staticmethod
    def of(table: pa.Table, window: int) -> Windows:
        hashes, _, _, first = words(*flat_bytes(table.column("text")), _INSIDE)
        vocabulary, numbers = np.unique(hashes, return_inverse=True)
        numbers = numbers.astype(np.int32)
        none = np.zeros(0, np.int32)
        begin, sizes, item = [none], [none], [none]
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            size = min(window, b - a)
            if not size:
                continue
            _, own = np.unique(np.lib.stride_tricks.sliding_window_view(numbers[a:b], size), axis=0, return_index=True)
            begin.append((a + own).astype(np.int32))
            sizes.append(np.full(len(own), size, np.int32))
            item.append(np.full(len(own), i, np.int32))
        return Windows(vocabulary, numbers, *map(np.concatenate, (begin, sizes, item)), table.column("item_id").to_pylist())

    def numbers(self, some: np.ndarray) -> np.ndarray:
        """Word numbers by place in ``some`` windows, -1 beyond a short one."""
        offsets = np.arange(self.sizes[some].max(initial=0))
        at = np.minimum(self.begin[some, None] + offsets, len(self.words) - 1)
        return np.where(offsets < self.sizes[some, None], self.words[at], -1)


def matches(segment: Segment, windows: Windows, slack: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Window numbers and the places where they begin (with slack: near which they begin), some at a time."""
    if not len(segment.terms) or not len(windows.begin):
        return
    at = np.minimum(np.searchsorted(segment.terms, windows.vocabulary), len(segment.terms) - 1)
    there = segment.terms[at] == windows.vocabulary
    counts = np.where(there, np.diff(segment.starts.astype(np.int64))[at], 0)
    missing = np.concatenate([[0], np.cumsum(counts[windows.words] == 0)])
    alive = np.flatnonzero(missing[windows.begin] == missing[windows.begin + windows.sizes])
    if not len(alive):
        return
    packed = segment.packed()
    for k in range(0, len(alive), RANKED):
        yield from _intersected(segment, packed, at, counts, windows, alive[k : k + RANKED], slack)


def _intersected(segment: Segment, packed: np.ndarray, at: np.ndarray, counts: np.ndarray, windows: Windows, some: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matches of ``some`` windows, all of whose words are in the segment: ``counts`` times, as the terms ``at``."""
    numbers = windows.numbers(some)
    frequency = np.where(numbers >= 0, counts[numbers], np.iinfo(np.int64).max)
    order = np.argsort(frequency, axis=1, kind="stable")
    rarest, each = order[:, 0], np.arange(len(some))
    begin, ends = segment.starts[at[numbers[each, rarest]]].astype(np.int64), np.cumsum(frequency[each, rarest])
    before = np.concatenate([[0], ends[:-1]])
    for first in range(0, int(ends[-1]), CANDIDATES):
        posting = np.arange(first, min(first + CANDIDATES, int(ends[-1])))
        row = np.searchsorted(ends, posting, side="right")
        place = segment.positions[begin[row] + posting - before[row]].astype(np.int64) - rarest[row]
        for j in range(1, numbers.shape[1]):
            if not len(row):
                break
            offset = order[row, j]
            number = numbers[row, offset]
            beyond = number < 0
            low = (at[number].astype(np.uint64) << np.uint64(32)) | (place + offset - slack).astype(np.uint64)
            found = packed[np.minimum(np.searchsorted(packed, low), len(packed) - 1)]
            keep = beyond | ((found >= low) & (found <= low + np.uint64(2 * slack)))
            row, place = row[keep], place[keep]
        if len(row):
            yield some[row], place


def find(segment: Segment, windows: Windows, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All ``matches`` at once."""
    none = np.zeros(0, np.int64)
    found = list(matches(segment, windows, slack))
    return np.concatenate([none, *[w for w, _ in found]]), np.concatenate([none, *[p for _, p in found]])


_HITS = "segment long, row int, doc_id {id}, same long, n_words long, items array<{item}>, starts array<long>, ends array<long>, near_items array<{item}>"
_NO_PAIRS = np.zeros(0, np.int64)


class _Search:
    """All documents of a segment, with the items whose windows occur and the merged word spans they cover."""

    def __init__(self, windows, slack: int) -> None:
        self.windows, self.slack = windows, slack

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = self.windows.value
        for batch in batches:
            for i in range(batch.num_rows):
                yield self._segment(batch.slice(i, 1), windows)

    def _segment(self, one: pa.RecordBatch, windows: Windows) -> pa.RecordBatch:
        n_words = one.column("n_words").flatten().to_numpy()
        segment = Segment.stored(one, n_words)
        docs = len(n_words)
        spans = [([], []) for _ in range(docs)]
        change, pairs = np.zeros(segment.first[-1] + 1, np.int32), _NO_PAIRS
        for window, place in matches(segment, windows):
            np.add.at(change, place, 1)
            np.add.at(change, place + windows.sizes[window], -1)
            pairs = self._pairs(pairs, segment, windows, window, place)
        if len(pairs):
            edge = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                doc = np.searchsorted(segment.first, a, side="right") - 1
                spans[doc][0].append(a - segment.first[doc])
                spans[doc][1].append(b - segment.first[doc])
        near_pairs = _NO_PAIRS
        if self.slack:
            for window, place in matches(segment, windows, self.slack):
                near_pairs = self._pairs(near_pairs, segment, windows, window, place)
        items, near = (self._named(docs, windows, p) for p in (pairs, near_pairs))
        number = one.column("segment")[0].as_py()
        named = pa.list_(pa.array(windows.items).type) if windows.items else pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * docs), pa.array(range(docs), pa.int32()), one.column("doc_ids").flatten(), one.column("same").flatten(), pa.array(n_words),
             pa.array(items, named), *[pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1)], pa.array(near, named)],
            ["segment", "row", "doc_id", "same", "n_words", "items", "starts", "ends", "near_items"],
        )

    @staticmethod
    def _pairs(known: np.ndarray, segment: Segment, windows: Windows, window: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Numbers of document and item, ``known`` and new ones, each pair once."""
        doc = np.searchsorted(segment.first, place, side="right") - 1
        inside = (doc >= 0) & (doc < len(segment.first) - 1)
        return np.unique(np.concatenate([known, doc[inside] * len(windows.items) + windows.item[window[inside]]]))

    @staticmethod
    def _named(docs: int, windows: Windows, pairs: np.ndarray) -> list[list]:
        named = [[] for _ in range(docs)]
        for pair in pairs.tolist():
            doc, item = divmod(pair, len(windows.items))
            named[doc].append(windows.items[item])
        return named


def _blocks(tests: DataFrame) -> list[DataFrame]:
    """Test texts in hashed blocks of about BLOCK_BYTES; more blocks until none is twice as large, unless by one text."""
    sizes = tests.select("item_id", "text", F.octet_length("text").alias("bytes"))
    total = sizes.agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m")).first()
    if not total["s"]:
        return []
    count = -(-total["s"] // BLOCK_BYTES)
    while True:
        numbered = sizes.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
        if count == 1 or numbered.groupBy("block").agg(F.sum("bytes").alias("s")).agg(F.max("s")).first()[0] <= max(2 * BLOCK_BYTES, 2 * total["m"]):
            return [numbered.where(F.col("block") == b).select("item_id", "text") for b in range(count)]
        count *= 2


def covered(spans: Column) -> Column:
    """Number of words in the union of ``spans``, structs of start and end."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(
        F.sort_array(spans), zero,
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): what of ``tests`` (item_id, text) it holds.

    doc_id, same (hash of the text), n_words, n_hit, items and near_items (sorted
    item_ids with an exact or a proximity match), spans (start and end word of what
    is hit), contaminated.  A null or wordless text has no words and no hits; a null or
    wordless test text matches nothing; an item of fewer than ``window`` words is one
    window.  Repeated documents have a row each; an item_id that repeats counts once and
    a null one is not listed.  Other columns are not read.
    """
    spark = docs.sparkSession
    index = positional_index(docs.select("doc_id", "text"))
    kind, item = docs.schema["doc_id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()
    parts = []
    for block in _blocks(tests) or [tests.select("item_id", "text").limit(0)]:
        windows = spark.sparkContext.broadcast(Windows.of(block.toArrow(), window))
        parts.append(index.mapInArrow(_Search(windows, slack), _HITS.format(id=kind, item=item)))
    if len(parts) == 1:
        rows = parts[0]
    else:
        lists = ("items", "starts", "ends", "near_items")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.union(part)
        rows = rows.groupBy("segment", "row").agg(*[F.first(c).alias(c) for c in ("doc_id", "same", "n_words")], *[F.flatten(F.collect_list(c)).alias(c) for c in lists])
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end")))
    named = [F.sort_array(F.array_distinct(F.array_compact(c))).alias(c) for c in ("items", "near_items")]
    found = rows.select("doc_id", "same", "n_words", *named, spans.alias("spans")).withColumn("n_hit", covered(F.col("spans")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * PERCENT))


def uncontaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Rows are told by doc_id and text, so repeated rows are treated alike.
    """
    bad = contamination(docs, tests, slack=0).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("same").alias("__same")).distinct()
    keys = (docs["doc_id"].eqNullSafe(F.col("__id"))) & (F.xxhash64(docs["text"]) == F.col("__same"))
    return docs.join(bad, keys, "left_anti")
