"""Packing documents into training windows, online, by the sum-of-squares rule.

A document is tokenised and ends with a separator.  Whole windows are cut from it; the
rest goes to the fill level at which the sum of squares of the numbers of open windows
by level is least afterwards.  At the end of a task, or when too many windows are open,
the open windows are merged by cutting the emptiest to fill the fullest, so at most one
window of a task is padded.

A task packs its own documents, and nothing is shuffled.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
SEPARATOR = 1
#: Open windows a task holds before it merges them.
OPEN = 4096
#: Rows and tokens handed on together.
_ROWS, _TOKENS = 2000, 250_000

#: doc_id, start, tokens of the document, ids.
Piece = tuple[object, int, int, np.ndarray]


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A byte-level BPE encoder for a tokenizer file; it gives the ids the tokenizers library gives.

    The file's special tokens are known to it; a caller allows them or takes them as text.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        content = json.load(file)
    tokens, special = content["model"]["vocab"], {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(letters[c] for c in t): i for t, i in tokens.items() if all(c in letters for c in t) and t not in special}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Levels:
    """Open windows by fill level, and the pieces each holds."""

    def __init__(self, window: int, first: int) -> None:
        self.window, self.next = window, first
        self.count = np.zeros(window + 1, np.int64)
        self.at: list[list[int]] = [[] for _ in range(window)]
        self.content: dict[int, list[Piece]] = {}

    def whole(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> tuple[int, int, bool]:
        """The window for a piece, the place in it, and whether it is full then."""
        open_, window = self.count, self.window
        after = 2 * open_[size:] + 1
        after[-1] = 0
        cost = np.where(open_[: window - size + 1] > 0, 1 - 2 * open_[: window - size + 1], np.iinfo(np.int64).max // 2) + after
        cost[0] = after[0]
        fill = window - size - int(np.argmin(cost[::-1]))
        if fill:
            number = self.at[fill].pop()
            open_[fill] -= 1
        else:
            number = self.whole()
            self.content[number] = []
        if fill + size < window:
            self.at[fill + size].append(number)
            open_[fill + size] += 1
        return number, fill, fill + size == window

    def merged(self) -> Iterator[tuple[int, list[Piece]]]:
        """Close all open windows but perhaps one; the pieces of each with their places."""
        waiting = deque((n, self.content.pop(n)) for fill in range(self.window - 1, 0, -1) for n in self.at[fill])
        self.count[:] = 0
        self.at = [[] for _ in range(self.window)]
        while waiting:
            number, pieces = waiting.popleft()
            fill = sum(len(p[3]) for p in pieces)
            while fill < self.window and waiting:
                donor = waiting[-1][1]
                doc, start, total, ids = donor.pop()
                take = min(self.window - fill, len(ids))
                pieces.append((doc, start, total, ids[:take]))
                fill += take
                if take < len(ids):
                    donor.append((doc, start + take, total, ids[take:]))
                elif not donor:
                    waiting.pop()
            yield number, pieces


_PIECES = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Pack:
    def __init__(self, vocabulary: str, window: int, separator: int, special: bool) -> None:
        self.vocabulary, self.window, self.separator = vocabulary, window, separator
        self.allowed = "all" if special else set()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, bpe, out = Levels(self.window, TaskContext.get().partitionId() << 40), encoder(self.vocabulary), []
        kind, tokens = None, 0
        for batch in batches:
            kind = batch.column("doc_id").type
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = np.append(bpe.encode_to_numpy(text.as_py() or "", allowed_special=self.allowed, disallowed_special=()), np.uint32(self.separator)).astype("<u4")
                out.extend(self._placed(levels, doc.as_py(), ids))
                tokens += len(ids)
                if len(levels.content) > OPEN:
                    out.extend(self._closed(levels))
                if len(out) >= _ROWS or tokens >= _TOKENS:
                    yield self._rows(out, kind)
                    out, tokens = [], 0
        out.extend(self._closed(levels))
        if out:
            yield self._rows(out, kind)

    def _placed(self, levels: Levels, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        """Rows that are final: whole windows, and those of a window that the rest of the document fills."""
        total = len(ids)
        whole = total // self.window * self.window
        for start in range(0, whole, self.window):
            yield doc, start, ids[start : start + self.window], total, levels.whole(), 0
        if whole < total:
            number, _, full = levels.place(total - whole)
            levels.content[number].append((doc, whole, total, ids[whole:].copy()))
            if full:
                yield from _laid(number, levels.content.pop(number))

    @staticmethod
    def _closed(levels: Levels) -> Iterator[tuple]:
        for number, pieces in levels.merged():
            yield from _laid(number, pieces)

    @staticmethod
    def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        doc, start, ids, total, number, offset = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, kind), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()),
             pa.array(total, pa.int64()), pa.array(number, pa.int64()), pa.array(offset, pa.int64())],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )


def _laid(number: int, pieces: list[Piece]) -> Iterator[tuple]:
    offset = 0
    for doc, start, total, ids in pieces:
        yield doc, start, ids, total, number, offset
        offset += len(ids)


def packed(docs: DataFrame, vocabulary: str, window: int = WINDOW, separator: int = SEPARATOR, special: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds little-endian unsigned 32-bit ids.  ``vocabulary`` is the path of a
    byte-level BPE tokenizer file.  With ``special`` its special tokens, written out in a
    text, have their one id, as the tokenizers library does by itself; else they are
    text like other text (its ``encode_special_tokens``).  A null or empty text is the separator alone.  Every
    row is a document of its own, also when its doc_id repeats or is null.  No rows give
    no pieces.  Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_Pack(vocabulary, window, separator, special), _PIECES.format(id=kind))
