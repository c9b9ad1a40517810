"""Texts of an Arrow batch as flat numpy arrays: bytes, words, word hashes.

Work inside a task goes over slices of at most ``SLICE_BYTES`` of text (or one
text, if that is longer), so memory does not follow the size of a batch.  A byte of
text takes some 60 bytes of hashes and places meanwhile, in each Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_WRAP = (1 << 64) - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that every bit of the result depends on all bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keyed(count: int, seed: int) -> np.ndarray:
    """``count`` fixed 64-bit numbers for a seed."""
    start = np.uint64((seed * 0xD1342543DE82EF95 + 1) & _WRAP)
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * _ODD + start)


_BYTE_CODE = keyed(256, 1)


class _Powers:
    """Powers of the hash base and of its inverse, grown when a longer slice comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = _ladder(_BASE, size)
            self.down = _ladder(pow(_BASE, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]


def _ladder(base: int, size: int) -> np.ndarray:
    steps = np.full(size, np.uint64(base))
    steps[0] = 1
    return np.cumprod(steps)


_POWERS = _Powers()


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded text length; a longer text has a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends, begin, total = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            ends.append((begin, i))
            begin, total = i, 0
        total += n
    if len(lengths) > begin:
        ends.append((begin, len(lengths)))
    for a, b in ends:
        yield batch.slice(a, b - a)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if content is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bytes(separators: bytes) -> np.ndarray:
    """Which byte values belong to a word, when ``separators`` do not."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of every word of every text, and each text's first word.

    ``inside`` says which bytes make up words.  A-Z count as a-z.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    within = inside[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    begins = within.copy()
    begins[1:] &= ~within[:-1] | border[1:-1]
    closes = within.copy()
    closes[:-1] &= ~within[1:] | border[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    up, down = _POWERS.to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[_LOWER[data]] * up, out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def runs(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive words inside a text, and each text's first run.

    A text with fewer words has none.
    """
    counts = np.maximum(np.diff(first) - size + 1, 0)
    places = np.concatenate([[0], np.cumsum(counts)])
    if not places[-1]:
        return np.zeros(0, np.uint64), places
    at = np.arange(places[-1]) + np.repeat(first[:-1] - places[:-1], counts)
    factors = keyed(size, 7) | np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out += hashes[at + j] * factors[j]
    return mixed(out), places
