"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A sketch has three subtables of cells (count, xor of digests, xor of checks).  Two
sketches subtract cell by cell; what both hold cancels, and peeling cells with one
digest left recovers the digests that differ.

The paragraphs of a text are its lines, divided after sentence ends, and long ones further
after words (in very long words after bytes) that their own hash picks: where a text is divided
depends on the place itself, so an edit changes the paragraphs around it only.  The first 2, 8 and
32 code points count as paragraphs as well, so that texts of a few words have some.  A paragraph
that repeats counts by its occurrence number.

A fingerprint is the smallest sketch, from the size that the number of paragraphs asks for in steps of
two, that peels down to nothing by itself: it gives back all its digests.  Two fingerprints are compared at the larger one's
size, the smaller one's digests put into a sketch of that size; if their difference does
not peel, both are made twice as large.  Nothing but the two fingerprints is needed.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.arrays import _BYTE_CODE, _POWERS, flat_bytes, keyed, mixed, text_slices

#: Sentences of more bytes than this are divided after words whose hash ends in four zero bits, words of more bytes after bytes whose hash ends in five.
LONG, LONG_WORD = 256, 64
_WORD_BITS, _BYTE_BITS = np.uint64(15), np.uint64(31)
OPENINGS = (2, 8, 32)
_SEEDS = keyed(3, 31)
_CHECK = keyed(1, 32)[0]
_OPENING = keyed(len(OPENINGS), 33)
_REPEATED = keyed(1, 34)[0] | np.uint64(1)
#: Bytes of text whose sketches are made together.
SLICE = 1_000_000
#: Ranges of doc_id a shuffle partition gets on average.
_RANGES = 4
_CELL_BYTES = 12
#: Rounds of peeling after which digests are looked at for coming twice; few sketches need as many.
_ROUNDS = 24


def _range_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * down[start])


def all_digests(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit digests of the paragraphs and occurrences of every text; a null is an empty text."""
    data, offsets = flat_bytes(column)
    n, texts = len(data), len(offsets) - 1
    if not n:
        return [np.zeros(0, np.uint64)] * texts
    up, down = _POWERS.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:n], out=sums[1:])
    space, line = data == 0x20, data == 0x0A
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    # Cuts stand before a byte: at texts, around line ends, after sentence ends.
    cut = border.copy()
    cut[:-1] |= line
    cut[1:] |= line
    ends = np.flatnonzero(np.isin(data, np.frombuffer(b".!?", np.uint8)))
    ends = ends[ends + 1 < n]
    cut[ends[space[ends + 1]] + 1] = True
    wide = np.flatnonzero((data[:-2] >= 0xE3) & (data[1:-1] >= 0x80)) if n > 2 else np.zeros(0, np.int64)
    three = (data[wide].astype(np.int64) << 16) | (data[wide + 1].astype(np.int64) << 8) | data[wide + 2]
    cut[wide[np.isin(three, (0xE38082, 0xEFBC81, 0xEFBC9F))] + 3] = True
    places = np.flatnonzero(cut)
    # Long sentences, after words of their own choice.
    length = np.diff(places)
    inside = np.zeros(n, bool)
    for i in np.flatnonzero(length > LONG):
        inside[places[i] : places[i + 1]] = True
    starts = np.flatnonzero(~space & inside & (np.concatenate([[True], space[:-1]]) | cut[:-1]))
    stops = np.flatnonzero(~space & inside & (np.concatenate([space[1:], [True]]) | cut[1:])) + 1
    if len(starts):
        cut[stops[(_range_hash(sums, down, starts, stops) & _WORD_BITS) == 0]] = True
        # Very long words, after bytes of their own choice that end a character.
        for a, b in zip(starts[stops - starts > LONG_WORD], stops[stops - starts > LONG_WORD]):
            at = np.arange(a + 16, b)
            at = at[(data[at] & 0xC0) != 0x80]
            cut[at[(_range_hash(sums, down, at - 8, at) & _BYTE_BITS) == 0]] = True
    places = np.flatnonzero(cut)
    begin, end = places[:-1], places[1:]
    # A paragraph that is a line end or blanks only is none.
    filled = np.concatenate([[0], np.cumsum(~(space | line))])
    some = filled[end] > filled[begin]
    begin, end = begin[some], end[some]
    owner = np.searchsorted(offsets, begin, side="right") - 1
    keys = _range_hash(sums, down, begin, end)
    points = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(points, offsets)
    owners, hashes = [owner], [keys]
    for size, seed in zip(OPENINGS, _OPENING):
        have = np.flatnonzero(np.diff(first) >= size)
        stop = np.append(points, n)[first[have] + size]
        owners.append(have)
        hashes.append(mixed(_range_hash(sums, down, offsets[have], np.minimum(stop, offsets[have + 1])) ^ seed))
    owner, keys = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    group = np.flatnonzero(fresh)
    rank = np.arange(len(keys)) - np.repeat(group, np.diff(np.append(group, len(keys))))
    keys = mixed(keys + rank.astype(np.uint64) * _REPEATED)
    return np.split(keys, np.searchsorted(owner, np.arange(1, texts)))


def digests(text: str) -> np.ndarray:
    return all_digests(pa.array([text], pa.string()))[0]


def cells_for(count: int) -> int:
    """Cells of a subtable that ``count`` digests ask for: 4, 6, 8, 12, 16, 24 ..."""
    need, out = (1.45 * count + 8) / 3, 4
    while out < need:
        out = out * 3 // 2 if out & (out - 1) == 0 else out * 4 // 3
    return out


class Sketches:
    """Sketches of many texts: counts, digests and checks, a row of three subtables each."""

    def __init__(self, rows: int, third: int) -> None:
        self.rows, self.third = rows, third
        self.count = np.zeros((rows, 3 * third), np.int32)
        self.digest = np.zeros((rows, 3 * third), np.uint64)
        self.check = np.zeros((rows, 3 * third), np.uint16)

    @classmethod
    def of(cls, keys: list[np.ndarray], third: int) -> Sketches:
        out = cls(len(keys), third)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        out.add(owner, np.concatenate([np.zeros(0, np.uint64), *keys]), np.ones(len(owner), np.int32))
        return out

    @staticmethod
    def checks(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys + _CHECK) >> np.uint64(48)).astype(np.uint16)

    def places(self, keys: np.ndarray, table: int) -> np.ndarray:
        return (mixed(keys ^ _SEEDS[table]) % np.uint64(self.third)).astype(np.int64) + table * self.third

    def add(self, owner: np.ndarray, keys: np.ndarray, signs: np.ndarray) -> None:
        checks = self.checks(keys)
        for j in range(3):
            at = owner * (3 * self.third) + self.places(keys, j)
            np.add.at(self.count.reshape(-1), at, signs)
            np.bitwise_xor.at(self.digest.reshape(-1), at, keys)
            np.bitwise_xor.at(self.check.reshape(-1), at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.rows, self.third)
        out.count, out.digest, out.check = self.count - other.count, self.digest ^ other.digest, self.check ^ other.check
        return out

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, digest and side (1 or -1) of what could be recovered, and which rows are whole.  Empties the cells.

        Several digests may by chance look like one; taking that out leaves its two other cells
        with the same digest, which would go in and out for ever.  A row whose digest comes a second time is given up.
        """
        rows, keys, sides = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        broken = np.zeros(self.rows, bool)
        while True:
            row, cell = np.nonzero((np.abs(self.count) == 1) & ~broken[:, None])
            found = self.digest[row, cell]
            # One digest alone has its check, and lies in the cell that it belongs to.
            home = np.choose(cell // self.third, [self.places(found, j) for j in range(3)]) if len(found) else cell
            pure = (self.checks(found) == self.check[row, cell]) & (home == cell)
            row, cell, found = row[pure], cell[pure], found[pure]
            if not len(row):
                break
            _, first = np.unique(mixed(found) + row.astype(np.uint64) * _SEEDS[0], return_index=True)
            row, found, side = row[first], found[first], self.count[row[first], cell[first]]
            if len(rows) > _ROUNDS:
                known = np.concatenate([mixed(k) + r.astype(np.uint64) * _SEEDS[0] for k, r in zip(keys, rows)])
                again = np.isin(mixed(found) + row.astype(np.uint64) * _SEEDS[0], known)
                broken[row[again]] = True
            self.add(row, found, -side)
            rows.append(row)
            keys.append(found)
            sides.append(side)
        whole = ~(broken | self.count.any(axis=1) | self.digest.any(axis=1) | self.check.any(axis=1))
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides), whole

    def copy(self) -> Sketches:
        out = Sketches(self.rows, self.third)
        out.count, out.digest, out.check = self.count.copy(), self.digest.copy(), self.check.copy()
        return out

    def texts(self) -> list[str]:
        """Counts modulo 2^16: more digests than that in a cell differ by whole turns, which a difference that peels does not see."""
        parts = zip(self.count.astype("<u2"), self.digest.astype("<u8"), self.check.astype("<u2"))
        return [base64.b64encode(c.tobytes() + d.tobytes() + k.tobytes()).decode("ascii") for c, d, k in parts]

    @classmethod
    def read(cls, text: str) -> Sketches:
        held = base64.b64decode(text)
        cells = len(held) // _CELL_BYTES
        out = cls(1, cells // 3)
        out.count[0] = np.frombuffer(held, "<i2", cells)
        out.digest[0] = np.frombuffer(held, "<u8", cells, 2 * cells)
        out.check[0] = np.frombuffer(held, "<u2", cells, 10 * cells)
        return out


def fingerprints(keys: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The fingerprint of every text, and the cells of its subtables."""
    out: list = [""] * len(keys)
    third = np.array([cells_for(len(k)) for k in keys], np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        left = []
        for size in np.unique(third[todo]):
            mine = todo[third[todo] == size]
            made = Sketches.of([keys[i] for i in mine], int(size))
            whole = made.copy().peeled()[3]
            for i, text, good in zip(mine, made.texts(), whole):
                if good:
                    out[i] = text
            left.append(mine[~whole])
        todo = np.concatenate(left)
        third[todo] *= 2
    return out, third


def differences(left: list[np.ndarray], right: list[np.ndarray], third: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair the digests only in ``left`` and only in ``right``, from sketches of the given size or larger ones where those fail."""
    out: list = [None] * len(left)
    third = third.copy()
    todo = np.arange(len(left))
    while len(todo):
        failed = []
        for size in np.unique(third[todo]):
            mine = todo[third[todo] == size]
            a, b = (Sketches.of([side[i] for i in mine], int(size)) for side in (left, right))
            rows, keys, sides, whole = a.minus(b).peeled()
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(len(mine) + 1))
            for i in np.flatnonzero(whole):
                found = order[ends[i] : ends[i + 1]]
                out[mine[i]] = (keys[found[sides[found] > 0]], keys[found[sides[found] < 0]])
            failed.append(mine[~whole])
        todo = np.concatenate(failed)
        third[todo] *= 2
    return out


def likeness(count: int, gone: int, new: int) -> float:
    """Shared paragraphs by all paragraphs; two texts without any are alike."""
    common = count - gone
    union = common + gone + new
    return common / union if union else 1.0


def compared(one: str, other: str) -> float:
    """The likeness of two fingerprints, from nothing but them."""
    a, b = Sketches.read(one), Sketches.read(other)
    size = max(a.third, b.third)
    keys = [s.copy().peeled()[1] for s in (a, b)]
    (gone, new), = differences([keys[0]], [keys[1]], np.array([size]))
    return likeness(len(keys[0]), len(gone), len(new))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first ones."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with its successor; the last row of a block is a copy of the next block's head."""
    waiting: list[tuple] = []
    for batch in batches:
        for piece in text_slices(batch, most=SLICE):
            ids, texts, blocks, copies = (piece.column(c).to_pylist() for c in ("doc_id", "text", "part", "copy"))
            keys = all_digests(piece.column("text"))
            rows = [*waiting, *((doc, text or "", *rest) for doc, text, *rest in zip(ids, texts, blocks, copies, keys, *fingerprints(keys)))]
            pairs = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
            waiting = rows[-1:]
            if pairs:
                yield _compared(rows, pairs, piece.column("doc_id").type)


def _compared(rows: list[tuple], pairs: list[int], kind: pa.DataType) -> pa.RecordBatch:
    keys = [rows[i][4] for i in pairs]
    following = [rows[i + 1][4] for i in pairs]
    others = [edited(rows[i][1], rows[i + 1][1]) for i in pairs]
    other_keys = [d for part in text_slices(pa.record_batch([pa.array(others, pa.string())], ["text"])) for d in all_digests(part.column("text"))]
    own, (other, other_size) = [rows[i][5] for i in pairs], fingerprints(other_keys)
    size, next_size = (np.array([rows[i + k][6] for i in pairs]) for k in (0, 1))
    versions_differ = differences(keys, other_keys, np.maximum(size, other_size))
    next_differ = differences(keys, following, np.maximum(size, next_size))
    columns = [
        [rows[i][0] for i in pairs], [len(rows[i][1]) for i in pairs], [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in others], own, other,
        [likeness(len(k), len(d[0]), len(d[1])) for k, d in zip(keys, versions_differ)], [likeness(len(k), len(d[0]), len(d[1])) for k, d in zip(keys, next_differ)],
        [np.concatenate(d).view(np.int64) for d in versions_differ],
    ]
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _NAMES)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "differing"]


def versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id of any type that has an order, text) and of an edited text.

    Rows are ordered by descending doc_id, equal ids by text and null ids last; the row
    after the last is the first, so a single row follows itself.  The edited text ends
    with the following text's begin.  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next (0 to 1), and differing,
    the digests of paragraphs in only one of the text and the edited text.  A null text
    counts as empty; two texts without paragraphs have likeness 1.  Repeated rows have a
    row each.  No rows give no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * _RANGES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Bounds of balanced ranges from some fifty ids a range, picked by hash; they only deal out the work.
    some = max(1, docs.count() // (50 * ranges))
    picked = sorted(r["doc_id"] for r in docs.select("doc_id").where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(some)) == 0)).collect())
    cuts = sorted({picked[i * len(picked) // ranges] for i in range(1, ranges)}) if picked else []
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>"), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(above).cast("int")
    placed = docs.select("doc_id", "text", part.alias("part"))
    heads = sorted((r["part"], r["head"]) for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return docs.select("doc_id").mapInArrow(_sketched, _SCHEMA.format(id=kind))
    # Each range also gets the head of the range behind it; rows of one id come together, in the order of their texts.
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    known = [(head, number) for head, number in before.items() if head is not None]
    copies = [placed.where("doc_id IS NULL").withColumn("part", F.lit(before[None]))] if None in before else []
    if known:
        table = F.broadcast(spark.createDataFrame(known, f"doc_id {kind}, before int"))  # one row per range
        copies.append(placed.drop("part").join(table, "doc_id").select("doc_id", "text", F.col("before").alias("part")))
    rows = placed.withColumn("copy", F.lit(False))
    for frame in copies:
        rows = rows.unionByName(frame.withColumn("copy", F.lit(True)))
    return (
        rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
        .sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
        .mapInArrow(_sketched, _SCHEMA.format(id=kind))
    )


_SCHEMA = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, differing array<long>"
