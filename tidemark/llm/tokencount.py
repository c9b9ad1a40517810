"""Token counts that follow edits, by segment trees over pre-tokens.

A document's pre-tokens are grouped into leaves; its tree holds characters and tokens of
every leaf and the sums of every subtree.  An edit finds its leaves by descending the
character sums, encodes again from the leaf before it until pre-tokens meet an old leaf
border behind it, and updates the sums on the paths of the leaves in between.  The split
into pre-tokens looks at most two characters ahead and never back, so nothing outside
that region changes.  Special tokens written out in a text count as text like other text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.packing import encoder

LEAF = 16
#: Pre-tokens whose counts a worker remembers.
_REMEMBERED = 1_000_000


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers

        self.bpe, self.pattern, self.known = encoder(vocabulary), regex.compile(public_tokenizers.PATTERN), {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.bpe.encode_ordinary(piece))
        return n

    def leaves(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        chars, tokens = [], []
        for i in range(0, len(pieces), LEAF):
            part = pieces[i : i + LEAF]
            chars.append(sum(map(len, part)))
            tokens.append(sum(map(self.count, part)))
        return chars, tokens


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


class Tree:
    """Heap-ordered sums of (characters, tokens) over leaves; node 1 is the root."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.rebuild(np.array([chars, tokens], np.int64).T.reshape(-1, 2))

    def rebuild(self, leaves: np.ndarray) -> None:
        self.size = len(leaves)
        self.room = 1 << max(self.size - 1, 0).bit_length()
        self.sums = np.zeros((2 * self.room, 2), np.int64)
        self.sums[self.room : self.room + self.size] = leaves
        level = self.room
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @classmethod
    def load(cls, stored: bytes) -> Tree:
        out = cls([], [])
        out.rebuild(np.frombuffer(stored, "<i8").reshape(-1, 2))
        return out

    def dump(self) -> bytes:
        return self.sums[self.room : self.room + self.size].astype("<i8").tobytes()

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins; the last leaf for a place behind the text."""
        if not self.size:
            return 0, 0
        if place >= self.chars:
            return self.size - 1, self.chars - int(self.sums[self.room + self.size - 1, 0])
        node, begin = 1, 0
        while node < self.room:
            node *= 2
            left = int(self.sums[node, 0])
            if place - begin >= left:
                begin += left
                node += 1
        return node - self.room, begin

    def replace(self, first: int, behind: int, chars: list[int], tokens: list[int]) -> None:
        """New leaves for those in [first, behind)."""
        fresh = np.array([chars, tokens], np.int64).T.reshape(-1, 2)
        leaves = self.sums[self.room : self.room + self.size]
        if len(fresh) != behind - first:
            self.rebuild(np.concatenate([leaves[:first], fresh, leaves[behind:]]))
            return
        leaves[first:behind] = fresh
        nodes = np.unique(np.arange(self.room + first, self.room + behind) // 2)
        while len(nodes) and nodes[0] >= 1:
            self.sums[nodes] = self.sums[2 * nodes] + self.sums[2 * nodes + 1]
            nodes = np.unique(nodes // 2)


def built(text: str, counts: Counter) -> Tree:
    return Tree(*counts.leaves(counts.pattern.findall(text)))


def edit(text: str, tree: Tree, start: int, removed: int, inserted: str, counts: Counter) -> tuple[str, int]:
    """The edited text and the number of characters encoded again; ``tree`` follows."""
    start = min(max(start, 0), len(text))
    removed = min(max(removed, 0), len(text) - start)
    after = text[:start] + inserted + text[start + removed :]
    first, begin = tree.leaf_at(max(start - 3, 0))
    if begin > max(start - 3, 0):
        first, begin = 0, 0
    behind, border = (first, begin) if not tree.size else tree.leaf_at(start + removed)
    shift = len(inserted) - removed
    while behind < tree.size and border < start + removed:
        border += int(tree.sums[tree.room + behind, 0])
        behind += 1
    pieces, at = [], begin
    for match in counts.pattern.finditer(after, pos=begin):
        while behind < tree.size and border + shift < at:
            border += int(tree.sums[tree.room + behind, 0])
            behind += 1
        if at == border + shift and at >= start + len(inserted):
            break
        pieces.append(match.group())
        at = match.end()
    else:
        behind = tree.size
    tree.replace(first, behind, *counts.leaves(pieces))
    return after, at - begin


class _Build:
    def __init__(self, vocabulary: str, columns: list[str]) -> None:
        self.vocabulary, self.columns = vocabulary, columns

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(self.vocabulary)
        for batch in batches:
            trees = [built(t.as_py() or "", counts) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in self.columns], pa.array([t.dump() for t in trees], pa.binary()), pa.array([t.tokens for t in trees], pa.int64())],
                [*self.columns, "tree", "n_tokens"],
            )


class _Edit:
    def __init__(self, vocabulary: str) -> None:
        self.vocabulary = vocabulary

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(self.vocabulary)
        for batch in batches:
            texts, trees, tokens, again = [], [], [], []
            for text, stored, edits in zip(batch.column("text"), batch.column("tree"), batch.column("edits")):
                after, tree, redone = text.as_py() or "", Tree.load(stored.as_py()), 0
                for e in edits.as_py() or []:
                    if e is not None:
                        after, n = edit(after, tree, e["start"] or 0, e["removed"] or 0, e["inserted"] or "", counts)
                        redone += n
                texts.append(after)
                trees.append(tree.dump())
                tokens.append(tree.tokens)
                again.append(redone)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(trees, pa.binary()), batch.column("n_tokens"), pa.array(tokens, pa.int64()), pa.array(again, pa.int64())],
                ["doc_id", "text", "tree", "n_tokens", "edited_tokens", "encoded_again"],
            )


def trees(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` (doc_id, text, perhaps edits) with its tree (binary) and n_tokens.

    A null or empty text has an empty tree and no tokens.  Repeated rows have a tree each.
    """
    columns = [c for c in ("doc_id", "text", "edits") if c in docs.columns]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns).mapInArrow(_Build(vocabulary, columns), f"{schema}, tree binary, n_tokens long")


def edited(counted: DataFrame, vocabulary: str) -> DataFrame:
    """Apply ``edits``, an array of (start, removed, inserted) in characters, one after another.

    ``counted`` has doc_id, text, edits, tree, n_tokens.  Returns doc_id, text and tree
    after the edits, n_tokens before and edited_tokens after them, and encoded_again, the
    characters that were encoded again.  Places beyond the text count as its end; null
    edits and null fields change nothing.
    """
    kind = counted.schema["doc_id"].dataType.simpleString()
    return counted.select("doc_id", "text", "edits", "tree", "n_tokens").mapInArrow(
        _Edit(vocabulary), f"doc_id {kind}, text string, tree binary, n_tokens long, edited_tokens long, encoded_again long"
    )
