"""Near-duplicate documents by min-max hashing.

Each of ``PERMUTATIONS`` hash functions is evaluated once per shingle and gives two
signature values, its minimum and its maximum.  Bands take their values from
different functions, because the two ends of one function are not independent.
With 32 bands of 4 values a pair at similarity 0.75 shares a band with probability
1 - (1 - 0.75^4)^32, more than 0.99999.

Equal shingle sets form a class first, so exact copies cost one row.  Inside a band
bucket, members are compared with the bucket's hub only: a number of comparisons
linear in the bucket.  Links are confirmed on full sets.  Buckets whose members are
in different components after ``HUB_ROUNDS`` rounds of hubs are compared
exhaustively: small groups after a test on signatures,
large ones in blocks of full sets, inside tasks.  No pairs of a group are listed there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.arrays import flat_bytes, keyed, mixed, runs, text_slices, word_bytes, words
from tidemark.llm.tables import stored

SHINGLE = 5
SIMILARITY = 75
PERMUTATIONS = 64
BANDS = 32
ROWS = 4
HUB_ROUNDS = 1
BLOCK = 64
LARGE_BLOCK = 256
_COLUMNS = 4096
#: Pairs whose estimate from 128 values is below this are five deviations away from 0.75.
ESTIMATE = 0.55
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_FACTORS = keyed(PERMUTATIONS, 11) | np.uint64(1)
_SHIFTS = keyed(PERMUTATIONS, 12)
_BAND_FACTORS = keyed(ROWS, 13) | np.uint64(1)
_BAND_SEEDS = keyed(BANDS, 14)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    hashes, _, _, first = words(*flat_bytes(column), word_bytes(SPACES))
    shingles, places = runs(hashes, first, size)
    out = []
    for i in range(len(first) - 1):
        if places[i + 1] > places[i]:
            out.append(np.unique(shingles[places[i] : places[i + 1]]))
        elif first[i + 1] > first[i]:
            few = hashes[first[i] : first[i + 1]]
            out.append(mixed(np.array([np.sum(few * keyed(len(few), 20 + len(few)))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of every set (none may be empty) under every function."""
    values = np.concatenate(sets)
    places = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((len(sets), PERMUTATIONS), np.uint64)
    high = np.empty_like(low)
    for j in range(PERMUTATIONS):
        hashed = values * _FACTORS[j] + _SHIFTS[j]
        hashed ^= hashed >> np.uint64(32)
        hashed *= _FACTORS[-1 - j]
        low[:, j] = np.minimum.reduceat(hashed, places)
        high[:, j] = np.maximum.reduceat(hashed, places)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; half of the bands are made of minima, half of maxima."""
    ends = np.concatenate([low, high], axis=1).reshape(len(low), BANDS, ROWS)
    return mixed((ends * _BAND_FACTORS).sum(axis=2, dtype=np.uint64) + _BAND_SEEDS)


_SKETCH = "doc_id {id}, same long, n_shingles long, node binary, bands array<long>, signature binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            sets = shingle_sets(part.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            nodes, bands, signs = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                low, high = signatures([sets[i] for i in full])
                keys = band_keys(low, high).view(np.int64).tolist()
                short = np.concatenate([low, high], axis=1).astype(np.uint16)
                for k, i in enumerate(full):
                    nodes[i] = _node(sets[i])
                    bands[i], signs[i] = keys[k], short[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("same"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                ["doc_id", "same", "n_shingles", "node", "bands", "signature"],
            )


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the wanted nodes; a row whose doc_id is right but whose text is another is left out."""
    for batch in batches:
        for part in text_slices(batch):
            found = [(n, s.view(np.int64)) for n, s in zip(part.column("node").to_pylist(), shingle_sets(part.column("text"))) if _node(s) == n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.binary()), pa.array([s for _, s in found], pa.list_(pa.int64()))], ["node", "shingles"]
            )


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across components of a small group whose signatures agree often enough."""
    for batch in batches:
        found_a, found_b = [], []
        for group in batch.column("content").to_pylist():
            signs = np.frombuffer(b"".join(m["signature"] for m in group), np.uint16).reshape(len(group), -1)
            agree = (signs[:, None, :] == signs[None, :, :]).mean(axis=2)
            for i, j in np.argwhere(agree >= ESTIMATE):
                a, b = group[i], group[j]
                if a["node"] < b["node"] and a["root"] != b["root"] and min(a["n"], b["n"]) * 100 >= SIMILARITY * max(a["n"], b["n"]):
                    found_a.append(a["node"])
                    found_b.append(b["node"])
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.binary()), pa.array(found_b, pa.binary())], ["a", "b"])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, over columns for what both sides hold."""
    values = [np.concatenate(side) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    shared = np.intersect1d(*values)
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for v, r in zip(values, rows):
        at = np.minimum(np.searchsorted(shared, v), max(len(shared) - 1, 0))
        held = shared[at] == v if len(shared) else np.zeros(len(v), bool)
        places.append((at[held], r[held]))
    for begin in range(0, len(shared), _COLUMNS):
        sides = []
        for (at, r), side in zip(places, (left, right)):
            here = (at >= begin) & (at < begin + _COLUMNS)
            held = np.zeros((len(side), min(_COLUMNS, len(shared) - begin)), np.float32)
            held[r[here], at[here] - begin] = 1
            sides.append(held)
        out += sides[0] @ sides[1].T
    return out


def _linked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components between two blocks of a large group (or inside one), by their full sets."""
    for batch in batches:
        for k in range(batch.num_rows):
            unit = batch.slice(k, 1)
            content = unit.column("content").flatten()
            blocks, nodes, roots = (content.field(f).to_pylist() for f in ("block", "node", "root"))
            shingles = content.field("shingles")
            ends = np.cumsum(shingles.value_lengths().to_numpy())
            sets = np.split(shingles.flatten().to_numpy(), ends[:-1])
            one = [i for i, b in enumerate(blocks) if b == unit.column("low")[0].as_py()]
            two = [i for i, b in enumerate(blocks) if b == unit.column("high")[0].as_py()]
            if not one or not two:
                continue
            common = common_counts([sets[i] for i in one], [sets[i] for i in two])
            sizes = np.array([len(s) for s in sets])
            union = sizes[one][:, None] + sizes[two][None, :] - common
            pairs = [(nodes[one[i]], nodes[two[j]]) for i, j in np.argwhere(common * 100 >= union * SIMILARITY) if roots[one[i]] != roots[two[j]]]
            yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in pairs], pa.binary()) for f in (min, max)], ["a", "b"])


def _sized() -> F.Column:
    return F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * SIMILARITY


def hub_pairs(members: DataFrame, salt: int) -> DataFrame:
    """Every member of a bucket beside the bucket's hub, where they are in different components."""
    hub = F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("rank"), "node", "n", "root")).alias("hub")
    beside = members.join(members.groupBy("bucket").agg(hub), "bucket")
    return (
        beside.withColumn("other_n", F.col("hub.n"))
        .where((F.col("root") != F.col("hub.root")) & _sized())
        .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
        .distinct()
    )


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        .withColumn("common", F.size(F.array_intersect("left", "right")).cast("long"))
    )
    union = F.size("left") + F.size("right") - F.col("common")
    return both.where(F.col("common") * 100 >= union * SIMILARITY).select("a", "b")


def remaining_links(members: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """All links across components between nodes that share a bucket.

    Buckets with one hub form a group.  In a group of at most ``BLOCK`` nodes likely
    pairs are listed and confirmed.  A larger one is cut into blocks by hash, and the
    full sets of every two blocks are compared in one task, which emits links only.
    """
    hub = F.min(F.struct(F.xxhash64("node", F.lit(0)).alias("rank"), "node"))["node"].alias("hub")
    groups = stored(members.join(members.groupBy("bucket").agg(hub), "bucket").select("hub", "node", "n", "root").distinct(), "groups")
    sized = groups.join(groups.groupBy("hub").agg(F.count(F.lit(1)).alias("size")), "hub")
    few = sized.where(F.col("size") <= BLOCK).join(classes.select("node", "signature"), "node")
    pairs = few.groupBy("hub").agg(F.collect_list(F.struct("node", "n", "root", "signature")).alias("content")).mapInArrow(_likely, "a binary, b binary").distinct()
    blocks = F.ceil(F.col("size") / LARGE_BLOCK)
    block = F.pmod(F.xxhash64("node", F.lit(1)), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    units = (
        sized.where(F.col("size") > BLOCK).join(sets, "node")
        .withColumn("block", block).withColumn("other", other)
        .groupBy("hub", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .agg(F.collect_list(F.struct("block", "node", "root", "shingles")).alias("content"))
    )
    return linked(pairs, sets).union(units.mapInArrow(_linked_blocks, "a binary, b binary")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """A common root for the nodes of every component, by contraction.

    In each round a node joins its neighbour of least rank under a fresh hash, and
    edges move to the roots; the number of edges falls by a constant factor.
    """
    roots = None
    salt = 0
    while not edges.isEmpty():
        salt += 1
        ends = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.xxhash64("b", F.lit(salt)).alias("rank"), F.col("b").alias("node"))
        own = F.struct(F.xxhash64("a", F.lit(salt)).alias("rank"), F.col("a").alias("node"))
        step = stored(
            ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank), F.first(own))["node"].alias("to")), "contraction"
        )
        left = step.select(F.col("node").alias("a"), F.col("to").alias("c"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("d"))
        edges = stored(
            edges.join(left, "a").join(right, "b").where("c != d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(),
            "edges",
        )
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            onward = step.select(F.col("node").alias("root"), F.col("to"))
            roots = stored(roots.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    return roots


def at_roots(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Edges between the roots of their ends."""
    ends = edges.join(own.select(F.col("node").alias("a"), F.col("root").alias("c")), "a").join(own.select(F.col("node").alias("b"), F.col("root").alias("d")), "b")
    return ends.where("c != d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()


def _moved(rows: DataFrame, moved: DataFrame) -> DataFrame:
    return rows.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")


def near_duplicates(docs: DataFrame, same: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept, per row of ``docs`` (doc_id, text).

    With ``same`` also a hash of the text.

    A text without words, or a null text, has an empty set and is linked with nothing.
    Texts of fewer than five words are one shingle.  Rows that repeat a doc_id share
    its component; a null doc_id is ignored when the smallest is sought, and a row
    without any doc_id in its component has a null component_id and is kept.  Other
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("same"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = stored(docs.mapInArrow(_sketch, _SKETCH.format(id=kind)), "sketches")
    filled = sketches.where("node IS NOT NULL")
    classes = stored(
        filled.groupBy("node").agg(
            F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
        ),
        "classes",
    )
    spread = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    members = stored(spread.join(shared, "bucket").withColumn("root", F.col("node")), "members")
    wanted = members.select("node").distinct().join(classes.select("node", "first_id"), "node")
    # A doc_id may repeat, with the same text or with another one.
    sets = stored(
        docs.join(wanted.select(F.col("first_id").alias("id"), "node"), F.col("doc_id").eqNullSafe(F.col("id")))
        .groupBy("doc_id", "node", "same").agg(F.first("text").alias("text"))
        .select("node", "text").mapInArrow(_sets, "node binary, shingles array<long>"),
        "sets",
    )
    own = classes.select("node", "first_id", F.col("node").alias("root"))
    for salt in range(HUB_ROUNDS + 1):
        fresh = stored(linked(hub_pairs(members, salt), sets) if salt < HUB_ROUNDS else remaining_links(members, classes, sets), "links")
        if not fresh.isEmpty():
            moved = components(at_roots(fresh, own) if salt else fresh).select(F.col("node").alias("root"), F.col("root").alias("to"))
            own = stored(_moved(own, moved), "owners")
            members = _moved(members, moved)
        if salt < HUB_ROUNDS:
            mixed_buckets = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
            members = stored(members.join(mixed_buckets, "bucket"), "members")
            if members.isEmpty():
                break
    least = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = stored(own.join(least, "root").select("node", "component_id", "root"), "components")
    hashed, rooted = (["same"], ["root"]) if same else ([], [])
    out = sketches.select("doc_id", *hashed, "n_shingles", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", *hashed, *rooted, "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns.

    Rows are told by doc_id and text.  Of the rows of a group that have its smallest
    doc_id any one stays, and so does one of equal texts without words under one doc_id;
    rows of one doc_id in different groups all stay.  Rows without a doc_id are dropped
    from a group that has a doc_id, and else are all kept.
    """
    found = near_duplicates(docs, same=True)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("same").alias("__same"))
    one_of = F.coalesce(F.hex("root"), F.col("same").cast("string")).alias("__group")
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("same").alias("__same"), one_of)
    repeated = kept.join(kept.groupBy("__id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id"), "__id").distinct()
    rest = docs.join(dropped.distinct(), docs["doc_id"].eqNullSafe(F.col("__id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("__same")), "left_anti")
    if repeated.isEmpty():
        return rest
    repeated = stored(repeated, "repeated")
    single = rest.join(repeated.select("__id").distinct(), rest["doc_id"] == F.col("__id"), "left_anti")
    several = rest.join(repeated, (rest["doc_id"] == F.col("__id")) & F.xxhash64(rest["text"]).eqNullSafe(F.col("__same")))
    return single.unionByName(several.dropDuplicates(["doc_id", "__group"]).select(*docs.columns))
