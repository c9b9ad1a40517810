"""Centroid clustering on bit planes.

A vector's 64 components become integers floor(1024 * x) in two's complement.  Plane b
holds bit b of all 64 components in one 64-bit word; its weight is 2^b, and -2^b for
the plane of signs.  With the planes p of a vector and q of a centroid the dot product is
the sum of weight(i) * weight(j) * popcount(p_i AND q_j), an exact integer, and so are
squared lengths and distances.  The planes of all vectors are written once; each round
reads them, and gives the sums of components per cluster, which are also counted plane
by plane.  Only centroids (clusters x 64 integers) pass through the driver.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.tables import stored

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Integers from -2^27 to 2^27 - 1: 64 squared differences then fit into a long.
MOST_BITS = 28
#: Vectors unpacked at a time.
SLICE = 2048


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a list column count, and their components as integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = pc.fill_null(pc.equal(pc.list_value_length(column), DIMENSIONS), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(right)
    values = column.take(pa.array(rows)).flatten()
    whole = np.ones(len(values), bool) if not values.null_count else values.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        numbers = np.floor(SCALE * pc.fill_null(values.cast(pa.float64()), 0).to_numpy(zero_copy_only=False)).reshape(-1, DIMENSIONS)
    bound = float(1 << (MOST_BITS - 1))
    good = (whole.reshape(-1, DIMENSIONS) & (numbers >= -bound) & (numbers < bound)).all(axis=1)
    return rows[good], numbers[good].astype(np.int64)


def bits_for(numbers: np.ndarray) -> int:
    """Two's complement bits that hold all of ``numbers``."""
    if not numbers.size:
        return 1
    return max(int(numbers.max()).bit_length(), int(~numbers.min()).bit_length() if numbers.min() < 0 else 0) + 1


def planes_of(numbers: np.ndarray, bits: int) -> np.ndarray:
    """One 64-bit word per vector and bit: component d is bit d of the word."""
    out = np.empty((len(numbers), bits), np.uint64)
    places = np.arange(DIMENSIONS, dtype=np.uint64)
    for b in range(bits):
        out[:, b] = np.bitwise_or.reduce(((numbers >> b) & 1).astype(np.uint64) << places, axis=1)
    return out


def weights(bits: int) -> np.ndarray:
    out = np.left_shift(1, np.arange(bits, dtype=np.int64))
    out[-1] = -out[-1]
    return out


def widened(planes: np.ndarray, bits: int) -> np.ndarray:
    """The same integers in more planes: the plane of signs is repeated."""
    more = bits - planes.shape[1]
    return planes if more <= 0 else np.concatenate([planes, np.repeat(planes[:, -1:], more, axis=1)], axis=1)


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of every left with every right vector, by AND and popcount of their planes."""
    out = np.zeros((len(left), len(right)), np.int64)
    for i, x in enumerate(weights(left.shape[1])):
        for j, y in enumerate(weights(right.shape[1])):
            out += (x * y) * np.bitwise_count(left[:, None, i] & right[None, :, j]).astype(np.int64)
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """Squared lengths of vectors, by their own planes."""
    out = np.zeros(len(planes), np.int64)
    of = weights(planes.shape[1])
    for i, x in enumerate(of):
        for j in range(i, len(of)):
            out += (1 + (j > i)) * (x * of[j]) * np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every vector (ties: the smaller number) and its squared distance."""
    distance = squares(planes)[:, None] - 2 * dots(planes, centroids) + squares(centroids)[None, :]
    chosen = distance.argmin(axis=1)
    return chosen, distance[np.arange(len(planes)), chosen]


def component_sums(planes: np.ndarray) -> np.ndarray:
    """Sums of components over vectors: the bits of each plane are counted per component."""
    bits = np.unpackbits(planes.astype("<u8").view(np.uint8), bitorder="little").reshape(len(planes), planes.shape[1], DIMENSIONS)
    return weights(planes.shape[1]) @ bits.sum(axis=0, dtype=np.int64)


_PACKED = "row_id {id}, planes binary, start string, tie long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            part = batch.slice(begin, SLICE)
            rows, numbers = integers(part.column("vector"))
            packed = planes_of(numbers, bits_for(numbers))
            places = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("row_id").take(places), pa.array([p.tobytes() for p in packed], pa.binary()), part.column("start").take(places),
                 part.column("tie").take(places)],
                ["row_id", "planes", "start", "tie"],
            )


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with the planes of their vectors, all as wide as the widest."""
    for begin in range(0, batch.num_rows, SLICE):
        part = batch.slice(begin, SLICE)
        held = [np.frombuffer(p, np.uint64)[None, :] for p in part.column("planes").to_pylist()]
        bits = max((p.shape[1] for p in held), default=0)
        if held:
            yield part, np.concatenate([widened(p, bits) for p in held])


def _sums(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and sums of components per cluster, over all vectors of a task."""
    counts = np.zeros(len(centroids), np.int64)
    sums = np.zeros((len(centroids), DIMENSIONS), np.int64)
    for batch in batches:
        for _, planes in _matrices(batch):
            chosen, _ = nearest(planes, centroids)
            for c in np.unique(chosen):
                mine = planes[chosen == c]
                counts[c] += len(mine)
                sums[c] += component_sums(mine)
    filled = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(filled.astype(np.int32)), pa.array(counts[filled]), pa.array(list(sums[filled]), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
    )


def _assigned(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, planes in _matrices(batch):
            chosen, distance = nearest(planes, centroids)
            yield pa.RecordBatch.from_arrays([part.column("row_id"), pa.array(chosen.astype(np.int32)), pa.array(distance)], ["row_id", "cluster", "distance"])


def _on(function: Callable, centroids: list[list[int]]) -> Callable:
    numbers = np.array(centroids, np.int64).reshape(-1, DIMENSIONS)
    return functools.partial(function, planes_of(numbers, bits_for(numbers)))


def unpacked(planes: bytes) -> list[int]:
    return component_sums(np.frombuffer(planes, np.uint64)[None, :]).tolist()


def clustered(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, per kept vector.

    Kept are vectors with exactly 64 components, none of them null or non-finite, whose
    integers lie between -2^27 and 2^27 - 1 (beyond, a distance may not fit into a long).
    The first centroids are the ``clusters`` vectors with the smallest sha256 of
    ``seed:id``, rows that share an id in the order of a hash of their vectors; a vector without an
    id is clustered, but never a first centroid.  Fewer such vectors give fewer centroids,
    none at all an empty result.  A sum over distances that does not fit into a long is
    null.  Other columns of ``vectors`` are not read.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    rows = vectors.select(F.col(id_column).alias("row_id"), F.col(vector_column).alias("vector"), hashed.alias("start"), F.xxhash64(vector_column).alias("tie"))
    kind = rows.schema["row_id"].dataType.simpleString()
    packed = stored(rows.mapInArrow(_pack, _PACKED.format(id=kind)), "planes")
    first = packed.where("start IS NOT NULL").orderBy("start", "tie").limit(clusters)
    centroids = [unpacked(bytes(r["planes"])) for r in first.collect()]
    if not centroids:
        return packed.select(
            F.col("row_id").alias(id_column), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"),
            F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"),
        ).where(F.lit(False))
    planes = packed.select("row_id", "planes")
    total = F.sum(F.col("total")).alias("total")
    for _ in range(rounds):
        parts = planes.mapInArrow(_on(_sums, centroids), "cluster int, n long, sums array<long>")
        flat = parts.select("cluster", "n", F.posexplode("sums").alias("place", "total"))
        for r in flat.groupBy("cluster", "place").agg(F.sum("n").alias("n"), total).collect():
            centroids[r["cluster"]][r["place"]] = r["total"] // r["n"]
    found = stored(planes.mapInArrow(_on(_assigned, centroids), f"row_id {kind}, cluster int, distance long"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda n: n if n < 1 << 63 else None
    facts = [(r["cluster"], fits(int(r["sum"])), digests[r["cluster"]]) for r in sums]
    known = F.broadcast(vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string"))
    whole = F.lit(fits(sum(int(r["sum"]) for r in sums))).cast("long").alias("inertia")
    return found.join(known, "cluster").select(F.col("row_id").alias(id_column), "cluster", "distance", "cluster_inertia", whole, "centroid_sha256")
