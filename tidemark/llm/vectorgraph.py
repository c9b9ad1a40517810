"""Near-duplicate vectors over a robust-pruned flat graph.

Vectors are compared inside a label (and length) only.  Equal directions are one node with
its number of copies, so exact copies cost one row.

1. Shards.  The nodes of a label are cut into cells by spherical k-means, fitted in a task
   on a bounded sample, again and again until a cell has at most ``CELL`` nodes.  A node
   has one home cell, builds in a second cell that is nearly as near, and visits every
   cell whose centroid is at most ``MARGIN`` less similar than the best one.  Two vectors with
   cosine 0.98 differ by 0.2; the projection of that on the line between two centroids
   deviates by some 0.03 in 64 dimensions, so a link seldom lies beyond the margin.
   The cells of one dense group are about equally near to all of it: its nodes visit
   them all, and no link between them is lost to the cut.
2. Graph.  In each cell every node keeps the neighbours that robust pruning leaves of its
   nearest and of farther candidates, at most ``DEGREE``, and reverse edges.  The lists
   of a node from its cells are united.
3. Search.  Every node is sought in all cells it visits: best-first from the cell's medoid,
   then all of the ball is expanded until nothing new lies within ``SLACK`` of the limit.  A member
   that does not find itself, and a cell whose audited queries find less than
   ``AUDIT_RECALL`` of what a full comparison finds, are sought again with twice the
   beam.
4. Verification.  Similarities are dot products of unit vectors in double precision.  Each
   pair is counted in one cell only: both ends carry their home cells and visits.

Tasks give one row per node, with its number of links and the least node of its links'
component there; no pairs leave a task.  A dense group of m different vectors costs the
comparisons of its m^2 links, spread over its cells and slices of visitors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.arrays import mixed
from tidemark.llm.minhash import components
from tidemark.llm.tables import stored

COSINE = 0.98
#: Nodes that build the graph of a cell at most, homes per cell aimed at, and children of one cut.
CELL = 2048
HOMES = 640
CHILDREN = 256
#: Sampled rows per child that a cut is fitted on.
FIT_ROWS = 32
MARGIN = 0.08
#: Cuts by k-means; a cell still too large then is cut by hash, and all its nodes visit all its parts.
CUTS = 5
SLICE = 4096
DEGREE = 32
ALPHA = 1.2
NEAR_CANDIDATES = 192
FAR_CANDIDATES = 64
BEAM = 32
SLACK = 0.02
AUDIT_RECALL = 0.98
#: One query in so many is audited.
AUDIT_EVERY = 16
_QUERIES = 256

_UNITS = "vec_id {id}, label {label}, key binary, unit binary"


def unit_vectors(column: pa.Array) -> list[bytes | None]:
    """Unit vectors as doubles; None for null, empty and zero vectors and those with null or non-finite components."""
    out: list[bytes | None] = [None] * len(column)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        values = column.take(pa.array(rows)).flatten().cast(pa.float64())
        vectors = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, n)
        with np.errstate(invalid="ignore", divide="ignore"):
            largest = np.abs(vectors).max(axis=1)
            good = np.isfinite(vectors).all(axis=1) & (largest > 0)
            scaled = vectors / largest[:, None]
            scaled /= np.sqrt((scaled * scaled).sum(axis=1))[:, None]
        for i in np.flatnonzero(good):
            out[rows[i]] = (scaled[i] + 0.0).tobytes()
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = unit_vectors(batch.column("vector"))
        keys = [None if u is None else hashlib.blake2b(u, digest_size=16).digest() for u in units]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "label", "key", "unit"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), np.float64).reshape(len(held), -1)


def centroids_of(vectors: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means from rows evenly spread over the sample; an empty centroid stays."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, min(count, len(vectors))).astype(int)]
    for _ in range(8):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        length = np.sqrt((sums * sums).sum(axis=1))
        centroids = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centroids)
    return centroids


def _fit(group: pa.Table) -> pa.Table:
    group = group.sort_by("id")
    centroids = centroids_of(_matrix(group["unit"]), group["children"][0].as_py())
    return pa.table({"cell": pa.array([group["cell"][0].as_py()]), "centroids": pa.array([centroids.tobytes()], pa.binary())})


_PLACES = "id long, cell string, role int, unit binary"


def _dealt(rows: pa.Table, fitted: pa.Table) -> pa.Table:
    """Each row in its child cells, with its role there."""
    if not rows.num_rows or not fitted.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "cell": pa.array([], pa.string()), "role": pa.array([], pa.int32()), "unit": pa.array([], pa.binary())})
    vectors = _matrix(rows["unit"])
    centroids = np.frombuffer(fitted["centroids"][0].as_py(), np.float64).reshape(-1, vectors.shape[1])
    alike = vectors @ centroids.T
    best = alike.argmax(axis=1)
    top = alike.max(axis=1)
    role = np.where(alike >= top[:, None] - MARGIN, 0, -1)
    rest = alike.copy()
    rest[np.arange(len(rest)), best] = -2
    second = rest.argmax(axis=1)
    held = rows["role"].to_numpy()
    builds = (rest.max(axis=1) >= top - MARGIN / 2) & (held > 0)
    role[np.flatnonzero(builds), second[builds]] = 1
    role[np.arange(len(rest)), best] = held
    row, child = np.nonzero(role >= 0)
    name = rows["cell"][0].as_py()
    return pa.table({
        "id": rows["id"].take(pa.array(row)), "cell": pa.array([f"{name}|{c}" for c in child], pa.string()), "role": pa.array(role[row, child].astype(np.int32)),
        "unit": rows["unit"].take(pa.array(row)),
    })


def cells(nodes: DataFrame) -> DataFrame:
    """id, cell, role (2 home, 1 builds there, 0 visits), unit, from nodes (id, label, unit)."""
    first = F.to_json(F.struct("label", F.length("unit").alias("n"))).alias("cell")
    places = nodes.select("id", first, F.lit(2).alias("role"), "unit")
    for cut in range(64):
        homes, built = F.count_if(F.col("role") == 2), F.count_if(F.col("role") > 0)
        sizes = places.groupBy("cell").agg(homes.alias("homes"), built.alias("built"), F.count(F.lit(1)).alias("all")).where(F.col("built") > CELL)
        children = F.greatest(F.lit(2), F.least(F.lit(CHILDREN), F.ceil(F.col("homes") / HOMES))).cast("int").alias("children")
        large = stored(sizes.select("cell", "homes", children, F.ceil(F.col("all") / SLICE).alias("salts")), "large")
        if large.isEmpty():
            break
        going = places.join(large, "cell")
        if cut < CUTS:
            drawn = F.pmod(F.xxhash64("id", F.lit(cut)), F.lit(1 << 30)) / float(1 << 30) * F.col("homes") < F.col("children") * FIT_ROWS
            sample = going.where((F.col("role") == 2) & drawn).select("cell", "id", "unit", "children")
            fitted = stored(sample.groupBy("cell").applyInArrow(_fit, "cell string, centroids binary"), "centroids")
            salted = going.withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).select("cell", "salt", "id", "role", "unit")
            beside = fitted.join(large, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "centroids")
            dealt = salted.groupBy("cell", "salt").cogroup(beside.groupBy("cell", "salt")).applyInArrow(_dealt, _PLACES)
        else:
            part = F.explode(F.sequence(F.lit(0), F.col("children") - 1))
            own = F.pmod(F.xxhash64("id", F.lit(cut)), F.col("children")) == F.col("part")
            dealt = going.withColumn("part", part).select(
                "id", F.concat_ws("|", "cell", "part").alias("cell"), F.when(own, F.col("role")).otherwise(0).cast("int").alias("role"), "unit"
            )
        places = stored(places.join(large.select("cell"), "cell", "left_anti").select("id", "cell", "role", "unit").unionByName(dealt), "places")
    return places


def pruned(alike: np.ndarray, rows: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning of the candidates of ``rows`` (nearest first, -1 for none): a kept one removes those nearer to it by ``ALPHA``."""
    each = np.arange(len(rows))
    far = 2 - 2 * alike[rows[:, None], np.maximum(candidates, 0)]
    alive = (candidates >= 0) & (candidates != rows[:, None])
    kept = np.full((len(rows), degree), -1, np.int64)
    for place in range(degree):
        first = alive.argmax(axis=1)
        some = alive[each, first]
        if not some.any():
            break
        chosen = np.where(some, candidates[each, first], 0)
        kept[some, place] = chosen[some]
        between = 2 - 2 * alike[chosen[:, None], np.maximum(candidates, 0)]
        alive &= ALPHA * ALPHA * between > far
        alive[each[some], first[some]] = False
    return kept


def padded(lists: list[np.ndarray]) -> np.ndarray:
    lengths = np.array([len(x) for x in lists], np.int64)
    out = np.full((len(lists), int(lengths.max(initial=1))), -1, np.int64)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.concatenate([*lists, np.zeros(0, np.int64)])
    return out


def medoid(vectors: np.ndarray) -> int:
    return int((vectors @ vectors.mean(axis=0)).argmax())


def graph(vectors: np.ndarray) -> list[np.ndarray]:
    """The neighbours of every vector: pruned lists and reverse edges, all of them reached from the medoid."""
    n = len(vectors)
    alike = vectors @ vectors.T
    order = np.argsort(-alike, axis=1, kind="stable")
    taken = np.unique(np.concatenate([np.arange(min(n, NEAR_CANDIDATES + 1)), np.linspace(0, n - 1, min(n, FAR_CANDIDATES)).astype(int)]))
    kept = pruned(alike, np.arange(n), order[:, taken], DEGREE)
    rows, places = np.nonzero(kept >= 0)
    edges = np.unique(np.concatenate([rows * n + kept[rows, places], kept[rows, places] * n + rows]))
    lists = np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))
    many = np.array([i for i in range(n) if len(lists[i]) > 2 * DEGREE], np.int64)
    if len(many):
        sorted_lists = padded([lists[i][np.argsort(-alike[i, lists[i]], kind="stable")] for i in many])
        for i, held in zip(many, pruned(alike, many, sorted_lists, 2 * DEGREE)):
            lists[i] = held[held >= 0]
    reached = np.zeros(n, bool)
    fresh = np.array([medoid(vectors)])
    while True:
        while len(fresh):
            reached[fresh] = True
            ahead = np.unique(np.concatenate([lists[i] for i in fresh]))
            fresh = ahead[~reached[ahead]]
        left = np.flatnonzero(~reached)
        if not len(left):
            return lists
        near = alike[left][:, reached]
        best = int(near.max(axis=1).argmax())
        source = int(np.flatnonzero(reached)[near[best].argmax()])
        lists[source] = np.append(lists[source], left[best])
        fresh = left[[best]]


def _build(group: pa.Table) -> pa.Table:
    group = group.sort_by("id")
    ids = group["id"].to_numpy()
    lists = graph(_matrix(group["unit"]))
    return pa.table({"id": group["id"], "neighbours": pa.array([ids[x] for x in lists], pa.list_(pa.int64()))})


def searched(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, beam: int) -> np.ndarray:
    """Which vectors each query finds at ``COSINE`` or more: best-first from the medoid, then over the whole ball."""
    alike = np.full((len(queries), len(vectors)), -2.0)
    done = np.zeros(alike.shape, bool)
    rows = np.arange(len(queries))
    entry = medoid(vectors)
    alike[:, entry] = queries @ vectors[entry]

    def expand(at: np.ndarray, nodes: np.ndarray) -> None:
        done[at, nodes] = True
        ahead = neighbours[nodes]
        some = ahead >= 0
        pairs = np.repeat(at, some.sum(axis=1)) * len(vectors) + ahead[some]
        pairs = np.unique(pairs[alike.reshape(-1)[pairs] == -2.0])
        q, v = pairs // len(vectors), pairs % len(vectors)
        alike[q, v] = np.einsum("ij,ij->i", queries[q], vectors[v])

    for _ in range(beam):
        open_ones = np.where(done, -3.0, alike)
        best = open_ones.argmax(axis=1)
        going = open_ones[rows, best] > -2
        if not going.any():
            break
        expand(rows[going], best[going])
    while True:
        at, nodes = np.nonzero((alike >= COSINE - SLACK) & ~done)
        if not len(at):
            return alike >= COSINE
        for begin in range(0, len(at), 8192):
            expand(at[begin : begin + 8192], nodes[begin : begin + 8192])


def _found(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, own: np.ndarray, audited: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The search, repeated with wider beams until members find themselves and audits are met; links and found links of the audited."""
    full = queries[audited] @ vectors.T >= COSINE
    beam, todo = BEAM, np.arange(len(queries))
    out = np.zeros((len(queries), len(vectors)), bool)
    members = np.flatnonzero(own >= 0)
    while len(todo):
        out[todo] |= searched(vectors, neighbours, queries[todo], beam)
        hits = int((out[audited] & full).sum())
        if beam > len(vectors):
            break
        beam *= 2
        todo = np.arange(len(queries)) if hits < AUDIT_RECALL * full.sum() else members[~out[members, own[members]]]
    return out, int(full.sum()), hits


def _least_of_components(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Roots after the links a - b: the least number that any node of a component has."""
    while True:
        low = np.minimum(root[a], root[b])
        moved = root.copy()
        np.minimum.at(moved, root[a], low)
        np.minimum.at(moved, root[b], low)
        moved = moved[moved]
        if (moved == root).all():
            return root
        root = moved


def _search(group: pa.Table) -> pa.Table:
    """Links and local component of every node of a cell's slice; a row without id has the audit."""
    group = group.sort_by([("role", "descending"), ("id", "ascending")])
    ids, role, weight, asks = (group[c].to_numpy() for c in ("id", "role", "weight", "asks"))
    vectors = _matrix(group["unit"])
    n = int((role > 0).sum())
    homes = int((role == 2).sum())
    place = group["place"][0].as_py()
    by_id = np.argsort(ids[:n])
    lists = group["neighbours"].slice(0, n).combine_chunks()
    flat = lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(ids[:n][by_id], flat), n - 1) if n else np.zeros(0, np.int64)
    local = np.where(ids[:n][by_id][at] == flat, by_id[at], -1) if n else at
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    neighbours = padded([x[x >= 0] for x in np.split(local, ends[:-1])]) if n else np.zeros((0, 1), np.int64)
    home = group["home"].to_numpy()
    visits = group["visits"].slice(0, homes).combine_chunks()
    owner = np.repeat(np.arange(homes), pc.list_value_length(visits).to_numpy(zero_copy_only=False)) if homes else np.zeros(0, np.int64)
    numbers, codes = np.unique(np.concatenate([home, visits.flatten().to_numpy() if homes else home[:0]]), return_inverse=True)
    visiting = np.zeros((homes, len(numbers)), bool)
    visiting[owner, codes[len(home) :]] = True
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    true, hits = 0, 0
    within = np.zeros((homes, homes), bool)
    queries = np.flatnonzero(asks)
    for begin in range(0, len(queries) if homes else 0, _QUERIES):
        rows = queries[begin : begin + _QUERIES]
        audited = np.flatnonzero(mixed(ids[rows].view(np.uint64)) % np.uint64(AUDIT_EVERY) == 0)
        found, t, h = _found(vectors[:n], neighbours, vectors[rows], np.where(rows < n, rows, -1), audited)
        true, hits = true + t, hits + h
        q, y = np.nonzero(found[:, :homes])
        root = _least_of_components(len(ids), rows[q], y, root)
        inner = rows < homes
        within[rows[inner]] |= found[inner][:, :homes]
        outer = np.flatnonzero(~inner)
        # A pair of two homes is counted in the lesser of the cells where it can be found.
        other = rows[outer]
        counted = found[outer][:, :homes] & ~(visiting[:, codes[other]].T & (home[other] < place)[:, None])
        links[other] += counted @ weight[:homes]
        links[:homes] += weight[other] @ counted
    within |= within.T
    np.fill_diagonal(within, False)
    links[:homes] += within @ weight[:homes]
    told = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
    none = lambda value: np.append(np.zeros(len(told), np.int64), value)
    return pa.table({
        "id": pa.array([*ids[told].tolist(), None], pa.int64()), "links": pa.array(np.append(links[told], 0)), "root": pa.array([*ids[root[told]].tolist(), None], pa.int64()),
        "audited": pa.array(none(true)), "hits": pa.array(none(hits)),
    })


def united(places: DataFrame) -> DataFrame:
    """id, neighbours: the lists of every node, united over the cells it builds in."""
    built = places.where("role > 0").select("cell", "id", "unit").groupBy("cell").applyInArrow(_build, "id long, neighbours array<long>")
    return built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


def links(nodes: DataFrame) -> DataFrame:
    """Per node with links its number of linked rows and a node of its component, and one row without id per task group with its audit."""
    numbered = cells(nodes.select("id", "label", "unit")).withColumn("place", F.xxhash64("cell"))
    owners = numbered.groupBy("id").agg(F.max(F.when(F.col("role") == 2, F.col("place"))).alias("home"), F.collect_list("place").alias("visits"))
    facts = stored(owners.join(united(numbered), "id").join(nodes.select("id", "weight"), "id"), "graph")
    slices = numbered.groupBy("cell").agg(F.greatest(F.ceil(F.count_if(F.col("role") < 2) / SLICE), F.lit(1)).alias("slices"))
    own = F.when(F.col("role") == 2, 0).otherwise(F.pmod(F.xxhash64("id"), F.col("slices"))).alias("own")
    rows = numbered.join(slices, "cell").join(facts, "id").select(
        "cell", "place", "id", "role", "unit", "weight", "home", own, "slices",
        F.when(F.col("role") > 0, F.col("neighbours")).alias("neighbours"), F.when(F.col("role") == 2, F.col("visits")).alias("visits"),
    )
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)
    dealt = rows.withColumn("slice", F.explode(F.when(F.col("role") > 0, everywhere).otherwise(F.array("own")))).withColumn("asks", F.col("slice") == F.col("own"))
    return dealt.drop("own", "slices").groupBy("cell", "slice").applyInArrow(_search, "id long, links long, root long, audited long, hits long")


def near_duplicate_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, DataFrame]:
    """vec_id, n_links, component_id (smallest linked id), kept, per row; and the audit: audited links, found ones.

    Rows are linked when their labels are equal and not null, their vectors have the same
    length, and their cosine is 0.98 or more.  A null, empty or zero vector, one with null
    or non-finite components, or one without a label is linked with nothing.  Equal
    vectors count as links of each other, also under one id.  A null id is ignored
    when the smallest is sought; a row whose component has no id at all has a null
    component_id and is kept.  Other columns are not read.
    """
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"), F.col(label_column).alias("label"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    units = stored(rows.mapInArrow(_units, _UNITS.format(id=kinds["vec_id"], label=kinds["label"])), "units")
    known = units.where("key IS NOT NULL AND label IS NOT NULL")
    grouped = known.groupBy("label", "key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"))
    nodes = stored(grouped.withColumn("id", F.monotonically_increasing_id()), "nodes")
    found = stored(links(nodes), "found")
    audit = found.where("id IS NULL").agg(F.sum("audited").alias("audited"), F.sum("hits").alias("hits"))
    counted = found.where("id IS NOT NULL")
    roots = components(stored(counted.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), "edges"))
    own = nodes.select("label", "key", "id", "first_id", "weight")
    own = own.join(roots, own["id"] == roots["node"], "left") if roots is not None else own.withColumn("root", F.lit(None).cast("long"))
    own = own.select("label", "key", "id", "first_id", "weight", F.coalesce("root", "id").alias("root"))
    own = own.join(counted.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
    least = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    facts = stored(
        own.join(least, "root").select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "facts"
    )
    out = units.select("vec_id", "label", "key").join(facts, ["label", "key"], "left")
    single = F.col("n_links").isNull()
    component = F.when(single, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    result = out.select(F.col("vec_id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component)
    return result.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.col("component_id").isNull())), audit
