"""Operators on vectors against brute force."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import bitplanes, vectorgraph


def rows_of(vectors, labels):
    return [(i, [float(x) for x in v], int(l)) for i, (v, l) in enumerate(zip(vectors, labels))]


def grouped(seed=5, n=900, dimensions=16):
    """Random vectors, pairs near the limit, a dense group, exact and scaled copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dimensions))
    dense = rng.normal(size=dimensions) * 4 + rng.normal(size=(n // 3, dimensions)) * 0.45
    near = base[:200] + rng.normal(size=(200, dimensions)) * 0.2
    vectors = np.concatenate([base, dense, near, base[:30], base[30:60] * 7.5])
    return vectors, rng.integers(0, 3, len(vectors)) * (np.arange(len(vectors)) % 5 == 0)


def linked(vectors, labels):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    root = np.arange(len(unit))
    while True:
        new = np.array([root[links[i]].min() for i in range(len(unit))])
        if (new == root).all():
            return links.sum(axis=1) - 1, root
        root = new


@pytest.mark.parametrize("cell, cuts", [(2048, 5), (128, 5), (128, 0)])
def test_links_equal_brute_force(spark, monkeypatch, cell, cuts):
    """One cell a label, cells cut by k-means, and cells cut by hash alone."""
    monkeypatch.setattr(vectorgraph, "CELL", cell)
    monkeypatch.setattr(vectorgraph, "HOMES", cell // 3)
    monkeypatch.setattr(vectorgraph, "CUTS", cuts)
    monkeypatch.setattr(vectorgraph, "SLICE", 200)
    vectors, labels = grouped()
    n_links, root = linked(vectors, labels)
    frame = spark.createDataFrame(rows_of(vectors, labels), "vec_id long, embedding array<double>, label int").repartition(4)
    found, audit = vectorgraph.near_duplicate_vectors(frame)
    got = {r["vec_id"]: r for r in found.collect()}
    assert len(got) == len(vectors)
    ours = np.array([got[i]["n_links"] for i in range(len(vectors))])
    assert (ours <= n_links).all() and ours.sum() >= 0.98 * n_links.sum()
    same = np.array([got[i]["component_id"] for i in range(len(vectors))]) == root
    assert same.mean() >= 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    told = audit.first()
    assert told["hits"] >= 0.9 * told["audited"] > 0


def test_search_over_the_graph_finds_the_ball():
    vectors, _ = grouped(seed=9)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.unique(unit.round(12), axis=0)
    lists = vectorgraph.graph(unit)
    assert max(map(len, lists)) <= 2 * vectorgraph.DEGREE + 5
    found = vectorgraph.searched(unit, vectorgraph.padded(lists), unit, vectorgraph.BEAM)
    true = unit @ unit.T >= vectorgraph.COSINE
    assert not (found & ~true).any() and found.sum() >= 0.98 * true.sum()


def test_odd_vectors(spark):
    one, other = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [
        (1, one, 1), (2, [2.0, 4.0, 6.0], 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1),
        (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (None, other, 1), (None, one, 2), (11, [1.0, 2.0], 1), (12, [1e300, 2e300, 3e300], 1),
        (13, [1e-310, 2e-310, 3e-310], 1), (14, other, 3),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("id", "cell", "unit", "key", "role", "weight", "links", "root", "n_links", "kept"):
        frame = frame.selectExpr("*", f"1 AS `{name}`")
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectorgraph.near_duplicate_vectors(frame)[0].collect()), key=repr)
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 14)]
    # 1, both rows of 2, 12 and 13 point the same way.
    linked_rows = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (12, 4, 1, False), (13, 4, 1, False), (3, 1, 3, True), (None, 1, 3, False), (None, 0, None, True)]
    assert found == sorted(alone + linked_rows, key=repr)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectorgraph.near_duplicate_vectors(empty)[0].count() == 0


def means(rows, rounds=10, clusters=8):
    """The contract in Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    centres = [v for _, v in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        chosen = [min((gap(v, c), k) for k, c in enumerate(centres)) for _, v in kept]
        if step < rounds:
            for k in range(len(centres)):
                mine = [v for (_, v), (_, c) in zip(kept, chosen) if c == k]
                if mine:
                    centres[k] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = [sum(d for d, c in chosen if c == k) for k in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, chosen)), key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_equal_integer_arithmetic(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 64)) * rng.choice([0.01, 1, 900], size=(300, 1)))]
    vectors += [(1000 + i, vectors[7][1]) for i in range(120)] + [(None, vectors[9][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    got = bitplanes.clustered(frame)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == means(vectors)


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(-(1 << 27), 1 << 27, size=(20, 64)) for _ in range(2))
    a[0], b[0] = -(1 << 27), (1 << 27) - 1
    planes = [bitplanes.planes_of(x, bitplanes.bits_for(x)) for x in (a, b)]
    assert (bitplanes.dots(*planes) == a @ b.T).all() and (bitplanes.squares(planes[0]) == (a * a).sum(axis=1)).all()
    assert (bitplanes.component_sums(planes[0]) == a.sum(axis=0)).all()


def test_odd_vectors_are_left_out(spark):
    good = [float(i % 7) - 3 for i in range(64)]
    rows = [(1, good), (2, good), (2, good), (3, None), (4, []), (5, good[:63]), (6, good + [1.0]), (7, [None, *good[1:]]), (8, [float("nan"), *good[1:]]),
            (9, [float("-inf"), *good[1:]]), (10, [1e9, *good[1:]]), (None, [0.0] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS planes", "3 AS row_id")
    got = sorted((tuple(r) for r in bitplanes.clustered(frame).collect()), key=repr)
    assert got == means([(1, good), (2, good), (2, good), (None, [0.0] * 64)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bitplanes.clustered(empty).columns == COLUMNS and bitplanes.clustered(empty).count() == 0
