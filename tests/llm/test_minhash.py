from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm import minhash

SPACES = " \t\n\v\f\r"


def shingles(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in SPACES:
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    """Smallest doc_id reachable for each (doc_id, text), comparing all pairs."""
    nodes = [(d, frozenset(shingles(t))) for d, t in rows]
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    seen = defaultdict(list)
    for i, (_, s) in enumerate(nodes):
        common = defaultdict(int)
        for x in s:
            for j in seen[x]:
                common[j] += 1
            seen[x].append(i)
        for j, k in common.items():
            if 100 * k >= 75 * (len(s) + len(nodes[j][1]) - k):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, s) in enumerate(nodes):
        if d is not None:
            least[root(i)].append(d)
    return [(d, len(s), min(least[root(i)], default=None) if s else d) for i, (d, s) in enumerate(nodes)]


def as_sorted(rows):
    return sorted(rows, key=repr)


def test_components_match_all_pairs(documents, texts):
    got = minhash.near_duplicates(documents).collect()
    assert as_sorted((r[0], r[1], r[2]) for r in got) == as_sorted(brute_components(texts.items()))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(odd, nothing):
    got = minhash.near_duplicates(odd).collect()
    assert as_sorted((r[0], r[1], r[2]) for r in got) == as_sorted(brute_components([(d, t) for d, t, _ in odd_rows()]))
    assert minhash.near_duplicates(nothing).count() == 0


def test_one_document_of_each_group_stays(odd, nothing):
    kept = minhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert as_sorted(i for i in ids if i is not None) == [1, 11, 12, 13, 2, 4, 5, 6, 7, 9]
    assert ids.count(None) == 1
    assert minhash.without_near_duplicates(nothing).count() == 0


def test_hot_groups_of_copies_and_chains(spark):
    """Hundreds of exact and near copies, and a chain in which only neighbours are similar."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300):
        changed = list(base)
        changed[(7 * i) % 200] = f"x{i}"
        rows.append((1000 + i, " ".join(changed)))
    for i in range(40):
        rows.append((5000 + i, " ".join(f"c{j}" for j in range(8 * i, 8 * i + 120))))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert as_sorted((r[0], r[1], r[2]) for r in got) == as_sorted(brute_components(rows))


@pytest.mark.parametrize("block", [200, 8])
def test_exhaustive_comparison_finds_what_hubs_leave(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "LARGE_BLOCK", 20)
    monkeypatch.setattr(minhash, "_COLUMNS", 50)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*base[:10 + i], f"y{i}", *base[11 + i:]])) for i in range(90)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert as_sorted((r[0], r[1], r[2]) for r in got) == as_sorted(brute_components(rows))


def test_signatures_estimate_similarity():
    pick = np.random.default_rng(5)
    shared, left, right = (pick.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    low, high = minhash.signatures([np.unique(np.concatenate([shared, left])), np.unique(np.concatenate([shared, right]))])
    agree = np.concatenate([low[0] == low[1], high[0] == high[1]]).mean()
    assert abs(agree - 0.6) < 0.15


def test_short_texts_are_one_shingle():
    sets = minhash.shingle_sets(pa.array(["a b", "A  B", "a b c", "", None]))
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0] and sets[0] == sets[1] and sets[0] != sets[2]


def test_one_doc_id_in_several_groups(spark):
    """A row that duplicates nothing stays, whatever its doc_id; null ids go only where a doc_id is."""
    first, other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in ("a", "b", "c"))
    near = first.replace("a39", "z")
    rows = [(1, first), (1, first), (1, near), (1, other), (1, None), (1, ""), (1, ""), (None, other), (None, third), (None, third), (2, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], "first" if r["text"] in (first, near) else r["text"]) for r in minhash.without_near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "first"), (1, other), (1, None), (1, ""), (None, third), (None, third)], key=str)
