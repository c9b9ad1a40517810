import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm import sketches


def brute(docs):
    """Rows in order of descending doc_id, nulls last, equal ids by text; each beside the next one."""
    rows = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        a, b, c = (set(sketches.digests(t).tolist()) for t in (text, other, following))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((doc, len(text), hashlib.sha256(other.encode()).hexdigest(), round(near(a, b), 9), round(near(a, c), 9), len(a ^ b)))
    return sorted(out, key=repr)


def result(frame):
    return sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), len(set(r["differing"]))) for r in frame.collect()], key=repr)


def test_equals_brute_force(documents, texts):
    assert result(sketches.versions(documents.repartition(3))) == brute(texts.items())


def test_odd_rows(spark, odd, nothing):
    docs = [(d, t) for d, t, _ in odd_rows()]
    assert result(sketches.versions(odd)) == brute(docs)
    assert sketches.versions(nothing).count() == 0
    for few in ([(5, "one row alone")], [(None, "no id")], [(1, None), (2, "")]):
        assert result(sketches.versions(spark.createDataFrame(few, "doc_id long, text string"))) == brute(few)


def test_equal_texts_have_equal_fingerprints(odd):
    by_text = defaultdict(set)
    prints = {r["fingerprint"] for r in sketches.versions(odd.where("doc_id IN (1, 9, 10, 12, 13)")).collect()}
    assert len(prints) == 5
    for r in sketches.versions(odd).join(odd.select("doc_id", "text"), "doc_id").where("doc_id IN (1, 9, 10)").collect():
        by_text[r["text"]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in by_text.values())


@pytest.mark.parametrize("changed", [0, 1, 5, 40, 700])
def test_peeling_recovers_the_difference(changed):
    pick = np.random.default_rng(changed)
    shared, left, right = (pick.integers(1, 2**63, n).astype(np.uint64) for n in (50, changed, changed // 2))
    a, b = np.concatenate([shared, left]), np.concatenate([right, shared])
    one, two = sketches.differences([a, shared], [b, b], np.array([8, 8]))[0]
    assert set(one.tolist()) == set(left.tolist()) and set(two.tolist()) == set(right.tolist())


def test_a_cell_that_looks_like_one_digest_ends(spark):
    """A key alone in one of its three cells would be taken out and put back for ever."""
    held = sketches.Sketches.of([np.array([5, 9], np.uint64), np.array([7], np.uint64)], 16)
    key = np.array([12345], np.uint64)
    cell = held.places(key, 1)[0]
    held.count[0, cell], held.digest[0, cell], held.check[0, cell] = 1, key[0], sketches.Sketches.checks(key)[0]
    rows, keys, _, whole = held.peeled()
    assert whole.tolist() == [False, True] and keys[rows == 1].tolist() == [7]


def test_likeness_comes_from_the_returned_fingerprints(spark, documents):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for frame in (sketches.versions(documents), sketches.versions(rows)):
        prints = {r["doc_id"]: r for r in frame.collect()}
        order = sorted(prints, reverse=True)
        for i, doc in enumerate(order):
            r, following = prints[doc], prints[order[(i + 1) % len(order)]]
            assert sketches.compared(r["fingerprint"], r["edited_fingerprint"]) == r["near_edited"]
            assert sketches.compared(r["fingerprint"], following["fingerprint"]) == r["near_next"]
            assert r["near_edited"] > 0 or r["n_chars"] < 3


def test_a_fingerprint_gives_back_its_digests(texts):
    keys = sketches.all_digests(pa.array(list(texts.values())))
    for k, text, third in zip(keys, *sketches.fingerprints(keys)):
        _, found, sides, whole = sketches.Sketches.read(text).peeled()
        assert whole.all() and (sides == 1).all() and sorted(found.tolist()) == sorted(k.tolist()) and third >= sketches.cells_for(len(k))


def test_paragraphs_depend_on_their_own_place_only(texts):
    """An edit in the middle leaves all but the paragraphs around it."""
    for text in [t for t in texts.values() if len(t) > 2000][:30] + ["汉字。漢字！" * 300, "x" * 3000 + " end", "one line of ordinary words " * 80]:
        half = len(text) // 2
        a, b = (set(sketches.digests(t).tolist()) for t in (text, text[:half] + "!! changed !!" + text[half:]))
        assert len(a & b) >= len(a) - 40 and len(a & b) > 0
    # Alone or among others, a text has the same digests.
    some = list(texts.values())[:50]
    assert all(np.array_equal(sketches.digests(t), k) for t, k in zip(some, sketches.all_digests(pa.array(some))))


def test_ids_that_are_texts(spark):
    docs = [(f"d{i:03}", f"text number {i}. It has a second sentence, with {i} words") for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id string, text string").repartition(7)
    rows = sorted(docs, reverse=True)
    got = {r["doc_id"]: r["edited_sha256"] for r in sketches.versions(frame).collect()}
    assert got == {d: hashlib.sha256(sketches.edited(t, rows[(i + 1) % 200][1]).encode()).hexdigest() for i, (d, t) in enumerate(rows)}
