import zlib
from collections import defaultdict

import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm import sharding


def checked(frame, docs, count):
    """Each row once, sizes and slots right; the shards' bytes and the shards of each text."""
    rows = frame.collect()
    key = lambda d, t: (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted((key(d, t) for d, t in docs), key=repr)
    slots, sizes, of_text = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        assert 0 <= r["shard"] < count
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        of_text[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, of_text


@pytest.mark.parametrize("count", [8, 5])
def test_near_equal_bytes_and_whole_groups(documents, texts, count):
    sizes, of_text = checked(sharding.shards(documents.repartition(4), count=count), list(texts.items()), count)
    mean = sum(sizes.values()) / count
    largest = max(len(t.encode()) for t in texts.values())
    assert len(sizes) == count and all(abs(s - mean) <= 0.05 * mean + largest for s in sizes.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_target_bytes(documents, texts):
    total = sum(len(t.encode()) + 1 for t in texts.values())
    sizes, _ = checked(sharding.shards(documents, target_bytes=total // 6 + 1), list(texts.items()), 6)
    assert len(sizes) == 6


def test_a_hot_text_is_parted(spark):
    docs = [(i, "the same text " * 10) for i in range(900)] + [(1000 + i, f"text {i} " * 12) for i in range(600)]
    sizes, _ = checked(sharding.shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), count=8), docs, 8)
    mean = sum(sizes.values()) / 8
    assert all(abs(s - mean) <= 0.03 * mean for s in sizes.values())


def test_odd_rows(spark, odd, nothing):
    checked(sharding.shards(odd, count=8), [(d, t) for d, t, _ in odd_rows()], 8)
    assert sharding.shards(nothing, count=8).count() == 0
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    checked(sharding.shards(one, count=8), [(1, "x")], 8)
