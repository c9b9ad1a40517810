import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.conftest import SF, odd_rows
from tidemark.llm import resampling


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(docs, target, least=20, percent=10):
    """n_features, weight, score and rank by doc_id and text, by the contract."""
    crc = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = (Counter(crc(w) for x in texts for w in words(x)) for texts in ([x for _, x in docs], target))
    sums = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sums[0] + 10_000) / ((s[b] + 1) * (sums[1] + 10_000))))
    out = []
    for doc_id, text in docs:
        found = [gain(crc(w)) for w in words(text)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        score = None if doc_id is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
    entered = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(entered[: percent * len(entered) // 100]):
        r[4] = place + 1
    return sorted(map(tuple, out), key=repr)


def test_equals_the_contract(spark, documents, texts):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resampling.resampled(documents.repartition(5), benchmark)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(list(texts.items()), [r["text"] for r in benchmark.collect()])


def test_odd_rows_and_ties(spark, odd, nothing):
    target = ["river stone", None, "Ember ember"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(map(tuple, resampling.resampled(odd, frame, percent=50, least_words=2).collect()), key=repr)
    want = expected([(d, t) for d, t, _ in odd_rows()], target, least=2, percent=50)
    # Rows that share doc_id and score may change places.
    assert [r[:4] for r in got] == [r[:4] for r in want] and sorted(r[4] or 0 for r in got) == sorted(r[4] or 0 for r in want)
    assert resampling.resampled(nothing, frame).count() == 0
    assert resampling.resampled(odd, frame.limit(0)).count() == len(odd_rows())


def test_radix_sort(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 64)
    pick = random.Random(8)
    rows = [(pick.choice([0, 7, -3, pick.randrange(-(10**6), 10**6)]), pick.randrange(10**10)) for _ in range(1500)] + [(5, 5)] * 3
    for data in (rows, [(4, 4)] * 5, [(-(1 << 63), 1), ((1 << 63) - 1, 2), (0, 3), (-(1 << 63), 0)]):
        frame = spark.createDataFrame(data, "a long, b long").repartition(7)
        out = resampling.radix_sorted(frame, [("a", True), ("b", False)]).orderBy("place").collect()
        assert [r["place"] for r in out] == list(range(len(data)))
        assert [(r["a"], r["b"]) for r in out] == sorted(data, key=lambda r: (-r[0], r[1]))
    assert resampling.radix_sorted(spark.createDataFrame([], "a long, b long"), [("a", True)]).count() == 0


def test_crc32_of_long_and_short_words():
    text = "a bc " + "x" * 5000 + " d" + "é" * 100 + " Zz"
    buckets, first = resampling.buckets_of(pa.array([text, None, ""]))
    assert buckets.tolist() == [zlib.crc32(w.encode()) % 10_000 for w in words(text)] and np.diff(first).tolist() == [5, 0, 0]
