import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF, odd_rows
from tidemark.llm import decontaminate, queries

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, test in items:
            other = words(test)
            size = min(13, len(other))
            windows = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if size else set()
            for i in range(len(own) - size + 1 if size else 0):
                if tuple(own[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(item)
        out.append((doc, len(own), len(hit), sorted(i for i in found if i is not None), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def result(frame):
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in frame.collect()], key=repr)


@pytest.fixture(scope="module")
def tests_table(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def planted(texts, tests):
    """Documents that hold whole items, parts of one, twelve words only, and an item in other case and punctuation."""
    items = [(r["item_id"], r["text"]) for r in tests.collect()]
    long = max(items, key=lambda i: len(words(i[1])))[1]
    some = words(long)
    return items, [
        *texts.items(), (9001, f"before {items[0][1]} after"), (9002, " ".join(some[3:18])), (9003, " ".join(some[3:15])), (9004, ", ".join(some).upper()),
        (9005, " ".join([*some[:13], *some[:13]])), (9006, f"{items[1][1]} {items[2][1]}"),
    ]


def test_equals_brute_force(spark, tests_table, texts):
    items, docs = planted(texts, tests_table)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert result(decontaminate.contamination(frame, tests_table)) == brute(docs, items)


def test_blocks_give_the_same(spark, tests_table, texts, monkeypatch):
    items, docs = planted(texts, tests_table)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert len(decontaminate._blocks(tests_table)) > 2
    assert result(decontaminate.contamination(frame, tests_table)) == brute(docs, items)


def test_odd_rows(spark, odd, nothing):
    items = [(1, "two words"), (1, "nobody knows"), (None, "it's"), (3, None), (4, ""), (5, "!!"), (6, odd_rows()[0][1]), (6, odd_rows()[0][1])]
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("segment", F.lit(1))
    docs = [(d, t) for d, t, _ in odd_rows()]
    assert result(decontaminate.contamination(odd, tests)) == brute(docs, items)
    kept = decontaminate.uncontaminated(odd, tests)
    assert kept.columns == odd.columns
    clean = sorted([d for d, _, _, _, c in brute(docs, items) if not c], key=repr)
    assert sorted([r["doc_id"] for r in kept.select("doc_id").collect()], key=repr) == clean
    assert decontaminate.contamination(nothing, tests).count() == 0
    none = result(decontaminate.contamination(odd, tests.limit(0)))
    assert len(none) == len(docs) and not any(r[4] for r in none)


def test_proximity_allows_shifted_words():
    segment, _ = decontaminate.segment_of(pa.array(["a b c extra d e f", "a b c d e f", "f e d c b a", "a a a a"]))
    windows = decontaminate.Windows.of(pa.table({"item_id": [7], "text": ["a b c d e f"]}), 13)
    exact = decontaminate.find(segment, windows)[1]
    near = decontaminate.find(segment, windows, 1)[1]
    doc = lambda places: set((np.searchsorted(segment.first, places, side="right") - 1).tolist())
    assert doc(exact) == {1} and {0, 1} <= doc(near) and 2 not in doc(near)


def test_query_digests_items(spark):
    rows = queries.op10_positional_decontamination(spark, SF).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r["items_sha256"] == empty) == (r["n_items"] == 0) for r in rows)


def some_words(n, seed):
    pick = random.Random(seed)
    return " ".join(f"w{int(pick.paretovariate(0.5)) % 100_000}" for _ in range(n))


def test_index_rows_and_row_groups_are_small(spark):
    pick = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{pick.randrange(100_000)}" for _ in range(2000))) for i in range(800)], "doc_id long, text string").coalesce(1)
    index = decontaminate.positional_index(docs)
    binary = [f.name for f in index.schema if f.dataType.simpleString() == "binary"]
    sizes = [sum(r) for r in index.select(*[F.octet_length(c) for c in binary]).collect()]
    assert len(sizes) > 10 and max(sizes) < 700_000
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [f.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)]
    assert sum(groups) > 4_000_000 and max(groups) < 4_500_000 + max(sizes)


def test_stored_segments_are_the_built_ones(spark):
    texts = [some_words(3000, 1), "", None, "a", some_words(20, 2)]
    for some in (texts, [None, ""]):
        frame = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").coalesce(1)
        one = decontaminate.positional_index(frame).toArrow().combine_chunks().to_batches()[0]
        built, n_words = decontaminate.segment_of(pa.array(some, pa.string()))
        again = decontaminate.Segment.stored(one, one.column("n_words").flatten().to_numpy())
        assert n_words.tolist() == [len(words(t)) for t in some]
        assert all((getattr(built, c) == getattr(again, c)).all() and getattr(built, c).dtype == getattr(again, c).dtype for c in ("terms", "starts", "positions", "first"))


def test_pieces_give_the_same(monkeypatch):
    segment, _ = decontaminate.segment_of(pa.array([some_words(4000, 1), "a a a a b a", some_words(4000, 1)]))
    items = [some_words(4000, 1)[500:3000], "a", "a b", "b a", "nowhere a", some_words(40, 9), "a a a a b a"]
    windows = decontaminate.Windows.of(pa.table({"item_id": range(len(items)), "text": items}), 13)
    for slack in (0, 2):
        whole = sorted(zip(*map(np.ndarray.tolist, decontaminate.find(segment, windows, slack))))
        with monkeypatch.context() as m:
            m.setattr(decontaminate, "RANKED", 5)
            m.setattr(decontaminate, "CANDIDATES", 3)
            assert sorted(zip(*map(np.ndarray.tolist, decontaminate.find(segment, windows, slack)))) == whole and len(whole) > 100


def test_frequent_words_are_bounded_in_memory():
    segment, _ = decontaminate.segment_of(pa.array(["a " * 50_000]))
    items = ["a"] * 200 + ["a a b"] * 200
    windows = decontaminate.Windows.of(pa.table({"item_id": range(400), "text": items}), 13)
    tracemalloc.start()
    assert sum(len(place) for _, place in decontaminate.matches(segment, windows)) == 200 * 50_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
