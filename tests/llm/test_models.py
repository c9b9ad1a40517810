"""Language identification and toxicity: held-out accuracy, learning rules, odd rows."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import SF, odd_rows
from tidemark.llm import arrays, charmodel, language, minhash, toxicity

SF_LARGER = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_character_model_is_interpolated_kneser_ney(spark):
    """Against a plain implementation over strings."""
    pick, order = random.Random(3), 3
    texts = [("".join(pick.choice("abc ") for _ in range(60)), i % 2) for i in range(8)]
    frame = spark.createDataFrame(texts, "text string, cls int")
    model = charmodel.fitted(charmodel.gram_counts(frame, order), 2, order)

    def cleaned(text):
        out = " " * (order - 1)
        for c in text:
            if c != " " or out[-1] != " " :
                out += c
        return out

    counts = [[Counter() for _ in range(order + 1)] for _ in range(2)]
    for text, cls in texts:
        padded = cleaned(text)
        for i in range(order - 1, len(padded)):
            counts[cls][order][padded[i - order + 1 : i + 1]] += 1
    for c in range(2):
        for k in range(order - 1, 0, -1):
            for gram in counts[c][k + 1]:
                counts[c][k][gram[1:]] += 1
    letters = len(set(counts[0][1]) | set(counts[1][1])) + 1

    def probability(c, gram):
        k = len(gram)
        if not k:
            return 1 / letters
        table = counts[c][k]
        values = list(table.values())
        discount = min(max(values.count(1) / max(values.count(1) + 2 * values.count(2), 1), 0.1), 0.95)
        follow = [n for g, n in table.items() if g[:-1] == gram[:-1]]
        lower = probability(c, gram[1:])
        return (max(table[gram] - discount, 0) + discount * len(follow) * lower) / sum(follow) if follow else lower

    sample = "abca cab bbca"
    found = charmodel.symbols(pa.array([sample]), order)
    padded = cleaned(sample)
    expected = [[math.log(probability(c, padded[i - order + 1 : i + 1])) for c in range(2)] for i in range(order - 1, len(padded))]
    assert np.allclose(model.log_probabilities(found), expected, atol=1e-4)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_gibberish_is_rejected_and_other_columns_survive(spark):
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    strange = [(10**6 + i, "".join(chr(0x4E00 + (i * 131 + j * 977) % 9000) for j in range(300)), None) for i in range(5)]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(strange, "doc_id long, text string, lang string")).selectExpr("*", "1 AS letters", "2 AS in_0")
    kept = language.accepted(both)
    assert kept.columns == both.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not ids & {s[0] for s in strange} and len(ids) >= 0.99 * docs.count()


def test_language_of_odd_rows(odd, nothing):
    got = language.identify(odd).collect()
    assert len(got) == len(odd_rows())
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for empty in (4, 5, 6, 11):
        assert [(r["lang_pred"], r["score"], r["rejected"]) for r in by_id[empty]] == [("und", 0.0, True)]
    assert all(r["held_out"] for r in by_id[None]) and by_id[9][0]["lang_pred"] in ("en", "de", "fr")
    assert language.identify(nothing).count() == 0 and language.accepted(nothing).count() == 0


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    caught = sum(r["predicted"] and r["toxic"] for r in held)
    assert caught >= 0.75 * sum(r["toxic"] for r in held) and caught >= 0.9 * sum(r["predicted"] for r in held)


@pytest.mark.parametrize("marks", [[], [(1, 1), (3, 0), (None, 1), (2, None)], [(i, i % 2) for i in range(14)] + [(1, 1)]])
def test_toxicity_of_odd_rows(spark, odd, nothing, marks):
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.scored(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.scored(nothing, labels).count() == 0
    assert toxicity.clean(odd, labels).columns == odd.columns


def test_rare_words_speak_for_neither_class(spark):
    rows = [(f"common words {'filth' if i % 4 == 0 else 'fine'} only{i}", int(i % 4 == 0)) for i in range(400)]
    counted = spark.createDataFrame(rows, "text string, cls int").mapInArrow(toxicity._count, "word long, ordinary long, toxic long, texts long")
    model = toxicity.word_model(counted.groupBy("word").sum("ordinary", "toxic", "texts").toDF("word", "ordinary", "toxic", "texts"))
    hashes, _ = toxicity._words(pa.array(["filth fine common only4 only5 unseen"]))
    filth, fine, common, rare_toxic, rare_ordinary, unseen = model.ratios(hashes)
    assert filth > 3 and fine < -1 and abs(common) < 0.5
    assert abs(unseen) < abs(filth) / 2 and rare_toxic < filth and abs(rare_ordinary) < 2


def test_isotonic_pools():
    assert charmodel.isotonic([0.0, 0.5, 0.3, 1.0], [1, 1, 1, 1]) == [0.0, 0.4, 0.4, 1.0]


def test_every_labelled_training_text_counts(spark):
    """Also those of the fifth by xxhash64 that once only calibrated."""
    rows = spark.range(6000).selectExpr("id AS doc_id", "pmod(xxhash64(id), 5) AS fifth").collect()
    texts = [(r["doc_id"], f"plain words here {'vile' if r['fifth'] == 0 else 'mild'}", int(r["fifth"] == 0 or r["doc_id"] % 7 == 0)) for r in rows]
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    vile, mild = model.broadcast.value.ratios(toxicity._words(pa.array(["vile mild"]))[0])
    assert vile > 3 and mild < 0


def test_own_counts_are_taken_off(spark):
    """As if the text had not been counted; discounts and the words' number stay."""
    rows = [(f"common words {'filth filth' if i % 4 == 0 else 'fine'} only{i}", int(i % 4 == 0)) for i in range(200)]
    names = ("ordinary", "toxic", "texts")

    def model(of):
        counted = spark.createDataFrame(of, "text string, cls int").mapInArrow(toxicity._count, "word long, ordinary long, toxic long, texts long")
        return toxicity.word_model(counted.groupBy("word").agg(*[toxicity.F.sum(c).alias(c) for c in names]))

    whole, without = model(rows), model(rows[1:])
    without.discounts, without.spare, without.vocabulary = whole.discounts, whole.spare, whole.vocabulary
    text = pa.array([rows[0][0]])
    assert np.allclose(toxicity.compared(whole, text, np.array([rows[0][1]])), toxicity.compared(without, text))


def test_no_word_takes_counts_of_another(spark):
    """Millions of counted words: unseen ones stay unseen, and rare ones keep their own counts."""
    counted = spark.range(6_000_000).selectExpr("xxhash64(id) AS word", "20L AS ordinary", "id % 2 AS toxic", "20 + id % 2 AS texts")
    model = toxicity.word_model(counted)
    probe = np.array([r[0] for r in spark.range(6_000_000, 6_000_500).selectExpr("xxhash64(id)").collect()]).view(np.uint64)
    assert len(model.keys) == 6_000_000 and np.ptp(model.ratios(probe)) == 0
    rare = np.array([r[0] for r in spark.range(500).selectExpr("xxhash64(id)").collect()]).view(np.uint64)
    assert len(set(model.ratios(rare).round(6))) == 2


def test_toxicity_spread_over_moderate_words(spark):
    """No single word tells the classes apart, their number does."""
    pick = random.Random(5)
    moderate, plain = [f"m{chr(97 + i)}" for i in range(20)], [f"p{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(3000):
        toxic = i % 3 == 0
        rows.append((i, " ".join(pick.choice(moderate if pick.random() < (0.7 if toxic else 0.3) else plain) for _ in range(40)), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).collect()}
    held = [(got[i]["predicted"], toxic) for i, _, toxic in rows if got[i]["held_out"]]
    caught = sum(p and t for p, t in held)
    assert caught >= 0.9 * sum(t for _, t in held) and caught >= 0.9 * sum(p for p, _ in held)


def test_spans_stay_inside_texts():
    class Plain:
        def ratios(self, hashes, own=None):
            return np.arange(len(hashes), dtype=float)

    got = toxicity.compared(Plain(), pa.array(["a b c d e f g", None, "a b", "x", "", "a b c d e"]))
    assert got.tolist() == [[3, 4, 6], [0, 0, 0], [7.5, 7.5, 8], [9, 9, 9], [0, 0, 0], [12, 12, 14]]


class _Held:
    def __init__(self, value):
        self.value = value


def _working_memory():
    """Per task function of the pipeline's first stages: MB at most in hand over one batch of 2.4 MB of text."""
    pick = random.Random(3)
    vocabulary = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(pick.choices(vocabulary, k=400)) for _ in range(1000)]
    numbers = pa.array(range(len(texts)))
    batch = pa.record_batch([numbers, numbers, pa.array(texts), pa.array([i % 2 for i in range(len(texts))], pa.int32())], ["doc_id", "same", "text", "cls"])
    level = lambda: charmodel.Level(np.zeros(1, np.uint32), np.zeros((1, 2), np.float32), np.zeros(1, np.uint32), np.zeros((1, 2), np.float32))
    characters = charmodel.CharModel([level() for _ in range(4)], 2, -3.0)
    characters.levels[-1].index(characters.bits)
    charmodel.folded()
    judge = toxicity.Judge([0.0, 0.0, 0.0, 1.0], [-1e9], [0.0])
    known = toxicity.WordModel(np.arange(3, dtype=np.uint64), np.ones((3, 3), np.int32), [3.0, 3.0], [[0.0, 0.5, 0.5, 0.5]] * 2, [0.5, 0.5], 6.0, 3.0)
    for name, task in (
        ("gram counts", charmodel._Counter(4)), ("languages", language._Measure(_Held(characters), ["doc_id"])), ("word counts", toxicity._count),
        ("toxicity", toxicity._Compare(_Held(known), ["doc_id"], False, judge)), ("sketches", minhash._sketch),
    ):
        arrays._POWERS.__init__()
        tracemalloc.start()
        for _ in task(iter([batch])):
            pass
        yield name, tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()


def test_a_worker_holds_little_beside_its_batch():
    """A batch may hold tens of MB of text; what a worker computes over it at once must not follow."""
    most = dict(_working_memory())
    assert all(mb < 40 for mb in most.values()), most
