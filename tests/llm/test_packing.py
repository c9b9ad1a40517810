import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import odd_rows
from tidemark.llm import packing, queries
from tidemark.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def reference():
    out = Tokenizer.from_file(VOCABULARY)
    out.encode_special_tokens = True
    return out


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.SEPARATOR]


def rebuilt(pieces, window):
    """The documents' ids and the fill of each sequence, after checking places."""
    documents, fills = {}, {}
    for p in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert p["offset"] == fills.get(p["sequence_id"], 0) and p["length"] > 0
        fills[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(f <= window for f in fills.values())
    for p in sorted(pieces, key=lambda r: r["start"]):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        documents.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], ids))
    return documents, fills


@pytest.mark.parametrize("window", [64, 2048])
def test_every_id_is_in_one_piece(documents, texts, reference, window):
    frame = documents.repartition(3)
    found, fills = rebuilt(packing.packed(frame, VOCABULARY, window).collect(), window)
    assert len(found) == len(texts)
    for (doc, total), parts in found.items():
        assert [s for s, _ in parts] == list(np.cumsum([0, *[len(i) for _, i in parts]])[:-1])
        assert [x for _, ids in parts for x in ids] == ids_of(reference, texts[doc]) and total == sum(len(i) for _, i in parts)
    assert sum(f < window for f in fills.values()) <= 3  # one of each task


def test_odd_rows(odd, nothing, reference):
    got = packing.packed(odd, VOCABULARY).collect()
    assert sum(r["length"] for r in got) == sum(len(ids_of(reference, t)) for _, t, _ in odd_rows())
    assert len({(r["doc_id"], r["doc_tokens"]) for r in got if r["doc_id"] == 4}) == 1
    assert packing.packed(nothing, VOCABULARY).count() == 0


def test_sum_of_squares_choice():
    levels = packing.Levels(10, 0)
    levels.at[4], levels.at[6] = [101, 102], [103]
    levels.count[4], levels.count[6] = 2, 1
    levels.content = {101: [], 102: [], 103: []}

    def squares(counts):
        return sum(c * c for c in counts[1:10])

    for size in (4, 3, 6, 1, 9, 2, 5, 5):
        before = levels.count.copy()
        options = []
        for fill in range(10 - size + 1):
            if fill == 0 or before[fill]:
                after = before.copy()
                after[fill] -= fill > 0
                if fill + size < 10:
                    after[fill + size] += 1
                options.append(squares(after))
        levels.place(size)
        assert squares(levels.count) == min(options)


def test_query_gives_special_tokens_their_id(spark, tmp_path):
    """The ids of the tokenizers library with nothing but add_special_tokens=False."""
    plain, literal = Tokenizer.from_file(VOCABULARY), "<|endoftext|>"
    texts = [f"a {literal} b", literal, f"{literal}{literal}\n x", f"end {literal}", "<|endoftext|", f"caf\u00e9{literal}'s  12", "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found, _ = rebuilt(packing.packed(frame, VOCABULARY, special=True).collect(), packing.WINDOW)
    for (doc, total), parts in found.items():
        ids = [x for _, part in parts for x in part]
        assert ids == ids_of(plain, texts[doc]) and total == len(ids)
    assert len(found) == len(texts)
    got = queries.op3_sum_of_squares_packing(spark, str(tmp_path)).collect()
    expected = {i: zlib.crc32(np.array(ids_of(plain, t), "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids_crc32"] for r in got if r["length"] == r["doc_tokens"]}.items() <= expected.items()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {i: len(ids_of(plain, t)) for i, t in enumerate(texts)}
