import random

import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import odd_rows
from tidemark.llm import queries, tokencount
from tidemark.llm.packing import encoder

VOCABULARY = queries.VOCABULARY


def tokens(text):
    return len(encoder(VOCABULARY).encode_ordinary(text))


def applied(text, start, removed, inserted):
    start = min(max(start, 0), len(text))
    return text[:start] + inserted + text[start + max(removed, 0) :]


PIECES = st.text(alphabet=" \n\tab'stré1%　Z", max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=8).map("".join), st.lists(st.tuples(st.integers(0, 500), st.integers(0, 40), PIECES), max_size=5))
def test_edits_keep_counts_exact(text, edits):
    counts = tokencount.counter(VOCABULARY)
    tree = tokencount.built(text, counts)
    assert (tree.tokens, tree.chars) == (tokens(text), len(text))
    for start, removed, inserted in edits:
        expected = applied(text, start, removed, inserted)
        text, _ = tokencount.edit(text, tree, start, removed, inserted, counts)
        assert text == expected and (tree.tokens, tree.chars) == (tokens(text), len(text))
        again = tokencount.Tree.load(tree.dump())
        assert (again.sums == tree.sums).all()


def test_only_the_touched_region_is_encoded_again():
    pick = random.Random(1)
    text = " ".join(pick.choice(["alpha", "beta", "it's", "42", "x%y"]) for _ in range(50_000))
    counts = tokencount.counter(VOCABULARY)
    tree = tokencount.built(text, counts)
    for _ in range(50):
        text, again = tokencount.edit(text, tree, pick.randrange(len(text)), 3, "new", counts)
        assert again < 400
    assert tree.tokens == tokens(text)


def test_query_on_given_documents(spark, texts):
    from tests.llm.conftest import SF

    for r in queries.op9_edit_aware_counts(spark, SF).collect():
        text = texts[r["doc_id"]]
        n = len(text)
        assert r["n_tokens"] == tokens(text)
        for e in ((n // 3, 0, " edited 12,"), (n // 2, 5, ""), (n - 5, 16, text[:20])):
            text = applied(text, *e)
        assert (r["edited_tokens"], r["edited_chars"]) == (tokens(text), len(text))


def test_odd_rows(spark, odd, nothing):
    edits = "array(struct(2 AS start, 1 AS removed, 'in' AS inserted), NULL, struct(CAST(NULL AS INT) AS start, CAST(NULL AS INT) AS removed, CAST(NULL AS STRING) AS inserted))"
    got = tokencount.edited(tokencount.trees(odd.selectExpr("*", f"{edits} AS edits"), VOCABULARY), VOCABULARY).collect()
    expected = [(d, tokens(t or ""), tokens(applied(t or "", 2, 1, "in"))) for d, t, _ in odd_rows()]
    assert sorted([(r["doc_id"], r["n_tokens"], r["edited_tokens"]) for r in got], key=repr) == sorted(expected, key=repr)
    assert tokencount.trees(nothing, VOCABULARY).count() == 0
    missing = tokencount.edited(tokencount.trees(odd.selectExpr("*", "CAST(NULL AS array<struct<start:int,removed:int,inserted:string>>) AS edits"), VOCABULARY), VOCABULARY)
    assert all(r["n_tokens"] == r["edited_tokens"] and r["encoded_again"] == 0 for r in missing.collect())
