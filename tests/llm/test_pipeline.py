import numpy as np

import corpus_pipeline
from tests.llm.conftest import SF, odd_rows
from tidemark.llm import language, minhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_keep_columns_and_pack_all_that_is_left(spark, documents, tmp_path):
    docs, ids = documents, set(range(10**6))
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, docs, SF)
        assert kept.columns == COLUMNS
        kept.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids
        ids = left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == ids
    for p in pieces:
        assert len(np.frombuffer(p["ids"], "<u4")) == p["length"]


def test_stages_follow_their_operators(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda frame: sorted(r["doc_id"] for r in frame.select("doc_id").collect())
    assert ids(stage("toxicity")(spark, documents, SF)) == ids(toxicity.scored(documents, labels).where("predicted = 0"))
    assert ids(stage("language")(spark, documents, SF)) == ids(language.identify(documents).where("NOT rejected"))
    assert ids(stage("near_duplicates")(spark, documents, SF)) == ids(minhash.near_duplicates(documents).where("kept"))


def test_odd_and_empty_tables(spark, nothing):
    odd = spark.createDataFrame([(d, t, l, "s", 1) for d, t, l in odd_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, nothing):
        for _, function in corpus_pipeline.STAGES:
            function(spark, docs, SF).count()
