"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bitplanes, decontaminate, language, licences, packing, resampling, sharding, sketches, sql, tokencount, toxicity, vectorgraph, warc
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.tables import table
from tidemark.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), VOCABULARY, special=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))
    return found.withColumn("line_licences", F.concat_ws(",", "line_licences"))


def op5_content_addressed_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).drop("url")


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(table(spark, sf_dir, "documents"), count=8)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_paragraph_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.versions(table(spark, sf_dir, "documents")).withColumn("differing", F.size("differing").cast("long"))


def op9_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: an insertion, a deletion and a replacement at the end."""
    n = F.char_length("text")
    edits = F.array(
        F.struct(F.floor(n / 3).cast("int").alias("start"), F.lit(0).alias("removed"), F.lit(" edited 12,").alias("inserted")),
        F.struct(F.floor(n / 2).cast("int").alias("start"), F.lit(5).alias("removed"), F.lit("").alias("inserted")),
        F.struct((n - 5).alias("start"), F.lit(16).alias("removed"), F.substring("text", 1, 20).alias("inserted")),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    done = tokencount.edited(tokencount.trees(docs, VOCABULARY), VOCABULARY)
    return done.select("doc_id", "n_tokens", "edited_tokens", F.char_length("text").cast("long").alias("edited_chars"), "encoded_again")


def op8_toxicity_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slack=0)
    named = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", named).cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_pruned_graph_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = vectorgraph.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found


def op12_bit_plane_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.clustered(table(spark, sf_dir, "embeddings"))


def op13_radix_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_minmax_near_duplicates, op2_language_models, op3_sum_of_squares_packing, op4_licence_digests, op5_content_addressed_archive, op6_kd_shards,
    op7_paragraph_sketches, op8_toxicity_models, op9_edit_aware_counts, op10_positional_decontamination, op11_pruned_graph_near_duplicates,
    op12_bit_plane_clustering, op13_radix_importance_resampling,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
