"""Registered queries: each applies one operator to its whole table and returns its contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequill.llm import (
    disclosure, exact_dedup, hard_negatives, language_id, lattice_lm, metric_join, mixing, packing, quality, sentence_spans, simhash,
    spelling_variants, token_store,
)
from casequill.llm.common import table


#: the vocabulary that the contracts name
VOCABULARY = "byte_bpe_50k.json"
#: the vocabulary whose pieces and scores make up the lattice
SCORED_VOCABULARY = "piece_bpe_32k.model"


def vocabulary_path() -> str:
    """Where the public vocabulary lies; it is installed on every machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def scored_vocabulary_path() -> str:
    """Where the public vocabulary with scores of pieces lies."""
    import public_tokenizers

    return public_tokenizers.path(SCORED_VOCABULARY)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("page_id"), "host", "declared", "text_lang", "lang", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_store.write_store(table(spark, sf_dir, "documents"), vocabulary_path())
    return token_store.read_store(folder, manifest).withColumnRenamed("key", "doc_id")


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    number = {k: (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in disclosure.PATTERNS}
    return found.select(
        F.col("id").alias("doc_id"),
        *number.values(),
        F.sha2(disclosure.as_string(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        disclosure.as_string(F.concat("spans", "words")).alias("spans"),
    )


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sentence_spans.cut_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), mark="removed")
    return cut.select(
        "doc_id",
        F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join("removed", ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def op6_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metric_join.linked_vectors(table(spark, sf_dir, "embeddings"))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept.alias("kept"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(table(spark, sf_dir, "documents"))
    return drawn.select(
        F.col("id").alias("doc_id"), "source", "n_tokens", F.round("weight", 6).alias("weight"), "epoch", "block", "place"
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_copies(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path()).withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", predicted.alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"), change=spelling_variants.one_letter_less(97))


def op13_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    found = lattice_lm.score_documents(table(spark, sf_dir, "documents"), scored_vocabulary_path(), held_out)
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_token_store": op3_token_store,
    "op4_disclosure": op4_disclosure,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_metric_join": op6_metric_join,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lattice_lm": op13_lattice_lm,
}
