"""Registered queries of the operators; each takes (spark, sf_dir) and uses whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.llm import (
    byte_bpe, collocations, hamming_search, jaccard_join, katz, language, mixing, pseudonyms, sharding, suffix_dedup,
    toxicity, turn_repair, vector_dedup,
)
from weft.llm.common import held_out, table
from weft.llm.oracles import ORACLES  # noqa: F401

NEAREST = 10
SHARDS = 24
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
PSEUDONYM_KEY = "a key of the caller"


def op1_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 20, against all rows."""
    index = hamming_search.sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming_search.search_codes(index, index.filter("id % 20 = 0"), NEAREST)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on rows whose crc32(doc_id as text) mod 5 is not 0."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 5))
    return toxicity.train(table(spark, sf_dir, "documents"), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")


def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(table(spark, sf_dir, "documents")).taken()
    return made.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(documents, PSEUDONYM_KEY)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = documents.filter(~held_out(F.col("doc_id"), 5))
    model = language.fit(learned, public_tokenizers.path(PIECES))
    predicted = language.predict(documents.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(documents, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "repeat.n_bytes", "repeat.n_removed", F.size("repeat.starts").cast("long").alias("n_spans"),
        F.sha2("repeat.kept", 256).alias("kept_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best(collocations.collocations(table(spark, sf_dir, "documents")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = turn_repair.damage(table(spark, sf_dir, "conversations"))
    return turn_repair.digest(turn_repair.repair(damaged, present_col="present"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hamming_search, op2_toxicity, op3_katz_scores, op4_jaccard_join, op5_vector_dedup, op6_mixing, op7_sharding,
        op8_pseudonyms, op9_language, op10_byte_bpe, op11_suffix_dedup, op12_collocations, op13_turn_repair,
    )
}
