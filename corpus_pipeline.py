"""Corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm import byte_bpe, jaccard_join, mixing, pseudonyms, toxicity
from weft.llm.common import table
from weft.llm.queries import PSEUDONYM_KEY, RANKS, toxicity_model
from weft.session import checkpoint_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict toxic."""
    return toxicity.without_toxic(docs, toxicity_model(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates."""
    return jaccard_join.without_copies(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal values; n_chars follows the text."""
    made = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY, counts=False)
    return pseudonyms.with_length(made, "text", "n_chars").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each time that it is taken."""
    return mixing.mixed_documents(docs, chars_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_copies),
    ("pii_pseudonyms", pseudonymise),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: A classifier, connected components, keyed permutations and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/weft/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
