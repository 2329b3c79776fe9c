"""Catalog to searchable store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weft import vocab
from weft.functions.vectors import common_length, unit, usable
from weft.operators.chunking import chunk_documents, product_documents
from weft.operators.reduction import components_table, fit_reduction
from weft.operators.terms import dense_terms, fit_vocabulary, weigh, weigh_rows
from weft.operators.variants import product_variants
from weft.session import cut_lineage
from weft.sources.catalog import first_rows
from weft.sources.store import CHUNK_SCHEMA, Store, StoreWriter, load_store


# A task splits the texts of so many products.
PRODUCTS_PER_SPLIT = 16384


def product_chunks(
    catalog: DataFrame, limit: int | None = None, size: int = vocab.CHUNK_SIZE,
    overlap: int = vocab.CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of the first ``limit`` products, or of all.

    A catalog is a small file that makes many chunks: its rows are spread first, and what is
    written of the chunks lies in as many files.
    """
    products = first_rows(catalog, limit)
    tasks = max(1, -(-products.count() // PRODUCTS_PER_SPLIT))
    products = products.repartition(tasks, "product_id", "ordinal")
    return chunk_documents(product_documents(products), size, overlap)


def attribute_store(catalog: DataFrame) -> Store:
    """Store without vectors; the folded catalog is written once."""
    empty = catalog.sparkSession.createDataFrame([], CHUNK_SCHEMA)
    return Store(catalog, cut_lineage(product_variants(catalog), "variants"), empty)


def build_store(
    catalog: DataFrame, folder: str, limit: int | None = None, size: int = vocab.CHUNK_SIZE,
    overlap: int = vocab.CHUNK_OVERLAP, dense: bool = False,
    max_terms: int = vocab.MAX_TERMS, length: int = vocab.VECTOR_LENGTH,
    stop_words: tuple[str, ...] = vocab.TERM_STOP_WORDS,
) -> Store:
    """Write every table of a new version, each from the one written before it, and publish it.

    ``catalog`` may be the one of the store that is replaced. ``dense`` reduces the term
    rows to ``length`` numbers, which are made as chunks are read; a corpus too small for that keeps its raw rows, cut or
    padded.
    """
    spark = catalog.sparkSession
    writer = StoreWriter(spark, folder)
    saved = writer.write
    catalog = saved(first_rows(catalog, limit), "catalog")
    saved(product_variants(catalog).sortWithinPartitions("category"), "variants")
    chunks = saved(product_chunks(catalog, None, size, overlap), "chunk_texts")
    vocabulary = saved(
        fit_vocabulary(chunks, "chunk_id", "text", max_terms, stop_words), "vocabulary"
    )
    if dense and vocabulary.count() > 1 and chunks.select("chunk_id").distinct().limit(2).count() > 1:
        rows = saved(weigh_rows(chunks, "chunk_id", "text", vocabulary, stop_words), "chunks")
        # Chunks without an id are not stored, but their texts count as those of one more.
        nameless = cut_lineage(weigh(chunks.filter("chunk_id is null"), "chunk_id", "text", vocabulary, stop_words))
        fitted = rows.filter("first").select("ids", "weights").unionByName(nameless.select("ids", "weights"))
        components = fit_reduction(fitted, vocabulary.count(), fitted.count(), length, written=True)
        saved(components_table(spark, components), "components")
    else:
        rows = weigh(chunks, "chunk_id", "text", vocabulary, stop_words)
        if dense:
            saved(components_table(spark, None), "components")
            rows = dense_terms(rows, length).select("chunk_id", "vector")
        saved(chunks.join(rows, "chunk_id"), "chunks")
    writer.publish()
    return load_store(spark, folder)


def given_store(
    catalog: DataFrame, vectors: DataFrame, folder: str, size: int = vocab.CHUNK_SIZE,
    overlap: int = vocab.CHUNK_OVERLAP,
) -> Store:
    """Write and publish a store whose chunk vectors the caller gives.

    ``vectors`` has ``chunk_id`` and ``vector`` (any numeric array), one row per chunk of
    ``product_chunks(catalog)``; they are scaled to length one. Chunks without a vector and
    those whose vector is null, empty or holds null or non-finite numbers cannot be found;
    of several rows of one chunk the least vector counts. Lengths must agree.
    """
    spark = catalog.sparkSession
    writer = StoreWriter(spark, folder)
    catalog = writer.write(catalog, "catalog")
    writer.write(product_variants(catalog).sortWithinPartitions("category"), "variants")
    chunks = writer.write(product_chunks(catalog, None, size, overlap), "chunk_texts")
    rows = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector"))).groupBy("chunk_id").agg(F.min("vector").alias("vector"))
    made = writer.write(
        chunks.join(rows.select("chunk_id", unit(F.col("vector")).alias("vector")), "chunk_id"), "chunks"
    )
    common_length(made, "vector")
    writer.publish()
    return load_store(spark, folder)


def ingest_statistics(catalog: DataFrame, chunks: DataFrame, vector: str | None = None) -> DataFrame:
    """One row: products, chunks, chunks per product, vector length."""
    products = catalog.agg(F.count(F.lit(1)).alias("product_count"))
    length = F.max(F.size(vector)) if vector else F.lit(0)
    counted = chunks.agg(
        F.count(F.lit(1)).alias("chunk_count"), length.alias("embedding_dim")
    )
    return counted.select(
        products.scalar().alias("product_count"), "chunk_count",
        F.coalesce(
            F.try_divide(F.col("chunk_count"), products.scalar()), F.lit(0.0)
        ).alias("avg_chunks_per_product"),
        "embedding_dim", F.col("chunk_count").alias("indexed_count"),
    )
