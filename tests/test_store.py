"""Versions of a store: readers see the old one or the new one, whole."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import catalog_of, product
from weft.operators.reduction import components_from
from weft.operators.terms import weigh
from weft.plans.ingest import attribute_store, build_store, given_store, product_chunks
from weft.plans.search import given_requests, search
from weft.sources.store import Store, StoreWriter, load_store, manifests, write_store


def catalog(spark, names=("a", "b", "c", "d")):
    return catalog_of(spark, [
        product(f"PRD{k}", k, product_name=f"Blue jeans {n}", category="jeans", color="Blue") for k, n in enumerate(names)
    ])


def names_of(store):
    return sorted(r[0] for r in store.catalog.select("product_name").collect())


def test_a_write_that_dies_leaves_the_old_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    write_store(attribute_store(catalog(spark)), folder)
    before = load_store(spark, folder)
    writer = StoreWriter(spark, folder)
    writer.write(catalog(spark, ("x",)), "catalog")
    broken = catalog(spark).withColumn("category", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        write_store(Store(broken, before.variants, before.chunks), folder)
    assert manifests(spark, folder) == [1]
    assert names_of(load_store(spark, folder)) == names_of(before)
    assert writer.publish() == 2
    with pytest.raises(FileNotFoundError):
        load_store(spark, str(tmp_path / "nothing"))


def test_a_store_is_rewritten_from_itself_and_old_versions_go(spark, tmp_path):
    folder = str(tmp_path / "store")
    write_store(attribute_store(catalog(spark)), folder)
    old = load_store(spark, folder)
    fewer = old.catalog.filter("product_id <> 'PRD0'")
    write_store(Store(fewer, old.variants, old.chunks), folder)
    assert len(names_of(load_store(spark, folder))) == 3
    assert len(names_of(old)) == 4 and names_of(load_store(spark, folder, number=1)) == names_of(old)
    write_store(load_store(spark, folder), folder)
    assert manifests(spark, folder) == [2, 3] and len(os.listdir(f"{folder}/versions")) == 2
    with pytest.raises(ValueError, match="no version 1"):
        load_store(spark, folder, number=1)


def test_given_vectors(spark, tmp_path):
    """Hits follow the vectors, not the words; unusable vectors find nothing; lengths must agree."""
    products = catalog(spark)
    chunks = product_chunks(products).select("chunk_id", "product_id", "chunk_index")
    place = F.substring("product_id", 4, 9).cast("int")
    vector = F.when(place == 3, F.lit(None)).otherwise(F.array(F.cos(place.cast("double")), F.sin(place.cast("double"))))
    given = chunks.select("chunk_id", vector.alias("vector"), F.lit("x").alias("text"))
    store = given_store(products, given.union(given), str(tmp_path / "given"))
    assert store.has_vectors and store.given and store.components is None
    assert store.chunks.filter("product_id = 'PRD3'").isEmpty()
    log = spark.createDataFrame([(1, " blue jeans "), (2, "blue jeans for men"), (3, "jeans")], "query_id long, raw_query string")
    asked = [("blue jeans", [0.0, 2.0]), ("jeans", [float("nan"), 1.0]), ("unasked", [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(asked, "raw_query string, vector array<double>")
    result = search(log, store, query_vectors=vectors)
    rows = result.items_by_search().orderBy("query_id", "distance").collect()
    assert {r["query_id"] for r in rows} == {1} and rows[0]["product_id"] == "PRD2"
    requests = log.select(F.col("query_id").alias("request_id"), F.trim("raw_query").alias("raw_query"))
    with pytest.raises(ValueError, match="3 numbers, chunks of 2"):
        given_requests(requests.withColumn("raw_query", F.lit("unasked")), store, vectors)
    with pytest.raises(ValueError, match="give those"):
        given_requests(requests, store, None)


def test_reduced_vectors_are_not_stored(spark, tmp_path):
    """A dense store holds term rows; its vectors are those of the components, also in a copy of the store."""
    import numpy as np

    names = [f"{a} {b} {c}" for a in ("slim", "wide") for b in ("denim", "silk", "wool") for c in ("blue", "red", "green")]
    products = catalog(spark, names + names[:2]).withColumn("product_id", F.when(F.col("ordinal") < 18, F.col("product_id")).otherwise("PRD3"))
    folder = str(tmp_path / "dense")
    store = build_store(products, folder, dense=True, length=6)
    assert store.dense and "vector" not in store.texts.columns and "ids" not in store.chunks.columns
    assert store.chunks.columns == [*product_chunks(products).columns, "vector"]
    components = components_from(store.components)
    rows = {r["chunk_id"]: r for r in weigh(product_chunks(products), "chunk_id", "text", store.vocabulary).collect()}
    found = store.chunks.collect()
    assert sorted(r["chunk_id"] for r in found) == sorted(r[0] for r in product_chunks(products).select("chunk_id").collect())
    for r in found:
        own = rows[r["chunk_id"]]
        want = np.asarray(own["weights"]) @ components[own["ids"]]
        assert np.allclose(r["vector"], want / np.linalg.norm(want), atol=1e-5)
    log = spark.createDataFrame([(1, "blue jeans"), (2, "blue silk jeans for men")], "query_id long, raw_query string")
    write_store(store, str(tmp_path / "copy"))
    answers = [search(log, s).items_by_search().select("query_id", "rank", "product_id", "hybrid_score") for s in (store, load_store(spark, str(tmp_path / "copy")))]
    assert sorted(answers[0].collect()) == sorted(answers[1].collect()) != []
