"""Requests that share a text share its hits."""

from pyspark.sql import functions as F

from conftest import catalog_of, product
from weft.operators.filters import explicit_filters
from weft.plans import search as plans
from weft.plans.ingest import build_store

COLORS = ("Blue", "Black", "Red")
FORM = "query_id int, raw_query string, gender string, category string, color string, fit string, material string, low_price int, high_price int, top_k string"


def form(query_id, text, color="All", low=0, top_k="4"):
    return (query_id, text, "All", "All", color, "All", "All", low, 6000, top_k)


def rows(result):
    hits = F.array_join(F.col("matched_chunks.chunk_id"), ",").alias("hits")
    columns = ["product_id", "rank", "hybrid_score", "distance", hits]
    found = result.items_by_search().select("query_id", *columns).collect()
    counts = ["retrieved_chunks_count", "retrieved_chunk_ids", "represented_product_ids", "unique_products_before_filtering"]
    told = result.diagnostics_by_search().select("query_id", *counts).collect()
    return sorted(map(tuple, found)), sorted(map(repr, told))


def test_a_text_is_searched_once_and_pairs_stay_in_small_tasks(spark, tmp_path, monkeypatch):
    products = [
        product(f"PRD{1000 + i}", i, color=COLORS[i % 3], price_inr=500.0 + 50 * (i % 40), product_name=f"{COLORS[i % 3]} jeans {i}")
        for i in range(90)
    ]
    store = build_store(catalog_of(spark, products), str(tmp_path / "store"))
    asked = [form(i, ("blue jeans", "jeans")[i % 2], ("All", "Red")[i % 3 % 2], 100 * (i % 7), ("4", "10", "7")[i % 3]) for i in range(40)]
    asked += [form(40, "blue jeans", top_k="0"), form(41, None), form(42, "sarees")]
    searched = []
    nearest = plans.nearest_chunks

    def counted(queries, *args, **options):
        searched.append(queries.count())
        return nearest(queries, *args, **options)

    monkeypatch.setattr(plans, "nearest_chunks", counted)
    monkeypatch.setattr(plans, "REQUESTS_PER_TASK", 3)
    together = plans.search(explicit_filters(spark.createDataFrame(asked, FORM)), store)
    assert searched == [3]  # two texts and the missing one; nothing is a saree
    found, told = rows(together)
    for i in (0, 1, 2, 5, 40, 41, 42):
        alone = plans.search(explicit_filters(spark.createDataFrame([asked[i]], FORM)), store)
        mine, mine_told = rows(alone)
        assert [r for r in found if r[0] == i] == mine
        assert mine_told[0] in told
