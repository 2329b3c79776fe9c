import pytest
from pyspark.sql import functions as F

from conftest import catalog_of, product
from weft.operators.filters import (
    ask_struct, explicit_filters, filter_products, match_products, sanitize_top_k,
)
from weft.operators.joins import Measure, measure
from weft.operators.variants import product_variants, split_variants
from weft.plans.explain import explain, explanation_requests
from weft.plans.ingest import attribute_store, build_store, ingest_statistics
from weft.plans.search import search
from weft.sources.store import load_store, peek, stored_rows, write_report, write_store
from weft import vocab

CATEGORIES = ("jeans", "shirts", "dresses", "jackets")
COLORS = ("Blue", "Black", "Red")
GENDERS = ("Men", "Women", "Unisex")


def rows_of(count=120, **hot):
    return [
        product(
            f"PRD{1000 + i}", i, category=CATEGORIES[i % 4], color=COLORS[i % 3], gender=GENDERS[i % 5 % 3],
            product_name=f"{COLORS[i % 3]} {CATEGORIES[i % 4]} number{i}", price_inr=500.0 + 50 * (i % 40),
            rating=3.5 + (i % 16) / 10, fit=vocab.FITS[i % 5], material=vocab.MATERIALS[i % 8],
            season=vocab.SEASONS[i % 5], subcategory=("Party Evening", "Formal Office", "Plain")[i % 7 % 3],
            description=f"A {COLORS[i % 3].lower()} piece in {vocab.MATERIALS[i % 8].lower()}", **hot,
        )
        for i in range(count)
    ]


QUERIES = [
    "blue jeans under 2000", "blue jeans under 2000", "  blue jeans under 2000 ", "women's dresses",
    "jackets under 100", "party wear", "formal shirts above 1500", "something under 900",
    "orange silk jeans", "iphone", "red slim fit shirts for men",
]


@pytest.fixture(scope="module")
def catalog(spark):
    return catalog_of(spark, rows_of()).cache()


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, raw_query string")


@pytest.fixture(scope="module")
def store(spark, catalog, tmp_path_factory):
    return build_store(catalog, str(tmp_path_factory.mktemp("store")))


@pytest.fixture(scope="module")
def result(log, store):
    return search(log, store)


def by_query(result, *columns):
    rows = result.items_by_search().orderBy("query_id", "rank").select("query_id", *columns).collect()
    got = {}
    for r in rows:
        got.setdefault(r[0], []).append(tuple(r)[1:] if len(columns) > 1 else r[1])
    return got


def test_items_keep_the_constraints(result):
    items = by_query(result, "category", "price_inr", "gender", "color", "has_retrieved_evidence")
    assert all(c == "jeans" and p <= 2000 and col == "Blue" and e for c, p, _, col, e in items[0])
    assert items[0] == items[1] == items[2] and 0 < len(items[0]) <= 4
    assert all(c == "dresses" and g in ("Women", "Unisex") for c, _, g, _, _ in items[3])
    assert 4 not in items
    assert all(p <= 900 for _, p, *_ in items[7])
    # no orange or silk jeans: category only
    assert all(c == "jeans" for c, *_ in items[8])


def test_diagnostics(result, store):
    rows = {r["query_id"]: r for r in result.diagnostics_by_search().collect()}
    assert set(rows) == set(range(len(QUERIES)))
    assert rows[4]["message"] == vocab.MESSAGE_NO_CANDIDATE and rows[4]["retrieved_chunks_count"] == 0
    assert rows[0]["message"] == "Success" and rows[0]["retrieved_chunks_count"] == 100
    assert len(rows[0]["retrieved_chunk_ids"]) == 15 and rows[0]["stored_chunks"] == 360
    assert rows[8]["relaxed"] and not rows[0]["relaxed"]
    assert result.requests.count() == len({q.strip() for q in QUERIES})
    assert stored_rows(store) == 360 and peek(store).count() == 3


def test_matched_chunks_belong_to_their_product(result):
    for row in result.items.collect():
        chunks = row["matched_chunks"]
        assert chunks and all(c["chunk_id"].startswith(row["product_id"] + "_chunk_") for c in chunks)
        assert [c["distance"] for c in chunks] == sorted(c["distance"] for c in chunks)
        assert chunks[0]["distance"] == row["distance"] and chunks[0]["text"]


def test_top_k(spark, store):
    log = spark.createDataFrame(
        [(i, "jeans", k) for i, k in enumerate(["4", "1", "0", "-1", "x", "10", None, "2.5"])],
        "query_id int, raw_query string, top_k string",
    )
    items = by_query(search(log, store), "product_id")
    assert {q: len(v) for q, v in items.items()} == {0: 4, 1: 1, 4: 4, 5: 10, 6: 4, 7: 4}


@pytest.mark.parametrize("value, expected", [(3.7, 3), (float("nan"), 4), (-2.0, 0), (None, 4)])
def test_numeric_top_k(spark, value, expected):
    df = spark.createDataFrame([(value,)], "k double")
    assert df.select(sanitize_top_k(F.col("k"))).first()[0] == expected


def test_form_filters(spark):
    df = spark.createDataFrame(
        [(1, "All", "jeans", "All", "All", "All", 0, 6000), (2, "Men", "All", "Red", "All", "All", 500, 3000)],
        "query_id int, gender string, category string, color string, fit string, material string, low_price int, high_price int",
    )
    first, second = explicit_filters(df).orderBy("query_id").collect()
    assert (first["ui_gender"], first["ui_category"], first["ui_min_price"], first["ui_max_price"]) == (None, "jeans", None, None)
    assert (second["ui_color"], second["ui_min_price"], second["ui_max_price"]) == ("Red", 500.0, 3000.0)


def test_explicit_filters_override_and_tighten(spark, store):
    log = spark.createDataFrame(
        [(1, "blue jeans under 2000", "Red", 1000.0), (2, "blue jeans under 2000", "", None)],
        "query_id int, raw_query string, ui_color string, ui_max_price double",
    )
    items = by_query(search(log, store), "color", "price_inr")
    assert all(c == "Red" and p <= 1000 for c, p in items[1])
    assert all(c == "Blue" and p <= 2000 for c, p in items[2])


def test_attribute_search_has_no_similarity(log, catalog):
    result = search(log, attribute_store(catalog))
    rows = result.items_by_search().collect()
    assert {r["semantic_similarity"] for r in rows} == {0.0}
    assert not any(r["has_retrieved_evidence"] or r["matched_chunks"] for r in rows)
    assert result.diagnostics.filter("vector_search_active").count() == 0


def test_store_without_chunks_searches_by_attributes(spark, log, catalog, store, tmp_path):
    write_store(attribute_store(catalog), str(tmp_path / "plain"))
    plain = load_store(spark, str(tmp_path / "plain"))
    assert not plain.has_vectors and stored_rows(plain) == 0
    assert by_query(search(log, plain), "product_id") == by_query(search(log, attribute_store(catalog)), "product_id")


def test_store_over_an_older_one(spark, log, catalog, store, tmp_path):
    from weft.sources.store import write_table

    folder = str(tmp_path / "replaced")
    write_store(store, folder)
    write_store(attribute_store(catalog), folder)
    plain = load_store(spark, folder)
    assert not plain.has_vectors
    assert by_query(search(log, plain), "product_id") == by_query(search(log, attribute_store(catalog)), "product_id")
    write_table(spark.range(1), folder, "components")
    assert build_store(catalog, folder).components is None


def test_fallback_chunks(spark, log, catalog, result, store, tmp_path):
    from weft.sources.store import write_table

    write_table(catalog, str(tmp_path / "new"), "catalog")
    write_table(product_variants(catalog), str(tmp_path / "new"), "variants")
    write_store(store, str(tmp_path / "old"))
    loaded = load_store(spark, str(tmp_path / "new"), str(tmp_path / "old"))
    assert loaded.name == "old" and loaded.has_vectors
    assert by_query(search(log, loaded), "product_id") == by_query(result, "product_id")


def test_reduced_store(spark, log, catalog, tmp_path):
    made = build_store(catalog, str(tmp_path / "dense"), dense=True, length=32)
    assert made.dense and made.chunks.select(F.size("vector")).distinct().collect() == [(32,)]
    items = by_query(search(log, made), "category", "color")
    assert all(i == ("jeans", "Blue") for i in items[0])


def test_tiny_dense_store(spark, log, tmp_path):
    one = catalog_of(spark, [product(category="jeans", color="Blue")])
    made = build_store(one, str(tmp_path / "tiny"), dense=True, max_terms=1)
    assert len(by_query(search(log, made), "product_id")[0]) == 1


def test_filter_record(catalog):
    got = filter_products(catalog, {"max_price": 900, "gender": "Women", "category": " JEANS ", "color": "", "fit": None})
    rows = got.collect()
    assert rows and all(r["price_inr"] <= 900 and r["category"] == "jeans" and r["gender"] in ("Women", "Unisex") for r in rows)
    assert filter_products(catalog, {"max_price": 0}).count() == 0
    assert filter_products(catalog, {"subcategory": "office", "season": "winter"}).count() > 0
    assert filter_products(catalog, {"subcategory": "."}).count() == 0


def asks_of(spark, records):
    columns = ("category", "gender", "color", "brand", "max_price")
    df = spark.createDataFrame([(i, *[r.get(c) for c in columns]) for i, r in enumerate(records)],
                               "request_id int, category string, gender string, color string, brand string, max_price double")
    return df.select("request_id", ask_struct(df.columns).alias("ask"))


RECORDS = [
    {"category": "Jeans"}, {}, {"gender": "men", "max_price": 700.0}, {"brand": "BRAND", "color": " red "},
    {"category": "none"}, {"color": "  "},
]


@pytest.mark.parametrize("small", [True, False])
def test_batch_matching_equals_single_records(spark, small):
    # two thirds of the products in one category
    rows = rows_of(90) + [product(f"HOT{i}", 1000 + i, category="jeans") for i in range(180)]
    catalog = catalog_of(spark, rows)
    asks = asks_of(spark, RECORDS)
    size = measure(asks) if small else Measure(10**9, 10**12)
    got = match_products(asks, catalog, salts=5, size=size).select("request_id", "ordinal").collect()
    expected = [
        (i, r["ordinal"]) for i, record in enumerate(RECORDS) for r in filter_products(catalog, record).collect()
    ]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_repeated_product_keeps_first_place_and_last_values(spark):
    rows = [
        product("A", 0, color="Blue", rating=3.5), product("B", 1, color="Blue", rating=5.0),
        product("A", 2, color="Blue", rating=5.0), product("A", 3, color="Red", rating=4.0),
    ]
    catalog = catalog_of(spark, rows)
    plain, changing = split_variants(product_variants(catalog))
    assert plain.count() == 1 and changing.count() == 2
    log = spark.createDataFrame([(1, "blue jeans"), (2, "red jeans"), (3, "jeans")], "query_id int, raw_query string")
    result = search(log, attribute_store(catalog))
    items = by_query(result, "product_id", "ordinal")
    assert items == {1: [("A", 2), ("B", 1)], 2: [("A", 3)], 3: [("B", 1), ("A", 3)]}
    counts = {r["query_id"]: r["candidates_count"] for r in result.diagnostics_by_search().collect()}
    assert counts == {1: 2, 2: 1, 3: 2}


def test_statistics(spark, catalog, store):
    row = ingest_statistics(catalog, store.chunks).first()
    assert (row["product_count"], row["chunk_count"], row["avg_chunks_per_product"]) == (120, 360, 3.0)
    none = ingest_statistics(catalog.limit(0), store.chunks.limit(0)).first()
    assert none["avg_chunks_per_product"] == 0.0


def test_explanations(spark, result, tmp_path):
    rows = {r["request_id"]: r for r in explain(result.requests, result.items).collect()}
    assert rows[4]["source"] == "System" and rows[4]["text"] == vocab.TEXT_NO_ITEMS
    text = rows[0]["text"]
    assert rows[0]["source"] == vocab.SOURCE_TEMPLATE and text.startswith("**1. Brand Blue jeans number")
    assert "closely matches your request for blue jeans under ₹2000" in text and "**2. " in text

    asked = explanation_requests(result.requests, result.items)
    keys = {r["request_id"]: r for r in asked.collect()}
    context = keys[0]["context"]
    assert context.startswith("RETRIEVED PRODUCT 1\nproduct_id=PRD") and "\nretrieved_chunk_evidence:\nProduct: " in context
    good = f"{keys[0]['allowed_ids'][0].lower()} fits this request best of all."
    responses = spark.createDataFrame(
        [(keys[0]["request_key"], "service", f"  {good} "),
         (keys[3]["request_key"], "service", "PRD9999 is the best match for this request."),
         (keys[4]["request_key"], "service", "Nothing was found, but this is a long text.")],
        "request_key string, source string, text string",
    )
    rows = {r["request_id"]: r for r in explain(result.requests, result.items, responses).collect()}
    assert (rows[0]["source"], rows[0]["text"]) == ("service", good)
    assert rows[3]["source"] == vocab.SOURCE_TEMPLATE and rows[4]["source"] == "System"
    write_report(explain(result.requests, result.items), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == result.requests.count()


def test_items_without_chunks_are_not_explained(spark, log, catalog):
    result = search(log, attribute_store(catalog))
    rows = explain(result.requests, result.items).collect()
    assert {r["text"] for r in rows} == {vocab.TEXT_NO_ITEMS, vocab.TEXT_NO_EVIDENCE}
