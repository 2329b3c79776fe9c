"""Tasks hold bounded shares of larger tables, and pairs meet by every equal term."""

from pyspark.sql import functions as F

from checks import queries
from conftest import catalog_of, product
from weft.functions.predicates import passes
from weft.operators import filters, joins
from weft.operators.filters import ask_struct, candidate_counts, fold_ask, fold_catalog, match_products
from weft.operators.joins import join_by_category, measure
from weft.operators.variants import product_variants

ASKS = "request_id int, category string, brand string"


def folded_asks(spark, rows):
    asks = spark.createDataFrame(rows, ASKS)
    return fold_ask(asks.select("request_id", ask_struct(asks.columns).alias("ask")))


def test_brand_is_a_key(spark):
    """Pairs of unlike brands are not even made; values that run together stay apart."""
    rows = [
        product("A", 0, category="jeans", brand="b1"), product("B", 1, category="jeans", brand="b2"),
        product("C", 2, category="shirts", brand="b1"), product("D", 3, category=None, brand="b1"),
        product("E", 4, category="jeans", brand=None), product("F", 5, category="*", brand="jeans"),
    ]
    products = fold_catalog(catalog_of(spark, rows), "ordinal", "product_id")
    asks = folded_asks(spark, [(1, None, "b1"), (2, "jeans", "b1"), (3, "jeans", None), (4, None, None), (5, "*", None)])
    expected = {1: "ACD", 2: "A", 3: "ABE", 4: "ABCDEF", 5: "F"}
    size = measure(asks)
    for condition in (F.lit(True), passes(lambda t: F.col(f"used.{t}"))):
        for many in (size, type(size)(size.rows, 1 << 40)):
            made = join_by_category(asks, products, condition, "used", many, "ordinal", salts=3).collect()
            found = {}
            for r in sorted(made, key=lambda r: r["product_id"]):
                found[r["request_id"]] = found.get(r["request_id"], "") + r["product_id"]
            assert found == expected


def test_products_of_several_profiles_spread(spark, monkeypatch):
    rows = [product(f"P{i % 50}", i, color=("Blue", "Red")[i // 50]) for i in range(100)]
    variants = product_variants(catalog_of(spark, rows))
    asks = folded_asks(spark, [(1, "jeans", None), (2, None, None), (3, "jeans", "brand")]).select(
        F.col("request_id").alias("ask_id"), "used"
    )
    monkeypatch.setattr(filters, "PRODUCTS_PER_TASK", 5)
    tasks = []
    plain = filters.join_by_category

    def seen(*args):
        tasks.append(args[-1])
        return plain(*args)

    monkeypatch.setattr(filters, "join_by_category", seen)
    counts = candidate_counts(asks, variants, measure(asks)).collect()
    assert {(r["ask_id"], r["strict"], r["core"]) for r in counts} == {(1, 50, 50), (2, 50, 50), (3, 50, 50)}
    assert tasks == [20]


def test_order_violations_use_as_many_tasks_as_orders(spark, tmp_path, monkeypatch):
    """Orders of repeated keys, without a key and without a search."""
    part = [(i, f"part {i}", i % 7, f"Brand#{i}") for i in range(20)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_size long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    events = spark.range(64).selectExpr("id as event_id", "id as user_id", "timestamp'2020-01-01' as ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    lines = [(i % 70, i % 20) for i in range(200)] + [(4, 4), (4, 4), (None, 1), (1, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(queries, "ORDER_ROWS_PER_TASK", 10)
    found = queries.order_violations(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 21
    rows = {r["query_id"]: r for r in found.collect()}
    assert len(rows) == 64 and sum(r["items"] for r in rows.values()) == 2 + sum(i % 70 < 64 for i in range(200))
    assert not rows[4]["unique_products"] and rows[61]["unique_products"]


def test_keys_of_many_pairs_are_cut_on_both_sides(spark, monkeypatch):
    """A hot key is copied a few times on either side, others not at all, and the pairs stay the same."""
    monkeypatch.setattr(joins, "PAIRS_PER_CELL", 40)
    products = [product(f"P{i}", i, brand="hot" if i % 3 else f"b{i}", price_inr=float(i)) for i in range(60)]
    catalog = catalog_of(spark, products + [product("N", 60, brand=None)])
    rows = [(i, None, "hot" if i % 2 else f"b{i}") for i in range(40)] + [(40, None, None)]
    asks = spark.createDataFrame(rows, ASKS)
    asks = asks.select("request_id", ask_struct(asks.columns).alias("ask"))
    size = measure(asks)
    pairs = match_products(asks, catalog, size=type(size)(size.rows, 1 << 40)).select("request_id", "product_id").collect()
    brands = {p["product_id"]: p["brand"] for p in products} | {"N": None}
    assert sorted(map(tuple, pairs)) == sorted((i, p) for i, _, b in rows for p in brands if b in (None, brands[p]))

    keys = lambda values: spark.createDataFrame([(v,) for v in values], "_key string")
    many = joins.cut_keys(keys(["a"] * 400 + ["b"] * 3 + ["c"]), keys(["a"] * 100 + ["b"] * 3 + ["d"]), 8).collect()
    assert [(r["_key"], r["_asks"], r["_products"]) for r in many] == [("a", 8, 2)]
    one = joins.cut_keys(keys(["a"] * 2), keys(["a"] * 1000), 8).collect()
    assert [(r["_asks"], r["_products"]) for r in one] == [(1, 16)]
