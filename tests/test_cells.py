"""Counts and short lists by cell and price node against pairs of searches and products."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import catalog_of, product
from weft.functions.predicates import ALL_TERMS
from weft.operators import cells, filters
from weft.operators.filters import ask_struct, candidate_counts, fold_ask, paired_counts
from weft.operators.joins import measure
from weft.operators.variants import product_variants
from weft.plans.ingest import attribute_store
from weft.plans.search import search


def odd_catalog(spark, count, seed, repeats=0):
    r = random.Random(seed)
    rows = [
        product(
            f"P{i if i < count - repeats else r.randrange(count - repeats)}", i,
            category=r.choice(["jeans", "Shirts", None]), gender=r.choice(["Men", "Women", "UNISEX", None]),
            color=r.choice(["Blue", "Red", ""]), fit=r.choice(["Slim Fit", "Oversized"]), material=r.choice(["Denim", "Silk"]),
            season=r.choice(["Summer", "Winter", "All-Season"]), brand=r.choice(["a", "b"]),
            subcategory=r.choice(["Party Evening", "Formal Office", "Party Office", None]),
            price_inr=r.choice([None, float("nan"), 0.0, 100.0, 250.0, 250.5, 999.0, 1000.0, 5000.0]),
            rating=r.choice([None, 3.5, 4.0, 4.00001, 4.000011, 4.2, 5.0]),
        )
        for i in range(count)
    ]
    return catalog_of(spark, rows)


def odd_asks(spark, count, seed):
    r = random.Random(seed)
    values = {
        "category": ["jeans", "shirts", "none"], "gender": [" men ", "Women", "unisex"], "color": ["blue", "green"],
        "fit": ["slim fit", "Skinny"], "material": ["silk"], "season": ["summer", "all-season"], "brand": ["a"],
        "subcategory": ["party", "office", "x"], "min_price": [0.0, 250.0, 1000.0, 2000.0], "max_price": [100.0, 250.0, 999.5, 5000.0],
    }
    rows = [(i, *[r.choice(values[t]) if r.random() < 0.35 else None for t in ALL_TERMS]) for i in range(count)]
    kinds = ", ".join(f"{t} {filters.term_type(t)}" for t in ALL_TERMS)
    frame = spark.createDataFrame(rows, f"ask_id int, {kinds}")
    return frame.select("ask_id", ask_struct(frame.columns).alias("ask"))


@pytest.mark.parametrize("repeats", [0, 40])
def test_counts_equal_pairs(spark, repeats):
    asks = fold_ask(odd_asks(spark, 150, 1)).select("ask_id", "used").cache()
    variants = product_variants(odd_catalog(spark, 160, 2, repeats))
    got = candidate_counts(asks, variants, measure(asks)).filter("core > 0 or strict > 0")
    strict = {r["ask_id"]: r["strict"] for r in got.collect()}
    relaxable = {r[0] for r in asks.filter(filters.relaxable("used")).select("ask_id").collect()}
    core = {r["ask_id"]: r["core"] for r in got.collect() if r["ask_id"] in relaxable}
    want = {r["ask_id"]: r for r in paired_counts(asks, variants, measure(asks)).collect()}
    assert strict == {k: r["strict"] for k, r in want.items() if r["strict"] or (k in relaxable and r["core"])}
    assert core == {k: r["core"] for k, r in want.items() if k in relaxable}


def test_counts_without_bounds_or_asks(spark):
    asks = fold_ask(odd_asks(spark, 1, 3)).select("ask_id", "used")
    bare = asks.withColumn("used", F.col("used").withField("min_price", F.lit(None).cast("double")).withField("max_price", F.lit(None).cast("double")))
    variants = product_variants(odd_catalog(spark, 30, 4))
    want = {tuple(r) for r in paired_counts(bare, variants, measure(bare)).select("ask_id", "strict").collect()}
    assert {tuple(r) for r in candidate_counts(bare, variants, measure(bare)).select("ask_id", "strict").collect()} == want
    none = asks.limit(0)
    assert candidate_counts(none, variants, measure(none)).count() == 0


LOG = [
    "blue jeans under 250", "blue jeans", "women's party shirts", "silk shirts above 250", "green slim fit jeans", "jeans",
    "green silk summer jeans for men", "formal office wear", "something under 1000", "skinny red jeans above 100 under 5000",
    "winter party wear for women", "oversized shirts", "maroon linen skinny fit winter jeans",
]


@pytest.mark.parametrize("repeats", [0, 60])
def test_items_equal_those_of_pairs(spark, monkeypatch, repeats):
    catalog = odd_catalog(spark, 400, 5, repeats)
    log = spark.createDataFrame([(i, q, k) for i, (q, k) in enumerate((q, k) for q in LOG for k in (1, 4, 30))], "query_id int, raw_query string, top_k int")
    columns = ["request_id", "rank", "product_id", "ordinal", "hybrid_score"]

    def items():
        result = search(log, attribute_store(catalog))
        return sorted(map(tuple, result.items.select(*columns).collect())), sorted(
            map(tuple, result.requests.select("request_id", "relaxed", "candidates").collect())
        )

    got = items()
    monkeypatch.setattr(cells, "MOST_BOUNDS", -1)
    assert got == items()
    assert any(relaxed for _, relaxed, _ in got[1]) and len(got[0]) > 100


def test_lists_stay_short(spark):
    """A node's list holds a few products however many there are, also with one salt for all."""
    frame = spark.range(5000).select(
        F.col("id").alias("ordinal"), F.col("id").alias("position"), F.concat(F.lit("P"), "id").alias("product_id"),
        *[F.lit("v").alias(t) for t in cells.TEXT_TERMS], F.lit(10.0).alias("price_inr"), F.lit(0).cast("long").alias("styles"),
        (F.col("id") % 50 / 1000).alias("boost"),
    )
    ask = spark.createDataFrame([(1, None, None, 0, 3)], "request_id int, min_price double, max_price double, style_place int, need int")
    ask = ask.select("request_id", "style_place", "need", F.struct("min_price", "max_price", F.lit(None).cast("string").alias("subcategory")).alias("used"))
    made = cells.plan_cells(ask, F.array(F.lit(0)))
    none = {t: F.lit(None).cast("string") for t in cells.TEXT_TERMS}
    nodes = cells.ask_nodes(ask, none, F.col("used.min_price"), F.col("used.max_price"), made)
    for salts in (1, 16):
        lists = cells.leading_products(frame, nodes.select(*cells.KEY, "style_place", "need").distinct(), made, salts)
        assert sorted(r["ordinal"] for r in lists.collect()) == [49, 99, 149]


def test_nodes_make_up_ranges(spark):
    facts = cells.Cells(None, 20, 17, (0,))
    pairs = [(a, b) for a in range(38) for b in range(38)]
    frame = spark.createDataFrame(pairs, "_from int, _to int").withColumn("_open", F.lit(False))
    for r in frame.select("_from", "_to", cells._range_nodes(facts).alias("n")).collect():
        pieces = [p for level, node in r["n"] for p in range(node << level, (node + 1) << level)]
        assert sorted(pieces) == list(range(r["_from"], r["_to"] + 1))
        assert len(r["n"]) <= 2 * facts.levels
