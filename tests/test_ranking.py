import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weft.functions.scoring import KNOWN_STYLES, has_flag, shows_style, style_flags, style_place, style_text
from weft.functions.text import round_exact
from weft.operators.filters import ask_struct
from weft.operators.ranking import match_style, price_guard, rank_products

FIELDS = ("product_name", "subcategory", "description", "season", "category", "color", "fit", "material")
SCHEMA = "query_id int, position int, product_id string, rating double, distance double, " + ", ".join(
    f"{f} string" for f in FIELDS
)


def rank(spark, items, ask=None, distances=None, **options):
    ask = ask or {}
    rows = [
        (1, i, item["product_id"], item.get("rating"), (distances or {}).get(item["product_id"]),
         *[item.get(f) for f in FIELDS])
        for i, item in enumerate(items)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("category", "color", "fit", "material", "season", "style", "intent", "max_price"):
        kind = "double" if name == "max_price" else "string"
        df = df.withColumn(f"_q_{name}", F.lit(ask.get(name)).cast(kind))
    df = df.withColumn("ask", ask_struct(df.columns, "_q_"))
    ranked = rank_products(match_style(df), keep=("product_id",), **options)
    return ranked.orderBy("rank").collect()


def ids(rows):
    return [r["product_id"] for r in rows]


def test_round_exact(spark):
    values = [0.13125, 0.66665, 0.00005, 0.12345, 1.0, 0.0, 0.14125, 0.28125, 0.99995, 0.3125 / 2]
    values += [i / 20000 for i in range(1, 2000, 2)] + [0.35 * i / 80 + j / 300 for i in range(80) for j in range(16)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r[0]: r[1] for r in df.select("v", round_exact(F.col("v"), 4)).collect()}
    assert [v for v in values if got[v] != round(v, 4)] == []
    assert Fraction(0.13125) != Fraction(21, 160)


def test_score_terms(spark):
    item = dict(product_id="P1", product_name="Test Jeans", category="jeans", color="Blue",
                fit="Slim Fit", material="Denim", season="All-Season", rating=4.8)
    row = rank(spark, [item], dict(category="jeans", color="Blue", fit="Slim Fit"), {"P1": 0.2})[0]
    assert row["hybrid_score"] == round(min(1.0, 0.65 * 0.8 + 0.35 + (4.8 - 3.5) / 1.5 * 0.05), 4)
    assert row["match_percentage"] == math.floor(row["hybrid_score"] * 100)
    half = rank(spark, [item], dict(category="jeans", color="Red", season="Winter"), {"P1": 0.2})[0]
    share = (0.30 + 0.10) / (0.30 + 0.25 + 0.10)
    assert half["hybrid_score"] == round(0.65 * 0.8 + 0.35 * share + (4.8 - 3.5) / 1.5 * 0.05, 4)


def test_threshold(spark):
    items = [dict(product_id="P1", rating=4.5), dict(product_id="P2", rating=3.5)]
    rows = rank(spark, items, {}, {"P1": 0.1, "P2": 0.95}, threshold=0.5)
    assert ids(rows) == ["P1"]


FORMAL = dict(product_id="FORMAL", product_name="Formal Shirt", subcategory="Formal Dress Shirt",
              description="Suitable for office wear", rating=4.0)
CASUAL = dict(product_id="CASUAL", product_name="Casual Shirt", subcategory="Casual Button-Down",
              description="Suitable for everyday wear", rating=4.0)
PARTY = dict(product_id="PARTY", product_name="Party Evening Shirt", description="Festive party wear", rating=4.0)


def test_style_lifts_matching_text(spark):
    rows = rank(spark, [CASUAL, FORMAL], dict(style="formal"), {"CASUAL": 0.4, "FORMAL": 0.4}, threshold=0.0)
    assert ids(rows) == ["FORMAL", "CASUAL"]


def test_occasion_gate(spark):
    ask = dict(style="party", intent="party wear")
    rows = rank(spark, [PARTY, FORMAL | dict(rating=4.8)], ask, {"PARTY": 0.4, "FORMAL": 0.1}, threshold=0.0)
    assert ids(rows) == ["PARTY"]
    broad = dict(style="party", intent="broad clothing")
    assert len(rank(spark, [PARTY, FORMAL], broad, {"PARTY": 0.4, "FORMAL": 0.1}, threshold=0.0)) == 2
    # styled, but without evidence: no gate
    assert ids(rank(spark, [PARTY, FORMAL], ask, {"FORMAL": 0.1}, threshold=0.0)) == ["FORMAL", "PARTY"]


def test_occasion_fallback(spark):
    ask = dict(style="party", intent="party wear")
    item = dict(product_id="R", product_name="Nehru Jacket", rating=3.5)
    assert ids(rank(spark, [item], ask, {"R": 0.35}, threshold=0.9)) == ["R"]
    assert rank(spark, [item], ask, {"R": 1.0}, threshold=0.9) == []
    assert rank(spark, [item], dict(intent="budget clothing"), {"R": 0.35}, threshold=0.9) == []


def test_missing_evidence(spark):
    items = [dict(product_id="R", rating=4.0), dict(product_id="M", rating=5.0)]
    assert ids(rank(spark, items, {}, {"R": 0.2}, threshold=0.0, allow_unretrieved=False)) == ["R"]
    row = rank(spark, items[1:], {}, {}, threshold=0.0)[0]
    assert (row["semantic_similarity"], row["has_retrieved_evidence"]) == (0.0, False)


def test_order_and_cut(spark):
    items = [dict(product_id=f"P{i}", rating=4.0) for i in (3, 1, 2)]
    assert ids(rank(spark, items, {}, {}, threshold=0.0, top_k=2)) == ["P3", "P1"]
    assert rank(spark, items, {}, {}, threshold=0.0, top_k=0) == []


def test_style_flags_agree_with_text(spark):
    rows = [("Sun hat", "Midi", "for the beach", "Summer"), ("Tailored", "x", "None of it", "Winter"), (None, "", "", "")]
    df = spark.createDataFrame(rows, "product_name string, subcategory string, description string, season string")
    both = df.crossJoin(spark.createDataFrame([(s,) for s in KNOWN_STYLES], "style string"))
    differing = both.filter(
        has_flag(style_flags(), style_place(F.col("style"))) != shows_style(style_text(), F.col("style"))
    )
    assert differing.count() == 0


@pytest.mark.parametrize("price, low, high, kept", [(100.0, None, 99.0, 0), (100.0, 100.0, 100.0, 1), (100.0, 101.0, None, 0)])
def test_price_guard(spark, price, low, high, kept):
    df = spark.createDataFrame([(price, low, high)], "price_inr double, lo double, hi double")
    ask = F.struct(F.col("lo").alias("min_price"), F.col("hi").alias("max_price"))
    assert price_guard(df.withColumn("ask", ask)).count() == kept
