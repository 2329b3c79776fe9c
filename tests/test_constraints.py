import pytest

from weft.functions.constraints import constraint_labels, is_domain_search, parse_searches

COLORS = "red blue yellow green black white pink orange purple brown grey navy maroon".split()

EXPECTED = [
    ("blue slim fit jeans under 2000", dict(category="jeans", color="Blue", fit="Slim Fit", max_price=2000.0)),
    ("black casual t-shirts below 1500", dict(category="t-shirts", color="Black", max_price=1500.0, style="casual", intent="casual wear")),
    ("women's cotton dresses for summer", dict(gender="Women", material="Cotton", category="dresses", season="Summer")),
    ("men's dress shirts", dict(category="shirts", gender="Men")),
    ("formal dress shirt for men", dict(category="shirts")),
    ("yellow formal dress for men", dict(gender="Men", color="Yellow", style="formal", category=None, intent="formal wear")),
    ("dress for men", dict(gender="Men", category=None, intent="broad clothing")),
    ("show me a dress for men", dict(category=None, intent="broad clothing")),
    ("men's dress", dict(gender="Men", category=None, intent="broad clothing")),
    ("casual dress for men", dict(category=None, intent="casual wear")),
    ("party dress for men", dict(category=None, intent="party wear")),
    *[(f"suggest me a {c} formal dress for men under 3000",
       dict(gender="Men", category=None, style="formal", max_price=3000.0, color=c.title())) for c in COLORS],
    ("suggest me a gray formal dress for men under 3000", dict(color="Grey")),
    ("yellow formal shirt for men", dict(category="shirts")),
    ("women's dresses", dict(category="dresses")),
    ("women's dress", dict(category="dresses")),
    ("women's cotton dress", dict(category="dresses")),
    ("can you recommend something blue for a man?", dict(gender="Men", color="Blue", intent="broad clothing")),
    ("recommend something stylish for a party", dict(style="party", intent="party wear")),
    ("something affordable for women", dict(gender="Women", intent="budget clothing")),
    ("dress", dict(category="dresses", style=None)),
    ("dress shirt", dict(category="shirts", style=None)),
    ("formal dress", dict(category=None, style="formal")),
    ("formal dress shirt", dict(category="shirts", style="formal")),
    ("party dress", dict(category="dresses", style="party")),
    ("formal wear", dict(category=None, style="formal")),
    ("summer dress", dict(category="dresses", style="summer")),
    ("office trousers", dict(intent="office wear", style="office")),
    ("festive kurta", dict(intent="occasion wear", category="ethnic wear")),
    ("men's oversized hoodies under 2500", dict(gender="Men", fit="Oversized", category="hoodies", max_price=2500.0)),
    ("jackets above 3000", dict(category="jackets", min_price=3000.0, max_price=None)),
    ("jeans under ₹2000", dict(min_price=None, max_price=2000.0)),
    ("jeans below rs. 2000", dict(min_price=None, max_price=2000.0)),
    ("jeans below 2,000", dict(max_price=2000.0)),
    ("jeans under 1999.99", dict(max_price=1999.99)),
    ("jeans from 1000", dict(min_price=1000.0, max_price=None)),
    ("jeans between 1000 and 2,000", dict(min_price=1000.0, max_price=2000.0)),
    ("jeans between 3000 and 1000", dict(min_price=3000.0, max_price=1000.0)),
    ("dresses under INR 3000", dict(max_price=3000.0)),
    ("shirts up to 2500", dict(max_price=2500.0)),
    ("2500 or less", dict(max_price=2500.0)),
    # a bare currency sign counts as an upper bound, words have no left edge
    ("above ₹3000", dict(min_price=3000.0, max_price=3000.0)),
    ("trousers 2000", dict(max_price=2000.0, min_price=None)),
    ("pullover 2000", dict(min_price=2000.0, max_price=None)),
    ("under 1,00,000", dict(max_price=1.0)),
    ("under 2,000.50", dict(max_price=2000.0)),
    ("3000 to 5000", dict(min_price=None, max_price=None)),
    # equal lengths go to the earlier word; a blank splits 't shirt'
    ("blue denim shirt", dict(category="jeans")),
    ("t shirt", dict(category="shirts")),
    ("maxi dress for men", dict(category="dresses")),
    ("women and men shoes", dict(gender="Women")),
    ("all-season coat", dict(season=None, category="jackets")),
    ("étop", dict(category=None)),
    ("under 2000 for a shirt 55", dict(cleaned_query="shirt")),
    ("under 2000", dict(cleaned_query="under 2000")),
    ("  Blue   JEANS ", dict(raw_query="Blue   JEANS", cleaned_query="blue jeans")),
]


def test_parse(spark):
    texts = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(EXPECTED)], "query_id int, raw_query string")
    rows = {r["query_id"]: r for r in parse_searches(texts).collect()}
    for i, (query, fields) in enumerate(EXPECTED):
        got = {name: rows[i][name] for name in fields}
        assert got == fields, query


ACCEPTED = [
    "can you recommend something blue for a man?", "something nice for a woman",
    "recommend something for a party", "something affordable for women",
    "something comfortable for men", "what should I wear to a party", "black tshirts",
    "black men's t-shirts", "women dresses", "hoodies", "sweatshirts", "JEANS UNDER 2000",
    "jeans UNDER ₹2,000", "activewear", "casual clothes", "t shirt", "beach-wear",
    "below ₹1500 please", "silk", "under 2000",
]
REJECTED = ["hello", "asdfgh", "123", "123456", "", "   ", "???", "xyz random words", None, "₹ 2000"]


def test_domain_gate(spark):
    texts = [(q, True) for q in ACCEPTED] + [(q, False) for q in REJECTED]
    df = spark.createDataFrame(texts, "raw_query string, expected boolean")
    rows = parse_searches(df).withColumn("got", is_domain_search()).collect()
    assert [r["raw_query"] for r in rows if r["got"] != r["expected"]] == []


@pytest.mark.parametrize(
    "query, labels",
    [
        ("men's blue slim cotton shirts between 500 and 1999.5",
         ["Max Price: ₹1999", "Min Price: ₹500", "Gender: Men", "Category: shirts", "Color: Blue",
          "Fit: Slim Fit", "Material: Cotton"]),
        ("shirts under 0", ["Category: shirts"]),
        ("hello", []),
    ],
)
def test_labels(spark, query, labels):
    df = parse_searches(spark.createDataFrame([(query,)], "raw_query string"))
    assert df.select(constraint_labels()).first()[0] == labels
