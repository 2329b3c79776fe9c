import pytest
from pyspark.sql import Observation, Row

from conftest import catalog_of, product
from weft import vocab
from weft.operators import audit
from weft.sources.catalog import (
    clean_catalog, first_rows, load_catalog, product_by_id, products_by_id, write_csv,
)


def dirty(spark, **columns):
    base = {c: "x" for c in vocab.REQUIRED_COLUMNS} | {"price_inr": "10", "rating": "4.5"}
    return spark.createDataFrame([Row(**(base | columns))])


@pytest.mark.parametrize(
    "price, kept",
    [("", None), ("abc", None), ("1,999", None), ("NaN", None), ("-5", None), ("0", None),
     ("1999d", None), ("0x1p3", None), (" 1499 ", 1499.0), ("1e3", 1000.0), (".5", 0.5),
     ("inf", float("inf")), (None, None)],
)
def test_price(spark, price, kept):
    df = dirty(spark).drop("price_inr")
    from pyspark.sql import functions as F

    rows = clean_catalog(df.withColumn("price_inr", F.lit(price).cast("string"))).collect()
    assert [r["price_inr"] for r in rows] == ([] if kept is None else [kept])


def test_texts_and_rating(spark):
    row = clean_catalog(dirty(spark, rating="good", brand="NA", color="  Blue\t", fit="na")).first()
    assert (row["rating"], row["brand"], row["color"], row["fit"]) == (4.0, "", "Blue", "na")


def test_dropped_rows_are_counted(spark):
    seen = Observation()
    rows = clean_catalog(dirty(spark).union(dirty(spark, price_inr="-1")), seen)
    assert rows.count() == 1
    assert seen.get == {"rows_read": 2, "rows_dropped": 1}


def test_missing_column_and_file(spark, tmp_path):
    with pytest.raises(ValueError, match="season"):
        clean_catalog(dirty(spark).drop("season"))
    with pytest.raises(FileNotFoundError):
        load_catalog(spark, str(tmp_path / "none.csv"))


HEADER = " Product_ID ,product_name,CATEGORY,subcategory,gender,color,size,fit,material,brand,price_inr,rating,season,description,image_url\n"


def line(i, description='"says ""hi"", twice\nand goes on"', price="100"):
    return f"P{i},n,jeans,s,Men,Blue,32,Slim Fit,Denim,b,{price},4.5,Summer,{description},u{i}\n"


def test_csv_header_quotes_and_order(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(HEADER + "".join(line(i, price="" if i == 3 else "100") for i in range(50)))
    rows = load_catalog(spark, str(path)).orderBy("ordinal").collect()
    assert [r["product_id"] for r in rows] == [f"P{i}" for i in range(50) if i != 3]
    assert rows[0]["description"] == 'says "hi", twice\nand goes on'
    assert rows[0]["image_url"] == "u0" and rows[0]["size"] == "32"


def test_csv_folder_keeps_file_order(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER + "".join(line(i, "d") for i in range(100, 400)))
    (tmp_path / "a.csv").write_text(HEADER + "".join(line(i, "d") for i in range(5)))
    for multi_line in (True, False):
        rows = load_catalog(spark, str(tmp_path), multi_line).orderBy("ordinal").collect()
        assert [r["product_id"] for r in rows] == [f"P{i}" for i in [*range(5), *range(100, 400)]]


def test_csv_split_file_keeps_order(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(HEADER + "".join(line(i, "d") for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        loaded = load_catalog(spark, str(path), multi_line=False)
        assert spark.read.option("header", True).csv(str(path)).rdd.getNumPartitions() > 3
        rows = loaded.orderBy("ordinal").select("product_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[0] for r in rows] == [f"P{i}" for i in range(3000)]


def test_csv_sink(spark, tmp_path):
    rows = catalog_of(spark, [product(description='a "b", c'), product("PRD2", 1)])
    write_csv(rows.drop("ordinal"), str(tmp_path / "out"))
    back = load_catalog(spark, str(tmp_path / "out"))
    assert {r["description"] for r in back.collect()} == {'a "b", c', "A blue denim jean."}


def test_lookup(spark):
    rows = [product("A", 5, color="Red"), product("A", 2, color="Blue"), product("B", 3)]
    catalog = catalog_of(spark, rows)
    assert product_by_id(catalog, "A").first()["color"] == "Blue"
    assert product_by_id(catalog, "Z").count() == 0
    wanted = spark.createDataFrame([("A",), ("A",), ("Z",)], "product_id string")
    assert [(r["product_id"], r["ordinal"]) for r in products_by_id(catalog, wanted).collect()] == [("A", 2)]
    assert [r["ordinal"] for r in first_rows(catalog, 2).orderBy("ordinal").collect()] == [2, 3]
    assert first_rows(catalog, 0).count() == 3


def test_profile_counts_missing(spark):
    rows = [product("A", 0, price_inr=7000.0), product("A", 1, brand=None), product("B", 2, price_inr=12000.0)]
    got = audit.catalog_profile(catalog_of(spark, rows)).first()
    assert (got["products"], got["duplicate_ids"], got["missing_brand"]) == (3, 1, 1)
    assert (got["above_6000"], got["above_10000"], got["above_20000"]) == (2, 1, 0)
    values = audit.value_counts(catalog_of(spark, rows))
    counts = {r["column_name"]: r["distinct_values"] for r in audit.distinct_counts(values).collect()}
    assert counts["brand"] == 1
