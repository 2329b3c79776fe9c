"""Long texts: openings and trimmed ends change no match; texts and products spread over tasks."""

import random
import re

from pyspark.sql import functions as F

from checks import queries
from conftest import catalog_of, product
from weft import vocab
from weft.functions import constraints as c
from weft.functions.text import UNICODE, strip, words_pattern
from weft.plans import ingest

WORDS = sorted(
    {w for group in (vocab.CATEGORY_WORDS, vocab.FIT_WORDS, vocab.GENDER_WORDS, vocab.INTENT_WORDS) for ws in group.values() for w in ws}
    | set(vocab.STYLES) | {"formal red dress", "dress shirts", "t shirt", "night-wear", "men's", "xl", "é", "jeañs", "ḿen", "_top_"}
)
PRICES = ["under", "between 1,000 and 2000", "< ₹", "more than", "rs.", "12", "1,999.50", "or less", "max", "minimum"]


def texts():
    chance = random.Random(7)
    made = ["", " ", " 　", "a\u0085", "\x1f12", "₹.,", " Jeans\t\n", None]
    made += [
        "slim party jeans for women", "men's formal wear", "between 500 and 2,000", "under 500", "above rs. 500", "a dress",
        "two dresses", "dress  shirts", "formal dark red dress", "unisex blue cotton in summer",
    ]
    joints = [" ", "", "-", "\n", " ", ". ", " ", "'"]
    for _ in range(600):
        parts = [chance.choice(WORDS + PRICES) + chance.choice(joints) for _ in range(chance.randint(1, 7))]
        made.append(chance.choice(joints) + "".join(parts))
    return made


def test_openings_change_no_match(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string").withColumn("l", F.lower("t"))
    pairs = []
    for words in (c.CATEGORY_PAIRS, c.FIT_PAIRS, c.STYLE_PAIRS, c.INTENT_PAIRS, c.COLOR_PAIRS, c.MATERIAL_PAIRS, c.SEASON_PAIRS):
        words = sorted((w for w, _ in words), key=len, reverse=True)
        pairs.append((words_pattern(words), r"\b(" + "|".join(re.escape(w) for w in words) + r")\b"))
    for words in vocab.GENDER_WORDS.values():
        pairs.append((words_pattern(words), r"\b(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")\b"))
    whole = [c.BETWEEN, c.MAX_BEFORE, c.MIN_BEFORE, c.DOMAIN, c.ANY_DRESS, c.DRESSES, c.DRESS_SHIRT, c.FORMAL_DRESS]
    pairs += [(p, re.sub(r"^\(\?=(\[(?:\\.|[^\]])*\])+\)", "", p)) for p in whole]
    assert all(old != new and not old.startswith("(?=") for new, old in pairs)
    every = [F.regexp_extract_all("l", F.lit(UNICODE + p), F.lit(0)) for pair in pairs for p in pair]
    stripped = F.regexp_replace("t", UNICODE + r"^\s+|\s+$", "")
    words = F.regexp_replace(F.regexp_replace("l", vocab.NON_TEXT, " "), UNICODE + r"^\s+|\s+$", "") != ""
    found = df.select(strip(F.col("t")), stripped, F.regexp_like("l", F.lit(c.WORD_PART)), words, *every).collect()
    for row in found:
        assert all(row[i] == row[i + 1] for i in range(0, len(row), 2)), row
    assert [i for i in range(len(pairs)) if not any(row[4 + 2 * i] for row in found)] == []


def test_texts_and_products_spread_over_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, "blue jeans under 500 " + "word " * 40) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    gate = queries.domain_gate_documents(spark, str(tmp_path))
    held = gate.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) > 1 and sum(r["count"] for r in held) == 400 and gate.filter("is_clothing").count() == 400
    monkeypatch.setattr(ingest, "PRODUCTS_PER_SPLIT", 4)
    products = catalog_of(spark, [product(f"PRD{1000 + i}", i) for i in range(64)]).coalesce(1)
    made = ingest.product_chunks(products)
    assert made.rdd.getNumPartitions() == 16
    assert made.groupBy(F.spark_partition_id().alias("p")).count().count() > 1
