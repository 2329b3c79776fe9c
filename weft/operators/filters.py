"""Explicit filters, their merge with parsed ones, and batch matching."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from weft import vocab
from weft.functions.predicates import (
    ALL_TERMS, CORE_TERMS, FILTER_COLUMNS, NUMBER_TERMS, OPTIONAL_TERMS, folded_product,
    folded_terms, passes, term_matches,
)
from weft.functions.text import is_set
from weft.operators.cells import KEY, TEXT_TERMS, ask_nodes, count_products, plan_cells, term_mask
from weft.operators.joins import EQUAL_TERMS, PRODUCTS_PER_TASK, Measure, join_by_category, measure, tasks_for
from weft.operators.variants import split_variants
from weft.session import cut_lineage

#: Terms that hold by equality among those that a relaxed ask keeps.
CORE_EQUAL = tuple(t for t in EQUAL_TERMS if t in CORE_TERMS)
OVERRIDING_TERMS = ("category", "gender", "color", "fit", "material")


def term_type(term: str) -> str:
    return "double" if term in NUMBER_TERMS else "string"


def filter_products(catalog: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Catalog rows that pass one filter record; empty entries are skipped."""
    kept = catalog
    for term in ALL_TERMS:
        value = filters.get(term)
        if term in NUMBER_TERMS and value is not None:
            kept = kept.filter(term_matches(term, F.lit(float(value)), F.col))
        elif term not in NUMBER_TERMS and value:
            wanted = F.lit(str(value).strip().lower())
            kept = kept.filter(term_matches(term, wanted, folded_product))
    return kept


def ask_struct(columns: list[str], prefix: str = "") -> Column:
    """Pack constraint columns into one struct; absent ones become null."""
    names = (*ALL_TERMS, "intent", "style")
    return F.struct(
        *[
            (F.col(prefix + n) if prefix + n in columns else F.lit(None))
            .cast(term_type(n)).alias(n)
            for n in names
        ]
    )


def sanitize_top_k(value: Column) -> Column:
    """Whole, not negative; the default for anything that is no whole number text."""
    whole = F.when(F.typeof(value) == "string", value.cast("string").try_cast("int")).otherwise(
        F.nanvl(value.try_cast("double"), F.lit(None)).try_cast("int")
    )
    return F.greatest(F.coalesce(whole, F.lit(vocab.TOP_K)), F.lit(0))


def explicit_filters(choices: DataFrame, prefix: str = "ui_") -> DataFrame:
    """Form choices to filters: 'All' and the slider's ends mean no filter.

    Reads columns gender, category, color, fit, material, low_price, high_price.
    """
    low, high = vocab.PRICE_SLIDER
    texts = {
        prefix + c: F.nullif(F.col(c), F.lit(vocab.ALL_OPTION))
        for c in ("gender", "category", "color", "fit", "material")
    }
    prices = {
        prefix + "min_price": F.when(F.col("low_price") > low, F.col("low_price").cast("double")),
        prefix + "max_price": F.when(F.col("high_price") < high, F.col("high_price").cast("double")),
    }
    used = {"gender", "category", "color", "fit", "material", "low_price", "high_price"}
    kept = [c for c in choices.columns if c not in used]
    return choices.select(
        *kept, *[value.alias(name) for name, value in {**texts, **prices}.items()]
    )


def merge_filters(parsed: DataFrame, prefix: str = "ui_") -> DataFrame:
    """Explicit filters over parsed ones: texts override, price bounds tighten."""
    columns = parsed.columns
    merged = {}
    for term in OVERRIDING_TERMS:
        if prefix + term in columns:
            own = F.col(prefix + term)
            merged[term] = F.when(is_set(own), own).otherwise(F.col(term))
    if prefix + "max_price" in columns:
        merged["max_price"] = F.least("max_price", prefix + "max_price")
    if prefix + "min_price" in columns:
        merged["min_price"] = F.greatest("min_price", prefix + "min_price")
    return parsed.withColumns(merged) if merged else parsed


def relaxable(want: str) -> Column:
    """Some optional constraint is set."""
    result = F.lit(False)
    for term in OPTIONAL_TERMS:
        result = result | is_set(F.col(f"{want}.{term}"))
    return result


def candidate_counts(
    asks: DataFrame, variants: DataFrame, size: Measure, salts: int | None = None
) -> DataFrame:
    """Distinct products per ask under all terms and under the core terms.

    ``asks`` has ``ask_id`` and the folded terms ``used``. Products are counted per
    cell and price node, which asks find by equality. Ids that occur with several
    filter profiles, and all products where the asks' bounds or subcategory words
    are too many to be planned, join one by one.
    """
    plain, changing = split_variants(variants)
    strict = {t: F.col(f"used.{t}") for t in TEXT_TERMS}
    core = {t: F.col(f"used.{t}") if t in CORE_TERMS else F.lit(None).cast("string") for t in TEXT_TERMS}
    cells = plan_cells(asks, F.array(term_mask(strict), term_mask(core)))
    if cells is None:
        return paired_counts(asks, variants, size, salts)
    low, high = F.col("used.min_price"), F.col("used.max_price")
    few = asks.filter(relaxable("used"))
    questions = [
        ask_nodes(rows, values, low, high, cells).select("ask_id", F.lit(kind).alias("kind"), *KEY)
        for kind, rows, values in (("strict", asks, strict), ("core", few, core))
    ]
    asked = cut_lineage(questions[0].unionByName(questions[1]), "asked")
    counted = count_products(asked, plain.select("product_id", *FILTER_COLUMNS), cells, ["ask_id", "kind"])
    of = {k: F.sum(F.when(F.col("kind") == k, F.col("products")).otherwise(0)).alias(k) for k in ("strict", "core")}
    counts = counted.groupBy("ask_id").agg(of["strict"], of["core"])
    return _added(counts, _paired(asks, changing, size, salts))


def _paired(asks: DataFrame, changing: DataFrame, size: Measure, salts: int | None) -> DataFrame:
    """Counts of ids with several profiles: an id counts once however many of its profiles pass."""
    core = passes(lambda t: F.col(f"used.{t}"), terms=CORE_TERMS)
    optional = passes(lambda t: F.col(f"used.{t}"), terms=OPTIONAL_TERMS)
    products = changing.select("product_id", *FILTER_COLUMNS)
    tasks = tasks_for(products, PRODUCTS_PER_TASK)
    pairs = join_by_category(asks, products, core, "used", size, "product_id", salts, CORE_EQUAL, tasks)
    return (
        pairs.withColumn("_strict", optional).groupBy("ask_id", "product_id").agg(F.max("_strict").alias("_strict"))
        .groupBy("ask_id").agg(F.count_if("_strict").alias("strict"), F.count(F.lit(1)).alias("core"))
    )


def _added(*counts: DataFrame) -> DataFrame:
    whole = counts[0]
    for more in counts[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("ask_id").agg(F.sum("strict").alias("strict"), F.sum("core").alias("core"))


def paired_counts(
    asks: DataFrame, variants: DataFrame, size: Measure, salts: int | None = None
) -> DataFrame:
    """The same counts by pairs of asks and filter profiles of their category."""
    plain, changing = split_variants(variants)
    profiles = plain.groupBy(*FILTER_COLUMNS).agg(F.count(F.lit(1)).alias("products"))
    core = passes(lambda t: F.col(f"used.{t}"), terms=CORE_TERMS)
    optional = passes(lambda t: F.col(f"used.{t}"), terms=OPTIONAL_TERMS)
    spread = profiles.withColumn("_profile", F.xxhash64(*FILTER_COLUMNS))
    pairs = join_by_category(asks, spread, core, "used", size, "_profile", salts, CORE_EQUAL).withColumn("_strict", optional)
    counts = pairs.groupBy("ask_id").agg(
        F.sum(F.when(F.col("_strict"), F.col("products")).otherwise(0)).alias("strict"),
        F.sum("products").alias("core"),
    )
    return _added(counts, _paired(asks, changing, size, salts))


def choose_constraints(asks: DataFrame, counts: DataFrame) -> DataFrame:
    """Cut ``used`` to the constraints in force; add ``relaxed`` and ``candidates``.

    An ask without any strict candidate falls back to its core terms, if it set
    an optional one.
    """
    strict = F.coalesce(F.col("strict"), F.lit(0))
    core_only = F.struct(
        *[
            (F.col(f"used.{t}") if t in CORE_TERMS else F.lit(None).cast(term_type(t))).alias(t)
            for t in ALL_TERMS
        ]
    )
    return (
        asks.join(counts, "ask_id", "left")
        .withColumn("relaxed", (strict == 0) & relaxable("ask"))
        .withColumn("used", F.when(F.col("relaxed"), core_only).otherwise(F.col("used")))
        .withColumn(
            "candidates",
            F.when(F.col("relaxed"), F.coalesce(F.col("core"), F.lit(0))).otherwise(strict),
        )
        .drop("strict", "core")
    )


def fold_ask(asks: DataFrame, want: str = "ask") -> DataFrame:
    """Add the folded terms of an ask as ``used``."""
    return asks.withColumn("used", folded_terms(lambda t: F.col(f"{want}.{t}")))


def fold_catalog(catalog: DataFrame, *keep: str) -> DataFrame:
    """The filter columns in compared form, with the columns to keep."""
    return catalog.select(*keep, *[folded_product(c).alias(c) for c in FILTER_COLUMNS])


def match_products(
    asks: DataFrame, catalog: DataFrame, salts: int | None = None, size: Measure | None = None
) -> DataFrame:
    """Every (ask, product) pair whose product passes the ask's constraints.

    Keeps the ask columns, ``ordinal`` and ``product_id``.
    """
    folded = fold_ask(asks)
    products = fold_catalog(catalog, "ordinal", "product_id")
    pairs = join_by_category(
        folded, products, passes(lambda t: F.col(f"used.{t}")), "used",
        size or measure(asks), "ordinal", salts,
    )
    return pairs.select(*asks.columns, "ordinal", "product_id")
