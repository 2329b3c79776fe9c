"""Catalog rows folded by product id and filter profile.

A repeated product keeps the place of its first row and the values of its last
one, among the rows a search lets through. Rows of one filter profile pass or
fail together, so that rule can be applied per profile before any search is seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weft.functions.predicates import FILTER_COLUMNS, folded_product
from weft.functions.scoring import style_flags
from weft.operators.topn import top_n

# What the ranking reads of a product beside its filter columns.
SCORING_COLUMNS = ("rating", "styles")


def product_variants(catalog: DataFrame) -> DataFrame:
    """One row per (product_id, filter profile).

    ``position`` is the first row's ordinal; ``ordinal``, ``rating`` and
    ``styles`` are the last row's. Texts are folded as the filters compare them.
    """
    narrow = catalog.select(
        "product_id", *[folded_product(c).alias(c) for c in FILTER_COLUMNS], "ordinal",
        "rating", style_flags().alias("styles"),
    )
    # Plain numbers as buffers keep this a hash aggregate.
    last = [F.max_by(c, "ordinal").alias(c) for c in SCORING_COLUMNS]
    return narrow.groupBy("product_id", *FILTER_COLUMNS).agg(
        F.min("ordinal").alias("position"), F.max("ordinal").alias("ordinal"), *last
    )


def split_variants(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants of ids with one profile, and those of ids with several.

    Only ids are shuffled to be counted. The ids with several profiles are few in
    most catalogs; the plan then broadcasts them by their measured size.
    """
    several = (
        variants.groupBy("product_id").agg(F.count(F.lit(1)).alias("_profiles"))
        .filter(F.col("_profiles") > 1).select("product_id")
    )
    plain = variants.join(several, "product_id", "left_anti")
    return plain, variants.join(several, "product_id", "left_semi")


def leading_variants(plain: DataFrame, k: int) -> DataFrame:
    """The first ``k`` products of every group that all searches score alike.

    Without vector evidence a score depends on filter profile, rating and styles
    only, and ties go by position. So no search can return a later product of
    such a group, and dropping it changes no result.
    """
    return top_n(
        plain, [*FILTER_COLUMNS, *SCORING_COLUMNS], [F.col("position")], k, rank="_place"
    ).drop("_place")


def fold_variants(pairs: DataFrame, keys: list[str], extra: dict | None = None) -> DataFrame:
    """One row per key and product: first position, last row's values."""
    values = F.struct("ordinal", *SCORING_COLUMNS, *FILTER_COLUMNS)
    extra = extra or {}
    return (
        pairs.groupBy(*keys, "product_id")
        .agg(
            F.min("position").alias("position"), F.max(values).alias("_last"),
            *[value.alias(name) for name, value in extra.items()],
        )
        .select(*keys, "product_id", "position", "_last.*", *extra)
    )
