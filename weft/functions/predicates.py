"""Hard filters: one constraint record against one product row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from weft import vocab
from weft.functions.text import is_set, strip

# What a zero-hit search gives up, and what it keeps.
OPTIONAL_TERMS = ("color", "material", "fit", "season", "brand", "subcategory")
CORE_TERMS = ("category", "gender", "max_price", "min_price")
ALL_TERMS = (
    "max_price", "min_price", "gender", "category", "subcategory", "color", "fit",
    "material", "season", "brand",
)
NUMBER_TERMS = ("max_price", "min_price")
# Product columns the filters read.
FILTER_COLUMNS = (
    "price_inr", "gender", "category", "subcategory", "color", "fit", "material",
    "season", "brand",
)


def folded_product(name: str) -> Column:
    """Product column in the form the filters compare."""
    return F.col(name) if name == "price_inr" else F.lower(name)


def folded_term(term: str, value: Column) -> Column:
    """Constraint in the form the filters compare; null where it is not set.

    Prices count when present (zero too), texts when not empty. Folding is done
    once per constraint record, so that a pair costs plain comparisons.
    """
    if term in NUMBER_TERMS:
        return value.cast("double")
    return F.when(is_set(value), F.lower(strip(value)))


def folded_terms(want: Callable[[str], Column], terms: tuple[str, ...] = ALL_TERMS) -> Column:
    """Folded constraints as one struct of all terms; those not listed are null."""
    return F.struct(
        *[
            (
                folded_term(t, want(t)) if t in terms
                else F.lit(None).cast("double" if t in NUMBER_TERMS else "string")
            ).alias(t)
            for t in ALL_TERMS
        ]
    )


def term_matches(term: str, want: Column, product: Callable[[str], Column]) -> Column:
    """One folded constraint against one folded product."""
    if term == "max_price":
        return product("price_inr") <= want
    if term == "min_price":
        return product("price_inr") >= want
    value = product(term)
    if term == "subcategory":
        return F.contains(value, want)
    if term == "gender":
        return (value == want) | (value == vocab.ANY_GENDER)
    if term == "season":
        return (value == want) | (value == vocab.ANY_SEASON)
    return value == want


def passes(
    want: Callable[[str], Column], product: Callable[[str], Column] = F.col,
    terms: tuple[str, ...] = ALL_TERMS,
) -> Column:
    """All folded terms hold; a null term holds for every product."""
    result = F.lit(True)
    for term in terms:
        result = result & (want(term).isNull() | term_matches(term, want(term), product))
    return result
