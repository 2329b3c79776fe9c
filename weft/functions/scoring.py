"""Style evidence and hybrid score as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from weft import vocab
from weft.functions.text import is_set

# Every style a parsed search can be ranked by.
KNOWN_STYLES = tuple(
    dict.fromkeys([*vocab.INTENT_STYLE.values(), *vocab.STYLES, vocab.NO_STYLE])
)
STYLE_FIELDS = ("product_name", "subcategory", "description", "season")


def style_text(product: Callable[[str], Column] = F.col) -> Column:
    """The product text that can show a style."""
    fields = [F.coalesce(product(f), F.lit("")) for f in STYLE_FIELDS]
    return F.lower(F.concat_ws(" ", *fields))


def _contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    result = F.lit(False)
    for term in terms:
        result = result | F.contains(text, F.lit(term))
    return result


def shows_style(text: Column, style: Column) -> Column:
    """Does the text show this (row's own) style?"""
    branches = None
    for name, terms in vocab.STYLE_EVIDENCE.items():
        test = _contains_any(text, terms)
        branches = (
            F.when(style == name, test) if branches is None
            else branches.when(style == name, test)
        )
    return branches.otherwise(F.contains(text, style))


def style_flags(product: Callable[[str], Column] = F.col) -> Column:
    """Bit i is set if the product shows ``KNOWN_STYLES[i]``.

    Computed once per product, so matching a search needs no product text.
    """
    text = style_text(product)
    flags = F.lit(0).cast("long")
    for i, style in enumerate(KNOWN_STYLES):
        terms = vocab.STYLE_EVIDENCE.get(style, (style,))
        flags = flags + F.when(_contains_any(text, terms), 1 << i).otherwise(0)
    return flags


def style_place(style: Column) -> Column:
    """Bit of a known style."""
    return (F.array_position(F.array(*[F.lit(s) for s in KNOWN_STYLES]), style) - 1).cast("int")


def has_flag(flags: Column, place: Column) -> Column:
    return F.getbit(flags, place) == 1


def effective_style(intent: Column, style: Column) -> Column:
    """Style a search is ranked by: its intent's style, else its own, else none."""
    by_intent = F.create_map(
        *[F.lit(x) for pair in vocab.INTENT_STYLE.items() for x in pair]
    )
    return F.coalesce(
        F.try_element_at(by_intent, F.lower(intent)), F.lower(style), F.lit(vocab.NO_STYLE)
    )


def specific_intent(intent: Column) -> Column:
    """An intent that names an occasion."""
    return intent.isNotNull() & ~intent.isin(*vocab.UNSPECIFIC_INTENTS)


def similarity(distance: Column) -> Column:
    """Cosine distance to similarity; no evidence counts as none."""
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - distance), F.lit(0.0))


def attribute_score(
    want: Callable[[str], Column], product: Callable[[str], Column], style_match: Column
) -> Column:
    """Share of the asked-for attribute points a product earns; 0.5 if none asked."""
    earned, possible = F.lit(0.0), F.lit(0.0)
    for name, points in vocab.ATTRIBUTE_POINTS.items():
        asked = is_set(want(name))
        if name == "style":
            match = style_match
        else:
            value = F.lower(F.coalesce(product(name), F.lit("")))
            match = value == F.lower(want(name))
            if name == "season":
                match = match | (value == vocab.ANY_SEASON)
        possible = possible + F.when(asked, points).otherwise(0.0)
        earned = earned + F.when(asked & match, points).otherwise(0.0)
    return F.when(possible > 0, earned / possible).otherwise(0.5)


def rating_boost(rating: Column) -> Column:
    """Up to 0.05 for ratings above 3.5."""
    value = F.coalesce(rating, F.lit(vocab.DEFAULT_RATING))
    return F.greatest(F.lit(0.0), (value - 3.5) / 1.5) * 0.05


def raw_score(
    sim: Column, attributes: Column, boost: Column,
    semantic_weight: float = vocab.SEMANTIC_WEIGHT,
    attribute_weight: float = vocab.ATTRIBUTE_WEIGHT,
) -> Column:
    """Weighted sum, at most 1, not yet rounded."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sim))
    total = F.lit(semantic_weight) * bounded + F.lit(attribute_weight) * attributes + boost
    return F.least(F.lit(1.0), total)
