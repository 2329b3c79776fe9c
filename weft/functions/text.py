"""Text and number helpers as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from weft import vocab

# Spark regexes follow Unicode word, digit and blank classes with this flag.
UNICODE = "(?U)"


def strip(text: Column) -> Column:
    """Drop blanks of every kind (tabs, no-break spaces) from both ends."""
    return F.btrim(text, F.lit(vocab.WHITE_SPACE))


def found(text: Column, pattern: str) -> Column:
    """True where ``pattern`` occurs in ``text``."""
    return F.regexp_like(text, F.lit(UNICODE + pattern))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, null when there is none."""
    return F.nullif(F.regexp_extract(text, UNICODE + pattern, group), F.lit(""))


def opening(words: Iterable[str], most: int = 3) -> str:
    """Lookahead for the first characters that the words have, place by place.

    Before a pattern that starts with one of the words it changes no match: it only spares
    most places of a long text the dearer tests behind it.
    """
    words = list(words)
    places = zip(*[w[:most] for w in words])
    return "(?=" + "".join("[" + "".join(sorted({re.escape(c) for c in place})) + "]" for place in places) + ")"


def words_pattern(words: Iterable[str]) -> str:
    """Whole-word alternation that prefers longer words."""
    longest_first = sorted(words, key=len, reverse=True)
    return opening(longest_first) + r"\b(" + "|".join(re.escape(w) for w in longest_first) + r")\b"


def first_listed(
    text: Column, pairs: list[tuple[str, str]], without: tuple[Column, tuple[str, ...]] | None = None
) -> Column:
    """Value of the earliest ``(word, value)`` pair whose word occurs in ``text``.

    One regex pass collects all words; list order, not text order, decides.
    ``without`` is a condition and the words it disables.
    """
    words = [w for w, _ in pairs]
    hits = F.regexp_extract_all(text, F.lit(UNICODE + words_pattern(words)), F.lit(1))
    if without is not None:
        condition, disabled = without
        hits = F.when(
            condition, F.filter(hits, lambda w: ~w.isin(*disabled))
        ).otherwise(hits)
    order = F.array(*[F.lit(w) for w in words])
    place = F.array_min(F.transform(hits, lambda w: F.array_position(order, w)))
    values = F.array(*[F.lit(v) for _, v in pairs])
    # Not element_at: with a constant array it ignores a null index.
    return F.get(values, (place - 1).cast("int"))


def is_set(value: Column) -> Column:
    """True for a text that is neither null nor empty."""
    return F.coalesce(value != "", F.lit(False))


def whole_number(value: Column) -> Column:
    """Number as text without its fraction."""
    return value.cast("bigint").cast("string")


def plain_number(value: Column) -> Column:
    """Whole numbers without a fraction, others as they are."""
    whole = value.cast("bigint")
    return F.when(whole == value, whole.cast("string")).otherwise(value.cast("string"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value computed once per row.

    Inside a lambda over an array, an outer expression is evaluated again for
    every element; as a lambda's own argument it is not.
    """
    return F.get(F.transform(F.array(value), use), 0)


def round_exact(value: Column, digits: int) -> Column:
    """Round a non-negative double by its exact binary value, ties to even.

    Spark's ``round`` works on the shortest decimal text and moves ties up. Here
    the scaled value's rounding error is recovered with a split product, so a
    value just below a decimal tie stays below it. ``value`` is mentioned often:
    give a column, and do not filter on the result (the optimizer would copy the
    whole expression below every projection it passes).
    """
    scale = float(10**digits)
    scaled = value * scale
    spread = value * 134217729.0
    high = spread - (spread - value)
    error = (high * scale - scaled) + (value - high) * scale
    floor = F.floor(scaled)
    rest = scaled - floor
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (floor % 2 == 1))))
    return (floor + F.when(up, 1).otherwise(0)).cast("double") / scale
