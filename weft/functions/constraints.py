"""Search text to structured constraints, as columns over a table of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft import vocab
from weft.functions.text import (
    extract, first_listed, found, is_set, opening, strip, whole_number, words_pattern,
)

PARSED_COLUMNS = (
    "max_price", "min_price", "gender", "category", "subcategory", "intent",
    "color", "fit", "material", "season", "style", "cleaned_query",
)


def _longest_first(words_by_value: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    pairs = [(w, value) for value, words in words_by_value.items() for w in words]
    return sorted(pairs, key=lambda pair: len(pair[0]), reverse=True)


def _in_order(words_by_value: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    return [(w, value) for value, words in words_by_value.items() for w in words]


CATEGORY_PAIRS = _longest_first(vocab.CATEGORY_WORDS)
FIT_PAIRS = _longest_first(vocab.FIT_WORDS)
STYLE_PAIRS = [(s, s) for s in vocab.STYLES]
INTENT_PAIRS = _in_order(vocab.INTENT_WORDS)
COLOR_PAIRS = _in_order(
    {c: vocab.COLOR_SPELLINGS.get(c, (c.lower(),)) for c in vocab.COLORS}
)
MATERIAL_PAIRS = [(m.lower(), m) for m in vocab.MATERIALS]
SEASON_PAIRS = [(s.lower(), s) for s in vocab.SEASONS if s.lower() != vocab.ANY_SEASON]

BETWEEN = opening(["between"]) + (
    rf"\bbetween\s+{vocab.CURRENCY}\s*({vocab.PRICE_NUMBER})"
    rf"\s+and\s+{vocab.CURRENCY}\s*({vocab.PRICE_NUMBER})"
)
MAX_BEFORE = opening(vocab.MAX_PRICE_WORDS, 1) + (
    rf"(?:{'|'.join(vocab.MAX_PRICE_WORDS)})\s*{vocab.CURRENCY}\s*({vocab.PRICE_NUMBER})"
)
MAX_AFTER = (
    rf"({vocab.PRICE_NUMBER})\s*(?:rs|rupees|inr)?\s*"
    rf"(?:{'|'.join(vocab.MAX_PRICE_SUFFIXES)})"
)
MIN_BEFORE = opening(vocab.MIN_PRICE_WORDS, 1) + (
    rf"(?:{'|'.join(vocab.MIN_PRICE_WORDS)})\s*{vocab.CURRENCY}\s*({vocab.PRICE_NUMBER})"
)
DOMAIN = opening(vocab.DOMAIN_WORDS, 1) + r"\b(?:" + "|".join(vocab.DOMAIN_WORDS) + r")\b"
ANY_DRESS = opening(["dress"]) + r"\bdress(?:es)?\b"
DRESSES = opening(["dress"]) + r"\bdresses\b"
DRESS_SHIRT = opening(["dress"]) + vocab.DRESS_SHIRT
FORMAL_DRESS = opening(["formal"]) + vocab.FORMAL_DRESS
# A character that carries a word: neither blank nor one of those that stand for none.
WORD_PART = f"[^{vocab.NON_TEXT[1:-1]}{vocab.WHITE_SPACE}]"


def price(text: Column, pattern: str, group: int = 1) -> Column:
    """Number of a price phrase as a double, thousands commas dropped."""
    return F.replace(extract(text, pattern, group), F.lit(","), F.lit("")).try_cast("double")


def max_price(lowered: Column) -> Column:
    return F.coalesce(
        price(lowered, BETWEEN, 2), price(lowered, MAX_BEFORE), price(lowered, MAX_AFTER)
    )


def min_price(lowered: Column) -> Column:
    return F.coalesce(price(lowered, BETWEEN, 1), price(lowered, MIN_BEFORE))


def gender(lowered: Column) -> Column:
    branches = None
    for value, words in vocab.GENDER_WORDS.items():
        test = found(lowered, words_pattern(words))
        branches = F.when(test, value) if branches is None else branches.when(test, value)
    return branches


def cleaned_query(lowered: Column) -> Column:
    """Search text without stop tokens and bare numbers; all of it if none stay."""
    kept = F.filter(
        F.split(lowered, r"(?U)\s+"),
        lambda w: (w != "") & ~w.isin(*vocab.SEARCH_STOP_TOKENS) & ~F.rlike(w, F.lit(r"(?U)^\d+$")),
    )
    joined = F.array_join(kept, " ")
    return F.when(joined != "", joined).otherwise(lowered)


def parse_searches(searches: DataFrame, text: str = "raw_query") -> DataFrame:
    """Add the constraint columns of ``PARSED_COLUMNS`` to a table of searches.

    ``text`` is stripped in place; all other columns are kept.
    """
    lowered = F.col("_lowered")
    step = (
        searches.withColumn(text, strip(F.col(text)))
        .withColumn("_lowered", F.lower(text))
        .withColumns(
            {
                "gender": gender(lowered),
                "_dress_shirt": found(lowered, DRESS_SHIRT),
                "_any_dress": found(lowered, ANY_DRESS),
                "_formal_dress": found(lowered, FORMAL_DRESS)
                & ~found(lowered, DRESSES),
                "style": first_listed(lowered, STYLE_PAIRS),
            }
        )
        .withColumn(
            "_mens_dress",
            F.coalesce(F.col("gender") == "Men", F.lit(False))
            & F.col("_any_dress")
            & ~F.col("_dress_shirt"),
        )
    )
    no_bare_dress = (F.col("_formal_dress") & ~F.col("_dress_shirt")) | F.col("_mens_dress")
    style_intent = F.create_map(
        *[F.lit(x) for pair in vocab.STYLE_INTENT.items() for x in pair]
    )
    parsed = step.withColumns(
        {
            "max_price": max_price(lowered),
            "min_price": min_price(lowered),
            "category": F.when(F.col("_dress_shirt"), "shirts").otherwise(
                first_listed(
                    lowered, CATEGORY_PAIRS, without=(no_bare_dress, vocab.BARE_DRESS_WORDS)
                )
            ),
            "subcategory": F.lit(None).cast("string"),
            "intent": F.coalesce(
                F.try_element_at(style_intent, F.col("style")),
                first_listed(lowered, INTENT_PAIRS),
                F.when(F.col("_mens_dress"), vocab.BROAD_INTENT),
            ),
            "color": first_listed(lowered, COLOR_PAIRS),
            "fit": first_listed(lowered, FIT_PAIRS),
            "material": first_listed(lowered, MATERIAL_PAIRS),
            "season": first_listed(lowered, SEASON_PAIRS),
            "cleaned_query": cleaned_query(lowered),
        }
    )
    return parsed.select(*searches.columns, *PARSED_COLUMNS)


def is_domain_search(text: str = "raw_query") -> Column:
    """Gate over parsed searches: does the text ask for clothing at all?"""
    lowered = F.lower(strip(F.col(text)))
    has_words = F.regexp_like(lowered, F.lit(WORD_PART))
    parsed = F.coalesce(
        F.col("category"), F.col("fit"), F.col("material"), F.col("style"),
        F.col("intent"), F.col("gender"), F.col("color"),
        F.col("max_price").cast("string"), F.col("min_price").cast("string"),
    ).isNotNull()
    return F.coalesce((parsed | found(lowered, DOMAIN)) & has_words, F.lit(False))


def constraint_labels() -> Column:
    """Labels of the active constraints of a parsed search, in display order."""
    labels = [
        F.when(F.col(c) != 0, F.concat(F.lit(f"{name}: ₹"), whole_number(F.col(c))))
        for name, c in (("Max Price", "max_price"), ("Min Price", "min_price"))
    ]
    labels += [
        F.when(is_set(F.col(c)), F.concat(F.lit(f"{c.title()}: "), F.col(c)))
        for c in ("gender", "category", "color", "fit", "material")
    ]
    return F.array_compact(F.array(*labels))
