"""Evidence text, citation check and templated reasons for ranked items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft import vocab
from weft.functions.text import is_set, plain_number, round_exact, strip, whole_number


def evidence_line(rank: str = "rank", hits: str = "matched_chunks") -> Column:
    """One item as text: its fields and its first hits."""

    def field(name: str) -> Column:
        value = plain_number(F.col(name)) if name == "price_inr" else F.col(name).cast("string")
        return F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit("")))

    texts = F.transform(
        F.slice(hits, 1, vocab.EVIDENCE_CHUNKS),
        lambda h: F.left(h.text, F.lit(vocab.EVIDENCE_CHARS)),
    )
    return F.concat(
        F.lit("RETRIEVED PRODUCT "), F.col(rank).cast("string"), F.lit("\n"),
        F.concat_ws(" | ", *[field(n) for n in vocab.EVIDENCE_FIELDS]),
        F.lit("\nretrieved_chunk_evidence:\n"),
        F.array_join(F.filter(texts, lambda t: t != ""), "\n"),
    )


def supported(hits: str = "matched_chunks") -> Column:
    """Item with an id and at least one hit."""
    return is_set(F.trim("product_id")) & F.coalesce(F.size(hits) > 0, F.lit(False))


def cited_ids(text: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(F.upper(text), F.lit("(?U)" + vocab.CITED_ID), F.lit(0))
    )


def unknown_ids(text: Column, allowed: Column) -> Column:
    """Cited ids that the evidence does not hold."""
    return F.array_except(cited_ids(text), F.transform(allowed, F.upper))


def acceptable(text: Column, allowed: Column) -> Column:
    """A response long enough and free of unknown ids."""
    clean = strip(text)
    good = (F.length(clean) > vocab.LEAST_RESPONSE_CHARS) & (
        F.size(unknown_ids(clean, allowed)) == 0
    )
    return F.coalesce(good, F.lit(False))


def title() -> Column:
    """Brand and name, unless the name begins with the brand."""
    name = F.coalesce("product_name", F.lit("Clothing Item"))
    prefixed = is_set(F.col("brand")) & ~F.startswith(name, F.col("brand"))
    return F.when(
        prefixed, F.trim(F.concat(F.col("brand"), F.lit(" "), name))
    ).otherwise(name)


def matched_attributes(want: str = "ask") -> Column:
    """The asked-for attributes an item has, as words in a fixed order."""

    def asked(name: str) -> Column:
        wanted = F.col(f"{want}.{name}")
        return is_set(wanted) & F.contains(F.lower(name), F.lower(wanted))

    fit = F.lower(F.trim("fit"))
    highest = F.col(f"{want}.max_price")
    words = [
        F.when(asked("gender"), F.concat(F.col("gender"), F.lit("'s"))),
        F.when(asked("color"), F.lower("color")),
        F.when(
            asked("fit"),
            F.when(F.endswith(fit, F.lit("fit")), fit).otherwise(F.concat(fit, F.lit(" fit"))),
        ),
        F.when(asked("material"), F.lower("material")),
        F.when(is_set(F.col(f"{want}.category")), F.lower("category")),
        F.when(asked("season"), F.concat(F.lit("for "), F.lower("season"))),
        F.when(
            (highest != 0) & (F.col("price_inr") <= highest),
            F.concat(F.lit("under ₹"), whole_number(highest)),
        ),
    ]
    return F.array_compact(F.array(*words))


def reason(want: str = "ask", rank: str = "rank") -> Column:
    """Heading and sentence for one item; the first item has its own wording."""
    words = matched_attributes(want)
    about = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.col("category"))
    score = F.col("match_percentage")
    return F.concat(
        F.lit("**"), F.col(rank).cast("string"), F.lit(". "), title(), F.lit("**\n\n"),
        F.when(F.col(rank) == 1, F.format_string(vocab.REASON_FIRST, about, score))
        .otherwise(F.format_string(vocab.REASON_NEXT, about, score)),
    )


def explained_items(items: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request, from its first two items in one pass: ``top_ids``,
    ``context`` and ``allowed_ids`` of those with evidence, ``template`` reasons."""
    entry = F.struct(
        "rank", "product_id",
        F.when(supported(), evidence_line()).alias("line"),
        F.when(supported(), F.trim("product_id")).alias("allowed"),
        reason().alias("reason"),
    )
    top = items.filter(F.col("rank") <= vocab.EXPLAINED_ITEMS)
    grouped = top.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_items"))
    return grouped.select(
        key, F.col("_items.product_id").alias("top_ids"),
        F.left(F.array_join("_items.line", "\n\n"), F.lit(vocab.CONTEXT_CHARS)).alias("context"),
        F.array_distinct(F.array_compact("_items.allowed")).alias("allowed_ids"),
        F.array_join("_items.reason", "\n\n").alias("template"),
    )


def request_key(query: Column, ids: Column) -> Column:
    """Identity of an explanation: the text and the explained products."""
    return F.concat(F.lower(strip(query)), F.lit("|"), F.array_join(ids, "|"))


def four_digits(value: Column) -> Column:
    """Text with four decimals; formatting alone would move ties up."""
    return F.format_string("%.4f", round_exact(value, 4))


def result_table(items: DataFrame, key: str = "request_id") -> DataFrame:
    """Ranked items as the display table shows them."""
    return items.select(
        key, "rank", "product_id", "brand", "product_name",
        F.concat(F.lit("₹"), whole_number(F.col("price_inr"))).alias("price"),
        F.size("matched_chunks").alias("matched_chunks"),
        four_digits(F.coalesce("distance", F.lit(1.0))).alias("best_distance"),
        four_digits(F.col("semantic_similarity")).alias("semantic_sim"),
        F.concat(F.col("match_percentage").cast("string"), F.lit("%")).alias("hybrid_score"),
    )
