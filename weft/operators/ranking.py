"""Hybrid ranking of candidate products per search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weft import vocab
from weft.functions.scoring import (
    attribute_score, effective_style, rating_boost, raw_score, shows_style, similarity,
    specific_intent, style_text,
)
from weft.functions.text import round_exact
from weft.operators.topn import top_n


def own_style(want: str = "ask") -> Column:
    return effective_style(F.col(f"{want}.intent"), F.col(f"{want}.style"))


def match_style(candidates: DataFrame, want: str = "ask") -> DataFrame:
    """Add ``style_match`` from the candidates' own text."""
    return candidates.withColumn("style_match", shows_style(style_text(F.col), own_style(want)))


def rank_products(
    candidates: DataFrame, want: str = "ask", top_k: int = vocab.TOP_K,
    own_k: str | None = None, threshold: float = vocab.SCORE_THRESHOLD,
    allow_unretrieved: bool = True, few_per_query: bool = False, key: str = "query_id",
    position: str = "position", keep: tuple[str, ...] = (),
    semantic_weight: float = vocab.SEMANTIC_WEIGHT,
    attribute_weight: float = vocab.ATTRIBUTE_WEIGHT, placed: tuple[str, ...] = (),
) -> DataFrame:
    """Score, gate and cut candidates to the ``top_k`` of each query.

    Candidates carry the key, the ask struct, attributes, rating, position,
    ``distance`` (null without evidence) and ``style_match``. ``few_per_query``
    tells that a search limit bounds the rows of a query, so the style evidence
    may be looked up in a window; otherwise it is aggregated first. ``placed`` are columns
    that the key decides and that the candidates are partitioned by, so that they are ranked
    where they are. The result has the key, the position, the columns to ``keep`` and the scores.
    """
    if not allow_unretrieved:
        candidates = candidates.filter(F.col("distance").isNotNull())
    styled = F.max(F.col("distance").isNotNull() & F.col("style_match"))
    if few_per_query:
        known = candidates.withColumn("_styled", styled.over(Window.partitionBy(*placed, key)))
    else:
        per_query = candidates.groupBy(key).agg(styled.alias("_styled"))
        known = candidates.join(per_query, key)
    return _rank(
        known, want, top_k, own_k, threshold, key, position, keep, semantic_weight,
        attribute_weight, placed,
    )


def rank_by_attributes(
    candidates: DataFrame, want: str = "ask", top_k: int = vocab.TOP_K,
    own_k: str | None = None, threshold: float = vocab.SCORE_THRESHOLD,
    key: str = "query_id", position: str = "position", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Ranking without any vector evidence: no style gate and no fallback apply."""
    known = candidates.withColumns(
        {"distance": F.lit(None).cast("double"), "_styled": F.lit(False)}
    )
    return _rank(
        known, want, top_k, own_k, threshold, key, position, keep,
        vocab.SEMANTIC_WEIGHT, vocab.ATTRIBUTE_WEIGHT,
    )


def _rank(
    known: DataFrame, want: str, top_k: int, own_k: str | None, threshold: float,
    key: str, position: str, keep: tuple[str, ...], semantic_weight: float,
    attribute_weight: float, placed: tuple[str, ...] = (),
) -> DataFrame:
    intent = F.col(f"{want}.intent")
    evidence = F.col("distance").isNotNull()
    specific = specific_intent(intent)
    kept = known.filter(
        ~(specific & (intent != "") & F.col("_styled") & ~F.col("style_match"))
    )
    attributes = attribute_score(
        lambda n: F.col(f"{want}.{n}"), F.col, F.col("style_match")
    )
    carried = dict.fromkeys([*placed, key, position, *keep, *([own_k] if own_k else [])])
    # Only narrow rows go on to the sort.
    scored = kept.select(
        *carried, "distance", similarity(F.col("distance")).alias("_sim"),
        evidence.alias("has_retrieved_evidence"),
        (evidence & ~F.col("_styled") & specific).alias("_fallback"),
        raw_score(
            similarity(F.col("distance")), attributes, rating_boost(F.col("rating")),
            semantic_weight, attribute_weight,
        ).alias("_raw"),
    ).select(
        *carried, "distance", "has_retrieved_evidence", "_sim", "_fallback",
        round_exact(F.col("_raw"), 4).alias("hybrid_score"),
    )
    # Items below the threshold go behind all others instead of being filtered
    # here: a filter would be pushed down and repeat the whole score.
    judged = scored.withColumn(
        "_passed",
        (F.col("hybrid_score") >= threshold) | (F.col("_fallback") & (F.col("_sim") > 0)),
    )
    ranked = top_n(
        judged, [*placed, key], [F.desc("_passed"), F.desc("hybrid_score"), F.col(position)], top_k,
        own_n=F.col(own_k) if own_k else None,
    ).filter("_passed")
    return ranked.select(
        *[c for c in carried if c != own_k and c not in set(placed) - set(keep)], "distance", "has_retrieved_evidence",
        "hybrid_score", "rank",
        round_exact(F.col("_sim"), 4).alias("semantic_similarity"),
        (F.col("hybrid_score") * 100).cast("int").alias("match_percentage"),
    )


def price_guard(items: DataFrame, want: str = "ask") -> DataFrame:
    """Last check of the price bounds on ranked items."""
    low, high = F.col(f"{want}.min_price"), F.col(f"{want}.max_price")
    return items.filter(
        (high.isNull() | (F.col("price_inr") <= high))
        & (low.isNull() | (F.col("price_inr") >= low))
    )
