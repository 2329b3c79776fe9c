"""Explanations of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weft import vocab
from weft.operators.evidence import acceptable, explained_items, request_key
from weft.functions.text import strip


def explanation_requests(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Per request: explanation key, context, allowed ids and template.

    ``items`` carry the ``ask`` they were ranked by.
    """
    made = requests.select("request_id", "raw_query").join(
        explained_items(items), "request_id", "left"
    )
    ids = F.coalesce("top_ids", F.array().cast("array<string>"))
    return made.withColumn("request_key", request_key(F.col("raw_query"), ids))


def shared_requests(explained: DataFrame) -> DataFrame:
    """One row per explanation key that needs an outside answer."""
    return explained.filter(F.col("context") != "").groupBy("request_key").agg(
        F.min_by(F.struct("raw_query", "context", "allowed_ids"), "request_id").alias("_first")
    ).select("request_key", "_first.*")


def explain(
    requests: DataFrame, items: DataFrame, responses: DataFrame | None = None
) -> DataFrame:
    """(request_id, source, text) for every request.

    ``responses`` (request_key, source, text) come from outside; one that cites a
    product beyond the evidence, or says too little, gives way to the template.
    """
    explained = explanation_requests(requests, items)
    if responses is None:
        answered = explained.withColumns(
            {"_source": F.lit(None).cast("string"), "_text": F.lit(None).cast("string")}
        )
    else:
        given = responses.select(
            "request_key", F.col("source").alias("_source"), strip(F.col("text")).alias("_text")
        )
        answered = explained.join(given, "request_key", "left")
        # Several responses to one key: the first acceptable one by source and text.
        usable = F.coalesce(acceptable(F.col("_text"), F.col("allowed_ids")), F.lit(False))
        first = Window.partitionBy("request_id").orderBy(usable.desc(), F.col("_source"), F.col("_text"))
        answered = answered.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")
    accepted = acceptable(F.col("_text"), F.col("allowed_ids"))
    no_items = F.col("top_ids").isNull()
    no_context = F.coalesce(F.col("context") == "", F.lit(True))
    return answered.select(
        "request_id", "request_key",
        F.when(no_items | no_context, vocab.SOURCE_SYSTEM)
        .when(accepted, F.col("_source")).otherwise(vocab.SOURCE_TEMPLATE).alias("source"),
        F.when(no_items, vocab.TEXT_NO_ITEMS).when(no_context, vocab.TEXT_NO_EVIDENCE)
        .when(accepted, F.col("_text")).otherwise(F.col("template")).alias("text"),
    )
