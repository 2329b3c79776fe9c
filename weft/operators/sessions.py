"""Search history per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weft.functions.constraints import is_domain_search, parse_searches
from weft.functions.text import strip
from weft.operators.topn import top_n


def recent_searches(log: DataFrame, user: str = "user_id", n: int = 5) -> DataFrame:
    """Last ``n`` distinct accepted searches per user, newest first.

    ``log`` has user, ``raw_query`` and ``ts``. A repeated search keeps its first
    place. Each text is parsed once.
    """
    first = (
        log.withColumn("raw_query", strip(F.col("raw_query")))
        .groupBy(user, "raw_query").agg(F.min("ts").alias("first_ts"))
    )
    texts = parse_searches(first.select("raw_query").distinct())
    accepted = texts.filter(is_domain_search()).select("raw_query")
    kept = first.join(accepted, "raw_query")
    return top_n(
        kept, [user], [F.desc("first_ts"), F.col("raw_query")], n, rank="place"
    )
