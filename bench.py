"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import queries as q  # noqa: E402
from weft.plans.ingest import attribute_store, build_store  # noqa: E402
from weft.plans.search import search  # noqa: E402
from weft.session import build_session, cut_lineage  # noqa: E402


def sink(df) -> None:
    """Run a plan whole, with every column, without collecting it."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    made: dict = {}

    def log():
        return q.search_log(spark, sf_dir).select("query_id", "raw_query")

    def ingest() -> None:
        folder = q.scratch(spark, "bench-store")
        made["store"] = build_store(q.catalog(spark, sf_dir), folder)

    def attributes() -> None:
        made["plain"] = attribute_store(q.catalog(spark, sf_dir))
        sink(search(log(), made["plain"]).items_by_search())

    def chunks() -> None:
        made["result"] = search(log(), made["store"])
        sink(made["result"].items_by_search())

    def explanations() -> None:
        from weft.plans.explain import explain

        sink(explain(made["result"].requests, made["result"].items))

    steps = {
        "parse_log": lambda: sink(q.parse(spark, sf_dir)),
        "clean_catalog": lambda: sink(q.cleaned_catalog(spark, sf_dir)),
        "strict_matches": lambda: sink(q.strict_matches(spark, sf_dir)),
        "search_by_attributes": attributes,
        "ingest_term_store": ingest,
        "search_by_chunks": chunks,
        "explanations": explanations,
        "document_chunks": lambda: sink(q.document_chunks(spark, sf_dir)),
        "document_term_vectors": lambda: sink(q.term_vectors(spark, sf_dir)),
        "nearest_vectors": lambda: sink(q.nearest_vectors(spark, sf_dir)),
        "recent_searches": lambda: sink(q.recent(spark, sf_dir)),
        "order_violations": lambda: sink(q.order_violations(spark, sf_dir)),
    }
    # One small run first, so that the first query does not pay for starting up.
    cut_lineage(q.catalog(spark, sf_dir).limit(10)).count()
    seconds = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    searches = log().count()
    distinct = made["result"].requests.count()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "searches": searches,
                "distinct_searches": distinct,
                "searches_per_sec": round(searches / seconds["search_by_chunks"], 1),
                "distinct_searches_per_sec": round(distinct / seconds["search_by_chunks"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
