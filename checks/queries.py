"""Registered queries: every operator over the driver's tables, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import fixtures
from weft.functions.constraints import (
    PARSED_COLUMNS, constraint_labels, is_domain_search, parse_searches,
)
from weft.functions.vectors import norm, unit
from weft.operators import audit
from weft.operators.chunking import chunk_texts, product_documents
from weft.operators.evidence import cited_ids, acceptable, result_table, unknown_ids
from weft.operators.filters import (
    ask_struct, explicit_filters, filter_products, match_products, merge_filters,
    sanitize_top_k,
)
from weft.operators.joins import tasks_for
from weft.operators.nearest import nearest_chunks
from weft.operators.sessions import recent_searches
from weft.operators.terms import document_terms, fit_vocabulary, term_statistics, text_tasks, weigh
from weft.plans.explain import explain, explanation_requests, shared_requests
from weft.plans.ingest import (
    attribute_store, build_store, given_store, ingest_statistics, product_chunks,
)
from weft.plans.search import SearchResult, asked, distinct_requests, search, with_constraints
from weft.session import checkpoint_folder, cut_lineage
from weft.sources.catalog import clean_catalog, load_catalog, products_by_id, write_csv
from weft.sources.store import Store, load_store, report_line, write_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture view over the driver's tables."""
    for name in ("part", "events"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def catalog(spark, sf_dir):
    return view(spark, sf_dir, fixtures.CATALOG)


def search_log(spark, sf_dir):
    return view(spark, sf_dir, fixtures.SEARCH_LOG)


# --- search text ------------------------------------------------------------


def parse(spark, sf_dir):
    parsed = parse_searches(search_log(spark, sf_dir))
    return parsed.select("query_id", "raw_query", *PARSED_COLUMNS)


def domain_gate(spark, sf_dir):
    parsed = parse_searches(search_log(spark, sf_dir).select("query_id", "raw_query"))
    return parsed.select("query_id", is_domain_search().alias("is_clothing"))


def domain_gate_documents(spark, sf_dir):
    """The gate and the parser over whole free texts in four languages."""
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("raw_query")
    )
    # Parsed in tasks of bounded text, however the files were cut.
    texts = texts.repartition(text_tasks(texts, "raw_query"), "query_id", "raw_query")
    parsed = parse_searches(texts)
    return parsed.select(
        "query_id", *[c for c in PARSED_COLUMNS if c != "cleaned_query"],
        is_domain_search().alias("is_clothing"),
    )


def labels(spark, sf_dir):
    parsed = parse_searches(search_log(spark, sf_dir).select("query_id", "raw_query"))
    return parsed.select("query_id", F.array_join(constraint_labels(), " • ").alias("labels"))


def form_searches(spark, sf_dir):
    """Searches with the filters of their form."""
    return explicit_filters(view(spark, sf_dir, fixtures.FORM_LOG))


def merged_filters(spark, sf_dir):
    forms = form_searches(spark, sf_dir).withColumn("top_k", sanitize_top_k(F.col("top_k")))
    merged = merge_filters(parse_searches(forms))
    return merged.select(
        "query_id", "top_k", "max_price", "min_price", "gender", "category", "color", "fit",
        "material", "season",
    )


# --- catalog ----------------------------------------------------------------

CATALOG_COLUMNS = (
    "product_id", "product_name", "category", "subcategory", "gender", "color", "size",
    "fit", "material", "brand", "price_inr", "rating", "season", "description",
)


def cleaned_catalog(spark, sf_dir):
    return clean_catalog(view(spark, sf_dir, fixtures.DIRTY_CATALOG)).select(
        "ordinal", *CATALOG_COLUMNS
    )


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}/{name}"


def catalog_csv(spark, sf_dir):
    """The dirty catalog written as CSV and loaded again."""
    folder = scratch(spark, f"csv-{sf_dir.rstrip('/').rsplit('/', 1)[-1]}")
    write_csv(view(spark, sf_dir, fixtures.DIRTY_CATALOG).drop("ordinal"), folder)
    return load_catalog(spark, folder).select(*CATALOG_COLUMNS)


def product_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("PRD"), (F.col("l_partkey") + 1001).cast("string")).alias("product_id")
    )
    repeated = view(spark, sf_dir, fixtures.REPEATED_CATALOG)
    return products_by_id(repeated, wanted).select("ordinal", *CATALOG_COLUMNS)


def profile(spark, sf_dir):
    return audit.catalog_profile(view(spark, sf_dir, fixtures.REPEATED_CATALOG))


def catalog_values(spark, sf_dir):
    return audit.sorted_values(audit.value_counts(catalog(spark, sf_dir)))


def catalog_distinct(spark, sf_dir):
    return audit.distinct_counts(audit.value_counts(catalog(spark, sf_dir)))


# --- hard filters -----------------------------------------------------------

FILTER_RECORD = {
    "max_price": 5000, "min_price": 500, "gender": " men ", "category": "JEANS",
    "subcategory": "c", "season": "", "fit": None, "color": None,
}


def filter_record(spark, sf_dir):
    return filter_products(catalog(spark, sf_dir), FILTER_RECORD).select(
        "ordinal", *CATALOG_COLUMNS
    )


def _asks(spark, sf_dir):
    return distinct_requests(asked(search_log(spark, sf_dir))).select("request_id", "ask")


def strict_matches(spark, sf_dir):
    """Every product that passes each distinct search's constraints."""
    return match_products(_asks(spark, sf_dir), catalog(spark, sf_dir)).select(
        "request_id", "ordinal"
    )


def brand_matches(spark, sf_dir):
    """Theta join of constraint records with brand and subcategory terms."""
    records = (
        table(spark, sf_dir, "customer")
        .select(
            F.col("c_custkey").alias("request_id"),
            F.concat(F.lit(" brand#"), (F.col("c_custkey") % 25 + 1).cast("string")).alias("brand"),
            F.when(F.col("c_custkey") % 3 == 0, "Party").otherwise("").alias("subcategory"),
            (F.col("c_acctbal").cast("int") % 5000).cast("double").alias("max_price"),
            F.when(F.col("c_nationkey") % 2 == 0, "Women").alias("gender"),
        )
    )
    asks = records.select("request_id", ask_struct(records.columns).alias("ask"))
    return match_products(asks, catalog(spark, sf_dir)).select("request_id", "ordinal")


def _candidates(spark, sf_dir, sql):
    store = attribute_store(view(spark, sf_dir, sql))
    requests = distinct_requests(asked(search_log(spark, sf_dir)))
    return with_constraints(requests, store.variants).select(
        "request_id", "relaxed", "candidates"
    )


def relaxed_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir, fixtures.CATALOG)


def relaxed_candidates_repeated(spark, sf_dir):
    return _candidates(spark, sf_dir, fixtures.REPEATED_CATALOG)


# --- search by attributes ---------------------------------------------------


def _attribute_search(spark, sf_dir, sql) -> SearchResult:
    log = search_log(spark, sf_dir).select("query_id", "raw_query")
    return search(log, attribute_store(view(spark, sf_dir, sql)))


ITEM_COLUMNS = (
    "request_id", "rank", "product_id", "ordinal", "price_inr", "rating",
    "semantic_similarity", "has_retrieved_evidence", "hybrid_score", "match_percentage",
)


def attribute_items(spark, sf_dir):
    return _attribute_search(spark, sf_dir, fixtures.CATALOG).items.select(*ITEM_COLUMNS)


def attribute_items_repeated(spark, sf_dir):
    return _attribute_search(spark, sf_dir, fixtures.REPEATED_CATALOG).items.select(*ITEM_COLUMNS)


def attribute_answers(spark, sf_dir):
    """Items of every search of the log, repeated searches included."""
    result = _attribute_search(spark, sf_dir, fixtures.CATALOG)
    return result.items_by_search().select("query_id", "rank", "product_id", "hybrid_score")


# --- documents and chunks ---------------------------------------------------


def documents(spark, sf_dir):
    made = product_documents(catalog(spark, sf_dir))
    return made.select(
        "product_id", "full_text", F.col("metadata.category").alias("meta_category"),
        F.col("metadata.subcategory").alias("meta_subcategory"),
        F.col("metadata.size").alias("meta_size"), F.col("metadata.price_inr").alias("meta_price"),
    )


def chunks(spark, sf_dir):
    return product_chunks(catalog(spark, sf_dir)).drop("metadata")


def tight_chunks(spark, sf_dir):
    """Chunks so small that every identity text splits its description."""
    return product_chunks(catalog(spark, sf_dir), None, 60, 10).select(
        "chunk_id", "product_id", "chunk_index", "total_chunks", "chunk_type", "text",
        F.col("metadata.chunk_index").alias("meta_index"),
    )


def document_chunks(spark, sf_dir):
    return chunk_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def ingest_report(spark, sf_dir):
    made = cut_lineage(product_chunks(catalog(spark, sf_dir)))
    return ingest_statistics(catalog(spark, sf_dir), made)


def chunk_coverage(spark, sf_dir):
    """Ids that only the catalog or only its chunks hold, counted with the rest."""
    made = product_chunks(catalog(spark, sf_dir))
    orders = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("PRD"), (F.col("l_partkey") * 2 + 1001).cast("string")).alias("product_id")
    )
    return audit.covers(made, orders, "product_id")


# --- vectors ----------------------------------------------------------------


def unit_vectors(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3)).alias("v")
    )
    made = scaled.select("vec_id", unit(F.col("v")).alias("u"))
    return made.select("vec_id", F.round(norm(F.col("u")), 6).alias("length"),
                       F.round(F.col("u")[0], 6).alias("first"))


def vector_report(spark, sf_dir):
    return audit.vector_audit(table(spark, sf_dir, "embeddings"), "embedding")


def nearest_vectors(spark, sf_dir):
    """The ten nearest vectors of every vector."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("vec_id").alias("chunk_id"),
        F.col("embedding").alias("vector"),
    )
    return nearest_chunks(rows, rows, 10, sparse=False).withColumnRenamed("hit_rank", "place")


def term_counts(spark, sf_dir):
    texts = table(spark, sf_dir, "documents")
    tasks = text_tasks(texts, "text")
    return term_statistics(document_terms(texts, "doc_id", "text", tasks=tasks), tasks)


def vocabulary(spark, sf_dir):
    made = fit_vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select("term", "term_id", "total", "documents", F.round("idf", 6).alias("idf"))


def term_vectors(spark, sf_dir):
    texts = table(spark, sf_dir, "documents")
    rows = weigh(texts, "doc_id", "text", fit_vocabulary(texts, "doc_id", "text"))
    entry = F.explode(F.arrays_zip("ids", "weights")).alias("e")
    return rows.select("doc_id", entry).select(
        "doc_id", F.col("e.ids").alias("term_id"), F.round("e.weights", 6).alias("weight")
    )


# --- search by chunks -------------------------------------------------------

_MADE: dict = {}


def once(spark: SparkSession, key: tuple, make):
    """Stores and answers are written once per application and read by many queries."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def stored(spark, sf_dir, dense: bool = False) -> Store:
    folder = scratch(spark, f"store-{sf_dir.rstrip('/').rsplit('/', 1)[-1]}-{'dense' if dense else 'terms'}")
    return once(
        spark, (folder,), lambda: build_store(catalog(spark, sf_dir), folder, dense=dense)
    )


def answers(spark, sf_dir, dense: bool = False) -> SearchResult:
    log = search_log(spark, sf_dir).select("query_id", "raw_query")
    return once(
        spark, ("answers", sf_dir, dense), lambda: search(log, stored(spark, sf_dir, dense))
    )


def search_items(spark, sf_dir):
    hits = F.array_join(F.col("matched_chunks.chunk_id"), ",")
    return answers(spark, sf_dir).items.select(*ITEM_COLUMNS, "distance", hits.alias("hits"))


def search_diagnostics(spark, sf_dir):
    return answers(spark, sf_dir).diagnostics.select(
        "request_id", "relaxed", "candidates_count", "retrieved_chunks_count",
        F.array_join("retrieved_chunk_ids", ",").alias("chunk_ids"),
        F.array_join("represented_product_ids", ",").alias("product_ids"),
        "unique_products_before_filtering", "count", "stored_chunks", "message",
    )


def search_answers(spark, sf_dir):
    """Items of every search of the log, from the term store."""
    return answers(spark, sf_dir).items_by_search().select(
        "query_id", "rank", "product_id", "hybrid_score"
    )


def form_items(spark, sf_dir):
    """Searches with form filters and their own top_k."""
    result = search(form_searches(spark, sf_dir), stored(spark, sf_dir))
    return result.items_by_search().select(
        "query_id", "rank", "product_id", "hybrid_score", "match_percentage"
    )


def rebuilt_items(spark, sf_dir):
    """The same searches from a store rebuilt out of an older version of itself."""
    folder = scratch(spark, f"store-{sf_dir.rstrip('/').rsplit('/', 1)[-1]}-rebuilt")

    def make() -> SearchResult:
        write_store(attribute_store(catalog(spark, sf_dir)), folder)
        build_store(load_store(spark, folder).catalog, folder)
        log = search_log(spark, sf_dir).select("query_id", "raw_query")
        return search(log, load_store(spark, folder))

    hits = F.array_join(F.col("matched_chunks.chunk_id"), ",")
    items = once(spark, (folder,), make).items
    return items.select(*ITEM_COLUMNS, "distance", hits.alias("hits"))


def vector_items(spark, sf_dir):
    """The same searches where chunks and texts come with vectors of their own, borrowed from embeddings."""
    folder = scratch(spark, f"store-{sf_dir.rstrip('/').rsplit('/', 1)[-1]}-given")

    def make() -> SearchResult:
        given = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
        many = given.agg(F.max("vec_id") + 1).scalar()
        chunks = product_chunks(catalog(spark, sf_dir)).select(
            "chunk_id", F.pmod(F.expr(fixtures.CHUNK_VECTOR_NUMBER), many).alias("vec_id")
        )
        log = search_log(spark, sf_dir).select("query_id", "raw_query")
        texts = log.groupBy(F.trim("raw_query").alias("raw_query")).agg(F.min("query_id").alias("n"))
        texts = texts.select("raw_query", F.pmod("n", many).alias("vec_id"))
        store = given_store(catalog(spark, sf_dir), chunks.join(given, "vec_id"), folder)
        return search(log, store, query_vectors=texts.join(given, "vec_id"))

    hits = F.array_join(F.col("matched_chunks.chunk_id"), ",")
    items = once(spark, (folder,), make).items
    return items.select(*ITEM_COLUMNS, "distance", hits.alias("hits"))


def result_rows(spark, sf_dir):
    return result_table(answers(spark, sf_dir).items)


def reduced_items(spark, sf_dir):
    """The same searches against vectors reduced to 384 numbers."""
    return answers(spark, sf_dir, dense=True).items.select(*ITEM_COLUMNS)


def reduced_vectors(spark, sf_dir):
    return audit.vector_audit(stored(spark, sf_dir, dense=True).chunks, "vector")


# --- explanations -----------------------------------------------------------


def evidence(spark, sf_dir):
    result = answers(spark, sf_dir)
    made = explanation_requests(result.requests, result.items)
    return made.select(
        "request_id", "request_key", "context", F.array_join("allowed_ids", ",").alias("allowed_ids")
    )


def explanations(spark, sf_dir):
    result = answers(spark, sf_dir)
    return explain(result.requests, result.items).select("request_id", "source", "text")


def answered_explanations(spark, sf_dir):
    """Outside answers, accepted or replaced; one answer serves equal requests."""
    result = answers(spark, sf_dir)
    asked = explanation_requests(result.requests, result.items)
    first = F.element_at("allowed_ids", 1)
    place = F.crc32(F.col("request_key").cast("binary")) % 4
    responses = shared_requests(asked).select(
        "request_key", F.lit("service").alias("source"),
        F.when(place == 0, F.concat(first, F.lit(" matches this request very well.")))
        .when(place == 1, F.lit("too short"))
        .when(place == 2, F.concat(F.lit("  PRD0 and "), first, F.lit(" match this request.")))
        .otherwise("No product in the evidence supports a recommendation. ").alias("text"),
    )
    return explain(result.requests, result.items, responses).select(
        "request_id", "source", "text"
    )


def response_check(spark, sf_dir):
    rows = view(spark, sf_dir, fixtures.RESPONSE_LOG).withColumn("allowed", F.array("id_a", "id_b"))
    return rows.select(
        "response_id", F.array_join(F.array_sort(cited_ids(F.col("text"))), ",").alias("cited"),
        F.array_join(F.array_sort(unknown_ids(F.col("text"), F.col("allowed"))), ",").alias("unknown"),
        acceptable(F.col("text"), F.col("allowed")).alias("accepted"),
    )


# --- audits and sessions ----------------------------------------------------


def violations(spark, sf_dir):
    return audit.violation_audit(answers(spark, sf_dir).items)


ORDER_ROWS_PER_TASK = 250_000


def order_violations(spark, sf_dir):
    """Bought products against a search of the same number: many break it."""
    bought = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"),
        F.concat(F.lit("PRD"), (F.col("l_partkey") + 1001).cast("string")).alias("product_id"),
    )
    # Explicit tasks, so that none sorts more rows of a larger table; the audit needs no further shuffle.
    tasks = tasks_for(bought, ORDER_ROWS_PER_TASK)
    products = catalog(spark, sf_dir).select("product_id", "price_inr", "category", "gender")
    items = bought.repartition(tasks, "product_id").join(products.repartition(tasks, "product_id"), "product_id")
    parsed = parse_searches(search_log(spark, sf_dir).select("query_id", "raw_query"))
    asks = parsed.select("query_id", ask_struct(["max_price", "min_price", "category", "gender"]).alias("ask"))
    met = items.repartition(tasks, "query_id").join(asks.repartition(tasks, "query_id"), "query_id")
    return audit.violation_audit(met, "query_id")


def accuracy(spark, sf_dir):
    return audit.filter_accuracy(order_violations(spark, sf_dir), F.count(F.lit(1)))


def match_rate(spark, sf_dir):
    return audit.no_match_rate(answers(spark, sf_dir).diagnostics)


def passed_checks(spark, sf_dir):
    """Summary over requests: no broken constraint and no repeated product."""
    found = order_violations(spark, sf_dir)
    kinds = ("over_price", "under_price", "wrong_category", "wrong_gender")
    checks = found.select(
        (sum((F.col(k) for k in kinds), F.lit(0)) == 0).alias("_clean"), "unique_products"
    ).select((F.col("_clean") & F.col("unique_products")).alias("passed"))
    return audit.check_summary(checks, digits=1, otherwise="FAIL", tolerated=1)


def latency(spark, sf_dir):
    return audit.latency_summary(table(spark, sf_dir, "events"), "value")


def report_lines(spark, sf_dir):
    return report_line(profile(spark, sf_dir).select("products", "duplicate_ids", "bad_prices"))


def recent(spark, sf_dir):
    return recent_searches(search_log(spark, sf_dir)).select("user_id", "place", "raw_query")
