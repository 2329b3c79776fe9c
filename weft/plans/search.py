"""A log of searches against a store: hits, ranked items, diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from weft import vocab
from weft.functions.constraints import parse_searches
from weft.functions.predicates import OPTIONAL_TERMS, passes
from weft.functions.scoring import effective_style, has_flag, rating_boost, style_place
from weft.functions.text import is_set, strip
from weft.functions.vectors import common_length, usable
from weft.operators.cells import (
    KEY, TEXT_TERMS, Cells, ask_nodes, leading_products, plan_cells, term_mask,
)
from weft.operators.chunking import product_of_chunk
from weft.operators.filters import (
    ask_struct, candidate_counts, choose_constraints, fold_ask, merge_filters, sanitize_top_k,
)
from weft.operators.joins import PRODUCTS_PER_TASK, join_by_category, measure, tasks_for
from weft.operators.nearest import Blocks, nearest_chunks
from weft.operators.ranking import price_guard, rank_by_attributes, rank_products
from weft.operators.reduction import components_from, reduce_rows
from weft.operators.terms import dense_terms, weigh
from weft.operators.variants import fold_variants, leading_variants, split_variants
from weft.session import cut_lineage
from weft.sources.store import Store

@dataclass(frozen=True)
class SearchResult:
    """Answers per distinct request, and which search asked which request."""

    requests: DataFrame
    routing: DataFrame
    items: DataFrame
    diagnostics: DataFrame

    def items_by_search(self) -> DataFrame:
        return self.routing.join(self.items, "request_id")

    def diagnostics_by_search(self) -> DataFrame:
        return self.routing.join(self.diagnostics, "request_id")


def asked(searches: DataFrame) -> DataFrame:
    """Searches as asked: stripped text, clean ``top_k``, explicit filters."""
    if "top_k" not in searches.columns:
        searches = searches.withColumn("top_k", F.lit(vocab.TOP_K))
    return searches.select(
        "query_id", strip(F.col("raw_query")).alias("raw_query"),
        sanitize_top_k(F.col("top_k")).alias("top_k"),
        *[c for c in searches.columns if c.startswith("ui_")],
    )


def request_keys(asked_searches: DataFrame) -> list[str]:
    return [c for c in asked_searches.columns if c != "query_id"]


def distinct_requests(asked_searches: DataFrame) -> DataFrame:
    """One parsed row per distinct request; a text many search is parsed once."""
    keys = request_keys(asked_searches)
    distinct = asked_searches.groupBy(*keys).agg(F.min("query_id").alias("request_id"))
    merged = merge_filters(parse_searches(distinct))
    ask = ask_struct(merged.columns)
    return merged.select("request_id", *keys, ask.alias("ask"))


def with_constraints(requests: DataFrame, variants: DataFrame) -> DataFrame:
    """Requests with the constraints in force and their number of candidates.

    The parsed requests are written first: several steps read them.
    """
    folded = cut_lineage(
        fold_ask(requests).withColumn("ask_key", F.to_json("used")), "parsed"
    )
    asks = folded.groupBy("ask_key").agg(
        F.min("request_id").alias("ask_id"), F.first("ask").alias("ask"),
        F.first("used").alias("used"),
    )
    few = asks.select("ask_id", "used")
    chosen = choose_constraints(asks, candidate_counts(few, variants, measure(few)))
    style = effective_style(F.col("ask.intent"), F.col("ask.style"))
    return folded.drop("used").join(
        chosen.select("ask_key", "used", "relaxed", "candidates"), "ask_key"
    ).withColumn("style_place", style_place(style))


def encode_requests(requests: DataFrame, store: Store, stop_words: tuple[str, ...]) -> DataFrame:
    """Vectors of the texts in the space of the store's chunks."""
    rows = weigh(requests, "text_id", "raw_query", store.vocabulary, stop_words)
    if not store.dense:
        return rows
    components = store.reduction or components_from(store.components)
    if components is not None:
        return reduce_rows(rows, components, "text_id")
    length = store.chunks.select(F.size("vector")).first()
    return dense_terms(rows, length[0] if length else vocab.VECTOR_LENGTH)


def given_requests(requests: DataFrame, store: Store, vectors: DataFrame | None) -> DataFrame:
    """Requests with the vector that the caller gives for their text (``raw_query``, ``vector``).

    Texts are compared without surrounding blanks; of several vectors of a text the least
    counts. Requests whose text has no usable vector find nothing.
    """
    if vectors is None:
        raise ValueError("the chunks of this store have given vectors: give those of the searches too")
    rows = vectors.select(
        strip(F.col("raw_query")).alias("raw_query"), F.col("vector").cast("array<double>").alias("vector")
    ).filter(usable(F.col("vector")))
    texts = requests.select("raw_query").distinct()
    mine = cut_lineage(
        rows.join(texts, "raw_query").groupBy("raw_query").agg(F.min("vector").alias("vector")), "given"
    )
    asked_length, stored_length = common_length(mine, "vector"), common_length(store.chunks, "vector")
    if None not in (asked_length, stored_length) and asked_length != stored_length:
        raise ValueError(f"searches have vectors of {asked_length} numbers, chunks of {stored_length}")
    return requests.join(mine, "raw_query").select("text_id", "vector")


# A task pairs so many requests with the hits of their texts.
REQUESTS_PER_TASK = 4096


def asking_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that have candidates, and their distinct texts.

    Hits depend on the text and their number (``fetch``) alone. So each text is searched
    once, for the most hits that one of its requests takes, and a request takes the first
    ``fetch`` of them. Texts are (text_id, raw_query, fetch, requests).
    """
    fetch = F.greatest(F.col("top_k").cast("long") * 25, F.lit(100))
    asking = requests.filter((F.col("candidates") > 0) & F.col("request_id").isNotNull()).withColumn("fetch", fetch)
    texts = cut_lineage(
        asking.groupBy("raw_query").agg(
            F.min("request_id").alias("text_id"), F.max("fetch").alias("fetch"), F.count(F.lit(1)).alias("requests")
        ),
        "texts",
    )
    named = texts.select(F.col("raw_query").alias("_text"), "text_id", "requests")
    return asking.join(named, F.col("raw_query").eqNullSafe(F.col("_text"))).drop("_text"), texts


def find_hits(
    texts: DataFrame, store: Store, most_k: int,
    stop_words: tuple[str, ...] = vocab.TERM_STOP_WORDS, blocks: Blocks | None = None,
    query_vectors: DataFrame | None = None,
) -> DataFrame:
    """Nearest chunks of every text.

    The search is over all chunks; candidates are applied to its hits.
    """
    asking = texts.select("text_id", "raw_query")
    if store.given:
        encoded = given_requests(asking, store, query_vectors)
    else:
        encoded = encode_requests(asking, store, stop_words)
    vectors = encoded.join(texts.select("text_id", "fetch"), "text_id")
    found = nearest_chunks(
        vectors, store.chunks if store.vectors is None else store.vectors, max(25 * most_k, 100), not store.dense, "text_id",
        own_n="fetch", blocks=blocks, counts=(asking.count(), store.texts.count()),
    )
    owners = store.texts.select(
        "chunk_id", product_of_chunk(F.col("product_id"), F.col("chunk_id")).alias("product_id"),
        "chunk_type",
    )
    return found.join(owners, "chunk_id")


def rank_hits(
    asking: DataFrame, hits: DataFrame, variants: DataFrame, most_k: int,
    threshold: float,
) -> DataFrame:
    """Hits to ranked products: filter, best distance per product, hybrid score.

    Requests meet the products of their text in tasks of bounded size and are ranked there:
    pairs of a request and a hit are neither written nor moved. The products of a text that
    many search are copied for each of its tasks.
    """
    hit_products = hits.select("product_id").distinct()
    near = variants.join(hit_products, "product_id", "left_semi")
    best = hits.groupBy("text_id", "product_id").agg(
        F.min("distance").alias("distance"), F.min("hit_rank").alias("first")
    )
    parts = F.ceil(F.col("requests") / REQUESTS_PER_TASK).cast("int")
    tasks = tasks_for(asking, REQUESTS_PER_TASK)
    place = ["text_id", "_part"]
    mine = asking.select(
        "request_id", "text_id", "fetch", "used", "ask", "top_k", "style_place",
        F.pmod(F.xxhash64("request_id"), parts).cast("int").alias("_part"),
    ).repartition(tasks, *place)
    copies = asking.groupBy("text_id").agg(F.first(parts).alias("_parts"))
    products = best.join(near, "product_id").join(copies, "text_id").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    ).drop("_parts").repartition(tasks, *place)
    pairs = mine.join(products.hint("merge"), place).filter(
        (F.col("first") <= F.col("fetch")) & passes(lambda t: F.col(f"used.{t}"))
    )
    own = ("ask", "top_k", "style_place", "fetch")
    folded = fold_variants(
        pairs, [*place, "request_id"], {"distance": F.min("distance"), **{c: F.first(c) for c in own}}
    )
    candidates = folded.withColumn("style_match", has_flag(F.col("styles"), F.col("style_place")))
    return rank_products(
        candidates, top_k=most_k, own_k="top_k", threshold=threshold,
        allow_unretrieved=False, few_per_query=True, key="request_id",
        keep=("ordinal", "product_id", "text_id", "fetch"), placed=tuple(place),
    )


#: Optional terms whose match earns points.
EARNING_TERMS = tuple(t for t in OPTIONAL_TERMS if t in vocab.ATTRIBUTE_POINTS)


def attribute_candidates(asking: DataFrame, plain: DataFrame, cells: Cells) -> DataFrame:
    """(request_id, product columns) of products that can be in a request's first ``top_k``.

    A relaxed request keeps its core terms only, and the optional ones it asked for
    still earn points. Each subset of these makes a cell: a product that matches just
    the subset can only be beaten there by products that match as much.
    """
    met = {t: F.col(f"used.{t}") for t in TEXT_TERMS}
    wished = F.array_compact(
        F.array(*[F.when(F.col("relaxed") & is_set(F.col(f"ask.{t}")), F.lit(t)) for t in EARNING_TERMS])
    )
    subsets = F.aggregate(
        wished, F.array(F.array().cast("array<string>")),
        lambda made, t: F.concat(made, F.transform(made, lambda one: F.array_append(one, t))),
    )
    rows = asking.withColumn("_subset", F.explode(subsets))
    for t in EARNING_TERMS:
        met[t] = F.when(F.array_contains("_subset", t), F.lower(f"ask.{t}")).otherwise(met[t])
    nodes = ask_nodes(rows, met, F.col("used.min_price"), F.col("used.max_price"), cells)
    nodes = cut_lineage(nodes.select("request_id", "style_place", "top_k", *KEY).distinct(), "asked")
    asked = nodes.groupBy(*KEY, "style_place").agg(F.max("top_k").alias("need"))
    lists = leading_products(plain.withColumn("boost", rating_boost(F.col("rating"))), asked, cells)
    found = nodes.join(lists, [*KEY, "style_place"]).filter("place <= top_k and ahead < top_k")
    return found.select("request_id", *plain.columns).dropDuplicates(["request_id", "ordinal"])


def attribute_cells(asking: DataFrame) -> Cells | None:
    """Cells of the requests' terms, with every set of earning terms beside the core ones of a relaxed one."""
    masks = F.array(term_mask({t: F.col(f"used.{t}") for t in TEXT_TERMS}))
    for t in EARNING_TERMS:
        bit = F.when(F.col("relaxed") & is_set(F.col(f"ask.{t}")), 1 << TEXT_TERMS.index(t)).otherwise(0)
        masks = F.array_union(masks, F.transform(masks, lambda m: m + bit))
    return plan_cells(asking, masks)


def rank_attributes(
    requests: DataFrame, variants: DataFrame, most_k: int, threshold: float
) -> DataFrame:
    """Ranked products without vectors, from the leading products of each request's price nodes.

    Ids with several filter profiles, and all products where the requests' bounds are
    too many to be planned, meet the requests one by one.
    """
    plain, changing = split_variants(variants)
    asking = requests.filter((F.col("candidates") > 0) & (F.col("top_k") > 0)).select(
        "request_id", "ask", "used", "top_k", "style_place", "relaxed"
    )
    size = measure(asking)
    condition = passes(lambda t: F.col(f"used.{t}"))

    def join(products: DataFrame, tasks: int | None = None) -> DataFrame:
        return join_by_category(asking, products, condition, "used", size, "product_id", tasks=tasks)

    # Folded in the tasks that paired them, narrow: the asks join the products that are left.
    kept = ["ask", "top_k", "style_place"]
    folded = fold_variants(join(changing, tasks_for(changing, PRODUCTS_PER_TASK)), ["request_id"])
    repeated = folded.join(asking.select("request_id", *kept), "request_id")
    cells = attribute_cells(asking)
    if cells is None:
        single = join(leading_variants(plain, most_k))
    else:
        single = attribute_candidates(asking, plain, cells).join(asking.select("request_id", *kept), "request_id")
    candidates = single.select(*repeated.columns).unionByName(repeated).withColumn(
        "style_match", has_flag(F.col("styles"), F.col("style_place"))
    )
    return rank_by_attributes(
        candidates, top_k=most_k, own_k="top_k", threshold=threshold, key="request_id",
        keep=("ordinal", "product_id"),
    )


def attach_products(ranked: DataFrame, requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Full catalog rows and the ask for the ranked products."""
    wanted = requests.select(
        "request_id", "ask", F.struct("used.max_price", "used.min_price").alias("_bounds")
    )
    products = catalog.drop("product_id")
    items = ranked.join(products, "ordinal").join(wanted, "request_id")
    return price_guard(items, "_bounds").drop("_bounds")


def matched_chunks(ranked: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked products with their chunks among the request's hits, nearest first.

    Chunks are listed once per text and product. A text has at most n hits, and only hits of
    ranked products meet the chunk texts.
    """
    wanted = ranked.select("text_id", "product_id").distinct()
    mine = hits.join(wanted, ["text_id", "product_id"], "left_semi")
    texts = mine.join(chunks.select("chunk_id", "text"), "chunk_id")
    entry = F.struct("distance", "chunk_id", "text", "chunk_type", "hit_rank")
    listed = texts.groupBy("text_id", "product_id").agg(F.sort_array(F.collect_list(entry)).alias("_listed"))
    own = F.filter("_listed", lambda e: e["hit_rank"] <= F.col("fetch"))
    return ranked.join(listed, ["text_id", "product_id"]).withColumn(
        "matched_chunks", F.transform(own, lambda e: e.dropFields("hit_rank"))
    ).drop("_listed", "text_id", "fetch")


def diagnose(
    requests: DataFrame, asking: DataFrame | None, hits: DataFrame | None, ranked: DataFrame, store: Store
) -> DataFrame:
    """Counts, first hits and message per request; requests without items stay."""
    returned = ranked.groupBy("request_id").agg(F.count(F.lit(1)).alias("count"))
    base = requests.select(
        "request_id", "raw_query", "ask", "relaxed", F.col("candidates").alias("candidates_count")
    ).join(returned, "request_id", "left")
    if hits is not None:
        # Requests of one text that take as many hits share their counts.
        kinds = asking.select("text_id", F.col("fetch").alias("_fetch")).distinct()
        taken = hits.join(kinds, "text_id").filter("hit_rank <= _fetch")
        kind = ["text_id", "_fetch"]
        first = F.when(F.col("hit_rank") <= 15, F.struct("hit_rank", "chunk_id"))
        chunks = taken.groupBy(*kind).agg(
            F.count(F.lit(1)).alias("retrieved_chunks_count"),
            F.sort_array(F.collect_list(first)).alias("_first"),
        ).select(
            *kind, "retrieved_chunks_count",
            F.col("_first.chunk_id").alias("retrieved_chunk_ids"),
        )
        # Products are made distinct before they are counted; only the first 15 become a list.
        order = Window.partitionBy(*kind).orderBy("product_id")
        products = taken.filter("product_id is not null").select(*kind, "product_id").distinct()
        least = products.withColumn("_place", F.row_number().over(order)).filter("_place <= 15")
        found = chunks.join(
            products.groupBy(*kind).agg(
                F.count(F.lit(1)).cast("int").alias("unique_products_before_filtering")
            ),
            kind, "left",
        ).join(
            least.groupBy(*kind).agg(
                F.array_sort(F.collect_list("product_id")).alias("represented_product_ids")
            ),
            kind, "left",
        )
        found = asking.select("request_id", "text_id", F.col("fetch").alias("_fetch")).join(found, kind).drop(*kind)
        base = base.join(found, "request_id", "left")
        stored = store.texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    else:
        base = base.withColumns(
            {
                "retrieved_chunks_count": F.lit(0),
                "retrieved_chunk_ids": F.array().cast("array<string>"),
                "represented_product_ids": F.array().cast("array<string>"),
                "unique_products_before_filtering": F.lit(0),
            }
        )
        stored = F.lit(0).cast("long")
    none = F.array().cast("array<string>")
    returned_count = F.coalesce(F.col("count"), F.lit(0))
    return base.select(
        "request_id", "raw_query", "ask", "relaxed", "candidates_count",
        F.coalesce("retrieved_chunks_count", F.lit(0)).alias("retrieved_chunks_count"),
        F.coalesce("retrieved_chunk_ids", none).alias("retrieved_chunk_ids"),
        F.coalesce("represented_product_ids", none).alias("represented_product_ids"),
        F.coalesce("unique_products_before_filtering", F.lit(0)).alias(
            "unique_products_before_filtering"
        ),
        returned_count.alias("count"),
        F.lit(hits is not None).alias("vector_search_active"),
        stored.alias("stored_chunks"),
        status_message(F.col("candidates_count"), returned_count).alias("message"),
    )


def status_message(candidates, returned):
    return (
        F.when(candidates == 0, vocab.MESSAGE_NO_CANDIDATE)
        .when(returned == 0, vocab.MESSAGE_BELOW_THRESHOLD)
        .otherwise(vocab.MESSAGE_OK)
    )


def search(
    searches: DataFrame, store: Store, threshold: float = vocab.SCORE_THRESHOLD,
    stop_words: tuple[str, ...] = vocab.TERM_STOP_WORDS, blocks: Blocks | None = None,
    query_vectors: DataFrame | None = None,
) -> SearchResult:
    """Answer a table of searches (query_id, raw_query, optional top_k and ui_*).

    ``query_vectors`` (raw_query, vector) are needed where the store's vectors were given.

    The distinct requests, their hits and the few ranked products are read by
    several later steps, so each is written once to the checkpoint folder; the log
    itself joins last.
    """
    log = asked(searches)
    requests = cut_lineage(with_constraints(distinct_requests(log), store.variants), "requests")
    most_k = measure(requests.select("top_k"), most="top_k").most or 0
    asking = hits = None
    if store.has_vectors:
        asking, texts = asking_requests(requests)
        hits = cut_lineage(find_hits(texts, store, most_k, stop_words, blocks, query_vectors), "hits")
        ranked = cut_lineage(
            rank_hits(asking, hits, store.variants, most_k, threshold), "ranked"
        )
        items = attach_products(matched_chunks(ranked, hits, store.texts), requests, store.catalog)
    else:
        ranked = cut_lineage(
            rank_attributes(requests, store.variants, most_k, threshold), "ranked"
        )
        empty = "array<struct<distance:double,chunk_id:string,text:string,chunk_type:string>>"
        items = attach_products(ranked, requests, store.catalog).withColumn(
            "matched_chunks", F.array().cast(empty)
        )
    diagnostics = diagnose(requests, asking, hits, ranked, store)
    keys = request_keys(log)
    answered = requests.select("request_id", *[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    routing = log.join(answered, same).select("query_id", "request_id")
    return SearchResult(requests, routing, items, diagnostics)
