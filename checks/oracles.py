"""Oracle SQL per registered query."""

from __future__ import annotations

from checks.fixtures import (
    CATALOG, CHUNK_VECTOR_NUMBER, DIRTY_CATALOG, FORM_LOG, REPEATED_CATALOG, RESPONSE_LOG, SEARCH_LOG, WANTED,
    quoted,
)
from checks.oracle_parts import (
    CHUNKS, candidates_cte, catalog_cte, effective, is_domain, parsed, raw_score,
    requests_cte, round4, style_match, terms_cte, vocabulary_cte, weights_cte,
)
from weft import vocab

FIELDS = (
    "max_price, min_price, gender, category, subcategory, intent, color, fit, material, "
    "season, style"
)

PARSE = parsed(SEARCH_LOG, "query_id, raw_query")
PARSE_DOCUMENTS = parsed("SELECT doc_id AS query_id, text AS raw_query FROM documents", "query_id")

LABELS = " || ".join(
    [
        "CASE WHEN max_price <> 0 THEN ' • Max Price: ₹' || CAST(CAST(trunc(max_price) AS BIGINT) AS VARCHAR) ELSE '' END",
        "CASE WHEN min_price <> 0 THEN ' • Min Price: ₹' || CAST(CAST(trunc(min_price) AS BIGINT) AS VARCHAR) ELSE '' END",
        *[
            f"CASE WHEN {c} IS NOT NULL THEN ' • {c.title()}: ' || {c} ELSE '' END"
            for c in ("gender", "category", "color", "fit", "material")
        ],
    ]
)

COLUMNS = (
    "product_id, product_name, category, subcategory, gender, color, size, fit, material, "
    "brand, price_inr, rating, season, description"
)
TEXTS = tuple(c for c in COLUMNS.split(", ") if c not in ("price_inr", "rating"))

# --- form filters -----------------------------------------------------------

FORM_PARSED = parsed(
    f"""SELECT query_id, raw_query, nullif(gender, 'All') AS ui_gender, nullif(category, 'All') AS ui_category,
  nullif(color, 'All') AS ui_color, nullif(fit, 'All') AS ui_fit, nullif(material, 'All') AS ui_material,
  CASE WHEN low_price > 0 THEN CAST(low_price AS DOUBLE) END AS ui_min,
  CASE WHEN high_price < 6000 THEN CAST(high_price AS DOUBLE) END AS ui_max,
  greatest(coalesce(TRY_CAST(top_k AS INT), 4), 0) AS top_k FROM ({FORM_LOG}) AS f""",
    "query_id, raw_query, ui_gender, ui_category, ui_color, ui_fit, ui_material, ui_min, ui_max, top_k",
)
FORM_MERGED = f"""SELECT query_id, raw_query, top_k, least(max_price, ui_max) AS max_price,
  greatest(min_price, ui_min) AS min_price, coalesce(ui_gender, gender) AS gender,
  coalesce(ui_category, category) AS category, coalesce(ui_color, color) AS color,
  coalesce(ui_fit, fit) AS fit, coalesce(ui_material, material) AS material, season, style, intent
FROM ({FORM_PARSED}) AS m"""

# --- catalog ----------------------------------------------------------------

MISSING = ", ".join(quoted(t) for t in vocab.MISSING_TOKENS)
NUMERIC = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def numeric(column: str) -> str:
    return (
        f"CASE WHEN regexp_matches({column}, {NUMERIC}) THEN TRY_CAST(trim({column}) AS DOUBLE) END"
    )


def cleaned(source: str, extra: str = "") -> str:
    texts = ", ".join(
        f"CASE WHEN {c} IS NULL OR {c} IN ({MISSING}) THEN '' ELSE "
        f"regexp_replace({c}, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g') END AS {c}"
        for c in TEXTS
    )
    return f"""SELECT {extra}{texts}, {numeric('price_inr')} AS price_inr,
  coalesce({numeric('rating')}, 4e0) AS rating FROM ({source}) AS d WHERE {numeric('price_inr')} > 0"""


CLEANED = cleaned(DIRTY_CATALOG, "ordinal, ")
LOOKUP = f"""SELECT * EXCLUDE (place) FROM (
  SELECT c.*, row_number() OVER (PARTITION BY product_id ORDER BY ordinal) AS place
  FROM ({REPEATED_CATALOG}) AS c WHERE product_id IN ({WANTED})) AS x WHERE place = 1"""
PROFILE = f"""SELECT count(*) AS products, count(*) - count(DISTINCT product_id) AS duplicate_ids,
  min(price_inr) AS min_price, max(price_inr) AS max_price, round(avg(price_inr), 2) AS avg_price,
  {', '.join(f"count(*) FILTER (WHERE {c} IS NULL) AS missing_{c}" for c in COLUMNS.split(', '))},
  count(*) FILTER (WHERE price_inr <= 0) AS bad_prices,
  count(*) FILTER (WHERE price_inr > 6000) AS above_6000,
  count(*) FILTER (WHERE price_inr > 10000) AS above_10000,
  count(*) FILTER (WHERE price_inr > 20000) AS above_20000
FROM ({REPEATED_CATALOG}) AS c"""
VALUE_COLUMNS = ("category", "brand", "gender", "color", "fit", "material")
VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS products FROM ({CATALOG}) AS c GROUP BY {c}"
    for c in VALUE_COLUMNS
)
DISTINCT = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM ({CATALOG}) AS c"
    for c in VALUE_COLUMNS
)

# --- candidates -------------------------------------------------------------


def with_search(select: str, catalog: str = CATALOG) -> str:
    """Query over the parsed requests, the products and their candidates."""
    return (
        f"WITH {requests_cte()}, p AS MATERIALIZED ({catalog}), {candidates_cte()} {select}"
    )


CANDIDATES = """SELECT q.request_id, q.request_id IN (SELECT request_id FROM hopeless) AS relaxed, coalesce(k.n, 0) AS candidates
FROM q LEFT JOIN (SELECT c.request_id, count(DISTINCT p.product_id) AS n FROM candidate c JOIN p USING (ordinal) GROUP BY 1) AS k USING (request_id)"""
BRAND = f"""WITH r AS (SELECT c_custkey AS request_id, 'brand#' || CAST(c_custkey % 25 + 1 AS VARCHAR) AS brand,
  CASE WHEN c_custkey % 3 = 0 THEN 'party' ELSE '' END AS subcategory,
  CAST(CAST(trunc(c_acctbal) AS INT) % 5000 AS DOUBLE) AS max_price,
  CASE WHEN c_nationkey % 2 = 0 THEN 'women' END AS gender FROM customer)
SELECT r.request_id, p.ordinal FROM r JOIN ({CATALOG}) AS p ON lower(p.brand) = r.brand
  AND contains(lower(p.subcategory), r.subcategory) AND p.price_inr <= r.max_price
  AND (r.gender IS NULL OR lower(p.gender) IN (r.gender, 'unisex'))"""

# One row per request and candidate product: first position, last row's values.
FOLDED = """
folded AS MATERIALIZED (SELECT c.request_id, p.product_id, min(p.ordinal) AS position, max(p.ordinal) AS ordinal
  FROM candidate c JOIN p USING (ordinal) GROUP BY c.request_id, p.product_id)"""


def ranked_by_attributes(catalog: str) -> str:
    return f"""WITH {requests_cte()}, p AS MATERIALIZED ({catalog}), {candidates_cte()}, {FOLDED},
styled AS (SELECT f.request_id, f.position, f.ordinal, {style_match(effective('q'), 'p')} AS sm
  FROM folded f JOIN q USING (request_id) JOIN p ON p.ordinal = f.ordinal),
scored AS (SELECT s.request_id, s.position, s.ordinal, {raw_score('q', 'p', '0e0', 's.sm')} AS raw
  FROM styled s JOIN q USING (request_id) JOIN p ON p.ordinal = s.ordinal),
kept AS (SELECT *, {round4('raw')} AS hybrid_score FROM scored),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hybrid_score DESC, position) AS rank
  FROM kept WHERE hybrid_score >= 0.2e0 QUALIFY rank <= 4)"""


def item(sim: str, evidence: str) -> str:
    return f"""ranked.request_id, rank, p.product_id, p.ordinal, p.price_inr, p.rating, {sim} AS semantic_similarity,
  {evidence} AS has_retrieved_evidence, hybrid_score, CAST(trunc(hybrid_score * 100) AS INT) AS match_percentage"""


ROUTING = f"""(SELECT l.query_id, q.request_id FROM ({SEARCH_LOG}) AS l JOIN q ON q.raw_query = trim(l.raw_query))"""

# --- texts and vectors ------------------------------------------------------

FULL_TEXT = """'Product: ' || product_name || ' | Brand: ' || brand || ' | Category: ' || category || ' | Subcategory: ' || subcategory
  || ' | Gender: ' || gender || ' | Color: ' || color || ' | Size: ' || size || ' | Fit: ' || fit || ' | Material: ' || material
  || ' | Season: ' || season || ' | Price: Rs ' || CAST(CAST(price_inr AS BIGINT) AS VARCHAR) || ' | Rating: ' || CAST(rating AS VARCHAR)
  || ' | Description: ' || description"""


def literal(text: str) -> str:
    return quoted(text).replace("\n", "' || chr(10) || '")


def splitter(source: str, key: str, size: int, overlap: int) -> str:
    """Recursive walk over each text of ``source`` (key, text): key, pos, piece."""
    least = int(size * 0.3)
    cuts = []
    for d in vocab.SPLIT_DELIMITERS:
        # last place of the delimiter in the window, 0-based; -1 if absent
        back = f"strpos(reverse(win), {literal(d[::-1])})"
        place = f"(CASE WHEN {back} = 0 THEN -1 ELSE {size + 1 - len(d)} - {back} END)"
        cuts.append(f"WHEN {place} > {least} THEN pos + {place} + {len(d)}")
    cut = f"CASE {' '.join(cuts)} ELSE pos + {size} END"
    strip = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    return f"""
WITH RECURSIVE src AS MATERIALIZED (SELECT {key}, {strip.format('text')} AS t FROM ({source}) AS s),
walk({key}, pos, cut, done) AS (
  SELECT {key}, 0, CASE WHEN length(t) <= {size} THEN length(t) ELSE ({cut}) END, length(t) <= {size}
  FROM (SELECT {key}, t, 0 AS pos, substr(t, 1, {size}) AS win FROM src) AS a
  UNION ALL
  SELECT {key}, pos, CASE WHEN pos + {size} >= length(t) THEN length(t) ELSE ({cut}) END, pos + {size} >= length(t)
  FROM (SELECT w.{key}, s.t, greatest(w.pos + 1, w.cut - {overlap}) AS pos,
      substr(s.t, greatest(w.pos + 1, w.cut - {overlap}) + 1, {size}) AS win
    FROM walk w JOIN src s USING ({key}) WHERE NOT w.done) AS b
)
SELECT w.{key}, w.pos, {strip.format('substr(s.t, w.pos + 1, w.cut - w.pos)')} AS piece
FROM walk w JOIN src s USING ({key})"""


def numbered(split: str, key: str) -> str:
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pos) - 1 AS chunk_index,
  count(*) OVER (PARTITION BY {key}) AS total_chunks, piece AS text FROM ({split}) AS w WHERE piece <> ''"""


DOCUMENT_CHUNKS = f"""SELECT doc_id, CAST(doc_id AS VARCHAR) || '_chunk_' || CAST(chunk_index AS VARCHAR) AS chunk_id,
  chunk_index, total_chunks, text FROM ({numbered(splitter('SELECT doc_id, text FROM documents', 'doc_id', 400, 50), 'doc_id')}) AS n"""

HEAD = "'Product: ' || product_name || ' | Brand: ' || brand || ' | Category: ' || category || ' | Description: '"
DESCRIPTIONS = splitter(f"SELECT product_id, description AS text FROM ({CATALOG}) AS c", "product_id", 60, 10)
TIGHT = f"""SELECT product_id || '_chunk_' || CAST(chunk_index AS VARCHAR) AS chunk_id, product_id, chunk_index,
  count(*) OVER (PARTITION BY product_id) AS total_chunks, chunk_type, text, chunk_index AS meta_index FROM (
  SELECT product_id, chunk_type, text, row_number() OVER (PARTITION BY product_id ORDER BY part, pos) - 1 AS chunk_index FROM (
    SELECT p.product_id, 'identity_description' AS chunk_type, 0 AS part, s.chunk_index AS pos, {HEAD} || s.text AS text
    FROM ({CATALOG}) AS p JOIN ({numbered(DESCRIPTIONS, 'product_id')}) AS s USING (product_id)
    UNION ALL
    SELECT product_id, chunk_type, chunk_index, 0, text FROM ({CHUNKS}) AS c WHERE chunk_index > 0) AS u) AS v"""

LINKED = "SELECT 'PRD' || CAST(l_partkey * 2 + 1001 AS VARCHAR) AS product_id FROM lineitem"
COVERAGE = f"""SELECT product_id, 'left' AS only_in FROM ({CATALOG}) AS c WHERE product_id NOT IN ({LINKED})
UNION ALL SELECT DISTINCT product_id, 'right' FROM ({LINKED}) AS l WHERE product_id NOT IN (SELECT product_id FROM ({CATALOG}) AS c)"""

UNIT = """SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS length, round(u[1], 6) AS first
FROM (SELECT vec_id, list_transform(v, lambda x: x / (CASE WHEN n = 0 THEN 1e0 ELSE n END)) AS u
FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 3)) AS v FROM embeddings) AS a) AS b) AS c"""
NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))"
VECTORS = f"""SELECT count(*) AS vectors, min(len(embedding)) AS min_length, max(len(embedding)) AS max_length,
  round(min({NORM}), 4) AS min_norm, round(max({NORM}), 4) AS max_norm,
  count(*) FILTER (WHERE abs({NORM} - 1) > 1e-4) AS not_unit FROM embeddings"""
NEAREST = """WITH e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(1 - list_cosine_similarity(a.v, b.v), 6) + 0e0 AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(a.v, b.v), 6), b.vec_id) AS place
FROM e a, e b QUALIFY place <= 10"""

DOC_TERMS = terms_cte("SELECT doc_id, text FROM documents", "doc_id", "dt")
DOC_VOCABULARY = vocabulary_cte("dt", "SELECT doc_id FROM documents", "v", vocab.MAX_TERMS)

# --- search by chunks -------------------------------------------------------


def placed_cte(sims: str) -> str:
    """The nearest chunks of each text, from the similarities of ``sims``."""
    return f"""placed AS MATERIALIZED (SELECT t.text_id, t.raw_query, c.chunk_id, round(1 - coalesce(s.s, 0), 6) + 0e0 AS distance,
  row_number() OVER (PARTITION BY t.text_id ORDER BY round(1 - coalesce(s.s, 0), 6), c.chunk_id) AS hit_rank
  FROM texts t CROSS JOIN (SELECT chunk_id FROM c) AS c {sims} JOIN sims s ON s.text_id = t.text_id AND s.chunk_id = c.chunk_id
  QUALIFY hit_rank <= t.most)"""


TERM_SIMS = f"""{terms_cte('SELECT chunk_id, text FROM c', 'chunk_id', 'ct')},
{vocabulary_cte('ct', 'SELECT chunk_id FROM c', 'v', vocab.MAX_TERMS)},
{weights_cte('ct', 'v', 'chunk_id', 'cw')},
{terms_cte('SELECT text_id, raw_query AS text FROM texts', 'text_id', 'qt')},
{weights_cte('qt', 'v', 'text_id', 'qw')},
sims AS (SELECT text_id, chunk_id, sum(qw.w * cw.w) AS s FROM qw JOIN cw USING (term_id) GROUP BY text_id, chunk_id),
{placed_cte('LEFT')}"""
GIVEN_SIMS = f"""e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
ce AS MATERIALIZED (SELECT c.chunk_id, e.vec_id FROM c JOIN e ON e.vec_id = {CHUNK_VECTOR_NUMBER} % (SELECT max(vec_id) + 1 FROM embeddings)),
qe AS MATERIALIZED (SELECT t.text_id, e.vec_id FROM texts t JOIN (SELECT trim(raw_query) AS raw_query, min(query_id) AS n
  FROM ({SEARCH_LOG}) AS l GROUP BY 1) m USING (raw_query) JOIN e ON e.vec_id = m.n % (SELECT max(vec_id) + 1 FROM embeddings)),
pairs AS MATERIALIZED (SELECT a.vec_id AS query_vec, b.vec_id AS chunk_vec, list_cosine_similarity(a.vector, b.vector) AS s FROM e a, e b),
sims AS (SELECT qe.text_id, ce.chunk_id, s FROM pairs JOIN qe ON qe.vec_id = query_vec JOIN ce ON ce.vec_id = chunk_vec),
{placed_cte('INNER')}"""


def found(requests: str, sims: str = TERM_SIMS) -> str:
    """Requests, products, candidates, hits and ranking over term vectors or given ones."""
    return f"""WITH {requests}, {catalog_cte()}, {candidates_cte()},
c AS MATERIALIZED ({CHUNKS}),
asking AS MATERIALIZED (SELECT * FROM q WHERE request_id IN (SELECT request_id FROM candidate)),
texts AS MATERIALIZED (SELECT min(request_id) AS text_id, raw_query, max(greatest(25 * top_k, 100)) AS most FROM asking GROUP BY raw_query),
{sims},
hits AS MATERIALIZED (SELECT a.request_id, n.chunk_id, c.product_id, c.chunk_type, c.text, n.distance, n.hit_rank
  FROM asking a JOIN placed n USING (raw_query) JOIN c USING (chunk_id) WHERE n.hit_rank <= greatest(25 * a.top_k, 100)),
best AS MATERIALIZED (SELECT h.request_id, p.ordinal, min(h.distance) AS distance FROM hits h JOIN p USING (product_id)
  JOIN candidate k ON k.request_id = h.request_id AND k.ordinal = p.ordinal GROUP BY h.request_id, p.ordinal),
styled AS (SELECT b.*, {style_match(effective('q'), 'p')} AS sm FROM best b JOIN q USING (request_id) JOIN p USING (ordinal)),
evident AS (SELECT *, bool_or(sm) OVER (PARTITION BY request_id) AS any_styled, greatest(0e0, 1 - distance) AS sim FROM styled),
scored AS (SELECT e.*, coalesce(q.intent NOT IN ('broad clothing', 'budget clothing'), FALSE) AS specific, q.top_k,
  {raw_score('q', 'p', 'e.sim', 'e.sm')} AS raw FROM evident e JOIN q USING (request_id) JOIN p USING (ordinal)),
rounded AS (SELECT *, {round4('raw')} AS hybrid_score, {round4('sim')} AS semantic_similarity FROM scored
  WHERE NOT (specific AND any_styled AND NOT sm)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hybrid_score DESC, ordinal) AS rank
  FROM rounded WHERE hybrid_score >= 0.2e0 OR (NOT any_styled AND specific AND sim > 0) QUALIFY rank <= top_k),
matched AS (SELECT h.request_id, h.product_id, string_agg(h.chunk_id, ',' ORDER BY h.distance, h.chunk_id) AS hits, count(*) AS n_hits,
    list(h.text ORDER BY h.distance, h.chunk_id) AS texts
  FROM hits h JOIN p USING (product_id) JOIN ranked r ON r.request_id = h.request_id AND r.ordinal = p.ordinal GROUP BY h.request_id, h.product_id)"""


FOUND = found(requests_cte())
MATCHED = "matched ON matched.request_id = ranked.request_id AND matched.product_id = p.product_id"
MESSAGE = f"""CASE WHEN candidates_count = 0 THEN {quoted(vocab.MESSAGE_NO_CANDIDATE)}
  WHEN "count" = 0 THEN {quoted(vocab.MESSAGE_BELOW_THRESHOLD)} ELSE 'Success' END"""
DIAGNOSTICS = f"""{FOUND}
SELECT *, {MESSAGE} AS message FROM (SELECT q.request_id, q.request_id IN (SELECT request_id FROM hopeless) AS relaxed,
  coalesce(k.n, 0) AS candidates_count, coalesce(h.n, 0) AS retrieved_chunks_count, coalesce(h.chunk_ids, '') AS chunk_ids,
  coalesce(h.product_ids, '') AS product_ids, coalesce(h.products, 0) AS unique_products_before_filtering,
  coalesce(r.n, 0) AS "count", (SELECT count(*) FROM c) AS stored_chunks
FROM q LEFT JOIN (SELECT request_id, count(*) AS n FROM candidate GROUP BY 1) k USING (request_id)
LEFT JOIN (SELECT request_id, count(*) AS n FROM ranked GROUP BY 1) r USING (request_id)
LEFT JOIN (SELECT request_id, count(*) AS n, count(DISTINCT product_id) AS products,
    string_agg(chunk_id, ',' ORDER BY hit_rank) FILTER (WHERE hit_rank <= 15) AS chunk_ids,
    array_to_string(list_slice(list_sort(list_distinct(list(product_id))), 1, 15), ',') AS product_ids
  FROM hits GROUP BY 1) h USING (request_id)) AS d"""

FORM_REQUESTS = f"""forms AS MATERIALIZED ({FORM_MERGED}),
q AS MATERIALIZED (SELECT min(query_id) AS request_id, raw_query, max_price, min_price, gender, category, intent, color, fit, material, season, style, top_k
  FROM forms GROUP BY ALL)"""
SAME = " AND ".join(
    f"f.{c} IS NOT DISTINCT FROM q.{c}"
    for c in ("raw_query", "top_k", "max_price", "min_price", "gender", "category", "color", "fit", "material")
)

# --- explanations -----------------------------------------------------------

LINE = "'RETRIEVED PRODUCT ' || CAST(r.rank AS VARCHAR) || chr(10) || " + " || ' | ' || ".join(
    f"'{c}=' || " + (
        "CAST(CAST(p.price_inr AS BIGINT) AS VARCHAR)" if c == "price_inr"
        else f"CAST(p.{c} AS VARCHAR)"
    )
    for c in vocab.EVIDENCE_FIELDS
) + (
    " || chr(10) || 'retrieved_chunk_evidence:' || chr(10) || "
    "array_to_string(list_transform(m.texts[1:3], lambda t: left(t, 1200)), chr(10))"
)
EXPLAINED = f"""{FOUND},
top2 AS MATERIALIZED (SELECT r.request_id, r.rank, r.hybrid_score, CAST(trunc(r.hybrid_score * 100) AS INT) AS pct, p.*, {LINE} AS line
  FROM ranked r JOIN p USING (ordinal) JOIN matched m ON m.request_id = r.request_id AND m.product_id = p.product_id WHERE r.rank <= 2)"""
EVIDENCE = f"""{EXPLAINED}
SELECT q.request_id, lower(q.raw_query) || '|' || coalesce(t.ids, '') AS request_key, t.context, replace(t.ids, '|', ',') AS allowed_ids
FROM q LEFT JOIN (SELECT request_id, left(string_agg(line, chr(10) || chr(10) ORDER BY rank), 12000) AS context,
  string_agg(product_id, '|' ORDER BY rank) AS ids FROM top2 GROUP BY 1) t USING (request_id)"""
WORDS = """array_to_string(list_filter([
  CASE WHEN contains(lower(t.gender), lower(q.gender)) THEN t.gender || '''s' END,
  CASE WHEN contains(lower(t.color), lower(q.color)) THEN lower(t.color) END,
  CASE WHEN contains(lower(t.fit), lower(q.fit)) THEN CASE WHEN ends_with(lower(t.fit), 'fit') THEN lower(t.fit) ELSE lower(t.fit) || ' fit' END END,
  CASE WHEN contains(lower(t.material), lower(q.material)) THEN lower(t.material) END,
  CASE WHEN q.category IS NOT NULL THEN lower(t.category) END,
  CASE WHEN contains(lower(t.season), lower(q.season)) THEN 'for ' || lower(t.season) END,
  CASE WHEN q.max_price <> 0 AND t.price_inr <= q.max_price THEN 'under ₹' || CAST(CAST(trunc(q.max_price) AS BIGINT) AS VARCHAR) END
], lambda w: w IS NOT NULL), ' ')"""
REASONS = f"""{EXPLAINED},
worded AS (SELECT t.*, coalesce(nullif({WORDS}, ''), t.category) AS about FROM top2 t JOIN q USING (request_id)),
reasons AS (SELECT request_id, string_agg('**' || CAST(rank AS VARCHAR) || '. ' || CASE WHEN starts_with(product_name, brand) THEN product_name ELSE brand || ' ' || product_name END
  || '**' || chr(10) || chr(10) || CASE WHEN rank = 1
  THEN 'Recommended because it closely matches your request for ' || about || ' and has a strong relevance score (' || CAST(pct AS VARCHAR) || '% Match).'
  ELSE 'Recommended because it matches your requested ' || about || ' with high relevance to your search (' || CAST(pct AS VARCHAR) || '% Match).' END,
  chr(10) || chr(10) ORDER BY rank) AS text FROM worded GROUP BY request_id)
SELECT q.request_id, CASE WHEN r.text IS NULL THEN 'System' ELSE {quoted(vocab.SOURCE_TEMPLATE)} END AS source,
  coalesce(r.text, {quoted(vocab.TEXT_NO_ITEMS)}) AS text FROM q LEFT JOIN reasons r USING (request_id)"""
CITED = "list_sort(list_distinct(regexp_extract_all(' ' || upper(text), '[^\\p{L}\\p{N}_](PRD[0-9]+)\\b', 1)))"
RESPONSES = f"""SELECT response_id, array_to_string(cited, ',') AS cited, array_to_string(bad, ',') AS "unknown",
  length(trim(text)) > 30 AND len(bad) = 0 AS accepted
FROM (SELECT *, list_filter(cited, lambda x: x NOT IN (upper(id_a), upper(id_b))) AS bad
FROM (SELECT *, {CITED} AS cited FROM ({RESPONSE_LOG}) AS r) AS a) AS b"""

# --- audits and sessions ----------------------------------------------------


def audited(items: str, key: str) -> str:
    """Broken constraints per key of ``items`` joined with asks ``q`` and products ``p``."""
    return f"""SELECT {key}, count(*) AS items, count(*) = count(DISTINCT p.product_id) AS unique_products,
  count(*) FILTER (WHERE p.price_inr > q.max_price) AS over_price, count(*) FILTER (WHERE p.price_inr < q.min_price) AS under_price,
  count(*) FILTER (WHERE lower(p.category) <> q.category) AS wrong_category,
  count(*) FILTER (WHERE lower(p.gender) NOT IN (lower(q.gender), 'unisex')) AS wrong_gender
FROM {items} GROUP BY {key}"""


ORDER_AUDIT = f"""(WITH q AS MATERIALIZED ({PARSE}), p AS MATERIALIZED ({CATALOG}) {audited('lineitem l JOIN q ON q.query_id = l.l_orderkey JOIN p ON p.ordinal = l.l_partkey', 'query_id')})"""
BROKEN = "(over_price + under_price + wrong_category + wrong_gender)"
RECENT = f"""WITH f AS (SELECT user_id, trim(raw_query) AS raw_query, min(ts) AS first_ts FROM ({SEARCH_LOG}) AS l GROUP BY 1, 2),
ok AS (SELECT raw_query FROM (SELECT raw_query, ({is_domain()}) AS good FROM ({parsed('SELECT DISTINCT raw_query FROM f', 'raw_query')}) AS x) AS y WHERE good)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first_ts DESC, raw_query) AS place, raw_query
FROM f WHERE raw_query IN (SELECT raw_query FROM ok) QUALIFY place <= 5"""

ORACLES = {
    "parse": f"SELECT query_id, raw_query, {FIELDS}, cleaned_query FROM ({PARSE}) AS x",
    "domain_gate": f"SELECT query_id, ({is_domain()}) AS is_clothing FROM ({PARSE}) AS x",
    "domain_gate_documents": f"SELECT query_id, {FIELDS}, ({is_domain()}) AS is_clothing FROM ({PARSE_DOCUMENTS}) AS x",
    "labels": f"SELECT query_id, substr({LABELS}, 4) AS labels FROM ({PARSE}) AS x",
    "merged_filters": f"SELECT query_id, top_k, max_price, min_price, gender, category, color, fit, material, season FROM ({FORM_MERGED}) AS m",
    "cleaned_catalog": CLEANED,
    "catalog_csv": cleaned(DIRTY_CATALOG),
    "product_lookup": LOOKUP,
    "profile": PROFILE,
    "catalog_values": VALUES,
    "catalog_distinct": DISTINCT,
    "filter_record": f"""SELECT ordinal, {COLUMNS} FROM ({CATALOG}) AS c WHERE price_inr <= 5000 AND price_inr >= 500
  AND lower(gender) IN ('men', 'unisex') AND category = 'jeans' AND contains(lower(subcategory), 'c')""",
    "strict_matches": with_search("SELECT request_id, ordinal FROM strict_match"),
    "brand_matches": BRAND,
    "relaxed_candidates": with_search(CANDIDATES),
    "relaxed_candidates_repeated": with_search(CANDIDATES, REPEATED_CATALOG),
    "attribute_items": f"{ranked_by_attributes(CATALOG)} SELECT {item('0e0', 'FALSE')} FROM ranked JOIN p USING (ordinal)",
    "attribute_items_repeated": f"{ranked_by_attributes(REPEATED_CATALOG)} SELECT {item('0e0', 'FALSE')} FROM ranked JOIN p USING (ordinal)",
    "attribute_answers": f"{ranked_by_attributes(CATALOG)} SELECT w.query_id, rank, p.product_id, hybrid_score FROM ranked JOIN p USING (ordinal) JOIN {ROUTING} w USING (request_id)",
    "documents": f"""SELECT product_id, {FULL_TEXT} AS full_text, lower(category) AS meta_category, lower(subcategory) AS meta_subcategory,
  size AS meta_size, price_inr AS meta_price FROM ({CATALOG}) AS c""",
    "chunks": CHUNKS,
    "tight_chunks": TIGHT,
    "document_chunks": DOCUMENT_CHUNKS,
    "ingest_report": f"""SELECT (SELECT count(*) FROM ({CATALOG}) AS c) AS product_count, count(*) AS chunk_count,
  count(*) / (SELECT count(*) FROM ({CATALOG}) AS c) AS avg_chunks_per_product, 0 AS embedding_dim, count(*) AS indexed_count FROM ({CHUNKS}) AS k""",
    "chunk_coverage": COVERAGE,
    "unit_vectors": UNIT,
    "vector_report": VECTORS,
    "nearest_vectors": NEAREST,
    "term_counts": f"WITH {DOC_TERMS} SELECT term, sum(tf)::BIGINT AS total, count(*) AS documents FROM dt GROUP BY term",
    "vocabulary": f"WITH {DOC_TERMS}, {DOC_VOCABULARY} SELECT term, term_id, total, documents, round(idf, 6) AS idf FROM v",
    "term_vectors": f"WITH {DOC_TERMS}, {DOC_VOCABULARY}, {weights_cte('dt', 'v', 'doc_id', 'w')} SELECT doc_id, term_id, round(w, 6) AS weight FROM w",
    "search_items": f"{FOUND} SELECT {item('semantic_similarity', 'TRUE')}, ranked.distance, matched.hits FROM ranked JOIN p USING (ordinal) JOIN {MATCHED}",
    "rebuilt_items": f"{FOUND} SELECT {item('semantic_similarity', 'TRUE')}, ranked.distance, matched.hits FROM ranked JOIN p USING (ordinal) JOIN {MATCHED}",
    "vector_items": f"{found(requests_cte(), GIVEN_SIMS)} SELECT {item('semantic_similarity', 'TRUE')}, ranked.distance, matched.hits FROM ranked JOIN p USING (ordinal) JOIN {MATCHED}",
    "search_diagnostics": DIAGNOSTICS,
    "search_answers": f"{FOUND} SELECT w.query_id, rank, p.product_id, hybrid_score FROM ranked JOIN p USING (ordinal) JOIN {ROUTING} w USING (request_id)",
    "form_items": f"""{found(FORM_REQUESTS)} SELECT f.query_id, rank, p.product_id, hybrid_score, CAST(trunc(hybrid_score * 100) AS INT) AS match_percentage
  FROM ranked JOIN p USING (ordinal) JOIN q USING (request_id) JOIN forms f ON {SAME}""",
    "result_rows": f"""{FOUND} SELECT ranked.request_id, rank, p.product_id, p.brand, p.product_name, '₹' || CAST(CAST(p.price_inr AS BIGINT) AS VARCHAR) AS price,
  matched.n_hits AS matched_chunks, printf('%.4f', ranked.distance) AS best_distance, printf('%.4f', semantic_similarity) AS semantic_sim,
  CAST(CAST(trunc(hybrid_score * 100) AS INT) AS VARCHAR) || '%' AS hybrid_score
  FROM ranked JOIN p USING (ordinal) JOIN {MATCHED}""",
    "evidence": EVIDENCE,
    "explanations": REASONS,
    "response_check": RESPONSES,
    "violations": f"{FOUND} {audited('ranked JOIN p USING (ordinal) JOIN q USING (request_id)', 'request_id')}",
    "order_violations": f"SELECT * FROM {ORDER_AUDIT} AS a",
    "accuracy": f"""SELECT count(*) AS tested, sum({BROKEN})::BIGINT AS fails,
  CASE WHEN sum({BROKEN}) = 0 THEN 100e0 ELSE round((1 - CAST(sum({BROKEN}) AS DOUBLE) / greatest(1, count(*))) * 100, 2) END AS accuracy_pct FROM {ORDER_AUDIT} AS a""",
    "match_rate": f"""SELECT count(*) AS requests, count(*) FILTER (WHERE "count" = 0) AS without_items,
  count(*) FILTER (WHERE retrieved_chunks_count = 0) AS without_evidence,
  round(count(*) FILTER (WHERE "count" = 0) / count(*), 4) AS no_match_rate FROM ({DIAGNOSTICS}) AS x""",
    "passed_checks": f"""SELECT *, total - passed AS failed, printf('%.1f%%', passed * 100e0 / total) AS pass_rate,
  CASE WHEN passed >= total - 1 THEN 'PASS' ELSE 'FAIL' END AS status
  FROM (SELECT count(*) AS total, count(*) FILTER (WHERE {BROKEN} = 0 AND unique_products) AS passed FROM {ORDER_AUDIT} AS a) AS b""",
    "latency": "SELECT count(*) AS queries, round(avg(value), 2) AS mean_latency, round(quantile_cont(value, 0.95), 2) AS p95_latency FROM events",
    "report_lines": f"""SELECT '{{"products":' || products || ',"duplicate_ids":' || duplicate_ids || ',"bad_prices":' || bad_prices || '}}' AS report FROM ({PROFILE}) AS x""",
    "recent": RECENT,
}
