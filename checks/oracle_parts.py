"""Pieces of the oracle SQL: plain DuckDB text, written rule by rule.

The oracles follow the rules one search and one product at a time (CASE chains,
theta joins over all pairs), not the way the library computes them.
"""

from __future__ import annotations

import re

from checks.fixtures import CATALOG, SEARCH_LOG, quoted
from weft import vocab

# DuckDB's \b knows ASCII only; word edges are spelled out instead.


def word(text: str, pattern: str) -> str:
    """Whole-word test with Unicode word edges."""
    return f"regexp_matches({text}, {quoted('(^|[^\\p{L}\\p{M}\\p{N}_])(?:' + pattern + ')($|[^\\p{L}\\p{M}\\p{N}_])')})"


def chain(text: str, pairs: list[tuple[str, str]], test=word) -> str:
    """First listed word that occurs decides."""
    whens = " ".join(
        f"WHEN {test(text, re.escape(w))} THEN {quoted(v)}" for w, v in pairs
    )
    return f"CASE {whens} END"


def by_length(words_by_value: dict) -> list[tuple[str, str]]:
    pairs = [(w, v) for v, words in words_by_value.items() for w in words]
    return sorted(pairs, key=lambda p: len(p[0]), reverse=True)


def in_order(words_by_value: dict) -> list[tuple[str, str]]:
    return [(w, v) for v, words in words_by_value.items() for w in words]


def number(text: str, pattern: str, group: int = 1) -> str:
    return (
        f"TRY_CAST(replace(nullif(regexp_extract({text}, {quoted(pattern)}, {group}), ''), ',', '') "
        "AS DOUBLE)"
    )


FORMAL_DRESS = r"formal(?:\s+[\p{L}\p{M}\p{N}_]+){0,3}\s+dress"
CUR, NUM = vocab.CURRENCY, vocab.PRICE_NUMBER
BETWEEN = rf"\bbetween\s+{CUR}\s*({NUM})\s+and\s+{CUR}\s*({NUM})"
MAX_1 = rf"(?:{'|'.join(vocab.MAX_PRICE_WORDS)})\s*{CUR}\s*({NUM})"
MAX_2 = rf"({NUM})\s*(?:rs|rupees|inr)?\s*(?:{'|'.join(vocab.MAX_PRICE_SUFFIXES)})"
MIN_1 = rf"(?:{'|'.join(vocab.MIN_PRICE_WORDS)})\s*{CUR}\s*({NUM})"


def parsed(source: str, keep: str, test=word) -> str:
    """Constraint columns of the table expression ``source`` (has raw_query)."""
    q = "lq"
    dress = [p for p in by_length(vocab.CATEGORY_WORDS) if p[0] in vocab.BARE_DRESS_WORDS]
    whens = []
    for w, v in by_length(vocab.CATEGORY_WORDS):
        block = " AND NOT formal_dress AND NOT mens_dress" if (w, v) in dress else ""
        whens.append(f"WHEN {test(q, re.escape(w))}{block} THEN {quoted(v)}")
    style_intent = " ".join(
        f"WHEN style = {quoted(s)} THEN {quoted(i)}" for s, i in vocab.STYLE_INTENT.items()
    )
    stops = ", ".join(quoted(w) for w in vocab.SEARCH_STOP_TOKENS)
    gender = " ".join(
        f"WHEN {test(q, '|'.join(words))} THEN {quoted(g)}"
        for g, words in vocab.GENDER_WORDS.items()
    )
    colors = in_order(
        {c: vocab.COLOR_SPELLINGS.get(c, (c.lower(),)) for c in vocab.COLORS}
    )
    seasons = [(s.lower(), s) for s in vocab.SEASONS if s != "All-Season"]
    kept_text = (
        f"array_to_string(list_filter(string_split_regex({q}, '\\s+'), "
        f"lambda w: w <> '' AND w NOT IN ({stops}) AND NOT regexp_matches(w, '^[0-9]+$')), ' ')"
    )
    return f"""
SELECT {keep}, max_price, min_price, gender, category, CAST(NULL AS VARCHAR) AS subcategory,
  CASE {style_intent} ELSE coalesce({chain(q, in_order(vocab.INTENT_WORDS), test)},
    CASE WHEN mens_dress THEN 'broad clothing' END) END AS intent,
  color, fit, material, season, style, cleaned_query, lq
FROM (SELECT *,
  CASE WHEN dress_shirt THEN 'shirts' {' '.join(whens)} END AS category,
  coalesce({number(q, BETWEEN, 2)}, {number(q, MAX_1)}, {number(q, MAX_2)}) AS max_price,
  coalesce({number(q, BETWEEN, 1)}, {number(q, MIN_1)}) AS min_price,
  {chain(q, colors, test)} AS color,
  {chain(q, by_length(vocab.FIT_WORDS), test)} AS fit,
  {chain(q, [(m.lower(), m) for m in vocab.MATERIALS], test)} AS material,
  {chain(q, seasons, test)} AS season,
  CASE WHEN {kept_text} = '' THEN {q} ELSE {kept_text} END AS cleaned_query
FROM (SELECT *,
  coalesce(gender = 'Men', FALSE) AND {test(q, 'dress(?:es)?')} AND NOT dress_shirt AS mens_dress
FROM (SELECT *,
  CASE {gender} END AS gender,
  {chain(q, [(s, s) for s in vocab.STYLES], test)} AS style,
  {test(q, vocab.DRESS_SHIRT.strip(chr(92) + 'b'))} AS dress_shirt,
  {test(q, FORMAL_DRESS)}
    AND NOT {test(q, vocab.DRESS_SHIRT.strip(chr(92) + 'b'))} AND NOT {test(q, 'dresses')} AS formal_dress
FROM (SELECT *, lower(raw_query) AS lq FROM (
  SELECT * REPLACE (regexp_replace(raw_query, '^\\s+|\\s+$', '', 'g') AS raw_query) FROM ({source}) AS s0) AS s1
) AS s2) AS s3) AS s4) AS s5"""


def is_domain(test=word) -> str:
    words = "|".join(vocab.DOMAIN_WORDS)
    fields = ("category", "fit", "material", "style", "intent", "gender", "color",
              "max_price", "min_price")
    some = " OR ".join(f"{f} IS NOT NULL" for f in fields)
    non_text = r"""[0-9₹,.$%#@!*?&/\\()<>{}\[\]=+\-_:;"']"""
    return (
        f"trim(regexp_replace(lq, {quoted(non_text)}, ' ', 'g')) <> '' "
        f"AND ({test('lq', words)} OR {some})"
    )


def round4(x: str) -> str:
    """Round by the exact binary value, ties to even (split product)."""
    y, hi = f"({x}) * 1e4", f"(({x}) * 134217729e0 - (({x}) * 134217729e0 - ({x})))"
    err = f"(({hi} * 1e4 - {y}) + (({x}) - {hi}) * 1e4)"
    rest = f"({y} - floor({y}))"
    return (
        f"((floor({y}) + CASE WHEN {rest} > 0.5e0 OR ({rest} = 0.5e0 AND ({err} > 0 OR "
        f"({err} = 0 AND floor({y}) % 2 = 1))) THEN 1e0 ELSE 0e0 END) / 1e4)"
    )


def passes(q: str, p: str, optional: bool = True) -> str:
    """Hard filters of ask ``q`` against product ``p``."""
    terms = [
        f"({q}.max_price IS NULL OR {p}.price_inr <= {q}.max_price)",
        f"({q}.min_price IS NULL OR {p}.price_inr >= {q}.min_price)",
        f"({q}.gender IS NULL OR lower({p}.gender) IN (lower({q}.gender), 'unisex'))",
        f"({q}.category IS NULL OR lower({p}.category) = lower({q}.category))",
    ]
    if optional:
        terms += [
            f"({q}.{c} IS NULL OR lower({p}.{c}) = lower({q}.{c}))"
            for c in ("color", "fit", "material")
        ]
        terms.append(
            f"({q}.season IS NULL OR lower({p}.season) IN (lower({q}.season), 'all-season'))"
        )
    return " AND ".join(terms)


HAS_OPTIONAL = (
    "(color IS NOT NULL OR fit IS NOT NULL OR material IS NOT NULL OR season IS NOT NULL)"
)


def effective(q: str) -> str:
    whens = " ".join(
        f"WHEN {q}.intent = {quoted(i)} THEN {quoted(s)}" for i, s in vocab.INTENT_STYLE.items()
    )
    return f"CASE {whens} ELSE coalesce({q}.style, 'none') END"


def style_match(style: str, p: str) -> str:
    text = (
        f"lower({p}.product_name || ' ' || {p}.subcategory || ' ' || {p}.description || ' ' || "
        f"{p}.season)"
    )
    whens = " ".join(
        f"WHEN {style} = {quoted(s)} THEN "
        + " OR ".join(f"contains({text}, {quoted(t)})" for t in terms)
        for s, terms in vocab.STYLE_EVIDENCE.items()
    )
    return f"CASE {whens} ELSE contains({text}, {style}) END"


def raw_score(q: str, p: str, sim: str, styled: str) -> str:
    asked, earned = ["0e0"], ["0e0"]
    for name, points in vocab.ATTRIBUTE_POINTS.items():
        if name == "style":
            match = styled
        else:
            match = f"lower({p}.{name}) = lower({q}.{name})"
            if name == "season":
                match = f"({match} OR lower({p}.season) = 'all-season')"
        asked.append(f"CASE WHEN {q}.{name} IS NOT NULL THEN {points}e0 ELSE 0e0 END")
        earned.append(
            f"CASE WHEN {q}.{name} IS NOT NULL AND {match} THEN {points}e0 ELSE 0e0 END"
        )
    possible = "(" + " + ".join(asked) + ")"
    share = f"CASE WHEN {possible} > 0 THEN ({' + '.join(earned)}) / {possible} ELSE 0.5e0 END"
    boost = f"greatest(0e0, ({p}.rating - 3.5e0) / 1.5e0) * 0.05e0"
    return f"least(1e0, 0.65e0 * {sim} + 0.35e0 * ({share}) + {boost})"


def requests_cte(top_k: str = "4") -> str:
    """Distinct searches of the log, parsed: request_id is the least query_id."""
    log = f"SELECT query_id, raw_query FROM ({SEARCH_LOG}) AS l"
    columns = (
        "raw_query, max_price, min_price, gender, category, intent, color, fit, material, "
        "season, style"
    )
    inner = parsed(
        f"SELECT min(query_id) AS query_id, trim(raw_query) AS raw_query FROM ({log}) AS g GROUP BY trim(raw_query)",
        "query_id, raw_query",
    )
    return f"q AS MATERIALIZED (SELECT query_id AS request_id, {columns}, {top_k} AS top_k FROM ({inner}) AS pq)"


def catalog_cte() -> str:
    return f"p AS MATERIALIZED ({CATALOG})"


def candidates_cte() -> str:
    """Strict matches, else (if an optional constraint is set) core matches."""
    return f"""
strict_match AS MATERIALIZED (SELECT q.request_id, p.ordinal FROM q JOIN p ON {passes('q', 'p')}),
hopeless AS (SELECT * FROM q WHERE {HAS_OPTIONAL} AND request_id NOT IN (SELECT request_id FROM strict_match)),
candidate AS MATERIALIZED (SELECT * FROM strict_match UNION ALL
  SELECT q.request_id, p.ordinal FROM hopeless q JOIN p ON {passes('q', 'p', False)})"""


def terms_cte(source: str, key: str, out: str, stop_words=vocab.TERM_STOP_WORDS) -> str:
    """(key, term, tf) of every text of ``source`` (columns key, text)."""
    stops = ", ".join(quoted(w) for w in stop_words)
    return f"""
{out}_w AS (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[0-9A-Za-z_\\p{{L}}\\p{{N}}]{{2,}}'),
  lambda w: w NOT IN ({stops})) AS ws FROM ({source}) AS t),
{out} AS MATERIALIZED (SELECT {key}, term, count(*) AS tf FROM (
  SELECT {key}, unnest(ws) AS term FROM {out}_w
  UNION ALL
  SELECT {key}, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM {out}_w
) AS u GROUP BY {key}, term)"""


def vocabulary_cte(terms: str, rows: str, out: str, limit: int) -> str:
    return f"""
{out} AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY total DESC, term) - 1 AS term_id, total, documents,
  ln((1e0 + (SELECT count(*) FROM ({rows}) AS r)) / (1e0 + documents)) + 1e0 AS idf
FROM (SELECT term, sum(tf)::BIGINT AS total, count(*) AS documents FROM {terms} GROUP BY term
  ORDER BY total DESC, term LIMIT {limit}) AS s)"""


def weights_cte(terms: str, vocabulary: str, key: str, out: str) -> str:
    return f"""
{out} AS MATERIALIZED (SELECT {key}, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w
FROM (SELECT t.{key}, v.term_id, (1e0 + ln(t.tf)) * v.idf AS w FROM {terms} t JOIN {vocabulary} v USING (term)) AS x)"""


CHUNKS = f"""
SELECT product_id || '_chunk_' || CAST(i AS VARCHAR) AS chunk_id, product_id, i AS chunk_index, 3 AS total_chunks,
  CASE i WHEN 0 THEN 'identity_description' WHEN 1 THEN 'attributes_style' ELSE 'commercial_pricing' END AS chunk_type,
  CASE i
    WHEN 0 THEN 'Product: ' || product_name || ' | Brand: ' || brand || ' | Category: ' || category || ' | Description: ' || description
    WHEN 1 THEN 'Product: ' || product_name || ' | Category: ' || category || ' (' || subcategory || ') | Gender: ' || gender || ' | Fit: ' || fit || ' | Material: ' || material || ' | Color: ' || color || ' | Season: ' || season
    ELSE 'Product: ' || product_name || ' | Brand: ' || brand || ' | Price: Rs ' || CAST(CAST(price_inr AS BIGINT) AS VARCHAR) || ' | Customer Rating: ' || CAST(rating AS VARCHAR) || '/5.0 | Product ID: ' || product_id
  END AS text
FROM ({CATALOG}) AS p, (SELECT unnest([0, 1, 2]) AS i) AS n"""
