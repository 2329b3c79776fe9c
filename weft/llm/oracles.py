"""DuckDB SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT k, h, unnest(range(0, greatest(length(h) // 2 - 199, 0), 500)) AS base FROM d),
c AS (SELECT k, base, substr(h, 2 * base + 1, 1398) AS h FROM b),
p AS (SELECT k, base, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM c),
m AS (SELECT k, base + i AS i, md5_number(substr(h, 2 * i + 1, 400)) AS m FROM p),
t AS (SELECT m FROM m GROUP BY m HAVING count(*) > 1),
s AS (SELECT k, i, 2 AS c FROM m SEMI JOIN t USING (m)),
r AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM s WHERE c > 1),
g AS (SELECT k, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS span FROM r),
spans AS (SELECT k, span, min(i) AS first, max(i) + 200 AS past FROM g GROUP BY k, span),
gaps AS (
  SELECT k, past AS first, lead(first) OVER (PARTITION BY k ORDER BY span) AS past FROM spans
  UNION ALL SELECT k, 0, min(first) FROM spans GROUP BY k),
kept AS (
  SELECT d.k, string_agg(substr(h, 2 * first + 1, 2 * (coalesce(past, length(h) // 2) - first)), '' ORDER BY first) AS h
  FROM gaps JOIN d USING (k) GROUP BY d.k),
gone AS (SELECT k, sum(past - first) AS n_removed, count(*) AS n_spans FROM spans GROUP BY k)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (k) LEFT JOIN gone USING (k)
"""

COLLOCATIONS = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT k, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
  SELECT lang, 1 AS m, ws[i] AS phrase, count(*) AS f FROM o GROUP BY ALL
  UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1], count(*) FROM o WHERE i + 1 <= len(ws) GROUP BY ALL
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], count(*) FROM o WHERE i + 2 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, array_to_string(c.ws[1:k], ' ') AS head, array_to_string(c.ws[k + 1:], ' ') AS tail
  FROM c, (VALUES (1), (2)) AS v(k) WHERE k < c.m),
scored AS (
  SELECT x.lang, x.phrase, x.a, x.k, h.f AS l, t.f AS r,
    CAST((1000000::HUGEINT * x.a::HUGEINT * x.a::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT) AS BIGINT) AS score
  FROM cuts x JOIN g h ON h.lang = x.lang AND h.phrase = x.head AND h.m = x.k
  JOIN g t ON t.lang = x.lang AND t.phrase = x.tail AND t.m = x.m - x.k),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, inner_phrase, max(a) AS a FROM (
    SELECT lang, a, ws[1] || ' ' || ws[2] AS inner_phrase FROM c WHERE m = 3
    UNION ALL SELECT lang, a, ws[2] || ' ' || ws[3] FROM c WHERE m = 3) GROUP BY ALL),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer b ON b.lang = s.lang AND b.inner_phrase = s.phrase
  WHERE b.a IS NULL OR 100 * b.a < 50 * s.a),
ranked AS (
  SELECT kept.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op11_suffix_dedup": SUFFIX_DEDUP, "op12_collocations": COLLOCATIONS}
