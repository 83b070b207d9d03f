"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from furlong.llm.line_dedup import _BLOCKS, _TAGS, _UNSEEN, MIN_PAGES, RATIO
from furlong.llm.queries import PATTERN_RULES, SITE_RULES
from furlong.llm.url_filter import Rule

ORACLE: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rules() -> str:
    rows = [(t, v, True, Rule(t, v, site=True).regex()) for t, v in SITE_RULES]
    rows += [(t, v, False, Rule(t, v).regex()) for t, v in PATTERN_RULES]
    return ", ".join(f"({_quoted(t)}, {_quoted(v)}, {s}, {_quoted(x)})" for t, v, s, x in rows)


ORACLE["op2_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         row_number() OVER () AS rn
  FROM parts),
rules(text, verdict, site, regex) AS (VALUES {_rules()}),
fits AS (
  SELECT u.rn, r.*, row_number() OVER (
           PARTITION BY u.rn ORDER BY r.site DESC, length(r.text) DESC, r.text) AS place
  FROM u JOIN rules r ON regexp_matches(u.host || u.path, r.regex))
SELECT u.page_id, u.host, u.path,
       CASE WHEN f.site THEN f.text END AS rule,
       coalesce(f.verdict, 'allow') AS verdict,
       CASE WHEN NOT f.site THEN f.text END AS pattern
FROM u LEFT JOIN fits f ON u.rn = f.rn AND f.place = 1
"""

ORACLE["op4_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size,
       n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

ORACLE["op5_line_dedup"] = f"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS rn,
         translate(regexp_extract(regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1), '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_split_to_array(
           regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
             {_quoted(_UNSEEN)}, ' ', 'g'), {_quoted(_BLOCKS)}, chr(10), 'g'), {_quoted(_TAGS)}, '', 'g'),
           '[\\x20\\x09]*[\\r\\n]+[\\x20\\x09\\r\\n]*') AS raw
  FROM pages),
lines AS (
  SELECT rn, host, generate_subscripts(raw, 1) AS pos, trim(unnest(raw)) AS line FROM p),
kept AS (SELECT * FROM lines WHERE line <> ''),
share AS (
  SELECT k.host, k.line, count(DISTINCT k.rn) AS n, any_value(t.pages) AS pages
  FROM kept k JOIN (SELECT host, count(*) AS pages FROM p GROUP BY host) t ON k.host = t.host
  GROUP BY k.host, k.line),
boiler AS (SELECT host, line FROM share WHERE n >= {MIN_PAGES} AND n > CAST({RATIO} AS DOUBLE) * pages),
judged AS (
  SELECT k.*, b.line IS NOT NULL AS gone
  FROM kept k LEFT JOIN boiler b ON k.host = b.host AND k.line = b.line),
pages_of AS (
  SELECT rn, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text
  FROM judged GROUP BY rn)
SELECT p.page_id, p.host, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_dropped, 0) AS n_dropped,
       coalesce(o.text, '') AS text
FROM p LEFT JOIN pages_of o ON p.rn = o.rn
"""

ORACLE["op12_hard_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id, b.label,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, al, vec_id AS positive_id, score AS positive_score
  FROM s WHERE label = al
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.al
   AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE place <= 5
"""
