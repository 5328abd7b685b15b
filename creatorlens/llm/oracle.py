"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def top_k() -> str:
    return """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.r AS own, q.vec_id AS query_id, c.r AS other, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, other)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20"""


def decontamination() -> str:
    words = rf"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
iw AS (SELECT item_id, {words} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM iw WHERE len(w) > 0)
),
pos AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
),
hit AS (SELECT DISTINCT r, i, n, item_id FROM pos JOIN win USING (t, n)),
hw AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS x FROM hit) GROUP BY r),
hi AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
  FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)"""


def line_dedup() -> str:
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = LOWER.format(f"trim(line, {space})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, {key} AS key FROM l),
f AS (SELECT key AS frequent FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(frequent)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE frequent IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = frequent GROUP BY r, doc_id"""


def warc() -> str:
    bits = """array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda h:
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', h) - 3, 4)), '')"""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, {bits} AS bits FROM pages),
q AS (
  SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
      + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
      + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY payload) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q"""


def url_cascade(rules: list[tuple[str, str, str]], listed: str, tracked: str) -> str:
    values = ", ".join(f"('{k}', '{h}', '{p}')" for k, h, p in rules)
    host = LOWER.format("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")
    return f"""
WITH rules(kind, h, p) AS (VALUES {values}),
u AS (
  SELECT row_number() OVER () AS r, page_id, url, {host} AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
),
best AS (
  SELECT r, arg_max(kind, length(h || p)) AS kind, arg_max(h || p, length(h || p)) AS rule
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
),
places AS (SELECT DISTINCT host || path AS place FROM u WHERE regexp_matches(url, '{tracked}') AND host || path <> ''),
judged AS (
  SELECT u.*, rule, kind, regexp_matches(host, '{listed}') AS listed, place IS NOT NULL AS place_listed
  FROM u LEFT JOIN best USING (r) LEFT JOIN places ON host || path = place
)
SELECT page_id, host, path, rule,
  CASE WHEN kind IS NOT NULL THEN kind WHEN listed OR place_listed THEN 'block' ELSE 'allow' END AS verdict,
  listed, place_listed
FROM judged"""


def divergence(min_docs: int, top_terms: int) -> str:
    words = rf"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x60\x7B-\x7F]+')"
    p = "1 + 1000000000::HUGEINT * ({0} + 2) // ({1} + 2 * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {words} AS w FROM documents),
c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
  FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
),
k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= {min_docs}),
vs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM k GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0)::BIGINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN k USING (lang, term) GROUP BY ALL
),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p.format("coalesce(c.n, 0)", "g.total")} AS p, {p.format("k.n", "vs.total")} AS q
  FROM g JOIN k USING (lang) JOIN vs USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce(sum(CASE WHEN sa.p IS NOT NULL THEN (sa.p - sb.p) * (sa.p - sb.p) // (sa.p + sb.p) END), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s sa ON sa.lang = a.lang AND sa.source = a.source
  LEFT JOIN s sb ON sb.lang = b.lang AND sb.source = b.source AND sb.term = sa.term
  GROUP BY ALL
),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (FROM pair UNION ALL FROM term)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top_terms}"""
