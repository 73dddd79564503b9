"""SQL counterparts of the operator queries, for DuckDB."""

from __future__ import annotations

from lineflow.llm import pii, quality

_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{quality.WORD}') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{quality.WORD}')) AS ls
  FROM d
),
win AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
counted AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM win
),
rep AS (
  SELECT rid, count(DISTINCT i + o) AS n
  FROM counted, (VALUES (0), (1), (2)) AS v(o) WHERE c >= 2 GROUP BY rid
),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '{quality.SYMBOL}')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(ws, lambda x: regexp_matches(x, '{quality.SHOUTED}'))) AS BIGINT)
      AS n_shouted_words
  FROM w LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
       n_shouted_words,
       n_words < {quality.BASE_MIN_WORDS}
         OR 100 * n_repeat_words > {quality.BASE_REPEAT_PERCENT} * n_words AS base_failed,
       {quality.verdict_sql()} AS kept
FROM m
"""


# Patterns in the regex dialect of DuckDB, which needs no possessive runs.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_BARE = "replace(m, ' ', '')"
_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3"
          " OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length({_DIGITS})),"
            f" lambda i: CASE WHEN i % 2 = 1 THEN CAST(substring(reverse({_DIGITS}), i + 1, 1) AS INTEGER) * 2"
            f" // 10 + CAST(substring(reverse({_DIGITS}), i + 1, 1) AS INTEGER) * 2 % 10"
            f" ELSE CAST(substring(reverse({_DIGITS}), i + 1, 1) AS INTEGER) END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": f"length({_BARE}) BETWEEN 15 AND 34 AND CAST(array_to_string(list_transform(string_split("
            f"substring({_BARE}, 5) || left({_BARE}, 4), ''), lambda c: CASE WHEN ascii(c) < 65 THEN c"
            f" ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '') AS HUGEINT) % 97 = 1",
    "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|0000$') AND regexp_matches(near,"
           " 'ssn|social security')",
}


def _spans_sql(kind: str, rank: int) -> str:
    pattern = _PATTERNS[kind]
    return f"""
  SELECT rid, '{kind}' AS kind, {rank} AS rank, s, s + length(m) AS e, m, near FROM (
    SELECT rid, ms[i] AS m, lower(right(ps[i], {pii.CONTEXT_CHARS})) AS near,
      list_sum(list_transform(ps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT rid, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps
      FROM d) WHERE len(ms) > 0)
  ) WHERE {_VALID[kind]}"""


_ALL_SPANS = " UNION ALL ".join(_spans_sql(k, i) for i, k in enumerate(_PATTERNS))
_SPAN = "kind || ':' || s || ':' || e"
OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({_ALL_SPANS}),
g AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PATTERNS)},
    string_agg({_SPAN}, ',' ORDER BY s, rank) FILTER (rank < 4) AS base,
    string_agg({_SPAN}, ',' ORDER BY s, rank) AS spans
  FROM a GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _PATTERNS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""

OP10 = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
u AS (
  SELECT rid, page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
),
h AS (SELECT rid, page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
m AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""

OP5 = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.rid AS rid, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
r AS (
  SELECT query_id, vec_id, score,
    row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


# Base32 of a digest: its i-th character stands for the five bits from bit 5 i, which lie in two
# hexadecimal digits.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (((strpos('0123456789abcdef', substring(h, CAST(5 * i // 4 AS INTEGER) + 1, 1)) - 1) * 16
      + strpos('0123456789abcdef', substring(h, CAST(5 * i // 4 AS INTEGER) + 2, 1)) - 1)
     // CAST(pow(2, 3 - 5 * i % 4) AS INTEGER)) % 32 AS INTEGER), 1)), '')"""
OP13 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d
"""

OP11 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (
  SELECT a.rid, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS own,
    CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
),
p AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS slot FROM s WHERE own
),
n AS (
  SELECT p.rid, p.slot, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
    s.score AS negative_score, row_number() OVER (PARTITION BY p.rid, p.slot ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.own AND p.slot <= 5
    AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
"""
