"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.quality import BOILERPLATE, CALLS, MENU_RUN, SEPARATORS, SPACED_SEPARATORS, SYMBOLS, TERMINAL, UPPER, QualityRules

_R = QualityRules()
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TERMINAL = ", ".join("'" + t.replace("'", "''") + "'" for t in TERMINAL)
_BOILER = " OR ".join(f"contains(lower(l), '{b}')" for b in BOILERPLATE)
_CALLS = " + ".join(f"contains(lower(l), '{c}')::INTEGER" for c in CALLS)
_AMONG = lambda chars: f"(length(l) - length(translate(l, '{chars}', '')))"
_PARTS = " + ".join([_AMONG(SEPARATORS), *(f"(length(l) - length(replace(l, '{x}', ''))) / {len(x)}.0" for x in SPACED_SEPARATORS)])
_RUN = " OR ".join(
    "(" + " AND ".join(f"coalesce({'lag' if d < 0 else 'lead'}(short, {abs(d)}) OVER (PARTITION BY r ORDER BY k), false)" if d else "short" for d in range(-b, MENU_RUN - b)) + ")"
    for b in range(MENU_RUN)
)

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, string_split(body, chr(10)) AS lines FROM d),
win AS (
  SELECT r, i, words[i:i + {_R.window - 1}] AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - {_R.window - 2})) AS i FROM w WHERE len(words) >= {_R.window})
),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT r, sum(CASE WHEN p IS NULL THEN {_R.window} ELSE least({_R.window}, i - p) END) AS n
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM hit) GROUP BY r
),
ln AS (
  SELECT r, k, l, trim(l, {_WS}) AS b, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw
  FROM (SELECT r, unnest(lines) AS l, generate_subscripts(lines, 1) AS k FROM w)
),
seen AS (
  SELECT *, right(b, 1) IN ({_TERMINAL}) AS ended, {_AMONG(UPPER)} AS capital, {_PARTS} AS parts,
    len(regexp_extract_all(l, '(^|[\x20\x09-\x0D])[A-Z]')) AS titles, nw > 0 AND nw <= {_R.menu_words} AS short
  FROM ln
),
runs AS (SELECT *, {_RUN} AS menu FROM seen),
judged AS (
  SELECT r, k, l, nw = 0 OR (
    (ended OR nw >= {_R.min_open_words})
    AND {_AMONG(SYMBOLS.replace("|", ""))} <= {_R.symbol_share}::DOUBLE * nw
    AND (length(l) - length(replace(l, '!!', ''))) / 2.0 <= {_R.symbol_share}::DOUBLE * nw
    AND NOT (NOT regexp_matches(l, '[a-z]') AND capital >= {_R.shout_letters})
    AND NOT (parts >= {_R.nav_min_separators} AND parts >= {_R.nav_share}::DOUBLE * nw)
    AND NOT (NOT ended AND titles >= {_R.title_share}::DOUBLE * nw)
    AND NOT menu
    AND NOT (length(l) <= {_R.boilerplate_max_chars} AND ({_BOILER} OR ({_CALLS}) >= 2))) AS ok
  FROM runs
),
per AS (
  SELECT r, count(*) FILTER (WHERE trim(l, {_WS}) <> '')
    - count(DISTINCT CASE WHEN trim(l, {_WS}) <> '' THEN l END) AS dup,
    coalesce(length(string_agg(l, chr(10) ORDER BY k) FILTER (WHERE ok)), 0) AS kept_chars
  FROM judged GROUP BY r
),
base AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, kept_chars, length(body) AS chars
  FROM w JOIN per USING (r) LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words)
    AND kept_chars >= {_R.min_kept_share}::DOUBLE * chars AS kept
FROM base
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS l, generate_subscripts(lines, 1) AS k FROM d),
kl AS (SELECT r, k, l, {_LOWER.format(f"trim(l, {_WS})")} AS key FROM l),
hot AS (SELECT key FROM kl WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
per AS (
  SELECT r, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE hot.key IS NOT NULL)::BIGINT AS n_dropped,
    coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (WHERE hot.key IS NULL), '') AS kept
  FROM kl LEFT JOIN hot USING (key) GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN per USING (r)
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

# DuckDB has no CRC-32, so the SQL computes it over the few digits of a page id, a bit at a time.
OP10 = r"""
WITH RECURSIVE bits AS (
  SELECT page_id, 4294967295::BIGINT AS c, encode(page_id::VARCHAR) AS s, 0 AS i FROM pages
  UNION ALL
  SELECT page_id,
    CASE WHEN i % 9 = 0 THEN xor(c, ('0x' || hex(s[i // 9 + 1:i // 9 + 1]))::BIGINT)
      WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s, i + 1
  FROM bits WHERE i < 9 * octet_length(s)
),
p AS (
  SELECT pages.page_id, url, coalesce(html, '') AS html, xor(c, 4294967295) AS h, 1704067200 + pages.page_id * 60 AS first,
    '"' || md5(coalesce(html, ''))[1:16] || '"' AS etag
  FROM pages JOIN bits ON bits.page_id = pages.page_id AND i = 9 * octet_length(s)
),
r AS (
  SELECT 'response-' || page_id AS record_id, true AS full_, url AS uri, first AS ts, etag, first - 3600 AS lm,
    octet_length(encode(html)) AS len FROM p
  UNION ALL
  SELECT 'revisit-' || page_id, false, 'https://' || upper(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) ||
    regexp_replace(url, '^[a-z]+://[^/?#]*', ''), first + h % 93600 - 7200,
    CASE WHEN h % 7 = 0 THEN '"changed"' ELSE etag END, NULL, NULL
  FROM p WHERE h % 5 <> 0
),
u AS (SELECT *, regexp_replace(trim(uri), '#.*$', '') AS u FROM r),
parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]*)', 1)), '^www\.', '') AS host,
    regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*:([0-9]+)(?:[/?]|$)', 1) AS port,
    regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(/[^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid)(=|$)'))) AS q
  FROM u
),
c AS (
  SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || path ||
    CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END END AS canonical
  FROM parts
),
j AS (
  SELECT v.record_id, v.canonical, v.ts, v.etag, f.record_id AS response_id, f.etag AS old, f.lm, f.len,
    row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS k
  FROM c v LEFT JOIN c f ON f.full_ AND f.canonical = v.canonical AND f.ts < v.ts WHERE NOT v.full_
)
SELECT record_id, canonical, ts AS revisit_at,
  CASE WHEN response_id IS NULL THEN 'no_earlier_response' WHEN etag = old THEN 'resolved' ELSE 'validator_mismatch' END AS status,
  response_id,
  CASE WHEN etag = old THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || len || chr(10) ||
      'content-type: text/html; charset=utf-8' || chr(10) || 'date: ' || ts || chr(10) || 'etag: W/' || etag || chr(10) ||
      'last-modified: ' || lm
    ELSE 'cache-control: max-age=600' || chr(10) || 'connection: close' || chr(10) || 'content-length: 0' || chr(10) ||
      'date: ' || ts || chr(10) || 'etag: ' || CASE WHEN etag = '"changed"' THEN '' ELSE 'W/' END || etag END AS headers
FROM j WHERE k = 1
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
u AS (
  SELECT doc_id, body, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') AS units,
    list_transform([1, 9, 17, 25], lambda k: ('0x' || h[k:k + 7])::BIGINT) AS r
  FROM d
),
f AS (
  SELECT *, len(units)::BIGINT AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS low,
    greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS high,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
      WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
),
c AS (
  SELECT doc_id, body, n, form, array_to_string(units[1:low], '') AS p, array_to_string(units[low + 1:high], '') AS m,
    array_to_string(units[high + 1:], '') AS s
  FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
    ELSE body END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM c
"""
