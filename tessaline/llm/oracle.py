"""DuckDB SQL for the queries that SQL can express, written apart from their Spark plans.

SimHash bits, streamed chat text, Bloom filters, banding, tokenised packing, hyperplanes
and random rounding can't be said in SQL; tests/llm holds those against brute force.
"""

from __future__ import annotations

from tessaline.llm.licenses import SIMILARITY, TEMPLATES

_Q = r"[^\x20\x09-\x0D]+"
_SPACE = "[\\x20\\x09-\\x0D]"
#: White-space characters as a SQL expression, for translate().
_GAPS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(t, '{_Q}') AS ws FROM d)),
g AS (SELECT r, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '{_Q}') GROUP BY r),
m AS (
  SELECT r, doc_id, source, (SELECT count(*) FROM w WHERE w.r = d.r) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT sum(failed) / sum(n) AS mean, sum(failed * failed / n) / sum(n) - pow(sum(failed) / sum(n), 2) AS spread, count(*) AS hosts, sum(n) AS docs FROM hosts),
prior AS (SELECT mean, CASE WHEN mean * (1 - mean) <= 0 THEN 2 ELSE least(1e6, greatest(2, mean * (1 - mean) / greatest(spread - mean * (1 - mean) * hosts / docs, 1e-9) - 1)) END AS strength FROM moments),
bad AS (SELECT source FROM hosts, prior WHERE (failed + mean * strength) / (n + strength) > 0.8)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(source IN (SELECT source FROM bad), false) AS kept, coalesce(source IN (SELECT source FROM bad), false) AS host_failed FROM f
"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind(no: int, name: str, pattern: str, group: int) -> str:
    return f"""SELECT r, {no} AS kind_no, '{name}' AS kind, i, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals
    FROM d, LATERAL (SELECT unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i)"""


_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
x AS ({_kind(0, "assign", _ASSIGN, 2)} UNION ALL {_kind(1, "access", "AKIA[A-Z0-9]+", 0)} UNION ALL {_kind(2, "hex", "[0-9a-f]{16,}", 0)} UNION ALL {_kind(3, "live", "[A-Za-z0-9_-]{24,}", 0)}),
y AS (SELECT r, kind_no, kind, hits[i] AS hit, vals[i] AS v,
    list_sum([length(p) for p in pieces[:i]]) + coalesce(list_sum([length(h) for h in hits[:i - 1]]), 0) AS start FROM x),
z AS (
  SELECT r, kind_no, kind, CAST(start AS BIGINT) AS start, CAST(start + length(hit) AS BIGINT) AS stop, v FROM y
  WHERE kind = 'assign' AND length(v) >= 12 OR kind = 'access' AND length(v) >= 18 OR kind = 'hex' OR kind = 'live' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')),
owners AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS n, count(DISTINCT {{'s': source, 'l': lang}}) AS repos FROM z JOIN d USING (r) GROUP BY v),
base AS (SELECT * FROM z WHERE kind <> 'live'),
spans AS (
  SELECT z.*, repos, n > 3 OR repos > 6 AS copied FROM z JOIN owners USING (v)
  WHERE kind <> 'live' OR n <= 3 AND repos <= 6 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = z.r AND b.start < z.stop AND z.start < b.stop)),
s AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind <> 'live') AS b, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS spans,
    count(DISTINCT v) FILTER (NOT copied) AS n_live, count(DISTINCT v) FILTER (copied) AS n_copied, max(repos) AS most_repos FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN s USING (r)
"""

_VALUES = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in TEMPLATES.items())
_NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"

_LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
worded AS (SELECT *, i - row_number() OVER (PARTITION BY r ORDER BY i) AS run FROM lines WHERE {_NORMAL.format("line")} <> ''),
runs AS (SELECT r, run, count(*) AS n, string_agg(line, ' ' ORDER BY i) AS line FROM worded GROUP BY r, run),
l AS (
  SELECT r, 1 AS no, line FROM lines UNION ALL SELECT r, 2, t FROM d WHERE contains(t, chr(10))
  UNION ALL SELECT r, 3, line FROM runs WHERE n > 1 AND r IN (SELECT r FROM runs GROUP BY r HAVING count(*) > 1)),
u AS (SELECT r, row_number() OVER () AS u, {_NORMAL.format("line")} AS unit FROM l),
n AS (SELECT r, u, unit, len(string_split(unit, ' ')) - 1 AS n FROM u),
names AS (SELECT template, {_NORMAL.format("text")} AS unit FROM (VALUES {_VALUES}) t(template, text)),
sizes AS (SELECT *, len(string_split(unit, ' ')) - 1 AS size FROM names),
units AS (SELECT DISTINCT unit, n FROM n WHERE EXISTS (SELECT 1 FROM sizes WHERE n >= 1 AND 2 * least(n, size) >= {SIMILARITY} * (n + size))),
w AS (SELECT unit, unnest(string_split(unit, ' ')) AS w, generate_subscripts(string_split(unit, ' '), 1) AS i FROM (SELECT unit FROM units UNION SELECT unit FROM names)),
p AS (SELECT unit, w || ' ' || lead(w) OVER (PARTITION BY unit ORDER BY i) AS p FROM w),
c AS (SELECT unit, p, count(*) AS k FROM p WHERE p IS NOT NULL GROUP BY unit, p),
common AS (SELECT a.unit, template, sum(least(a.k, b.k)) AS k FROM c a JOIN c b ON a.p = b.p JOIN names ON names.unit = b.unit WHERE a.unit IN (SELECT unit FROM units) GROUP BY ALL),
dice AS (SELECT common.unit, template, 2 * k / (n + size) AS dice FROM common JOIN units USING (unit) JOIN sizes USING (template) WHERE 2 * k / (n + size) >= {SIMILARITY}),
best AS (SELECT unit, template, dice FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY dice DESC, template) AS rn FROM dice) WHERE rn = 1),
m AS (SELECT r, count(*) FILTER (n > 0) AS n_units, count(template) AS n_matches, coalesce(string_agg(DISTINCT template, ',' ORDER BY template), '') AS licenses, round(max(dice), 6) AS best_dice FROM n LEFT JOIN best USING (unit) GROUP BY r)
SELECT doc_id, n_units, n_matches, licenses, best_dice FROM d JOIN m USING (r)
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS all_terms FROM d),
q AS (SELECT r, item_id, unnest(list_distinct(ts)) AS term FROM (SELECT row_number() OVER () AS r, item_id, {_TERMS} AS ts FROM benchmark)),
c AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM c GROUP BY term), s),
m AS (SELECT r, doc_id, 10 + (90 * len(ts) * n_docs) // all_terms AS m FROM d, s WHERE len(ts) > 0),
x AS (SELECT q.r, item_id, c.r AS doc, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN c USING (term) JOIN w USING (term) JOIN m ON m.r = c.r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""

_WARC = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, first_value(r) OVER w AS first_r, first_value(page_id) OVER w AS first_id FROM p WHERE bytes >= 100 WINDOW w AS (PARTITION BY digest ORDER BY page_id NULLS LAST, r))
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN r <> first_r THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN r <> first_r THEN first_id END AS refers_to
FROM p LEFT JOIN (SELECT r, first_r, first_id FROM f) USING (r)
"""

SQL: dict[str, str] = {"op1_quality_rules": _QUALITY, "op2_secret_scan": _SECRETS, "op4_license_scan": _LICENSES, "op11_lexical_search": _SEARCH, "op13_warc": _WARC}
