"""DuckDB SQL for the queries of this package, written apart from their Spark plans."""

from __future__ import annotations

_RUNS = """
runs AS (
  SELECT user_id, event_type, run_no, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM (
    SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM (
      SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS starts FROM events))
  GROUP BY user_id, event_type, run_no)
"""

_SUPPLIERS = """
s AS (
  SELECT l_suppkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT o_custkey) AS n_customers, max(CAST(floor(l_extendedprice) AS BIGINT)) AS top_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey)
"""
_SIGNALS = ("n_lines", "n_parts", "n_customers", "top_price")


def _p(x: str) -> str:
    return f"CASE WHEN min({x}) OVER () < max({x}) OVER () THEN 100.0 * (rank() OVER (ORDER BY {x}) - 1 + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / (count(*) OVER () - 1) ELSE 0 END"


_HOT = f"""
{_SUPPLIERS}, p AS (SELECT l_suppkey, {", ".join(f"{_p(x)} AS p_{x}, CASE WHEN min({x}) OVER () < max({x}) OVER () THEN 1 ELSE 0 END AS a_{x}" for x in _SIGNALS)} FROM s),
h AS (SELECT l_suppkey, round(CASE WHEN {"+".join(f"a_{x}" for x in _SIGNALS)} > 0 THEN ({"+".join(f"p_{x}" for x in _SIGNALS)}) / ({"+".join(f"a_{x}" for x in _SIGNALS)}) ELSE 0 END, 2) AS score FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, l_suppkey) AS position FROM h)
"""

_METRICS = """
m AS (
  SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
    (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS debtors,
    (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation)
"""

_SIZED = "e AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS size, event_type = 'purchase' AS protected FROM events)"

_SLUG = "regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{Nd}}]+', '-', 'g'), '^-|-$', '', 'g')"

_MUTATED = """
a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders),
b AS (
  SELECT CASE WHEN o_orderkey % 89 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0),
cells AS (
  SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, 'o_orderstatus' AS kind, coalesce(a.o_orderstatus, '') AS before, coalesce(b.o_orderstatus, '') AS after FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
  UNION ALL
  SELECT coalesce(a.o_orderkey, b.o_orderkey), 'o_orderpriority', coalesce(a.o_orderpriority, ''), coalesce(b.o_orderpriority, '') FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey),
diffs AS (SELECT * FROM cells WHERE before <> after)
"""

_LINES = """
body AS (SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n$', '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM body WHERE text <> '')
"""

_HALVES = """
want AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
got AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
delta AS (
  SELECT l_partkey, l_returnflag, 'missing' AS kind, count(*) AS n FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM got) GROUP BY ALL
  UNION ALL SELECT l_partkey, l_returnflag, 'unexpected', count(*) FROM (SELECT * FROM got EXCEPT ALL SELECT * FROM want) GROUP BY ALL)
"""

_RESOLVED = """
symbols AS (SELECT lower(concat_ws('|', p_name, p_brand, p_type, CAST(p_size AS VARCHAR))) AS name, p_partkey FROM part),
sites AS (SELECT p_partkey AS site, CASE WHEN p_partkey % 10 = 0 THEN 'no such ' ELSE '' END || lower(concat_ws('|', p_name, p_brand, p_type, CAST(p_size AS VARCHAR))) AS name FROM part),
resolved AS (
  SELECT site, count(p_partkey) AS n_candidates, min(p_partkey) AS candidate,
    CASE WHEN count(p_partkey) = 1 THEN 'matched' WHEN count(p_partkey) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status
  FROM sites LEFT JOIN symbols USING (name) GROUP BY site)
"""

_FINDINGS = f"""
{_LINES}, findings AS (
  SELECT doc_id, line_no, code FROM lines, (VALUES ('R001', 'token|secret|password'), ('R002', '[#$%&*]{{3}}'), ('R003', '[Ll]icen[sc]e'), ('R004', '@[a-z0-9]+[.]'), ('R005', '[0-9]{{6}}'), ('R006', '^[^ ]+$')) d(code, pattern)
  WHERE regexp_matches(line, pattern) AND NOT (code = 'R005' AND regexp_matches(line, '[A-Za-z]{{30}}'))),
directives AS (
  SELECT doc_id, no, line_no, line_no + doc_id % 2 AS target_line, code FROM documents, (VALUES (1, 1), (2, 1), (3, 2)) n(no, line_no), (VALUES ('R002'), ('R003')) c(code))
"""

_DAY = "date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))"
_RANGES = f"ranges AS (SELECT o_custkey, min({_DAY}) AS low, min({_DAY}) + count(*) * 3 AS high FROM orders GROUP BY o_custkey)"

_REFERRALS = """
SELECT a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b ON a.c_custkey // 8 = b.c_custkey // 8
WHERE a.c_custkey <> b.c_custkey AND (a.c_nationkey + 2 * b.c_nationkey + a.c_custkey + {}) % 4 = 0
"""
_TRADE = f"trade AS ({_REFERRALS.format(0)})"
_REACH = f"""
{_TRADE}, reach AS (SELECT c_custkey AS src, c_custkey AS dst FROM customer UNION SELECT reach.src, trade.dst FROM reach JOIN trade ON reach.dst = trade.src)
"""
#: All ways round from each smallest node.
_CYCLES = f"""
{_TRADE}, p AS (
  SELECT src AS root, dst AS at_, [src] AS path FROM trade WHERE dst >= src
  UNION ALL SELECT root, dst, list_append(path, at_) FROM p JOIN trade ON src = at_ WHERE at_ <> root AND (dst = root OR dst > root AND NOT list_contains(list_append(path, at_), dst)))
"""
_FLOW = """
flow AS (
  SELECT DISTINCT p_partkey AS src, p_partkey - p_partkey % 12 + j AS dst FROM part, LATERAL (SELECT unnest([p_partkey % 12 + 1, p_partkey % 12 * 2 + 1, p_partkey % 12 + 5]) AS j)
  WHERE j < 12 AND (p_size % 4 <> 1 OR j <> p_partkey % 12 + 1))
"""
_EFFECTS = f"""
{_TRADE}, calls AS (
  SELECT src, dst, CASE WHEN (src + dst) % 7 = 0 THEN 'ambiguous' WHEN (src + dst) % 19 = 3 THEN 'external' ELSE 'matched' END AS status FROM trade WHERE src % 11 <> 0 AND dst % 13 <> 0),
matched AS (SELECT src, dst FROM calls WHERE status = 'matched'),
facts AS (
  SELECT c_custkey AS node, ['effect', 'state_change', 'state_restore', 'error', 'uncertainty'][c_custkey % 5 + 1] AS family, CASE WHEN c_custkey % 10 = 3 THEN 'may_raise' ELSE c_mktsegment END AS fact FROM customer
  UNION SELECT src, 'uncertainty', status FROM calls WHERE status <> 'matched')
"""

_REGIONS = """
f AS (SELECT 'S' || p_partkey // 500 AS sheet, p_partkey % 500 + 1 AS at_, CASE WHEN p_size % 10 = 3 THEN 0 WHEN p_size % 10 > 7 THEN 1 ELSE 2 END AS kind FROM part),
g AS (SELECT *, at_ - row_number() OVER (PARTITION BY sheet, kind ORDER BY at_) AS run FROM f),
r AS (SELECT sheet, kind, min(at_) AS a, max(at_) AS b, count(*) AS n FROM g GROUP BY sheet, kind, run)
"""


def _formula(row: str) -> str:
    return f"CASE kind WHEN 0 THEN '=A' || {row} || '+''Rate card''!$B$1' WHEN 1 THEN '=ROUND($A' || {row} || '*B$1,2)' ELSE '=A' || {row} || '*B' || {row} END"


_CALLS = """
calls AS (
  SELECT o_orderkey, 'Cust' || c_custkey % 50 AS caller_name, 'N' || c_nationkey AS caller_module, 'Do' || o_orderkey % 40 AS base_name, o_orderstatus AS member
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""


_SINK = "['shell', 'sql', 'http'][{} % 3 + 1]"
_MOVES = f"""
{_FLOW}, assigns AS (SELECT p_partkey AS node, 'v' || (p_partkey + 1) % 4 AS target, 'v' || p_partkey % 4 AS value FROM part WHERE p_partkey % 3 = 1),
cleaned AS (SELECT node, target AS var FROM assigns UNION SELECT p_partkey, 'v' || p_partkey % 4 FROM part WHERE p_partkey % 5 = 3),
moves AS (SELECT node, value AS var, target FROM assigns UNION ALL SELECT dst, v, NULL FROM (SELECT DISTINCT dst FROM flow), (VALUES ('v0'), ('v1'), ('v2'), ('v3')) x(v)),
sources AS (SELECT p_partkey AS node, 'v' || p_partkey // 8 % 4 AS var, CAST(p_partkey AS VARCHAR) AS origin, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS state FROM part WHERE p_partkey % 8 = 0)
"""
#: Every way of every fact, in the first steps of its nodes (begun) and the last (paths); the better of them are picked afterwards.
_PATHS = f"""
{_MOVES}, paths AS (
  SELECT node, var, origin, state, [{{'kind': 'source', 'node': node}}] AS path, CAST(0 AS BIGINT) AS safe FROM sources
  UNION SELECT dst, coalesce(target, f.var), origin, state, CASE WHEN target IS NULL THEN path ELSE list_append(path, {{'kind': 'assignment', 'node': dst}}) END,
    safe | CASE WHEN dst % 7 = 2 AND f.var = 'v' || dst % 4 THEN 1 << (dst % 3) ELSE 0 END
  FROM paths f JOIN flow ON src = f.node JOIN moves m ON m.node = dst AND m.var = f.var
  WHERE target IS NOT NULL OR NOT EXISTS (SELECT 1 FROM cleaned c WHERE c.node = dst AND c.var = f.var)),
ends AS (SELECT node, var, origin, max(state) AS state, arg_min(path, {{'n': len(path), 'p': path}}) AS path, bit_and(safe) AS safe FROM paths GROUP BY ALL),
begins AS (SELECT dst AS node, var, origin, max(state) AS state, arg_min(path, {{'n': len(path), 'p': path}}) AS path, bit_and(safe) AS safe FROM ends JOIN flow ON src = node GROUP BY ALL)
"""
_PATH = "array_to_string(list_transform(path, lambda x: x.kind || ':' || x.node), '>') AS path"
_GUARDED = f"""
{_MOVES}, taint AS (
  SELECT node, var, CAST(origin AS BIGINT) AS origin FROM sources
  UNION SELECT dst, coalesce(target, t.var), origin FROM taint t JOIN flow ON src = t.node AND NOT (dst - src > 1 AND src % 3 < 2 AND t.var = 'v' || src % 4) JOIN moves m ON m.node = dst AND m.var = t.var
  WHERE target IS NOT NULL OR NOT EXISTS (SELECT 1 FROM cleaned c WHERE c.node = dst AND c.var = t.var))
"""

SQL: dict[str, str] = {
    "w1_runs": f"WITH {_RUNS} SELECT user_id, event_type, start_ts, end_ts, n FROM runs",
    "w2_outlier_runs": f"""WITH {_RUNS} SELECT user_id, event_type, start_ts FROM (
        SELECT *, lag(n) OVER w AS n0, lead(n) OVER w AS n1, lag(event_type) OVER w AS k0, lead(event_type) OVER w AS k1 FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY run_no))
        WHERE n = 1 AND n0 > 1 AND n1 > 1 AND k0 = k1 AND k0 <> event_type""",
    "w3_percentile": f"WITH {_SUPPLIERS} SELECT l_suppkey, {', '.join(f'round({_p(x)}, 6) AS p_{x}' for x in _SIGNALS)} FROM s",
    "w4_hotspots": f"WITH {_HOT} SELECT l_suppkey, score, position FROM r",
    "l4_topn_or_threshold": f"WITH {_HOT} SELECT l_suppkey, score, position, position <= 5 AS by_top, score >= 60 AS by_score FROM r WHERE position <= 5 OR score >= 60",
    "p14_thresholds": f"WITH {_METRICS} SELECT n_nationkey, 'customers' AS metric, customers AS value, CAST(60 AS BIGINT) AS threshold FROM m WHERE customers > 60 UNION ALL SELECT n_nationkey, 'debtors', debtors, 5 FROM m WHERE debtors > 5",
    "w5_priority_overlay": """SELECT o_orderkey, o_orderstatus, priority, seq FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY priority DESC, seq DESC, o_orderstatus DESC) AS rn FROM (
          SELECT o_orderkey, o_orderstatus, 0 AS priority, 0 AS seq FROM orders
          UNION ALL SELECT o_orderkey, 'X', CAST(o_orderkey % 2 AS INTEGER), 1 FROM orders WHERE o_orderkey % 3 = 0)) WHERE rn = 1""",
    "w6_keep_last": f"WITH {_SIZED} SELECT user_id, event_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM e) WHERE recency <= 3",
    "w7_size_budget": f"""WITH {_SIZED} SELECT user_id, event_id FROM (
        SELECT *, sum(size) OVER (PARTITION BY user_id) - coalesce(sum(CASE WHEN NOT protected THEN size ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM e)
        WHERE NOT protected AND remaining > 1000""",
    "w8_latest": "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "p_older_than": "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-08'",
    "w9_last_n": """SELECT event_type, event_id, total, total > 200 AS truncated, recency FROM (
        SELECT *, count(*) OVER (PARTITION BY event_type) AS total, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS recency FROM events) WHERE recency <= 200""",
    "w10_redeclared": "SELECT p_partkey, occurrence, first_partkey FROM (SELECT p_partkey, row_number() OVER w AS occurrence, first_value(p_partkey) OVER w AS first_partkey FROM part WINDOW w AS (PARTITION BY p_name, p_brand ORDER BY p_partkey)) WHERE occurrence > 1",
    "w11_unique_names": f"WITH p AS (SELECT p_partkey, {_SLUG.format('p_name')} AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS no FROM p) SELECT p_partkey, CASE WHEN no = 1 THEN slug ELSE slug || '-' || no END AS unique_name FROM n",
    "w12_nearby": "SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '>') AS context FROM events",
    "j2_added_removed": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-04-01'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-04-01')
        SELECT o_custkey, 'removed' AS kind FROM a WHERE o_custkey NOT IN (SELECT * FROM b) UNION ALL SELECT o_custkey, 'added' FROM b WHERE o_custkey NOT IN (SELECT * FROM a)""",
    "j3_cell_diff": f"WITH {_MUTATED} SELECT * FROM diffs",
    "j4_file_diff": f"""WITH {_MUTATED} SELECT * FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
        CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'changed' END AS kind
        FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) WHERE kind IS NOT NULL""",
    "a3_diff_summary": f"WITH {_MUTATED} SELECT kind, count(*) AS n FROM diffs GROUP BY kind UNION ALL SELECT 'total', count(*) FROM diffs",
    "j5_line_diff": f"""WITH {_LINES}, later AS (SELECT doc_id - 1 AS doc_id, line_no, line FROM lines),
        d AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.line_no, b.line_no) AS line_no, coalesce(a.line, '') AS before, coalesce(b.line, '') AS after FROM lines a FULL JOIN later b ON a.doc_id = b.doc_id AND a.line_no = b.line_no)
        SELECT * FROM d WHERE before <> after""",
    "u1_multiset_delta": f"WITH {_HALVES} SELECT * FROM delta",
    "a7_delta_by_flag": f"WITH {_HALVES} SELECT l_returnflag, CAST(sum(CASE WHEN kind = 'missing' THEN n ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN kind = 'unexpected' THEN n ELSE 0 END) AS BIGINT) AS unexpected FROM delta GROUP BY l_returnflag",
    "a1_status": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus <> 'F') AS O, false AS total FROM orders GROUP BY 1 UNION ALL SELECT NULL, count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus <> 'F'), true FROM orders",
    "a2_summaries": "SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS size, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS states FROM lineitem GROUP BY 1",
    "a4_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, 2 - CASE WHEN grouping(l_returnflag) = 1 THEN 1 ELSE 0 END - CASE WHEN grouping(l_linestatus) = 1 THEN 1 ELSE 0 END AS level FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))",
    "a4_surface_pivot": "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') AS n_purchase FROM events GROUP BY 1",
    "a5_inventory": "WITH a AS (SELECT o_custkey AS key, count(*) AS actual FROM orders GROUP BY 1), d AS (SELECT c_custkey AS key, c_custkey % 20 AS declared FROM customer) SELECT key, actual, declared FROM a FULL JOIN d USING (key) WHERE actual IS DISTINCT FROM declared",
    "a8_precision": """SELECT lang, tp AS true_positive, fp AS false_positive, n, tp / nullif(tp + fp, 0) AS precision, unreviewed FROM (
        SELECT lang, count(*) FILTER (quality IS NULL) AS unreviewed, count(*) FILTER (n_chars > 500 AND quality = 1) AS tp, count(*) FILTER (n_chars > 500 AND quality <> 1) AS fp, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)""",
    "a11_fans": """WITH e AS (SELECT DISTINCT o_custkey % 500 AS src, l_suppkey % 500 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 500 <> l_suppkey % 500)
        SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node""",
    "a12_module_rollup": "SELECT c_nationkey, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT) AS sum_balance, max(CAST(floor(c_acctbal) AS BIGINT)) AS max_balance, count(*) FILTER (c_mktsegment = 'BUILDING') AS n_building FROM customer GROUP BY 1",
    "a13_counters": "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS bought, count(*) FILTER (event_type NOT IN ('view', 'purchase')) AS other, count(*) FILTER (value > 50) AS large FROM events GROUP BY 1",
    "a15_evidence": "SELECT l_suppkey, l_returnflag, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS evidence FROM lineitem GROUP BY 1, 2",
    "a17_stage_totals": """WITH s AS (SELECT event_type, event_id, CAST(floor(value) AS BIGINT) AS elapsed, CASE WHEN event_id % 1000 = 7 THEN 2 WHEN event_id % 50 = 3 THEN 1 ELSE 0 END AS rank FROM events)
        SELECT event_type, CAST(sum(elapsed) AS BIGINT) AS elapsed, ['ok', 'error', 'canceled'][max(rank) + 1] AS outcome, CAST(row_number() OVER (ORDER BY min(event_id)) AS INTEGER) AS place FROM s GROUP BY event_type""",
    "a19_first_wins": "SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2",
    "a23_digest": """WITH l AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, coalesce(sha256(text), '') AS h FROM documents),
        a AS (SELECT source, i // 256 AS i, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM l GROUP BY source, i // 256),
        b AS (SELECT source, i // 256 AS i, CASE WHEN count(*) = 1 AND i // 256 = 0 THEN any_value(h) ELSE sha256(string_agg(h, chr(10) ORDER BY i)) END AS h FROM a GROUP BY source, i // 256),
        c AS (SELECT source, i // 256 AS i, CASE WHEN count(*) = 1 AND i // 256 = 0 THEN any_value(h) ELSE sha256(string_agg(h, chr(10) ORDER BY i)) END AS h FROM b GROUP BY source, i // 256)
        SELECT source, h AS digest FROM c""",
    "j6_resolution": f"WITH {_RESOLVED} SELECT * FROM resolved",
    "a9_status_counts": f"WITH {_RESOLVED} SELECT status, count(*) AS n FROM resolved GROUP BY status",
    "j6_visibility": """WITH c AS (SELECT c_custkey AS site, c_nationkey AS module, c_custkey % 120 AS name FROM customer), v AS (
        SELECT site, s_suppkey, s_suppkey % 3 <> 0 OR s_nationkey = module AS seen FROM c LEFT JOIN supplier ON s_suppkey = name)
        SELECT site, count(*) FILTER (seen) AS n_candidates, min(s_suppkey) FILTER (seen) AS candidate,
          CASE WHEN count(*) FILTER (seen) = 1 THEN 'matched' WHEN count(*) FILTER (seen) > 1 THEN 'ambiguous' WHEN count(s_suppkey) > 0 THEN 'inaccessible' ELSE 'unresolved' END AS status FROM v GROUP BY site""",
    "j9_followers": "SELECT p.p_partkey, a.p_name AS anchor_formula, CASE WHEN a.p_partkey IS NULL THEN 'failed' ELSE 'ok' END AS parse_status FROM part p LEFT JOIN part a ON a.p_partkey = p.p_partkey % 60 AND a.p_partkey % 5 <> 0",
    "j10_expand": """SELECT p_partkey, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col FROM (SELECT p_partkey, p_size AS r0, p_size + p_partkey % 4 - 1 AS r1, p_partkey % 3 + 1 AS c1 FROM part),
        LATERAL (SELECT unnest(range(r0, r1 + 1)) AS "row"), LATERAL (SELECT unnest(range(1, c1 + 1)) AS col)""",
    "p11_code_only": f"""WITH {_LINES}, code AS (SELECT doc_id, line_no, regexp_replace(regexp_extract(line, '^((?:[^"'']|"(?:[^"]|"")*(?:"|$))*)', 1), '"(?:[^"]|"")*"', '""', 'g') AS line FROM lines)
        SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, code FROM code, (VALUES ('R001', 'token|secret|password'), ('R003', '[Ll]icen[sc]e'), ('R006', '^[^ ]+$')) d(code, pattern)
        WHERE regexp_matches(line, pattern) AND NOT (code = 'R001' AND regexp_matches(line, '=$'))""",
    "p11_detectors": f"WITH {_FINDINGS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, code FROM findings",
    "j12_suppressed": f"WITH {_FINDINGS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, code FROM findings f WHERE NOT EXISTS (SELECT 1 FROM directives d WHERE d.doc_id = f.doc_id AND d.target_line = f.line_no AND d.code = f.code)",
    "j12_unused_directives": f"""WITH {_FINDINGS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(target_line AS INTEGER) AS target_line, code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, target_line, code ORDER BY line_no, no) AS rn FROM directives) d
        WHERE rn > 1 OR NOT EXISTS (SELECT 1 FROM findings f WHERE d.doc_id = f.doc_id AND d.target_line = f.line_no AND d.code = f.code)""",
    "j13_unreached": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "j15_shadowing": """WITH l AS (SELECT p_partkey, p_partkey % 400 AS k, row_number() OVER (PARTITION BY p_brand, p_partkey % 400 ORDER BY p_partkey) AS rn FROM part)
        SELECT * FROM (SELECT p_partkey, CASE WHEN k IN (SELECT s_suppkey * 7 FROM supplier) THEN 'module' WHEN k IN (SELECT s_suppkey * 3 FROM supplier) THEN 'procedure' WHEN rn > 1 THEN 'duplicate' END AS shadows FROM l) WHERE shadows IS NOT NULL""",
    "j16_consume": """WITH a AS (SELECT user_id, event_type, event_id AS review_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events WHERE event_id % 3 = 0),
        b AS (SELECT user_id, event_type, event_id AS row_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events WHERE event_id % 3 <> 0)
        SELECT review_id, row_id FROM a JOIN b USING (user_id, event_type, rn)""",
    "p7_empty_groups": "SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 GROUP BY 1",
    "p13_violations": """SELECT p_partkey, 'large_is_dear' AS "constraint" FROM part WHERE p_size > 45 AND NOT p_retailprice > 1000
        UNION ALL SELECT p_partkey, 'unique' FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_name, p_brand, p_type, p_size) AS n FROM part) WHERE n > 1""",
    "p5_point_in_range": f"WITH {_RANGES} SELECT o_orderkey, arg_min(r.o_custkey, (low, r.o_custkey)) AS o_custkey FROM orders o JOIN ranges r ON {_DAY} BETWEEN low AND high GROUP BY o_orderkey",
    "p6_overlap": f"WITH {_RANGES} SELECT a.o_custkey, b.o_custkey AS other FROM ranges a JOIN ranges b ON a.low <= b.high AND b.low <= a.high",
    "c1_formula_regions": f"""WITH {_REGIONS} SELECT sheet, CASE WHEN a = b THEN 'C' || a ELSE 'C' || a || ':C' || b END AS range, formula_r1c1, {_formula("a")} AS example_formula, n AS count,
          coalesce(n = 1 AND n0 > 1 AND n1 > 1 AND k0 = k1 AND k0 <> kind, false) AS is_outlier, CASE kind WHEN 1 THEN 'ROUND' ELSE '' END AS functions, CASE kind WHEN 0 THEN 'Rate card' ELSE '' END AS depends_on_sheets
        FROM (SELECT *, ['=RC[-2]+''Rate card''!R1C2', '=ROUND(RC1*R1C[-1],2)', '=RC[-2]*RC[-1]'][kind + 1] AS formula_r1c1, lag(n) OVER w AS n0, lead(n) OVER w AS n1, lag(kind) OVER w AS k0, lead(kind) OVER w AS k1,
          lag(b) OVER w AS b0, lead(a) OVER w AS a1 FROM r WINDOW w AS (PARTITION BY sheet ORDER BY a))""",
    "c1_region_at": f"WITH {_REGIONS} SELECT CASE WHEN a = b THEN 'C' || a ELSE 'C' || a || ':C' || b END AS range, n AS count FROM r WHERE sheet = 'S1' AND a <= 200 AND b >= 100",
    "s18_layered": """WITH base AS (SELECT 'K' || p_partkey % 700 AS name, max(p_size) AS p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1)
        SELECT lower(name) AS name, CASE WHEN p_partkey % 10 = 0 THEN -1 ELSE p_size END AS p_size, p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'base,over' ELSE 'base' END AS tags FROM base""",
    "g1_impact": f"""WITH RECURSIVE {_TRADE}, d AS (SELECT c_custkey AS node, 0 AS distance FROM customer WHERE c_custkey % 16 = 1 UNION SELECT dst, distance + 1 FROM d JOIN trade ON src = node WHERE distance < 3),
        u AS (SELECT c_custkey AS node, 0 AS distance FROM customer WHERE c_custkey % 16 = 1 UNION SELECT src, distance + 1 FROM u JOIN trade ON dst = node WHERE distance < 3)
        SELECT node, min(distance) AS distance FROM (SELECT * FROM d UNION ALL SELECT * FROM u) WHERE node % 16 <> 1 GROUP BY node""",
    "g3_reachability": f"""WITH RECURSIVE {_TRADE}, c AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 24 = 0 UNION SELECT dst FROM c JOIN trade ON src = node),
        named AS (SELECT c_custkey AS src, c_custkey + 8 AS dst FROM customer WHERE c_custkey % 10 = 3 AND c_custkey // 8 % 4 <> 3), every AS (SELECT * FROM trade UNION SELECT * FROM named),
        several AS (SELECT c_custkey // 24 AS root FROM customer WHERE c_custkey % 24 IN (9, 10) GROUP BY 1 HAVING count(*) > 1),
        alone AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 24 IN (9, 10) AND c_custkey // 24 NOT IN (SELECT root FROM several)),
        sure AS (SELECT node FROM c UNION SELECT node FROM alone UNION SELECT dst FROM sure JOIN trade ON src = node),
        maybe AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 24 = 5 OR c_custkey % 24 IN (9, 10) AND c_custkey // 24 IN (SELECT root FROM several) UNION SELECT dst FROM named WHERE src IN (SELECT node FROM sure)
          UNION SELECT dst FROM maybe JOIN every ON src = node)
        SELECT node, tier FROM (SELECT c_custkey AS node, CASE WHEN c_custkey IN (SELECT node FROM sure) THEN 'confirmed' WHEN c_custkey IN (SELECT node FROM maybe) THEN 'possible' WHEN c_nationkey % 2 = 0 THEN 'unreachable' END AS tier FROM customer) WHERE tier IS NOT NULL""",
    "g5_components": f"""WITH RECURSIVE {_TRADE}, b AS (SELECT src, dst FROM trade UNION SELECT dst, src FROM trade), c AS (SELECT c_custkey AS node, c_custkey AS other FROM customer UNION SELECT c.node, b.dst FROM c JOIN b ON c.other = b.src)
        SELECT node, min(other) AS component FROM c GROUP BY node""",
    "g6_scc": f"""WITH RECURSIVE {_REACH}, c AS (SELECT a.src AS node, min(a.dst) AS component, count(*) AS size FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT node, component, size, size > 1 AS cyclic FROM c""",
    "g6_witness": f"""WITH RECURSIVE {_REACH}, c AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(*) > 1),
        p AS (SELECT component, component AS at_, [component] AS path FROM c WHERE node = component
          UNION ALL SELECT p.component, dst, list_append(path, dst) FROM p JOIN trade ON src = at_ JOIN c ON c.node = dst AND c.component = p.component WHERE len(path) <= 25 AND (dst = p.component AND at_ <> dst OR NOT list_contains(path, dst)) AND (len(path) = 1 OR at_ <> p.component))
        SELECT component, array_to_string(min(path[:-2]), '>') AS cycle, CAST(len(min(path[:-2])) AS INTEGER) AS length FROM p JOIN (SELECT component, min(len(path)) AS l FROM p WHERE at_ = component AND len(path) > 1 GROUP BY component) m USING (component) WHERE at_ = component AND len(path) = l GROUP BY component""",
    "g7_cycles": f"""WITH RECURSIVE {_CYCLES}, w AS (SELECT src, dst FROM trade UNION SELECT w.src, trade.dst FROM w JOIN trade ON w.dst = trade.src),
        s AS (SELECT a.src AS node, min(a.dst) AS component FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
        SELECT component, array_to_string(path, '>') AS cycle, CAST(len(path) AS BIGINT) AS length, true AS complete FROM p JOIN s ON s.node = root WHERE at_ = root""",
    "g8_participation": f"WITH RECURSIVE {_CYCLES} SELECT node, count(*) AS cycles, true AS complete FROM (SELECT unnest(path) AS node FROM p WHERE at_ = root) GROUP BY node",
    "l2_custom_order": "SELECT c_mktsegment, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END AS INTEGER) AS rank, count(*) AS n FROM customer GROUP BY ALL",
    "l5_total_and_first": "SELECT p_partkey, (SELECT count(*) FROM part WHERE p_size > 25) AS total FROM part WHERE p_size > 25 ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
    "r3_diagnostic_order": f"WITH {_FINDINGS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, code, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, code) AS place FROM findings",
    "x36_unary": "SELECT p_partkey, CAST(-p_partkey AS BIGINT) AS negated, CAST(-p_partkey - 1 AS BIGINT) AS inverted, CAST(NULL AS BIGINT) AS overflow, pow(p_partkey, -(p_partkey % 3)) AS power FROM part",
    "g9_affected": f"WITH RECURSIVE {_REACH} SELECT src, count(DISTINCT c_nationkey) AS nations, count(*) AS nodes FROM reach JOIN customer ON c_custkey = dst GROUP BY src",
    "g13_dominators": f"""WITH RECURSIVE {_FLOW}, loops AS (SELECT src, dst FROM flow UNION SELECT p_partkey, p_partkey - 4 FROM part WHERE p_size % 5 = 0 AND p_partkey % 12 >= 4),
        r AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 12 = 0 UNION SELECT dst FROM r JOIN loops ON src = node),
        s AS (SELECT node AS without, node - node % 12 AS node FROM r WHERE node % 12 <> 0 UNION SELECT without, dst FROM s JOIN loops ON src = s.node WHERE dst <> without),
        d AS (SELECT a.node, b.node AS over FROM r a JOIN r b ON a.node // 12 = b.node // 12 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.without = b.node AND s.node = a.node)),
        n AS (SELECT node, count(*) - 1 AS depth FROM d GROUP BY node)
        SELECT d.node, arg_max(over, o.depth) FILTER (over <> d.node) AS idom, any_value(n.depth) AS depth FROM d JOIN n ON n.node = d.node JOIN n o ON o.node = over GROUP BY d.node""",
    "g14_assigned": f"""WITH RECURSIVE {_FLOW}, r AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 12 = 0 UNION SELECT dst FROM r JOIN flow ON src = node),
        m AS (SELECT f AS fact, p_partkey AS node FROM part, range(3) t(f) WHERE p_partkey % 12 = 0 AND p_partkey % 3 <> f UNION SELECT fact, dst FROM m JOIN flow ON src = m.node WHERE dst % 3 <> fact OR dst > (SELECT max(p_partkey) FROM part))
        SELECT r.node, CAST(f AS BIGINT) AS fact FROM r, range(3) t(f) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.fact = f AND m.node = r.node)""",
    "g15_cleanup": f"""WITH RECURSIVE {_FLOW}, r AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 12 = 0 UNION SELECT dst FROM r JOIN flow ON src = node WHERE dst % 12 NOT IN (2, 7, 8))
        SELECT p_partkey AS node, p_partkey NOT IN (SELECT node FROM r) AS guaranteed FROM part WHERE p_partkey % 12 >= 9""",
    "d6_witness": f"""WITH RECURSIVE {_EFFECTS}, w AS (SELECT DISTINCT node, [node] AS chain FROM facts WHERE fact = 'may_raise'
          UNION SELECT src, list_prepend(src, chain) FROM w JOIN matched ON dst = w.node WHERE NOT list_contains(chain, src)),
        b AS (SELECT node, arg_min(chain, {{'n': len(chain), 'c': chain}}) AS chain FROM w GROUP BY node)
        SELECT node, chain[2] AS witness, array_to_string(chain, '>') AS chain FROM b WHERE len(chain) > 1""",
    "g12_flow_reachable": f"""WITH RECURSIVE {_FLOW}, normal AS (SELECT src, dst FROM flow WHERE (src + dst) % 3 <> 0),
        r AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 12 = 0 UNION SELECT dst FROM r JOIN normal ON src = node),
        o AS (SELECT DISTINCT p_partkey // 12 AS graph FROM part WHERE p_size % 17 = 3 AND p_partkey IN (SELECT node FROM r)),
        m AS (SELECT p_partkey AS node FROM part WHERE p_partkey // 12 IN (SELECT graph FROM o) AND p_partkey % 12 NOT IN (0, 11) UNION SELECT dst FROM m JOIN normal ON src = node)
        SELECT p_partkey // 12 AS graph, p_partkey AS node, CASE p_partkey % 12 WHEN 0 THEN 'entry' WHEN 11 THEN 'exit' ELSE 'statement' END AS kind,
          CASE WHEN p_partkey IN (SELECT node FROM r) THEN 'flow' WHEN p_partkey IN (SELECT node FROM m) THEN 'unknown' END AS via FROM part""",
    "d6_effects": f"""WITH RECURSIVE {_EFFECTS}, r AS (SELECT c_custkey AS src, c_custkey AS dst FROM customer UNION SELECT r.src, m.dst FROM r JOIN matched m ON r.dst = m.src)
        SELECT src AS node, family, fact, bool_or(src = node) AS direct FROM r JOIN facts ON node = dst GROUP BY ALL""",
    "a14_depths": "WITH RECURSIVE d AS (SELECT p_partkey AS node, 1 AS depth FROM part WHERE p_partkey <= 3 UNION ALL SELECT p_partkey, depth + 1 FROM d JOIN part ON p_partkey > 3 AND p_partkey // 3 = node) SELECT node, depth FROM d",
    "l8_rotation": """WITH c AS (SELECT p_partkey, list_transform(range(1, 6), lambda i: (p_partkey * 7 + i * 31) % 101) AS c FROM part), m AS (SELECT *, list_position(c, list_min(c)) AS at_ FROM c)
        SELECT p_partkey, array_to_string(list_concat(c[at_:], c[:at_ - 1]), '>') AS cycle FROM m""",
    "x_scalars": f"""WITH p AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, CAST(p_partkey AS HUGEINT) * 4611686018427 AS big, p_brand || ' / ' || p_type AS name FROM part)
        SELECT k AS p_partkey, {_SLUG.format("name")} AS slug,
          CASE WHEN k < 1 THEN NULL WHEN k <= 26 THEN chr(CAST(64 + k AS INTEGER)) WHEN k <= 702 THEN chr(CAST(65 + (k - 27) // 26 AS INTEGER)) || chr(CAST(65 + (k - 27) % 26 AS INTEGER)) WHEN k <= 18278 THEN chr(CAST(65 + (k - 703) // 676 AS INTEGER)) || chr(CAST(65 + (k - 703) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (k - 703) % 26 AS INTEGER)) END AS letters,
          CASE WHEN k BETWEEN 1 AND 18278 THEN CAST(k AS INTEGER) END AS number, CASE WHEN pow(s, k % 12) < 9007199254740992 THEN CAST(pow(s, k % 12) AS BIGINT) END AS power,
          CAST(k * CASE k % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 ELSE 1073741824 END AS BIGINT) AS bytes,
          CASE WHEN big * s * 1000000 <= 9223372036854775807 THEN CAST(big * s * 1000000 AS BIGINT) END AS value_0, CASE WHEN big * s * 1000000 <= 9223372036854775807 THEN 'known' ELSE 'unknown' END AS status_0,
          CAST(big + s AS BIGINT) AS value_1, 'known' AS status_1, CAST(s AS DOUBLE) / nullif(k % 3, 0) AS value_2, CASE WHEN k % 3 = 0 THEN 'invalid' ELSE 'known' END AS status_2,
          k // nullif(k % 4, 0) AS value_3, CASE WHEN k % 4 = 0 THEN 'invalid' ELSE 'known' END AS status_3, k % nullif(k % 5, 0) AS value_4, CASE WHEN k % 5 = 0 THEN 'invalid' ELSE 'known' END AS status_4 FROM p""",
    "t1_upsert": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "t3_sessions": """SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""",
    "p1_calls_from": f"WITH {_CALLS} SELECT o_orderkey FROM calls WHERE caller_module = 'N7'",
    "p2_calls_to": f"WITH {_CALLS} SELECT o_orderkey FROM calls WHERE base_name = 'Do7'",
    "p3_search": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'e')",
    "j17_matching": """WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 AND event_id % 6 <> 0 GROUP BY ALL), w AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 6 = 0 GROUP BY ALL),
        a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL), m AS (SELECT e.user_id, sum(least(e.n, a.n)) AS n FROM e JOIN a USING (user_id, event_type) GROUP BY ALL),
        t AS (SELECT user_id, count(*) FILTER (event_id % 2 = 0) AS n_expected, count(*) FILTER (event_id % 2 = 1) AS n_actual FROM events GROUP BY user_id)
        SELECT user_id, n_expected, n_actual, CAST(coalesce(m.n, 0) + least(coalesce(w.n, 0), n_actual - coalesce(m.n, 0)) AS BIGINT) AS n_matched FROM t LEFT JOIN m USING (user_id) LEFT JOIN w USING (user_id)""",
    "j18_hierarchy": f"WITH {_CALLS} SELECT caller_name, base_name, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS places FROM calls GROUP BY ALL",
    "g10_dependencies": f"""WITH {_CALLS}, e AS (
          SELECT 'procedure' AS kind, caller_name AS src, base_name AS dst, o_orderkey % 9 AS line FROM calls
          UNION ALL SELECT 'module', caller_module, 'N' || o_orderkey % 25, o_orderkey % 9 FROM calls WHERE caller_module <> 'N' || o_orderkey % 25
          UNION ALL SELECT 'type', caller_module, member, o_orderkey % 5 FROM calls)
        SELECT kind, src, dst, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines FROM e GROUP BY ALL""",
    "a21_state_access": """WITH e AS (SELECT event_type, CAST(user_id % 12 AS VARCHAR) AS p, event_id % 4 AS k FROM events)
        SELECT event_type, coalesce(string_agg(DISTINCT p, ',' ORDER BY p) FILTER (k IN (0, 3)), '') AS readers, coalesce(string_agg(DISTINCT p, ',' ORDER BY p) FILTER (k IN (1, 3)), '') AS writers, coalesce(string_agg(DISTINCT p, ',' ORDER BY p) FILTER (k IN (2, 3)), '') AS mutators FROM e GROUP BY 1""",
    "d1_taint": f"WITH RECURSIVE {_PATHS} SELECT node, var, origin, state, {_PATH}, safe FROM ends",
    "d2_sinks": f"""WITH RECURSIVE {_PATHS} SELECT node, {_SINK.format("(node // 2)")} AS sink, var, origin, state, {_PATH} FROM begins WHERE node % 2 = 1 AND node IN (SELECT p_partkey FROM part) AND var = 'v' || node % 4 AND (safe >> (node // 2 % 3)) & 1 = 0""",
    "d3_guards": f"WITH RECURSIVE {_GUARDED} SELECT node, var, origin FROM taint",
    "d7_provenance": f"WITH RECURSIVE {_REACH} SELECT src AS owner, dst AS origin, c_mktsegment AS fact, CAST(c_nationkey AS BIGINT) AS nation FROM reach JOIN customer ON c_custkey = dst WHERE src <> dst",
    "t2_postings": """WITH r AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS generation, event_id, event_type FROM events), t AS (SELECT user_id, max(generation) AS g FROM r GROUP BY user_id)
        SELECT user_id, generation, event_id, event_type FROM r JOIN t USING (user_id) WHERE generation = g AND NOT (g = 1 AND user_id % 5 = 0)""",
    "t7_watched_files": "SELECT user_id, CASE WHEN arg_max(event_id, event_id) % 3 = 0 THEN 'remove' ELSE 'refresh' END AS action, count(*) AS n FROM events GROUP BY user_id",
    "g11_affected": f"""WITH RECURSIVE b AS ({_REFERRALS.format(0)} UNION {_REFERRALS.format(1)}), a AS (SELECT c_custkey AS node, 0 AS distance FROM customer WHERE c_custkey % 32 = 6 UNION SELECT src, distance + 1 FROM a JOIN b ON dst = node WHERE distance < 8)
        SELECT node, min(distance) AS distance FROM a GROUP BY node""",
    "j19_assignable": """WITH RECURSIVE up AS (SELECT n_nationkey AS s, n_nationkey AS t FROM nation UNION SELECT s, t // 2 FROM up WHERE t > 0)
        SELECT 'T' || n_nationkey AS source, name AS target, CASE WHEN n_nationkey < 23 AND k < 23 THEN EXISTS (SELECT 1 FROM up WHERE s = n_nationkey AND t = k) END AS assignable FROM nation, (VALUES ('t1', 1), ('t2', 2), ('T24', 24)) x(name, k)""",
}
