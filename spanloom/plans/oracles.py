"""ANSI SQL (DuckDB) for the registered queries, over the driver's whole tables."""

from __future__ import annotations

ITEMS = """
items AS (SELECT l_orderkey AS okey, ord, l_quantity AS dur_us,
  coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rel_us,
  CASE WHEN l_returnflag = 'R' THEN 'sysvec_item_' ELSE 'item_' END || l_returnflag || l_linestatus AS func,
  CASE WHEN l_returnflag = 'R' THEN 9 ELSE 1 END AS flags
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord FROM lineitem)),
ords AS (SELECT *, coalesce(sum(dur_us) OVER (PARTITION BY ckey ORDER BY okey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rel_us,
  coalesce(sum(n_lines) OVER (PARTITION BY ckey ORDER BY okey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rel_line,
  row_number() OVER (PARTITION BY ckey ORDER BY okey) AS ord FROM (
  SELECT o_orderkey AS okey, o_custkey AS ckey, replace(o_orderpriority, ' ', '_') AS func,
  coalesce(s, 0) + 10 + CASE WHEN o_orderkey % 97 = 0 THEN 4000 ELSE 0 END AS dur_us, coalesce(n, 0) AS n_items,
  CASE WHEN coalesce(n, 0) > 0 THEN n + 2 ELSE 1 END AS n_lines
  FROM orders LEFT JOIN (SELECT okey, sum(dur_us) AS s, count(*) AS n FROM items GROUP BY 1) i ON i.okey = o_orderkey)),
cust AS (SELECT *, coalesce(sum(dur_us) OVER (PARTITION BY nkey ORDER BY ckey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_us,
  coalesce(sum(n_lines) OVER (PARTITION BY nkey ORDER BY ckey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM (
  SELECT c_custkey AS ckey, c_nationkey AS nkey, c_mktsegment AS func, coalesce(s, 0) + 5 AS dur_us, coalesce(n, 0) AS n_orders,
  CASE WHEN coalesce(n, 0) > 0 THEN l + 2 ELSE 1 END AS n_lines
  FROM customer LEFT JOIN (SELECT ckey, sum(dur_us) AS s, sum(n_lines) AS l, count(*) AS n FROM ords GROUP BY 1) o ON o.ckey = c_custkey))"""

TREE = "WITH " + ITEMS + """,
t0 AS (SELECT 'n' || nkey AS trace_id, ckey AS span_id, func, start_us, dur_us, NULL::BIGINT AS parent_id, 0 AS depth, ckey AS ord,
  nkey % 4 AS cpu, (ckey + 1)::VARCHAR AS task_key, CASE WHEN n_orders = 0 THEN 1 ELSE 0 END AS flags, func AS f0, NULL::VARCHAR AS f1, ckey AS p0, NULL::BIGINT AS p1 FROM cust),
t1 AS (SELECT 'n' || nkey AS trace_id, 1000000000000 + okey AS span_id, o.func, c.start_us + o.rel_us AS start_us, o.dur_us, c.ckey AS parent_id, 1 AS depth, o.ord,
  nkey % 4 AS cpu, (c.ckey + 1)::VARCHAR AS task_key, CASE WHEN n_items = 0 THEN 1 ELSE 0 END AS flags, c.func AS f0, o.func AS f1, c.ckey AS p0, 1000000000000 + okey AS p1
  FROM ords o JOIN cust c ON c.ckey = o.ckey),
t2 AS (SELECT trace_id, i.ord * 2000000000000 + i.okey AS span_id, i.func, t1.start_us + i.rel_us AS start_us, i.dur_us, t1.span_id AS parent_id, 2 AS depth, i.ord,
  cpu, task_key, i.flags, f0, f1, p0, p1 FROM items i JOIN t1 ON t1.span_id = 1000000000000 + i.okey),
tree AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2),
st AS (SELECT t.*, flags >= 8 AS irq, coalesce(q.irq_us, 0) AS irq_us, greatest(0, t.dur_us - coalesce(k.cd, 0)) AS self_us, coalesce(k.n, 0) AS kids FROM tree t
  LEFT JOIN (SELECT trace_id, parent_id, sum(dur_us) AS cd, count(*) AS n FROM tree WHERE parent_id IS NOT NULL GROUP BY ALL) k ON k.trace_id = t.trace_id AND k.parent_id = t.span_id
  LEFT JOIN (SELECT trace_id, a AS span_id, sum(dur_us) AS irq_us FROM (SELECT trace_id, p0 AS a, dur_us FROM tree WHERE flags >= 8 UNION ALL
    SELECT trace_id, p1, dur_us FROM tree WHERE flags >= 8) GROUP BY ALL) q ON q.trace_id = t.trace_id AND q.span_id = t.span_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id, func ORDER BY dur_us) - 1 AS i, count(*) OVER (PARTITION BY trace_id, func) AS n FROM st),
fs AS (SELECT trace_id, func, count(*) AS "count", count(*) AS timed, sum(dur_us) AS total_us, sum(self_us) AS self_us, min(dur_us) AS min_us, max(dur_us) AS max_us,
  max(CASE WHEN i = (n - 1) // 2 THEN dur_us END) AS mid_lo, max(CASE WHEN i = n // 2 THEN dur_us END) AS mid_hi, median(dur_us) AS p50,
  max(CASE WHEN i = least(n - 1, floor(n * 0.9::DOUBLE)) THEN dur_us END) AS p90, max(CASE WHEN i = least(n - 1, floor(n * 0.99::DOUBLE)) THEN dur_us END) AS p99 FROM ranked GROUP BY ALL)
"""

OUT = TREE + """,
meta AS (SELECT trace_id, max(start_us + dur_us) AS duration_us FROM tree GROUP BY 1),
dev AS (SELECT st.trace_id, st.func, st.span_id, st.dur_us, st.p0, st.p1, st.depth, p50, timed,
  (log2(greatest(mid_lo, 1e-3)) + log2(greatest(mid_hi, 1e-3))) / 2 AS med FROM st JOIN fs ON fs.trace_id = st.trace_id AND fs.func = st.func WHERE timed - 1 >= 8 AND p50 > 0),
mad AS (SELECT trace_id, func, median(abs(log2(greatest(dur_us, 1e-3)) - med)) AS mad FROM dev GROUP BY ALL),
cand AS (SELECT d.* FROM dev d JOIN mad m ON m.trace_id = d.trace_id AND m.func = d.func JOIN meta ON meta.trace_id = d.trace_id
  WHERE (log2(dur_us) - med) / greatest(1.4826 * mad, 0.25) >= 4 AND dur_us >= 3 * p50
  AND dur_us - p50 >= greatest(p50, greatest(10, least(50, duration_us * 1e-5)))),
kept AS (SELECT * FROM cand c WHERE (SELECT count(*) FROM cand k WHERE k.trace_id = c.trace_id AND k.func = c.func) <= greatest(1, floor(0.1 * timed))),
outl AS (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept a WHERE a.trace_id = k.trace_id AND a.span_id <> k.span_id AND a.depth < k.depth AND a.span_id IN (k.p0, k.p1)))
"""

FLAT = """WITH flat AS (SELECT event_id AS span_id, event_type AS func, (epoch_us(ts) - min(epoch_us(ts)) OVER ())::DOUBLE AS start_us, value AS dur_us,
  user_id % 4 AS cpu, user_id::VARCHAR AS task_key, user_id FROM events)"""

SW = FLAT + """,
sw AS (SELECT * FROM (SELECT span_id AS seq, start_us AS ts_us, cpu, lag(task_key) OVER (PARTITION BY cpu ORDER BY span_id) AS prev_key, task_key AS next_key FROM flat)
  WHERE prev_key IS NOT NULL AND prev_key <> next_key),
pts AS (SELECT prev_key AS task_key, ts_us, seq, 'out' AS side FROM sw UNION ALL SELECT next_key, ts_us, seq, 'in' FROM sw),
nxt AS (SELECT *, lead(side) OVER w AS ns, lead(ts_us) OVER w AS nt FROM pts WINDOW w AS (PARTITION BY task_key ORDER BY ts_us, seq)),
iv AS (SELECT task_key, ts_us AS off_us, nt AS on_us FROM nxt WHERE side = 'out' AND (ns IS NULL OR ns = 'in')),
lng AS (SELECT span_id, func, task_key, cpu, start_us, round(dur_us * 1000000, 0) AS dur_us FROM flat)"""

SPIKY = FLAT + """,
sp AS (SELECT span_id, func, start_us, cpu, task_key, round(10.0::DOUBLE + (span_id % 7) * 0.1::DOUBLE + CASE WHEN span_id % 97 = 0 THEN 400.0::DOUBLE ELSE 0 END, 4) AS dur_us FROM flat),
ss AS (SELECT func, count(*) AS timed, median(dur_us) AS p50 FROM sp GROUP BY 1),
sc AS (SELECT sp.*, p50, timed FROM sp JOIN ss USING (func) WHERE timed - 1 >= 8 AND dur_us >= 3 * p50 AND dur_us - p50 >= 50),
so AS (SELECT * FROM sc WHERE (SELECT count(*) FROM sc k WHERE k.func = sc.func) <= greatest(1, floor(0.1 * timed)))"""

RUNS = FLAT + """,
b AS (SELECT *, CASE WHEN lag(func) OVER (PARTITION BY task_key ORDER BY span_id) IS DISTINCT FROM func THEN 1 ELSE 0 END AS isnew FROM flat),
r AS (SELECT *, sum(isnew) OVER (PARTITION BY task_key ORDER BY span_id) AS run_id FROM b),
rr AS (SELECT *, count(*) OVER (PARTITION BY task_key, run_id) AS n FROM r)"""

LINE = """format('   user-{:d}   [{:03d}] .....  {:d}.{:06d}: {} <-caller_{:d}', user_id + 1, user_id % 4, u // 1000000, u % 1000000, event_type, user_id % 4)"""
TEXT = "WITH e AS (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER () AS u FROM events)"

REL = """,
roots AS (SELECT DISTINCT st.trace_id, st.span_id AS root_id, st.func AS root_func, st.depth AS rd FROM st JOIN outl o ON o.trace_id = st.trace_id AND o.func = st.func),
sub AS (SELECT r.root_id, r.root_func, rd, s.*,
  CASE WHEN s.depth = rd THEN '' WHEN rd = 0 AND s.depth = 1 THEN s.func WHEN rd = 0 THEN s.f1 || '/' || s.func ELSE s.func END AS path
  FROM roots r JOIN st s ON s.trace_id = r.trace_id AND ((rd = 0 AND s.p0 = root_id) OR (rd = 1 AND s.p1 = root_id AND s.depth >= 1) OR (rd = 2 AND s.span_id = root_id)) WHERE NOT s.irq OR s.span_id = root_id),
ps AS (SELECT trace_id, root_id, root_func, path, count(*) AS calls, sum(self_us) AS self_us, sum(dur_us - irq_us) AS wall_us FROM sub GROUP BY ALL),
tot AS (SELECT trace_id, root_func, path, sum(calls) AS tc, sum(self_us) AS ts, sum(wall_us) AS tw, count(*) AS tm FROM ps GROUP BY ALL),
ex AS (SELECT o.trace_id, o.span_id AS root_id, o.func AS root_func, o.dur_us - o.p50 AS excess, o.timed - 1 AS peers FROM outl o),
ap AS (SELECT p.*, excess, peers, (tc - calls) / peers AS mc, (ts - self_us) / peers AS ms, (tw - wall_us) / peers AS mw, (tm - 1) / peers AS pres
  FROM ps p JOIN ex USING (trace_id, root_id, root_func) JOIN tot USING (trace_id, root_func, path))"""

PARTS = """, own AS (SELECT trace_id, root_id, path, calls, excess, CASE WHEN path = '' THEN 'self' WHEN calls >= 1.5 * mc + 1 THEN 'more-calls' ELSE 'slower' END AS kind, self_us - ms AS part
        FROM ap WHERE self_us > ms AND (pres >= 0.05 OR path = '')),
        fresh AS (SELECT trace_id, root_id, split_part(path, '/', 1) AS p1, min(pres) FILTER (WHERE path = split_part(path, '/', 1)) AS top_pres FROM ap WHERE path <> '' GROUP BY ALL),
        tops AS (SELECT a.*, CASE WHEN f.top_pres < 0.05 THEN f.p1 ELSE a.path END AS top FROM ap a JOIN fresh f ON f.trace_id = a.trace_id AND f.root_id = a.root_id AND f.p1 = split_part(a.path, '/', 1) WHERE a.pres < 0.05 AND a.path <> ''),
        newp AS (SELECT trace_id, root_id, top AS path, max(CASE WHEN path = top THEN calls END) AS calls, max(excess) AS excess, 'new-path' AS kind, sum(self_us - ms) AS part FROM tops GROUP BY trace_id, root_id, top),
        irqm AS (SELECT trace_id, func AS root_func, sum(irq_us) AS ti FROM st GROUP BY ALL),
        irqp AS (SELECT ex.trace_id, ex.root_id, first(q.func ORDER BY q.dur_us DESC, q.parent_id, q.ord) AS path, count(*) AS calls, excess, 'irq' AS kind, r.irq_us - (ti - r.irq_us) / peers AS part
          FROM ex JOIN irqm USING (trace_id, root_func) JOIN st r ON r.trace_id = ex.trace_id AND r.span_id = ex.root_id
          JOIN tree q ON q.trace_id = ex.trace_id AND q.flags >= 8 AND ex.root_id IN (q.p0, q.p1) GROUP BY ex.trace_id, ex.root_id, excess, r.irq_us, ti, peers),
        c AS (SELECT trace_id, root_id, path, calls, excess, kind, part FROM own UNION ALL SELECT trace_id, root_id, path, calls, excess, kind, part FROM newp UNION ALL SELECT * FROM irqp),"""


def _tree(select: str) -> str:
    return TREE + select


def _tree_once(select: str) -> str:
    """``_tree`` for SQL that names ``tree`` twice."""
    return TREE.replace("tree AS (", "tree AS MATERIALIZED (", 1) + select


ORACLES: dict[str, str] = {
    "parse_graph_roundtrip": _tree("""SELECT trace_id, func, round(start_us, 4) AS start_us, round(dur_us, 4) AS dur_us, depth, task_key, cpu, flags,
        CASE depth WHEN 1 THEN f0 WHEN 2 THEN f1 END AS parent_func FROM tree"""),
    "parse_bracket_roundtrip": TEXT + """ SELECT event_id AS line_no, event_type AS func, 'caller_' || (user_id % 4) AS caller, u::DOUBLE AS start_us,
        user_id % 4 AS cpu, 'user' AS comm, user_id + 1 AS pid FROM e""",
    "reconstructed_clock": _tree("SELECT trace_id, task_key, round(start_us, 4) AS start_us, round(start_us + dur_us, 4) AS end_us FROM tree WHERE depth = 0"),
    "migrated_calls": "WITH RECURSIVE " + ITEMS + """,
        r AS (SELECT 'c' || ckey AS trace_id, okey, place, what, func, dur_us, (okey + place // 2) % 2 AS cpu,
          row_number() OVER (PARTITION BY ckey ORDER BY place, okey) - 1 AS i FROM (
          SELECT okey, ord AS place, 'leaf' AS what, func, dur_us FROM items
          UNION ALL SELECT okey, n_items + 1, 'open', 'wait_reply', NULL FROM ords UNION ALL SELECT okey, n_items + 3, 'close', 'wait_reply', 40.0 FROM ords) JOIN (SELECT okey, ckey FROM ords) USING (okey)),
        w AS (SELECT trace_id, -1::BIGINT AS i, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, MAP {}::MAP(BIGINT, DOUBLE) AS floors, MAP {}::MAP(BIGINT, DOUBLE) AS entered,
            NULL::BIGINT AS okey, NULL::VARCHAR AS what, NULL::DOUBLE AS t, NULL::DOUBLE AS e FROM r GROUP BY 1
          UNION ALL
          SELECT trace_id, i, CASE WHEN cpu = 0 THEN greatest(c0, e) ELSE c0 END, CASE WHEN cpu = 1 THEN greatest(c1, e) ELSE c1 END, map_concat(floors, MAP {okey: e}),
            CASE WHEN what = 'open' THEN map_concat(entered, MAP {okey: t}) ELSE entered END, okey, what, t, e
          FROM (SELECT *, CASE what WHEN 'leaf' THEN t + dur_us WHEN 'open' THEN t ELSE entered[okey] + dur_us END AS e FROM (
            SELECT w.trace_id, r.i, c0, c1, floors, entered, r.okey, r.what, r.cpu, r.dur_us::DOUBLE AS dur_us,
              greatest(CASE WHEN r.cpu = 0 THEN c0 ELSE c1 END, coalesce(floors[r.okey], 0)) AS t FROM w JOIN r ON r.trace_id = w.trace_id AND r.i = w.i + 1)))
        SELECT w.trace_id, (w.okey + 1)::VARCHAR AS task_key, r.cpu, func, w.i AS line_no, CASE WHEN w.what = 'open' THEN 0 ELSE flags END AS flags, round(t, 4) AS start_us,
          round(CASE WHEN w.what = 'open' THEN t + 40 ELSE e END, 4) AS end_us
        FROM w JOIN (SELECT r.*, CASE WHEN func LIKE 'sysvec%' THEN 9 ELSE 1 END AS flags FROM r) r ON r.trace_id = w.trace_id AND r.i = w.i WHERE w.what <> 'close'""",
    "trace_meta": _tree("""SELECT t.trace_id, 'function_graph' AS format, 'reconstructed' AS clock, l.lines, count(*) AS spans, 0 AS orphans, 0 AS unclosed, 0 AS unparsed,
        max(start_us + dur_us) AS duration_us, true AS proc, 1 AS warnings FROM tree t JOIN (SELECT 'n' || nkey AS trace_id, sum(n_lines) AS lines FROM cust GROUP BY 1) l USING (trace_id) GROUP BY ALL"""),
    "parse_quarantine": "SELECT 'events' AS trace_id, event_id AS line_no, 'damaged ' || event_id || ' line' AS text FROM events WHERE event_id % 50 = 3",
    "token_kinds": _tree("""SELECT trace_id, kind, count(*) AS n FROM (SELECT trace_id, CASE WHEN flags % 2 = 1 THEN 'leaf' ELSE 'open' END AS kind FROM tree
        UNION ALL SELECT trace_id, 'close' FROM tree WHERE flags % 2 = 0) GROUP BY ALL"""),
    "line_numbering": TEXT + f""", l AS (SELECT event_id, strlen({LINE}) + 1 AS o FROM e)
        SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS line_no, sum(o) OVER (ORDER BY event_id) - o AS byte_start, sum(o) OVER (ORDER BY event_id) AS byte_end FROM l""",
    "task_attribution": """SELECT event_id, CASE WHEN (SELECT count(DISTINCT user_id) FROM events k WHERE k.user_id % 4 = e.user_id % 4) = 1 THEN '?/' || (user_id % 4)
        ELSE (user_id + 1)::VARCHAR END AS task_key, event_type AS func FROM events e""",
    "tasks": "SELECT 'n' || c_nationkey AS trace_id, (c_custkey + 1)::VARCHAR AS task_key, c_custkey + 1 AS pid, 'cust' AS comm FROM customer",
    "tracks": _tree("""SELECT trace_id, task_key, count(*) AS n_spans, max(depth) AS max_depth, min(start_us) AS t0_us, max(start_us + dur_us) AS t1_us,
        sum(CASE WHEN depth = 0 THEN dur_us END) AS busy_us FROM tree GROUP BY ALL"""),
    "context_switches": SW + "SELECT seq, cpu, prev_key, next_key, ts_us FROM sw",
    "distinct_dimensions": _tree("SELECT trace_id, count(DISTINCT func) AS functions, count(DISTINCT task_key) AS tasks, count(DISTINCT cpu) AS cpus FROM tree GROUP BY 1"),
    "off_intervals": SW + "SELECT task_key, off_us, on_us FROM iv",
    "off_overlap": SW + """ SELECT span_id, round(least(dur_us, sum(greatest(0, least(start_us + dur_us, coalesce(on_us, 1e18)) - greatest(start_us, off_us)))), 4) AS off_us
        FROM lng JOIN iv USING (task_key) WHERE off_us < start_us + dur_us AND coalesce(on_us, 1e18) > start_us GROUP BY span_id, dur_us, start_us""",
    "irq_context": _tree("SELECT trace_id, span_id, true AS irq_root FROM tree WHERE flags >= 8"),
    "irq_time": _tree("SELECT trace_id, span_id, irq_us FROM st WHERE irq_us > 0"),
    "self_time": _tree("SELECT trace_id, span_id, self_us FROM st"),
    "time_split": _tree("""SELECT trace_id, span_id, self_us * k AS self_part, greatest(0, dur_us - self_us - irq_us) AS children_part, 0.0::DOUBLE AS off_part, irq_us * k AS irq_part
        FROM (SELECT *, CASE WHEN self_us + irq_us > dur_us THEN dur_us / (self_us + irq_us) ELSE 1 END AS k FROM st)"""),
    "func_stats": _tree("""SELECT fs.trace_id, fs.func, "count", timed, round(total_us, 4) AS total_us, round(self_us, 4) AS self_us, min_us, max_us, round(p50, 4) AS p50, p90, p99, x.max_span
        FROM fs JOIN (SELECT trace_id, func, arg_max(span_id, dur_us * 1e15 - span_id / 1e3) AS max_span FROM
          (SELECT trace_id, func, span_id, dur_us FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, func ORDER BY dur_us DESC, span_id) AS k FROM tree) WHERE k = 1) GROUP BY ALL) x USING (trace_id, func)"""),
    "total_no_recursion": _tree("""SELECT trace_id, CASE depth WHEN 1 THEN func ELSE 'same' END AS func, count(*) AS count,
        sum(CASE WHEN depth < 2 THEN dur_us ELSE 0 END) AS total_us FROM tree GROUP BY ALL"""),
    "quantiles": FLAT + """, k AS (SELECT func, dur_us, row_number() OVER (PARTITION BY func ORDER BY dur_us) - 1 AS i, count(*) OVER (PARTITION BY func) AS n FROM flat)
        SELECT func, n, round(median(dur_us), 4) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.9::DOUBLE)) THEN dur_us END) AS p90,
        max(CASE WHEN i = least(n - 1, floor(n * 0.99::DOUBLE)) THEN dur_us END) AS p99 FROM k GROUP BY func, n""",
    "histogram": FLAT + """ SELECT func, bucket, round(pow(2.0, bucket) / 1000, 4) AS from_us, count(*) AS calls FROM
        (SELECT func, least(39, greatest(0, floor(log2(greatest(1.0, dur_us * 1000)))))::INT AS bucket FROM flat) GROUP BY ALL""",
    "call_edges": _tree("""SELECT trace_id, CASE depth WHEN 1 THEN f0 ELSE f1 END AS caller_func, func AS callee_func, flags >= 8 AS caller_only, count(*) AS calls, sum(dur_us) AS total_us
        FROM tree WHERE depth > 0 GROUP BY ALL"""),
    "callees": _tree("""SELECT trace_id, CASE depth WHEN 1 THEN f0 ELSE f1 END AS func, func AS callee_func, count(*) AS calls, sum(dur_us) AS total_us
        FROM tree t WHERE depth > 0 AND flags < 8 GROUP BY 1, CASE depth WHEN 1 THEN f0 ELSE f1 END, t.func"""),
    "callers": _tree("""SELECT trace_id, t.func AS func, CASE depth WHEN 1 THEN f0 ELSE f1 END AS caller_func, count(*) AS calls, sum(dur_us) AS total_us
        FROM tree t WHERE depth > 0 GROUP BY ALL"""),
    "top_children": _tree("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY total_us DESC, func) AS rank FROM (
        SELECT trace_id, parent_id, func, count(*) AS calls, sum(dur_us) AS total_us, max(dur_us) AS slowest_us FROM tree WHERE parent_id IS NOT NULL GROUP BY ALL)) WHERE rank <= 3"""),
    "profile": _tree("""SELECT trace_id, f0 AS func, CASE WHEN flags >= 8 THEN func WHEN depth = 0 THEN '' WHEN depth = 1 THEN func ELSE f1 || '/' || func END AS path,
        count(*) AS calls, count(DISTINCT p0) AS members, sum(dur_us) AS total_us, sum(self_us) AS self_us FROM st GROUP BY trace_id, f0, 3"""),
    "category_shares": _tree("""SELECT *, round(self_us / sum(self_us) OVER (PARTITION BY trace_id), 4) AS share FROM (
        SELECT trace_id, CASE WHEN starts_with(func, 'sysvec_') THEN 'irq' WHEN regexp_matches(func, '^[0-9]-') THEN 'entry' WHEN starts_with(func, 'item_') THEN 'block' ELSE 'other' END AS category,
        count(*) AS calls, count(DISTINCT func) AS functions, sum(self_us) AS self_us FROM st GROUP BY ALL)"""),
    "function_categories": _tree("""SELECT DISTINCT func, CASE WHEN starts_with(func, 'sysvec_') THEN 'irq' ELSE 'other' END AS category FROM tree
        UNION SELECT DISTINCT event_type, 'other' FROM events"""),
    "irq_parts": _tree("""SELECT trace_id, a AS span_id, func AS label, count(*) AS count, sum(dur_us) AS total_us FROM
        (SELECT trace_id, func, dur_us, p0 AS a FROM tree WHERE flags >= 8 UNION ALL SELECT trace_id, func, dur_us, p1 FROM tree WHERE flags >= 8) GROUP BY ALL"""),
    "group_stats": FLAT + """ SELECT task_key, func, count(*) AS calls, round(sum(dur_us), 4) AS total_us, max(CASE WHEN i = n // 2 THEN dur_us END) AS median_us, max(dur_us) AS max_us FROM
        (SELECT *, row_number() OVER (PARTITION BY task_key, func ORDER BY dur_us) - 1 AS i, count(*) OVER (PARTITION BY task_key, func) AS n FROM flat) GROUP BY ALL""",
    "deviation_bins": FLAT + """, k AS (SELECT *, row_number() OVER (PARTITION BY func ORDER BY dur_us) - 1 AS i, count(*) OVER (PARTITION BY func) AS n FROM flat),
        m AS (SELECT func, max(CASE WHEN i = n // 2 THEN dur_us END) AS med FROM k GROUP BY 1)
        SELECT func, greatest(0, least(7, floor(log2(greatest(dur_us, 1e-6) / med)) + 2))::INT AS bin, count(*) AS calls FROM flat JOIN m USING (func) GROUP BY ALL""",
    "percent_rank": FLAT + """ SELECT span_id, round((rank() OVER (PARTITION BY func ORDER BY dur_us) - 1) / (count(*) OVER (PARTITION BY func) - 1), 4) AS faster_share,
        count(*) OVER (PARTITION BY func) - 1 AS peers FROM flat""",
    "event_counts": "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS rank FROM (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1)) WHERE rank <= 4",
    "switch_out_counts": SW + "SELECT prev_key AS task_key, count(*) AS n FROM sw GROUP BY 1",
    "lost_per_cpu": "SELECT user_id % 4 AS cpu, sum(event_id % 9 + 1) AS lost, count(*) AS gaps FROM events WHERE event_id % 40 = 7 GROUP BY 1",
    "error_returns": """WITH v AS (SELECT event_type AS func, event_id, CASE WHEN event_id % 5 = 0 THEN -(event_id % 3 + 2) ELSE event_id % 10 END AS ret FROM events),
        c AS (SELECT func, ret AS code, count(*) AS n, min(event_id) AS f FROM v WHERE ret BETWEEN -4095 AND -1 GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY func ORDER BY n DESC, f) AS r FROM c),
        t AS (SELECT func, count(*) AS returns, count_if(ret < 0) AS errors FROM v GROUP BY 1)
        SELECT func, returns, errors, code, n, CASE code WHEN -2 THEN 'ENOENT' WHEN -3 THEN 'ESRCH' WHEN -4 THEN 'EINTR' END AS errno_name
        FROM k JOIN t USING (func) WHERE r = 1 AND returns >= 4 AND errors < 0.3 * returns""",
    "typical_peer": FLAT + """, k AS (SELECT func, span_id, row_number() OVER (PARTITION BY func ORDER BY dur_us, span_id) - 1 AS i, count(*) OVER (PARTITION BY func) AS n FROM flat),
        m AS (SELECT func, n, max(CASE WHEN i = (n - 1) // 2 THEN span_id END) AS m0, max(CASE WHEN i = (n - 1) // 2 + 1 THEN span_id END) AS m1,
        max(CASE WHEN i = (n - 1) // 2 - 1 THEN span_id END) AS mp FROM k GROUP BY ALL)
        SELECT func, span_id, CASE WHEN n >= 2 THEN CASE WHEN m0 <> span_id THEN m0 ELSE coalesce(m1, mp) END END AS peer_id FROM flat JOIN m USING (func)""",
    "compare_with_typical": OUT + """, k AS (SELECT trace_id, func, span_id, row_number() OVER (PARTITION BY trace_id, func ORDER BY dur_us, span_id) - 1 AS i, n FROM ranked),
        m AS (SELECT trace_id, func, max(CASE WHEN i = (n - 1) // 2 THEN span_id END) AS m0, max(CASE WHEN i = (n - 1) // 2 + 1 THEN span_id END) AS m1, max(CASE WHEN i = (n - 1) // 2 - 1 THEN span_id END) AS mp FROM k GROUP BY ALL),
        pr AS (SELECT o.trace_id, o.span_id AS target_id, CASE WHEN m0 <> o.span_id THEN m0 ELSE coalesce(m1, mp) END AS peer FROM outl o JOIN m ON m.trace_id = o.trace_id AND m.func = o.func),
        two AS (SELECT trace_id, target_id, 'call' AS side, target_id AS root FROM pr UNION ALL SELECT trace_id, target_id, 'typical', peer FROM pr)
        SELECT two.trace_id, target_id, side, s.span_id, s.depth - r.depth AS row, s.start_us - r.start_us AS x0_us, least(s.start_us + s.dur_us, r.start_us + r.dur_us) - r.start_us AS x1_us
        FROM two JOIN tree r ON r.trace_id = two.trace_id AND r.span_id = root JOIN tree s ON s.trace_id = two.trace_id AND s.depth >= r.depth
        AND ((r.depth = 0 AND s.p0 = root) OR (r.depth = 1 AND s.p1 = root) OR (r.depth = 2 AND s.span_id = root))""",
    "surprise": FLAT + """, m AS (SELECT func, median(dur_us) AS p50, count(*) AS n FROM flat GROUP BY 1)
        SELECT span_id, round(CASE WHEN n - 1 >= 8 AND p50 > 0 THEN greatest(0, log2(dur_us / p50)) ELSE 0 END, 3) AS surprise FROM flat JOIN m USING (func)""",
    "outlier_candidates": OUT + "SELECT trace_id, span_id, func, dur_us, round(p50, 4) AS p50 FROM cand",
    "rarity_cap": OUT + "SELECT trace_id, span_id, func FROM kept",
    "root_outliers": OUT + "SELECT trace_id, span_id, func, round(dur_us - p50, 4) AS excess_us, round(dur_us / p50, 3) AS ratio FROM outl",
    "spiky_outlier_spans": SPIKY + "SELECT span_id, func, round(p50, 4) AS typical_us, round(dur_us - p50, 4) AS excess_us FROM so",
    "path_stats": OUT + REL + "SELECT trace_id, root_id, path, calls, self_us, wall_us FROM ps",
    "cause": OUT + REL + PARTS + """
        k AS (SELECT *, row_number() OVER (PARTITION BY trace_id, root_id ORDER BY part DESC) AS r, row_number() OVER (PARTITION BY trace_id, root_id, kind = 'irq' ORDER BY part DESC) AS r2
          FROM c WHERE part > 0.05 * excess),
        g AS (SELECT trace_id, root_id, max(excess) AS excess, max(CASE WHEN r = 1 THEN kind END) AS top, coalesce(max(CASE WHEN kind = 'self' THEN part END), 0) AS sp,
          coalesce(sum(CASE WHEN kind <> 'irq' AND r2 <= 2 THEN part END), 0) AS big2, count_if(kind <> 'irq') AS nb FROM k GROUP BY ALL),
        w AS (SELECT g.*, g.excess - greatest(0, s.irq_us - CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.trace_id = g.trace_id AND k.root_id = g.root_id AND k.kind = 'irq') THEN (ti - s.irq_us) / e2.peers ELSE 0 END) AS own
          FROM g JOIN st s ON s.trace_id = g.trace_id AND s.span_id = g.root_id JOIN irqm m ON m.trace_id = s.trace_id AND m.root_func = s.func JOIN ex e2 ON e2.trace_id = g.trace_id AND e2.root_id = g.root_id)
        SELECT o.trace_id, o.span_id, o.func, CASE WHEN top = 'irq' THEN 'irq' WHEN sp >= 0.5 * own AND sp > 0 THEN 'self' WHEN nb = 0 OR big2 < 0.5 * own THEN 'spread' ELSE top END AS cause,
        o.timed - 1 AS peers, round(o.p50, 4) AS typical_us, true AS slow FROM outl o JOIN w ON w.trace_id = o.trace_id AND root_id = span_id""",
    "contributors": OUT + REL + PARTS + """
        k AS (SELECT *, row_number() OVER (PARTITION BY trace_id, root_id ORDER BY part DESC) AS r FROM c WHERE part > 0.05 * excess)
        SELECT trace_id, root_id AS span_id, kind, path, round(part, 3) AS part_us, calls FROM k""",
    "same_func_steps": FLAT + """ SELECT span_id, lag(span_id) OVER w AS prev_id, lead(span_id) OVER w AS next_id FROM flat WINDOW w AS (PARTITION BY func ORDER BY start_us, span_id)""",
    "run_folds": RUNS + """ SELECT task_key, func, min(span_id) AS first_ord, max(span_id) AS last_ord, count(*) AS calls, round(sum(dur_us), 4) AS total_us,
        max(CASE WHEN i = n // 2 THEN dur_us END) AS median_us, max(dur_us) AS max_us
        FROM (SELECT *, row_number() OVER (PARTITION BY task_key, run_id ORDER BY dur_us) - 1 AS i FROM rr WHERE n >= 3) GROUP BY task_key, run_id, func, n""",
    "fold_outliers": RUNS + "SELECT span_id, task_key, func FROM rr WHERE n >= 3 AND span_id IN (" + SPIKY + "SELECT span_id FROM so)",
    "row_share": _tree_once("SELECT c.trace_id, c.span_id, round(least(1.0, c.dur_us / p.dur_us), 6) AS share FROM tree c JOIN tree p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id"),
    "search_calls": _tree("SELECT trace_id, span_id, func FROM tree WHERE contains(lower(func), 'urgent')"),
    "search_regex": _tree("SELECT trace_id, count(DISTINCT func) AS functions, count(*) AS calls FROM tree WHERE regexp_matches(func, '^item_.F$', 'i') GROUP BY 1"),
    "span_end": _tree(""", x AS (SELECT *, CASE WHEN span_id % 10 <> 3 THEN dur_us END AS d2 FROM tree)
        SELECT trace_id, span_id, round(coalesce(start_us + d2, t1), 4) AS end_us FROM (SELECT *, max(start_us + coalesce(d2, 0)) OVER (PARTITION BY trace_id, task_key) AS t1 FROM x)"""),
    "time_range": _tree("SELECT trace_id, span_id, depth FROM tree WHERE start_us + dur_us >= 1000 AND start_us <= 5000"),
    "visible_depth": _tree("SELECT trace_id, task_key, max(depth) AS visible_depth FROM tree WHERE start_us + dur_us >= 1000 AND start_us <= 5000 GROUP BY ALL"),
    "flag_words": OUT + """ SELECT * FROM (SELECT t.trace_id, t.span_id, concat_ws(', ', CASE WHEN flags >= 8 THEN 'interrupt' END, CASE WHEN t.span_id % 11 = 0 THEN 'never returned' END,
        CASE WHEN o.span_id IS NOT NULL THEN 'outlier' END) AS words FROM tree t LEFT JOIN outl o ON o.trace_id = t.trace_id AND o.span_id = t.span_id) WHERE words <> ''""",
    "ancestors": _tree("""SELECT trace_id, span_id, 0 AS level, p0 AS ancestor_id, f0 AS ancestor_func FROM tree WHERE depth > 0
        UNION ALL SELECT trace_id, span_id, 1, p1, f1 FROM tree WHERE depth = 2"""),
    "subtree": _tree("""SELECT s.trace_id, r.span_id AS root_id, s.span_id, s.depth - 1 AS row, s.start_us - r.start_us AS x0_us, least(s.start_us + s.dur_us, r.start_us + r.dur_us) - r.start_us AS x1_us
        FROM st r JOIN tree s ON s.trace_id = r.trace_id AND s.p1 = r.span_id WHERE r.depth = 1"""),
    "has_pattern": _tree("""SELECT DISTINCT trace_id, a AS span_id FROM (SELECT trace_id, unnest([p0, p1, span_id]) AS a FROM tree WHERE starts_with(func, 'item_A'))"""),
    "nested_anti": _tree(""", b AS (SELECT * FROM tree WHERE dur_us > 40)
        SELECT trace_id, span_id FROM b WHERE NOT EXISTS (SELECT 1 FROM b a WHERE a.trace_id = b.trace_id AND a.depth < b.depth AND a.span_id IN (b.p0, b.p1))"""),
    "off_stretches": SW + """ SELECT span_id, greatest(off_us, start_us) - start_us AS rel_off_us, least(coalesce(on_us, hi), start_us + dur_us) - start_us AS rel_on_us
        FROM lng JOIN iv USING (task_key) CROSS JOIN (SELECT max(start_us + dur_us) AS hi FROM lng) WHERE least(coalesce(on_us, hi), start_us + dur_us) > greatest(off_us, start_us)""",
    "off_where": SW + """, f AS (SELECT span_id, arg_min(next_key, ts_us) AS ran_task FROM lng JOIN sw ON prev_key = task_key AND ts_us BETWEEN start_us AND start_us + dur_us GROUP BY 1)
        SELECT lng.span_id, lng.span_id AS sleep_id, ran_task FROM lng LEFT JOIN f USING (span_id)""",
    "gap_lanes": SW + """, near AS (SELECT greatest(20, max(start_us + dur_us) * 0.002) AS near FROM lng), g AS (SELECT span_id AS gap_line, cpu, start_us + 1000 AS ts FROM lng WHERE span_id % 25 = 4)
        SELECT DISTINCT gap_line, g.cpu, l.task_key FROM g CROSS JOIN near LEFT JOIN lng l ON l.cpu = g.cpu AND ts BETWEEN l.start_us - near AND l.start_us + l.dur_us + near""",
    "func_table": _tree("SELECT trace_id, func, total_us FROM fs WHERE contains(func, 'item')"),
    "slowest_calls": FLAT + " SELECT * FROM (SELECT func, span_id, dur_us, row_number() OVER (PARTITION BY func ORDER BY dur_us DESC, span_id) AS rank FROM flat) WHERE rank <= 20",
    "track_order": _tree("SELECT trace_id, task_key, false AS is_idle, max(start_us + dur_us) - min(start_us) AS len_us FROM tree GROUP BY ALL"),
    "entry_points": _tree(""", tr AS (SELECT trace_id, sum(dur_us) AS tr FROM tree WHERE depth = 0 GROUP BY 1),
        e AS (SELECT trace_id, 'entry' AS what, func, sum(dur_us) AS us FROM tree WHERE depth = 0 GROUP BY ALL UNION ALL SELECT trace_id, 'self', func, self_us FROM fs),
        k AS (SELECT *, row_number() OVER (PARTITION BY trace_id, what ORDER BY us DESC, func) AS rank FROM e)
        SELECT trace_id, what, func, us, round(us / tr, 4) AS share, rank FROM k JOIN tr USING (trace_id) WHERE rank <= 3 AND (what = 'self' OR us >= 0.05 * tr)"""),
    "raw_lines": _tree(""", o AS (SELECT 'n' || nkey AS trace_id, nkey, c.ckey, okey, o.func, o.dur_us, o.n_lines, o.n_items, c.line_no + 1 + rel_line AS l FROM ords o JOIN cust c ON c.ckey = o.ckey),
        h AS (SELECT *, ' ' || (nkey % 4) || ')  cust-' || (ckey + 1) || '  |' AS head FROM o),
        x AS (SELECT trace_id, l AS span_id, n_lines, l AS line_no, head || CASE WHEN n_items > 0 THEN '               |    ' || func || '() {' ELSE format('{:10.3f}', dur_us) || ' us   |    ' || func || '();' END AS value FROM h
        UNION ALL SELECT trace_id, l, n_lines, l + n_lines - 1, head || format('{:10.3f}', dur_us) || ' us   |    } /* ' || func || ' */' FROM h WHERE n_items > 0
        UNION ALL SELECT trace_id, l, n_lines, l + i.ord, head || format('{:10.3f}', i.dur_us) || ' us   |      ' || i.func || '();' FROM h JOIN items i USING (okey))
        SELECT trace_id, span_id, line_no, value, CASE WHEN line_no = span_id THEN 'entry' WHEN line_no = span_id + n_lines - 1 THEN 'close' END AS mark, greatest(0, n_lines - 6) AS left_out FROM x
        WHERE n_lines <= 6 OR line_no < span_id + 4 OR line_no >= span_id + n_lines - 2"""),
    "event_fields_map": """SELECT event_id, user_id::VARCHAR AS "user", event_type AS kind, '"a b"' AS note FROM events""",
    "call_details": """SELECT event_id AS span_id, 'id=' || event_id || ';pos=(' || (user_id % 4) || ', 2)' AS args, (-(event_id % 3))::VARCHAR AS ret_text,
        CASE event_id % 3 WHEN 1 THEN 'EPERM' WHEN 2 THEN 'ENOENT' END AS errno_name, 'top+0x' || (user_id % 4) AS ret_addr FROM events""",
    "track_busy": _tree("SELECT trace_id, sum(b) AS busy_us, max(b) AS longest_us FROM (SELECT trace_id, task_key, sum(dur_us) AS b FROM tree WHERE depth = 0 GROUP BY ALL) GROUP BY 1"),
    "cpu_utilisation": SW + """, u AS (SELECT cpu, start_us, dur_us / 10 AS d FROM lng), m AS (SELECT least(0, min(start_us)) AS t0, max(start_us + d) AS t1 FROM u),
        p AS (SELECT cpu, (start_us - t0) / ((t1 - t0) / 50) AS a, (start_us + d - t0) / ((t1 - t0) / 50) AS b FROM u CROSS JOIN m),
        q AS (SELECT cpu, a, b, unnest(generate_series(greatest(0, floor(a))::INT, least(49, floor(b))::INT)) AS bin FROM p)
        SELECT cpu, bin::INT AS bin, round(least(1.0, sum(least(b, bin + 1) - greatest(a, bin))), 3) AS busy FROM q GROUP BY ALL""",
    "timeline_tiles": _tree(""", v AS (SELECT *, start_us * (200 / 20000.0::DOUBLE) AS x0, (start_us + dur_us) * (200 / 20000.0::DOUBLE) AS x1 FROM tree WHERE start_us + dur_us >= 0 AND start_us <= 20000)
        SELECT trace_id, task_key, depth, 'box' AS kind, span_id AS lead_span, 1 AS n, round(x0, 3) AS x0, round(x1, 3) AS x1 FROM v WHERE x1 - x0 >= 1
        UNION ALL SELECT trace_id, task_key, depth, 'run', first(span_id ORDER BY dur_us DESC, span_id), count(*), floor(x0), floor(x0) + 1 FROM v WHERE x1 - x0 < 1 GROUP BY trace_id, task_key, depth, floor(x0)"""),
    "event_marks": FLAT + " SELECT task_key, floor(start_us * (96 / 86400000000.0::DOUBLE))::BIGINT AS col, count(*) AS n FROM flat WHERE start_us <= 86400000000 GROUP BY ALL",
    "outlier_pins": SPIKY + """, m AS (SELECT max(start_us + dur_us) AS d FROM sp)
        SELECT floor(start_us / d * 200 + 0.5)::BIGINT AS x, count(*) AS members, first(span_id ORDER BY dur_us DESC, span_id) AS slowest_span FROM so CROSS JOIN m GROUP BY 1""",
    "violations": "SELECT 'x' AS trace_id, 0::BIGINT AS span_id, 'x' AS rule WHERE false",
    "violations_found": _tree(""", b AS (SELECT *, CASE WHEN span_id % 1000 = 5 THEN 7 ELSE depth END AS d2 FROM tree)
        SELECT trace_id, span_id, 'root depth' AS rule FROM b WHERE parent_id IS NULL AND d2 <> 0
        UNION ALL SELECT c.trace_id, c.span_id, 'depth' FROM b c JOIN b p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id WHERE c.d2 <> p.d2 + 1"""),
    "slow_calls": OUT + "SELECT trace_id, func, round(dur_us, 4) AS dur_us, round(p50, 4) AS typical_us, round(dur_us - p50, 4) AS excess_us, round(dur_us / p50, 3) AS ratio FROM outl",
    "reconstructed_clock_whole": _tree("SELECT trace_id, task_key, depth, func, round(start_us, 4) AS start_us, round(start_us + dur_us, 4) AS end_us FROM tree"),
    "raw_lines_whole": _tree_once(""", c AS (SELECT 'n' || nkey AS trace_id, ckey, ' ' || (nkey % 4) || ')  cust-' || (ckey + 1) || '  |' AS head, func, dur_us, n_lines, line_no AS l FROM cust),
        o AS (SELECT trace_id, ckey, okey, head, o.func, o.dur_us, o.n_lines, l + 1 + rel_line AS l FROM ords o JOIN c USING (ckey)),
        k AS (SELECT trace_id, ckey, head, func, dur_us, n_lines, l, '' AS pad FROM c UNION ALL SELECT trace_id, ckey, head, func, dur_us, n_lines, l, '  ' FROM o
          UNION ALL SELECT trace_id, ckey, head, i.func, i.dur_us, 1, l + i.ord, '    ' FROM o JOIN items i USING (okey)),
        x AS (SELECT trace_id, ckey, l AS line_no, head || CASE WHEN n_lines > 1 THEN '               |  ' || pad || func || '() {' ELSE format('{:10.3f}', dur_us) || ' us   |  ' || pad || func || '();' END AS value FROM k
          UNION ALL SELECT trace_id, ckey, l + n_lines - 1, head || format('{:10.3f}', dur_us) || ' us   |  ' || pad || '} /* ' || func || ' */' FROM k WHERE n_lines > 1)
        SELECT k.trace_id, l AS span_id, line_no, value, CASE WHEN line_no = l THEN 'entry' WHEN line_no = l + n_lines - 1 THEN 'close' END AS mark, greatest(0, n_lines - 220) AS left_out
        FROM k JOIN x ON x.ckey = k.ckey AND line_no BETWEEN l AND l + n_lines - 1 WHERE line_no < l + 200 OR line_no >= l + n_lines - 20"""),
    "timeline_tiles_whole": _tree(""", b AS (SELECT trace_id, least(0, min(start_us)) AS t0, greatest(max(start_us + dur_us), least(0, min(start_us)) + 1e-3) AS t1 FROM tree GROUP BY 1),
        v AS (SELECT tree.*, (start_us - t0)::DOUBLE * (200 / (t1 - t0)::DOUBLE) AS x0, (start_us + dur_us - t0)::DOUBLE * (200 / (t1 - t0)::DOUBLE) AS x1 FROM tree JOIN b USING (trace_id))
        SELECT trace_id, task_key, depth, 'box' AS kind, span_id AS lead_span, 1 AS n, round(x0, 3) AS x0, round(x1, 3) AS x1 FROM v WHERE x1 - x0 >= 1
        UNION ALL SELECT trace_id, task_key, depth, 'run', first(span_id ORDER BY dur_us DESC, span_id), count(*), floor(x0), floor(x0) + 1 FROM v WHERE x1 - x0 < 1 GROUP BY trace_id, task_key, depth, floor(x0)"""),
    "event_marks_whole": FLAT + """, b AS (SELECT least(0, min(start_us)) AS t0, greatest(max(start_us + dur_us), least(0, min(start_us)) + 1e-3) AS t1 FROM flat)
        SELECT task_key, floor((start_us - t0) * (96 / (t1 - t0)))::BIGINT AS col, count(*) AS n FROM flat CROSS JOIN b GROUP BY ALL""",
}
