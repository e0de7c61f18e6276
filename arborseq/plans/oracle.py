"""SQL that gives what the queries give, for another engine to check them."""

from __future__ import annotations

from arborseq.plans.workloads import HOLDING_SQL, WORKLOADS, Workload


def base(w: Workload, flat: bool = False) -> str:
    """CTEs: t (item, parent), s (sid, pos, item), n (total), clo (item, anc, depth), occ (sid, pos, a), fl (a, cf, df), red (a), least (k)."""
    tree = "SELECT 'x' AS item, 'x' AS parent WHERE false" if flat else w.tree_sql
    return f"""WITH RECURSIVE t AS ({tree}), s AS ({w.seq_sql}),
nodes AS (SELECT item FROM t UNION SELECT parent FROM t),
clo(item, anc, depth) AS (SELECT item, item, 0 FROM nodes UNION ALL SELECT c.item, t.parent, c.depth + 1 FROM clo c JOIN t ON t.item = c.anc),
occ AS (SELECT s.sid, s.pos, s.item AS own, coalesce(clo.anc, s.item) AS a FROM s LEFT JOIN clo ON clo.item = s.item WHERE s.item IS NOT NULL),
fl AS (SELECT a, count(*) AS cf, count(DISTINCT sid) AS df FROM occ GROUP BY a),
red AS (SELECT DISTINCT t.parent AS a FROM t JOIN fl c ON c.a = t.item JOIN fl p ON p.a = t.parent WHERE c.cf = p.cf)"""


def least(w: Workload) -> str:
    """CTE least (k). Empty sequences don't show in s, so the table's own count is taken for them."""
    n = "SELECT count(*) FROM sequences" if " FROM sequences)" in w.seq_sql else "SELECT count(DISTINCT sid) FROM s"
    return f"least AS (SELECT greatest(1, ((({n}) * {w.share[0]} + {w.share[1] - 1}) // {w.share[1]}))::BIGINT AS k)"


def mine(w: Workload, gap: int | None = None, length: int | None = None, flat: bool = False) -> str:
    gap, length = w.gap if gap is None else gap, w.length if length is None else length
    return f"""{base(w, flat)}, {least(w)},
g AS (SELECT DISTINCT sid, pos, occ.a FROM occ JOIN fl ON fl.a = occ.a, least WHERE df >= k AND occ.a NOT IN (SELECT a FROM red)),
e(sid, pattern, last, k) AS (SELECT sid, a, pos, 1 FROM g
  UNION SELECT e.sid, e.pattern || ' ' || g.a, g.pos, e.k + 1 FROM e JOIN g ON g.sid = e.sid AND g.pos > e.last AND g.pos <= e.last + {gap + 1} WHERE e.k < {length}),
f AS (SELECT pattern, count(DISTINCT sid) AS frequency, min(e.k) AS length FROM e WHERE e.k >= 2 GROUP BY pattern)
SELECT pattern, frequency FROM f, least WHERE frequency >= least.k"""


def dictionary(w: Workload) -> str:
    """CTEs up to dict (item, cf, df, tid, parent_tid, redundant)."""
    return f"""{base(w)},
rk AS (SELECT a AS item, cf, df, row_number() OVER (ORDER BY cf DESC, a) AS tid FROM fl),
up AS (SELECT c.item, p.tid, row_number() OVER (PARTITION BY c.item ORDER BY c.depth) AS rn
  FROM clo c JOIN rk o ON o.item = c.item JOIN rk p ON p.item = c.anc WHERE c.depth > 0 AND p.cf > o.cf),
dict AS (SELECT rk.item, cf, df, rk.tid::INT AS tid, coalesce(up.tid, 0)::INT AS parent_tid, rk.item IN (SELECT a FROM red) AS redundant
  FROM rk LEFT JOIN up ON up.item = rk.item AND up.rn = 1)"""


def chains(w: Workload) -> str:
    """CTEs up to enc (sid, pos, code) and ch (code, a): ids lifted to the nearest frequent one, and what these generalize to."""
    return f"""{dictionary(w)}, {least(w)},
good AS (SELECT item, tid FROM dict, least WHERE df >= k AND NOT redundant),
anc AS (SELECT c.item, g.tid, row_number() OVER (PARTITION BY c.item ORDER BY c.depth) AS rn
  FROM (SELECT item, anc, depth FROM clo UNION SELECT a, a, 0 FROM fl) c JOIN good g ON g.item = c.anc),
enc AS (SELECT s.sid, s.pos, coalesce(anc.tid, 0) AS code FROM s LEFT JOIN anc ON anc.item = s.item AND anc.rn = 1),
ch AS (SELECT g.tid AS code, anc.tid AS a FROM good g JOIN anc ON anc.item = g.item)"""


def queries() -> dict[str, str]:
    w = WORKLOADS["order_suppliers"]
    parts, seqs, pri = WORKLOADS["order_parts"], WORKLOADS["table_sequences"], WORKLOADS["customer_priority"]
    out = {f"mine_{name}": mine(x) for name, x in WORKLOADS.items()}
    out |= {f"mine_{s}_order_suppliers": out["mine_order_suppliers"] for s in ("joins", "bfs", "partitioned")}
    out |= {
        "mine_partitioned_order_parts": out["mine_order_parts"],
        "mine_partitioned_customer_priority": out["mine_customer_priority"],
        "mine_gap0": mine(w, gap=0), "mine_gap2": mine(w, gap=2), "mine_flat": mine(pri, flat=True), "mine_len2": mine(w, length=2),
        "two_sequences": mine(parts, length=2),
        "hierarchy_closure": f"{base(w)} SELECT item, anc AS ancestor, depth FROM clo",
        "taxonomy_root_depth": f"{base(parts)}, d AS (SELECT item, max(depth) AS depth FROM clo GROUP BY item) SELECT item, anc AS root, depth FROM clo JOIN d USING (item, depth)",
        "taxonomy_max_depth": f"{base(parts)} SELECT max(depth) AS max_depth FROM clo",
        "taxonomy_parents": f"{base(w)} SELECT n.item, t.parent, t.parent IS NOT NULL AS has_parent FROM nodes n LEFT JOIN t ON t.item = n.item",
        "taxonomy_common_parent": f"""{base(w)}, pairs AS (SELECT a.item AS a, b.item AS b FROM t a JOIN t b ON b.item = 's' || (CAST(substr(a.item, 2) AS INT) + 1)
  WHERE a.item LIKE 's%'),
  low AS (SELECT a, b, x.anc AS common, row_number() OVER (PARTITION BY a, b ORDER BY x.depth) AS rn FROM pairs JOIN clo x ON x.item = a JOIN clo y ON y.item = b AND y.anc = x.anc)
  SELECT pairs.a, pairs.b, common FROM pairs LEFT JOIN low ON low.a = pairs.a AND low.b = pairs.b AND rn = 1""",
        "taxonomy_is_parent": f"""{base(w)}, q AS (SELECT DISTINCT r.anc AS parent, n.item AS child FROM clo r JOIN nodes n ON n.item LIKE 's%' WHERE r.anc LIKE 'n%')
  SELECT q.parent, q.child, c.depth IS NOT NULL AS holds FROM q LEFT JOIN clo c ON c.item = q.child AND c.anc = q.parent AND c.depth > 0""",
        "taxonomy_is_generalization": f"""{base(w)}, q AS (SELECT item AS general, item FROM nodes UNION SELECT parent, item FROM t UNION SELECT item, parent FROM t)
  SELECT q.general, q.item, c.depth IS NOT NULL AS holds FROM q LEFT JOIN clo c ON c.item = q.item AND c.anc = q.general""",
        "flist_cf_df": f"{base(parts)} SELECT a AS item, cf, df FROM fl",
        "flist_table_sequences": f"{base(seqs)} SELECT a AS item, cf, df FROM fl",
        "frequent_items": f"{base(parts)}, {least(parts)} SELECT a AS item, cf, df FROM fl, least WHERE df >= k",
        "redundant_ancestors": f"{base(WORKLOADS['priority_levels'])} SELECT a AS item FROM red",
        "dictionary": f"{dictionary(parts)} SELECT * FROM dict",
        "encode_sequences": f"{dictionary(w)} SELECT string_agg(dict.tid::VARCHAR, ' ' ORDER BY s.pos) AS ids, sid AS seq_id FROM s JOIN dict USING (item) GROUP BY sid",
        "decode_roundtrip": f"{base(w)} SELECT string_agg(item, ' ' ORDER BY pos) AS items, sid AS seq_id FROM s GROUP BY sid",
        "pivot_partitions": f"{chains(w)} SELECT ch.a::INT AS \"pivot\", count(DISTINCT sid) AS n_sequences FROM enc JOIN ch USING (code) GROUP BY 1",
        "pivot_rewrite": f"""{chains(w)}, pv AS (SELECT DISTINCT sid, ch.a AS top FROM enc JOIN ch USING (code)),
  re AS (SELECT pv.sid, pv.top, enc.pos, max(ch.a) AS id FROM pv JOIN enc ON enc.sid = pv.sid LEFT JOIN ch ON ch.code = enc.code AND ch.a <= pv.top GROUP BY ALL),
  st AS (SELECT sid, top, string_agg(coalesce(id::VARCHAR, '_'), ' ' ORDER BY pos) AS seq FROM re GROUP BY sid, top)
  SELECT top::INT AS "pivot", seq, count(*) AS weight FROM st GROUP BY ALL""",
        "aggregated_sequences": f"""{chains(parts)}, x AS (SELECT sid, string_agg(code::VARCHAR, ' ' ORDER BY pos) AS seq FROM enc GROUP BY sid) SELECT seq, count(*) AS weight FROM x GROUP BY seq""",
        "pattern_counts_by_length": f"SELECT len(string_split(pattern, ' '))::INT AS length, count(*) AS n_patterns FROM ({mine(w)}) GROUP BY 1",
        "pattern_text": f"SELECT pattern || chr(9) || frequency AS line FROM ({mine(w)})",
        "sequences_loaded": P3_VALID_SEQUENCES, "hierarchy_loaded": P3_VALID_HIERARCHY,
        "p3_found": P3, "p3_recovered": P3_RECOVERED, "p6_found": P6, "p6_contracted": P6, "p7_found": P7,
    }
    pivots = out["pivot_rewrite"]
    trimmed = "regexp_replace(regexp_replace(seq, '^(_ )+', ''), '( _)+$', '')"
    out |= {
        "closure_joined": out["hierarchy_closure"], "flist_joined": out["flist_cf_df"], "dictionary_joined": out["dictionary"], "encode_joined": out["encode_sequences"],
        "decode_joined": out["decode_roundtrip"], "mine_partitioned_priority_levels": out["mine_priority_levels"],
        "mine_segmented_events": out["mine_events"], "mine_segmented_table_sequences": out["mine_table_sequences"],
        "mine_partitioned_split_priority": out["mine_customer_priority"],
    }
    out |= {x: out["mine_order_suppliers"] for x in (
        "mine_joined_lookups", "mine_levels_joined", "mine_partitioned_joined_lookups", "mine_partitioned_split", "encoded_resume", "pattern_parquet",
    )}
    out |= {
        "pattern_counters": f"""{base(w)}, {least(w)},
g AS (SELECT DISTINCT sid, pos, occ.a FROM occ JOIN fl ON fl.a = occ.a, least WHERE df >= k AND occ.a NOT IN (SELECT a FROM red)),
e2 AS (SELECT DISTINCT x.sid, [x.a, y.a] AS p, y.pos AS last FROM g x JOIN g y ON y.sid = x.sid AND y.pos > x.pos AND y.pos <= x.pos + {w.gap + 1}),
c2 AS (SELECT p, count(DISTINCT sid) AS n FROM e2 GROUP BY p),
e3 AS (SELECT DISTINCT x.sid, list_append(p, y.a) AS p FROM e2 x JOIN c2 USING (p) JOIN g y ON y.sid = x.sid AND y.pos > x.last AND y.pos <= x.last + {w.gap + 1}, least WHERE c2.n >= k),
c3 AS (SELECT p, count(DISTINCT sid) AS n FROM e3 GROUP BY p)
SELECT 2::INT AS length, count(*) AS n_candidates, count(*) FILTER (n >= k) AS n_patterns FROM c2, least
UNION ALL SELECT 3, count(*), count(*) FILTER (n >= k) FROM c3, least""",
        "relevant_positions": f"""SELECT "pivot", sum(weight * len(list_filter(string_split(seq, ' '), lambda x: x <> '_')))::BIGINT AS n_positions FROM ({pivots}) GROUP BY 1""",
        "blanks_roundtrip": pivots,
        "blanks_single": f"""SELECT "pivot", replace(seq, '_', '-1') AS seq, weight FROM ({pivots})""",
        "gap_split": f"""SELECT "pivot", seq, sum(weight)::BIGINT AS weight FROM (SELECT "pivot", unnest(string_split_regex({trimmed}, ' (_ ){{2,}}')) AS seq, weight FROM ({pivots})) GROUP BY ALL""",
        "sequence_text": f"SELECT sid::VARCHAR AS seq_id, string_agg(item, ' ' ORDER BY pos) AS items FROM ({w.seq_sql}) GROUP BY sid",
        "hierarchy_text": w.tree_sql,
        "dictionary_text": f"{dictionary(w)} SELECT item, cf, df, tid, parent_tid FROM dict",
        "encoded_text": f"SELECT ids, count(*) AS n FROM ({out['encode_sequences']}) GROUP BY ids",
        "pattern_sorted_text": f"SELECT pattern || chr(9) || frequency AS line, row_number() OVER (ORDER BY pattern) AS n FROM ({mine(w)})",
        "records_in_files": P3_IN_FILES,
    }
    out["command_line"] = out["pattern_sorted_text"]
    return out


_FIELD = r'"(?:[^"]|"")*"|[^" \t\r]+'
_P3_LINES = "SELECT 'sequences' AS source, line_id, line FROM raw_sequences UNION ALL SELECT 'hierarchy', line_id, line FROM raw_hierarchy"
_P3_TAIL = f"""split AS (SELECT *, line IS NULL OR regexp_full_match(line, '[ \\t\\r]*(?:(?:{_FIELD})(?:[ \\t\\r]+(?:{_FIELD}))*)?[ \\t\\r]*') AS fine,
  coalesce(regexp_extract_all(line, '{_FIELD}'), []) AS raw FROM l),
f AS (SELECT *, list_transform(raw, lambda x: CASE WHEN x[1] = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS fields FROM split),
v AS (SELECT *, CASE WHEN source = 'sequences' THEN fields[2:] ELSE fields END AS names FROM f),
c AS (SELECT *, CASE WHEN NOT fine THEN 'quoting'
  WHEN len(fields) < 2 OR (source = 'hierarchy' AND len(fields) <> 2) THEN 'columns'
  WHEN source = 'sequences' AND NOT coalesce(regexp_full_match(fields[1], '[0-9]{{1,19}}') AND try_cast(fields[1] AS HUGEINT) BETWEEN 1 AND 9223372036854775807, false) THEN 'value'
  WHEN len(list_filter(names, lambda x: x = '' OR length(x) > 100 OR regexp_matches(x, '[\\x00-\\x1f\\x7f\\x{{FFFD}}]'))) > 0 THEN 'value' END AS reason FROM v)
"""
_P3_BASE = f"WITH l AS ({_P3_LINES}), {_P3_TAIL}"
P3 = _P3_BASE + "SELECT source, line_id, reason FROM c WHERE reason IS NOT NULL"
P3_VALID_SEQUENCES = _P3_BASE + "SELECT line_id, fields[1]::BIGINT AS seq_id, fields[2:] AS items FROM c WHERE reason IS NULL AND source = 'sequences'"
P3_VALID_HIERARCHY = _P3_BASE + "SELECT fields[1] AS item, fields[2] AS parent, line_id AS line_no FROM c WHERE reason IS NULL AND source = 'hierarchy'"

P3_RECOVERED = f"""WITH t AS (SELECT line_id // 100 AS chunk, string_split(string_agg(line, chr(10) ORDER BY line_id), chr(10)) AS x FROM raw_sequences WHERE line IS NOT NULL GROUP BY 1),
n AS (SELECT chunk, unnest(range(len(x))) AS no, unnest(x) AS line FROM t),
l AS (SELECT 'sequences' AS source, chunk * 1000000 + no AS line_id, line FROM n WHERE NOT regexp_full_match(line, '[ \\t\\r]*')),
{_P3_TAIL},
w AS (SELECT *, line_id // 1000000 AS chunk, line_id % 1000000 AS no, max(CASE WHEN reason IS NULL THEN line_id ELSE -1 END) OVER (PARTITION BY line_id // 1000000 ORDER BY line_id) AS last_valid FROM c),
b AS (SELECT *, min(CASE WHEN reason = 'quoting' THEN no END) OVER (PARTITION BY chunk, last_valid) AS broken FROM w)
SELECT chunk, no AS line, CASE WHEN reason IS NULL THEN len(fields)::INT END AS n_fields, reason, CASE WHEN reason IS NOT NULL AND broken < no THEN broken END AS after FROM b"""

P3_IN_FILES = f"""WITH n AS (SELECT unnest(string_split(line, chr(10))) AS line FROM raw_sequences WHERE line IS NOT NULL),
l AS (SELECT 'sequences' AS source, 0 AS line_id, line FROM n WHERE NOT regexp_full_match(line, '[ \\t\\r]*')),
{_P3_TAIL}
SELECT reason, count(*) AS n_lines, sum(CASE WHEN reason IS NULL THEN len(fields) END)::BIGINT AS n_fields FROM c GROUP BY reason"""

P6 = f"""WITH RECURSIVE hold AS ({HOLDING_SQL}),
down(item, root, depth, path) AS (
  SELECT item, CASE WHEN parent IS NULL THEN item ELSE parent END, CASE WHEN parent IS NULL THEN 0 ELSE 1 END, CASE WHEN parent IS NULL THEN [item] ELSE [parent, item] END
  FROM hold WHERE parent IS NULL OR parent NOT IN (SELECT item FROM hold)
  UNION ALL SELECT h.item, d.root, d.depth + 1, list_append(d.path, h.item) FROM hold h JOIN down d ON d.item = h.parent),
below AS (SELECT a, count(*) AS n FROM (SELECT unnest(path[:-2]) AS a FROM down) GROUP BY a)
SELECT hold.item, coalesce(root, '') AS root, coalesce(depth, -1)::INT AS depth, coalesce(array_to_string(path, '>'), '') AS full_path,
  CASE WHEN root IS NULL THEN -1 ELSE coalesce(n, 0) END::BIGINT AS n_descendants
FROM hold LEFT JOIN down ON down.item = hold.item LEFT JOIN below ON below.a = hold.item"""

P7 = f"""WITH hold AS ({HOLDING_SQL}),
ev AS (SELECT DISTINCT seq_id, pos, item, ts FROM sequence_items WHERE item IS NOT NULL),
k AS (SELECT 'item' AS field, item AS key_value, seq_id, pos, ts FROM ev
  UNION ALL SELECT 'parent', parent, seq_id, pos, ts FROM ev JOIN hold USING (item) WHERE parent IS NOT NULL),
g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY field, key_value ORDER BY ts)) AS gap FROM k)
SELECT field, key_value, count(*) AS n_rows, count(DISTINCT seq_id) AS n_seqs, coalesce(max(gap) // 1000000, 0)::BIGINT AS max_wait_s FROM g GROUP BY field, key_value"""
