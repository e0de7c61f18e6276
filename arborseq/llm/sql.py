"""The same in SQL, where it can be said there."""

P1 = """WITH RECURSIVE s AS (SELECT DISTINCT seq_id, items FROM sequences WHERE seq_id IS NOT NULL),
n AS (SELECT count(DISTINCT seq_id) AS n FROM s),
r AS (SELECT row_number() OVER () AS rid, seq_id, items FROM s WHERE len(items) > 0),
o AS (SELECT rid, seq_id, unnest(range(len(items))) AS pos, unnest(items) AS item FROM r),
c AS (SELECT item FROM o, n WHERE item IS NOT NULL GROUP BY item, n HAVING count(DISTINCT seq_id) * 200 >= n),
g AS (SELECT o.* FROM o JOIN c USING (item)),
e(rid, seq_id, pattern, last, k) AS (SELECT rid, seq_id, item, pos, 1 FROM g
  UNION SELECT e.rid, e.seq_id, e.pattern || ' ' || g.item, g.pos, e.k + 1 FROM e JOIN g ON g.rid = e.rid AND g.pos > e.last AND g.pos <= e.last + 3 WHERE e.k < 5)
SELECT pattern AS sequence, count(DISTINCT seq_id) AS frequency FROM e, n WHERE e.k >= 2 GROUP BY pattern, n HAVING count(DISTINCT seq_id) * 200 >= n"""

_P2 = """WITH o AS (SELECT DISTINCT seq_id, unnest(items) AS item FROM sequences WHERE seq_id IS NOT NULL), f AS (SELECT * FROM o WHERE item IS NOT NULL),
total AS (SELECT count(DISTINCT seq_id) AS t FROM sequences), one AS (SELECT item, count(*) AS n FROM f GROUP BY item),
p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM f a JOIN f b ON a.seq_id = b.seq_id AND a.item < b.item GROUP BY ALL),
q AS (SELECT p.*, x.n AS n_a, y.n AS n_b, t FROM p JOIN one x ON x.item = item_a JOIN one y ON y.item = item_b, total WHERE n_ab >= 8 AND n_ab * 500 >= t)
"""
P2 = _P2 + "SELECT item_a, item_b FROM q WHERE n_ab * t >= 3 * n_a * n_b"
P2_ODDS = _P2 + """SELECT item_a, item_b, n_ab, n_a, n_b, round(n_ab::DOUBLE * t / (n_a::DOUBLE * n_b), 6) AS lift,
  round((n_ab + 0.5::DOUBLE) * (t - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)), 6) AS odds_ratio FROM q"""

P4 = """WITH e AS (SELECT 'item' AS field, item AS term, count(DISTINCT (seq_id, pos)) AS n_rows, count(DISTINCT seq_id) AS n_records,
  (SELECT count(DISTINCT seq_id) FROM sequence_items) AS n FROM sequence_items WHERE item IS NOT NULL GROUP BY item
UNION ALL SELECT 'parent', parent, count(DISTINCT line_no), count(DISTINCT item), (SELECT count(DISTINCT item) FROM hierarchy) FROM hierarchy WHERE parent IS NOT NULL GROUP BY parent)
SELECT field, term, n_rows, n_records, CASE WHEN 20 * n_records >= n THEN 'common' WHEN n_records < 3 THEN 'rare' ELSE 'ok' END AS mark FROM e"""

P5 = """WITH e AS (SELECT DISTINCT seq_id, pos, item FROM sequence_items WHERE item IS NOT NULL)
SELECT item FROM e GROUP BY item HAVING 250 * count(*) >= (SELECT count(*) FROM e)"""

P9 = r"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
dg AS (SELECT DISTINCT id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 8)) AS i FROM d)),
qg AS (SELECT DISTINCT id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 8)) AS i FROM q))
SELECT DISTINCT dg.id AS doc_id, qg.id AS item_id FROM dg JOIN qg USING (g)"""

P10 = """WITH t AS (SELECT doc_id, text FROM documents WHERE length(text) >= 240),
w AS (SELECT doc_id, p, md5(substring(text, p, 240)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 238)) AS p FROM t)),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p AS step FROM w WHERE h IN (SELECT h FROM s))
SELECT doc_id, sum(least(240, coalesce(step, 240)))::BIGINT AS shared_chars FROM m GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p2_found": P2, "p2_odds": P2_ODDS, "p4_found": P4, "p5_found": P5, "p9_found": P9, "p10_found": P10}
