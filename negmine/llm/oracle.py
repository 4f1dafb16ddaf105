"""DuckDB SQL for the queries that SQL can express."""

_DECONTAMINATION = r"""
WITH item AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
run AS (
  SELECT r, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS key
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc), (SELECT DISTINCT n FROM win) s
  WHERE i + s.n - 1 <= len(w)),
hit AS (SELECT run.r, run.i, run.n, win.item FROM run JOIN win ON run.key = win.key AND run.n = win.n),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN named USING (r)
"""

_REPEATS = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
start AS (SELECT r, s, md5(array_slice(b, s + 1, s + 200)) AS m FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS s FROM doc)),
twice AS (SELECT r, s FROM start WHERE m IN (SELECT m FROM start GROUP BY m HAVING count(*) > 1)),
placed AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM twice),
numbered AS (SELECT r, s, sum(CASE WHEN before IS NULL OR s - before > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS run FROM placed),
span AS (SELECT r, run, min(s) AS lo, max(s) + 200 AS hi FROM numbered GROUP BY r, run),
edge AS (SELECT r, lo, hi FROM span UNION ALL SELECT r, octet_length(b), octet_length(b) FROM doc),
rest AS (SELECT e.r, e.lo, coalesce(lag(e.hi) OVER (PARTITION BY e.r ORDER BY e.lo, e.hi), 0) AS from_ FROM edge e),
kept AS (SELECT rest.r, sha256(unhex(string_agg(CASE WHEN lo > from_ THEN hex(array_slice(b, from_ + 1, lo)) ELSE '' END, '' ORDER BY lo, from_))) AS kept_sha256
         FROM rest JOIN doc USING (r) GROUP BY rest.r),
total AS (SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM span GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256
FROM doc JOIN kept USING (r) LEFT JOIN total USING (r)
"""

_NEAR = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
link AS (SELECT x, y FROM common JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT r AS x, r AS y FROM doc UNION SELECT reach.x, way.y FROM reach JOIN way ON reach.y = way.x),
first AS (SELECT reach.x AS r, min(d.doc_id) AS component_id FROM reach JOIN doc d ON d.r = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM doc LEFT JOIN size USING (r) JOIN first USING (r)
"""

_DIVERGENCE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
word AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
cell AS (SELECT lang, source, term, count(*) AS n FROM word GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n
          FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
priced AS (
  SELECT d.*, 1 + (1000000000::HUGEINT * (d.n + 5)) // (sum(d.n) OVER (PARTITION BY d.lang, d.source) + 5 * s.v) AS p,
         1 + (1000000000::HUGEINT * (d.all_n + 5)) // (s.total + 5 * s.v) AS q
  FROM dense d JOIN size s ON d.lang = s.lang),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN priced y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY a.lang, a.source, b.source),
part AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, p - q FROM priced WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM part)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLE = {"op11_divergence": _DIVERGENCE, "op2_decontamination": _DECONTAMINATION, "op3_repeats": _REPEATS, "op7_parity_join": _NEAR}
