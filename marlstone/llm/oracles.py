"""DuckDB SQL for the corpus queries that SQL can express: brute force over whole tables."""

SQL: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op1_minhash_dedup"] = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i, len(w) AS words FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents)),
g AS (SELECT *, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS MATERIALIZED (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c) AS x FROM g WHERE c IS NOT NULL OR words < 3 AND i = 1),
u AS MATERIALIZED (SELECT doc_id, count(*) AS n, bit_xor(hash(x)) AS h FROM e GROUP BY doc_id),
one AS MATERIALIZED (SELECT h, n, min(doc_id) AS doc_id FROM u GROUP BY h, n),
s AS MATERIALIZED (SELECT e.doc_id, n, x FROM e JOIN one USING (doc_id)),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
equal AS MATERIALIZED (SELECT u.doc_id AS a, one.doc_id AS b FROM u JOIN one ON u.h = one.h AND u.n = one.n AND u.doc_id > one.doc_id),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs UNION ALL SELECT a, b FROM equal UNION ALL SELECT b, a FROM equal),
reach(node, root) AS (SELECT doc_id, doc_id FROM u UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node AND reach.root < links.b),
least_root AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM documents LEFT JOIN u USING (doc_id) LEFT JOIN least_root ON node = doc_id
"""

SQL["op2_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) AS size FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS x FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM sized) WHERE len(w) >= size),
found AS (SELECT doc_id, i, p.size, item FROM (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS x FROM places) p JOIN windows ON windows.size = p.size AND windows.x = p.x),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

SQL["op10_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

_FACTOR = """
  SELECT r, CASE WHEN d > 0 AND d < 1 THEN d ELSE (r - 0.5e0) / r END AS f
  FROM (SELECT r, CASE WHEN n[r] > 0 AND n[1] > 0 AND 6.0e0 * n[6] / n[1] < 1 THEN (((r + 1.0e0) * n[r + 1]) / (r * n[r]) - 6.0e0 * n[6] / n[1]) / (1 - 6.0e0 * n[6] / n[1]) ELSE 0.0e0 END AS d
        FROM (SELECT [count(*) FILTER (c = 1), count(*) FILTER (c = 2), count(*) FILTER (c = 3), count(*) FILTER (c = 4), count(*) FILTER (c = 5), count(*) FILTER (c = 6)] AS n FROM {}), (SELECT unnest(range(1, 6)) AS r))
"""

SQL["op8_katz"] = rf"""
WITH d AS (
  SELECT doc_id, list_append(list_concat([' <', ' <'], coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), [])), ' >') AS w,
    list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
h AS (SELECT doc_id, w, xor(crc, 4294967295) % 7 = 2 AS held_out FROM d),
t AS (SELECT doc_id, held_out, w[i - 2] AS u, w[i - 1] AS v, w[i] AS w FROM (SELECT doc_id, held_out, w, unnest(range(3, len(w) + 1)) AS i FROM h)),
c1 AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY u, v, w),
f1 AS ({_FACTOR.format("c1")}), f2 AS ({_FACTOR.format("c2")}), f3 AS ({_FACTOR.format("c3")}),
g1 AS (SELECT w, c, c * coalesce(f, 1) AS k FROM c1 LEFT JOIN f1 ON r = c),
g2 AS (SELECT v, w, c, c * coalesce(f, 1) AS k FROM c2 LEFT JOIN f2 ON r = c),
g3 AS (SELECT u, v, w, c, c * coalesce(f, 1) AS k FROM c3 LEFT JOIN f3 ON r = c),
m AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS kinds, coalesce(sum(c - k), 0) AS free FROM g1),
n AS (SELECT n, kinds, CASE WHEN free > 0 THEN CAST(n AS DOUBLE) ELSE n + 1.0e0 END AS whole, CASE WHEN free > 0 THEN free / n ELSE 1 / (n + 1.0e0) END AS unseen FROM m),
p1 AS (SELECT w, c, k / whole AS p FROM g1, n),
x2 AS (
  SELECT v, CASE WHEN kept < total * (1 - 1e-12) THEN CAST(total AS DOUBLE) ELSE total + 1.0e0 END AS scale, kept, below
  FROM (SELECT v, sum(g2.c) AS total, sum(k) AS kept, sum(p) AS below FROM g2 JOIN p1 USING (w) GROUP BY v)),
a2 AS (SELECT v, scale, greatest(1 - kept / scale, 0) / greatest(1 - below, unseen) AS alpha FROM x2, n),
p2 AS (SELECT v, w, k / scale AS p FROM g2 JOIN a2 USING (v)),
x3 AS (
  SELECT u, v, CASE WHEN kept < total * (1 - 1e-12) THEN CAST(total AS DOUBLE) ELSE total + 1.0e0 END AS scale, kept, below
  FROM (SELECT u, v, sum(g3.c) AS total, sum(k) AS kept, sum(p) AS below FROM g3 JOIN p2 USING (v, w) GROUP BY u, v)),
a3 AS (SELECT u, v, x3.scale, greatest(1 - kept / x3.scale, 0) / greatest(1 - below, alpha * unseen) AS alpha FROM x3 JOIN a2 USING (v), n),
y AS (
  SELECT doc_id, t.held_out, p1.c,
    log10(CASE WHEN g3.c IS NOT NULL THEN g3.k / a3.scale ELSE coalesce(a3.alpha, 1) * CASE WHEN p2.p IS NOT NULL THEN p2.p ELSE coalesce(a2.alpha, 1) * coalesce(p1.p, unseen) END END) AS s,
    log10((coalesce(p1.c, 0) + 1) / (n.n + n.kinds + 1.0e0)) AS b
  FROM t CROSS JOIN n LEFT JOIN p1 ON p1.w = t.w LEFT JOIN p2 ON p2.v = t.v AND p2.w = t.w LEFT JOIN a2 ON a2.v = t.v
  LEFT JOIN g3 ON g3.u = t.u AND g3.v = t.v AND g3.w = t.w LEFT JOIN a3 ON a3.u = t.u AND a3.v = t.v)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST((SELECT n FROM n) AS BIGINT) AS train_tokens, sum(b) AS base_score, sum(s) AS score
FROM y GROUP BY doc_id, held_out
"""
