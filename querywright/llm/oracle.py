"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

#: Payloads, digests and revisits straight from the pages.
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN strlen(h) >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 100 AND first < page_id THEN first END AS refers_to
FROM r
"""

#: Each source is one pattern here, so the cheapest flow is its quota.  The unit that fills all
#: quotas is found among the sources in the order in which they reach their caps.
MIX = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS th FROM documents),
g AS (SELECT s, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY s),
w AS (SELECT s, n, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY encode(s)) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight FROM g),
o AS (SELECT *, 2.0 * n / weight AS full_at, row_number() OVER (ORDER BY 2.0 * n / weight, s) AS k FROM w),
u AS (SELECT k, full_at,
  ((SELECT 1.5 * sum(n) FROM o)::DOUBLE - coalesce(sum(2.0 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS unit FROM o),
f AS (SELECT unit FROM u WHERE unit < full_at ORDER BY k LIMIT 1),
t AS (SELECT s, n, least(weight * (SELECT unit FROM f), 2.0 * n)::DOUBLE AS target FROM o),
c AS (SELECT doc_id, s, size, n, target,
  sum(size) OVER (PARTITION BY s ORDER BY md5('4:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || th), doc_id, size, th ROWS UNBOUNDED PRECEDING) AS e,
  CASE WHEN n > 0 THEN floor(target / n + 1e-9) ELSE 0 END AS whole
  FROM d JOIN t USING (s)),
r AS (SELECT *, size > 0 AND e <= target - whole * n + 1e-6 AS fits FROM c),
h AS (SELECT s, max(target - whole * n) - coalesce(max(CASE WHEN fits THEN e END), 0) AS gap FROM r GROUP BY s),
l AS (SELECT s, e FROM r JOIN h USING (s) WHERE NOT fits AND size > 0 AND abs(size - gap) < gap QUALIFY row_number() OVER (PARTITION BY s ORDER BY abs(size - gap), e) = 1)
SELECT doc_id, size, n AS source_size, target,
  CAST(CASE WHEN size > 0 THEN size * (whole + CASE WHEN fits OR (s, e) IN (SELECT s, e FROM l) THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM r
"""

#: All pairs that share an n-gram, counted; groups by reachability over the links.
NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS l FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
  ELSE [array_to_string(l[i:i + 4], ' ') FOR i IN range(1, len(l) - 3)] END) AS gram FROM w),
n AS (SELECT w.doc_id, any_value(w.body) AS body, count(gram) AS m FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY w.doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y, both_n, p.m AS mx, q.m AS my FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 9 * both_n >= 4 * (p.m + q.m)
  UNION ALL SELECT p.doc_id, q.doc_id, 0, 0, 0 FROM n p JOIN n q ON p.body = q.body AND p.doc_id <> q.doc_id WHERE p.m = 0 AND q.m = 0),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
class AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x)
SELECT n.doc_id, class_id,
  least(n.doc_id, coalesce((SELECT min(y) FROM link WHERE link.x = n.doc_id AND both_n = mx AND mx = my), n.doc_id)) AS rep_id,
  (SELECT count(*) FROM link WHERE link.x = n.doc_id) AS n_links
FROM n JOIN class ON class.x = n.doc_id
"""

#: The tolerance itself, without masks: w - s of w tokens that agree hold a run of ceil((w - s) / (s + 1))
#: that agree, so runs of that length find every alignment, and each is compared token by token.
LEAKS = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS l FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS l FROM benchmark),
bw AS (SELECT item_id, l, least(13, len(l)) AS w FROM b WHERE len(l) > 0),
bs AS (SELECT item_id, l, w, CAST(ceil(w * 11 / 13.0) AS BIGINT) AS need FROM bw),
bk AS (SELECT item_id, l, CAST(ceil(need / (w - need + 1.0)) AS BIGINT) AS k FROM bs),
ks AS (SELECT DISTINCT k FROM bk),
bi AS (SELECT item_id, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM bk),
bp AS (SELECT item_id, k, i, array_to_string(l[i:i + k - 1], ' ') AS g FROM bi),
ai AS (SELECT doc_id, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM a, ks WHERE len(l) >= k),
ap AS (SELECT doc_id, k, i, array_to_string(l[i:i + k - 1], ' ') AS g FROM ai),
hit AS (SELECT DISTINCT doc_id, item_id, ap.i - bp.i AS shift FROM ap JOIN bp ON ap.k = bp.k AND ap.g = bp.g),
pos AS (SELECT doc_id, item_id, shift, len(b.l) AS nb, a.l AS al, b.l AS bl, unnest(range(greatest(1, 1 - shift), least(len(b.l), len(a.l) - shift) + 1)) AS j FROM hit JOIN a USING (doc_id) JOIN b USING (item_id)),
run AS (SELECT doc_id, item_id, shift, j, least(13, nb) AS w, list_sum([CASE WHEN al[shift + k] = bl[k] THEN 1 ELSE 0 END FOR k IN range(j, j + least(13, nb))]) AS m
  FROM pos WHERE j + least(13, nb) - 1 <= least(nb, len(al) - shift)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m DESC, shift + j, j) AS k FROM run WHERE m * 13 >= w * 11)
SELECT doc_id, item_id, CAST(m AS INTEGER) AS matched, CAST(w AS INTEGER) AS compared, CAST(shift + j - 1 AS INTEGER) AS doc_pos, CAST(j - 1 AS INTEGER) AS item_pos FROM best WHERE k = 1
"""

#: The quotas sum to all words (twice), so the cheapest flow takes every document once (twice).
OVERLAPPING = r"""
WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)
SELECT doc_id, t AS times, CAST(CASE WHEN size > 0 THEN t ELSE 0 END AS INTEGER) AS copies, CAST(size * t AS BIGINT) AS taken FROM d, (VALUES (1), (2)) v(t)
"""

SQL = {"mix_overlapping": OVERLAPPING, "op3_warc": WARC, "op4_mix_sources": MIX, "op8_near_duplicates": NEAR, "op9_contamination": LEAKS}
