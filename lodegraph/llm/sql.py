"""SQL that says what a query returns, for the operators that SQL can express whole."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
repeats AS (SELECT doc_id, s FROM (SELECT doc_id, s, rank() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM repeats)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS s FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL) JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * shared >= 85 * (s.n + t.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""

DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
it AS (SELECT item_id, len(ws) AS m, least(len(ws), 5) AS k, ws FROM i WHERE len(ws) > 0),
ih AS (SELECT item_id, m, k, array_to_string(ws[s:s + k - 1], ' ') AS h FROM (SELECT *, unnest(range(1, m - k + 2)) AS s FROM it)),
ic AS (SELECT item_id, m, k, h, count(*) AS c FROM ih GROUP BY ALL),
dh AS (SELECT doc_id, n, k, s, array_to_string(ws[s:s + k - 1], ' ') AS h FROM (SELECT doc_id, ws, len(ws) AS n, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM it) WHERE len(ws) >= k)),
pairs AS (SELECT DISTINCT doc_id, n, item_id, m, k FROM dh JOIN ic USING (k, h)),
windows AS (SELECT *, least(m, n) AS size, unnest(range(1, n - least(m, n) + 2)) AS start FROM pairs),
wc AS (SELECT doc_id, item_id, m, k, size, start, h, count(*) AS c FROM windows JOIN dh USING (doc_id, k) WHERE s BETWEEN start AND start + size - k GROUP BY ALL),
shared AS (SELECT doc_id, item_id, wc.m, wc.k, size, start, sum(least(wc.c, ic.c)) AS inter FROM wc JOIN ic USING (item_id, h) GROUP BY ALL),
scored AS (SELECT *, CAST(inter AS DOUBLE) / (size - k + 1 + m - k + 1 - inter) AS similarity FROM shared)
SELECT doc_id, item_id, CAST(start - 1 AS INTEGER) AS start, CAST(size AS INTEGER) AS n_words, similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM scored WHERE similarity >= 0.8) WHERE r = 1
"""
