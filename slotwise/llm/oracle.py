"""DuckDB SQL for the ``opN_<name>`` queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH texts AS (SELECT doc_id, {WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS g
  FROM texts, unnest(range(1, len(ws) - 33)) AS t(i)),
repeated AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM windows SEMI JOIN repeated USING (g), unnest(range(0, 35)) AS t(k)),
words AS (SELECT doc_id, p, ws[p] AS w FROM texts, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS txt FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

OP2 = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS g
  FROM texts, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT g FROM shingles GROUP BY g HAVING count(*) > 1),
twice AS (SELECT * FROM shingles SEMI JOIN shared USING (g)),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM twice a JOIN twice b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) USING (doc_id)
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM k
"""

OP7 = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
targets AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS g
  FROM items, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT n FROM targets),
windows AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM texts, lengths, unnest(range(1, len(ws) - n + 2)) AS t(i)),
found AS (SELECT doc_id, i, n, item_id FROM windows JOIN targets USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_ROUNDS = ",\n".join(
    f"""
a{r} AS MATERIALIZED (SELECT rid, min(s * 16 + c) % 16 AS c, min(s * 16 + c) // 16 AS s FROM (SELECT rid, c, sum((x - m) * (x - m)) AS s FROM x JOIN c{r} USING (i) GROUP BY rid, c) GROUP BY rid),
c{r + 1} AS MATERIALIZED (
  SELECT c, i, CAST(coalesce((t - (((t % n) + n) % n)) // n, m) AS BIGINT) AS m
  FROM c{r} LEFT JOIN (SELECT c, i, sum(x) AS t, count(*) AS n FROM x JOIN a{r} USING (rid) GROUP BY c, i) USING (c, i))"""
    for r in range(4)
)

OP11 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = 64),
x AS MATERIALIZED (SELECT rid, i, v[i] AS x FROM v, unnest(range(1, 65)) AS t(i)),
first AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h LIMIT 16)),
c0 AS MATERIALIZED (SELECT c, i, v[i] AS m FROM first, unnest(range(1, 65)) AS t(i)),
{_ROUNDS},
hashes AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS h FROM c3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM v JOIN a3 USING (rid) JOIN hashes USING (c)
"""

OP13 = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
words AS (SELECT lang, source, r, unnest(ws) AS term FROM texts),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(lang_n), 0) AS lang_total FROM (SELECT DISTINCT lang FROM texts) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM texts) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, lang_n, v, lang_total,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM groups JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
  FROM (SELECT *, 1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 1)) // (lang_total + v) AS q FROM shares WHERE n > 0) WHERE p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""

ORACLE_SQL = {
    "op1_substring_dedup": OP1,
    "op2_ngram_jaccard_join": OP2,
    "op3_warc": OP3,
    "op7_benchmark_decontamination": OP7,
    "op11_centroid_clustering": OP11,
    "op13_source_divergence": OP13,
}
