"""SQL twins of the queries that SQL can express, for an independent engine."""

from __future__ import annotations

#: Smallest id reachable over links (a, b), both directions given; to be put behind WITH RECURSIVE.
_REACH = """
reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
),
component AS (SELECT a AS id, least(a, min(b)) AS c FROM reach GROUP BY a)"""

OP3 = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y
  ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) >= 0.93e0 ELSE FALSE END
),{_REACH},
counted AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, e.vec_id) AS component_id,
       e.vec_id = coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN component p ON p.id = e.vec_id LEFT JOIN counted k ON k.id = e.vec_id"""

OP5 = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingled AS (
  SELECT doc_id, list_sort(list_distinct(CASE
    WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END)) AS s
  FROM worded
),
classed AS (
  SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS class_id
  FROM shingled
),
single AS (SELECT doc_id, n, unnest(s) AS g FROM classed WHERE doc_id = class_id AND n > 0),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k
  FROM single x JOIN single y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
),
pairs AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (na + nb - k)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),{_REACH}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, class_id, coalesce(c, class_id) AS component_id
FROM classed LEFT JOIN component ON id = class_id"""


#: CRC-32 of a word: a table of 256 entries by its rule, then one step per byte of the word's hex form.
OP11 = r"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY i) AS crc FROM step WHERE k = 8),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
),
worded AS (
  SELECT side, id, coalesce(list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda w: w <> ''), []) AS ws
  FROM texts
),
counted AS (SELECT side, id, w, count(*) AS n FROM (SELECT side, id, unnest(ws) AS w FROM worded) GROUP BY ALL),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counted)),
bytes AS (
  SELECT w, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, CAST(i AS INT), 2) AS BIGINT)) AS b FROM vocabulary
),
bucketed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc[CAST(xor(c & 255, x) AS INT) + 1])),
                4294967295) % 10000 AS bucket
  FROM bytes, crc_table
),
sums AS (
  SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END)::DOUBLE AS t
  FROM counted JOIN bucketed USING (w) GROUP BY bucket
),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g
  FROM sums
),
weighed AS (
  SELECT id, sum(n) AS n, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight
  FROM counted JOIN bucketed USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id
),
scored AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
      (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed ON id = doc_id
),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * 10 // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)"""

OP12 = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS low FROM sized)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > low THEN low END AS refers_to
FROM first"""

OP13 = r"""
WITH worded AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
failed AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM worded
),
marked AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
grouped AS (
  SELECT part, a, b, c, d, e, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
  FROM failed LEFT JOIN marked USING (doc_id) GROUP BY ALL
),
one(x) AS (SELECT unnest(['A', 'B', 'C', 'D', 'E'])),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM one p, one q, one r, one s, one t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
),
steps AS (SELECT o, k, substr(o, CAST(k AS INT), 1) AS f, substr(o, 1, CAST(k AS INT) - 1) AS earlier FROM orders, range(1, 6) g(k)),
letters AS (
  SELECT *, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                   CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails
  FROM grouped
),
met AS (
  SELECT part, o, k, f, n, good, toxic, contains(fails, f) AS here, fails = f AS only_here,
         translate(earlier, fails, '') <> earlier AS gone
  FROM letters, steps
),
summed AS (
  SELECT part, o, k, f,
    sum(CASE WHEN NOT gone AND NOT here THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND here THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND here THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_here THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND here THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND here THEN toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, o AS filter_order, CAST(k AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed"""
