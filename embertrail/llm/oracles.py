"""The queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

OP10 = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
rows AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM rows),
marked AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, holder IS NOT NULL AND doc_id <> holder AS dropped FROM keyed LEFT JOIN marked USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP2 = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
word AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM split),
windows AS (
  SELECT doc_id, i, [w, lead(w) OVER o, lead(w, 2) OVER o] AS three, lead(w, 2) OVER o IS NOT NULL AS whole FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM windows WHERE whole QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + step) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS step) GROUP BY doc_id),
t0 AS (SELECT range AS n, range AS c FROM range(256)),
CRC_STEPS
crc AS (SELECT list(c ORDER BY n) AS lookup FROM t8),
spelled AS (
  SELECT w, list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS octets
  FROM (SELECT DISTINCT w FROM word)),
hashed AS (
  SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], octets), lambda a, o: xor(a >> 8, lookup[(xor(a, o) & 255) + 1])), 4294967295::BIGINT) % 65536 AS b
  FROM spelled, crc),
buckets AS (SELECT doc_id, i, b FROM word JOIN hashed USING (w)),
grams AS (
  SELECT doc_id, b AS gram FROM buckets
  UNION ALL SELECT doc_id, 65536 + (b * 31 + nxt) % 1048576 FROM (SELECT *, lead(b) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM buckets) WHERE nxt IS NOT NULL),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
counts AS (
  SELECT gram, gram >= 65536 AS kind, count(*) AS corpus, count(trusted.doc_id) AS target
  FROM grams LEFT JOIN trusted USING (doc_id) GROUP BY gram),
totals AS (SELECT kind, sum(corpus) AS all_corpus, sum(target) AS all_target FROM counts GROUP BY kind),
ratios AS (
  SELECT gram, ln(target + 5.0) - ln(corpus * (all_target / all_corpus) + 5.0) AS ratio FROM counts JOIN totals USING (kind)),
scores AS (SELECT doc_id, avg(ratio) AS score FROM grams JOIN ratios USING (gram) GROUP BY doc_id),
joined AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, score
  FROM split LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN scores USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM joined)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(score >= -0.15, false) AS kept
FROM judged
"""

OP4 = r"""
WITH found AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS place FROM pages),
rest AS (SELECT page_id, url, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM found),
parted AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest),
named AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parted),
ruled AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said,
         row_number() OVER () AS row_no FROM named),
chars AS (SELECT row_no, said, unnest(string_split(lower(url), '')) AS ch, unnest(range(length(url))) AS i FROM ruled WHERE url <> ''),
coded AS (SELECT row_no, said, i, strpos('abcdefghijklmnopqrstuvwxyz0123456789./:-_?=&', ch) AS c FROM chars),
cells AS (
  SELECT row_no, said, c, coalesce(lag(c) OVER w, 45) AS c1, coalesce(lag(c, 2) OVER w, 45) AS c2
  FROM coded WINDOW w AS (PARTITION BY row_no ORDER BY i)),
classes AS (SELECT unnest(['allow', 'block']) AS said),
t3 AS (SELECT said, c2, c1, c, count(*) AS n FROM cells WHERE said IS NOT NULL GROUP BY ALL),
t2 AS (SELECT said, c1, c, sum(n) AS n FROM t3 GROUP BY ALL),
t1 AS (SELECT said, c, sum(n) AS n FROM t3 GROUP BY ALL),
s3 AS (SELECT said, c2, c1, sum(n) AS total, count(*) AS kinds FROM t3 GROUP BY ALL),
s2 AS (SELECT said, c1, sum(n) AS total, count(*) AS kinds FROM t2 GROUP BY ALL),
s1 AS (SELECT said, sum(n) AS total, count(*) AS kinds FROM t1 GROUP BY ALL),
used AS (SELECT DISTINCT c2, c1, c FROM cells),
p1 AS (
  SELECT u.*, classes.said, CASE WHEN s1.total > 0 THEN (coalesce(t1.n, 0) + s1.kinds * (1.0::DOUBLE / 46)) / (s1.total + s1.kinds) ELSE 1.0::DOUBLE / 46 END AS p
  FROM used u, classes LEFT JOIN s1 ON s1.said = classes.said LEFT JOIN t1 ON t1.said = classes.said AND t1.c = u.c),
p2 AS (
  SELECT p1.* REPLACE (CASE WHEN s2.total > 0 THEN (coalesce(t2.n, 0) + s2.kinds * p) / (s2.total + s2.kinds) ELSE p END AS p)
  FROM p1 LEFT JOIN s2 ON s2.said = p1.said AND s2.c1 = p1.c1 LEFT JOIN t2 ON t2.said = p1.said AND t2.c1 = p1.c1 AND t2.c = p1.c),
p3 AS (
  SELECT p2.* REPLACE (CASE WHEN s3.total > 0 THEN (coalesce(t3.n, 0) + s3.kinds * p) / (s3.total + s3.kinds) ELSE p END AS p)
  FROM p2 LEFT JOIN s3 ON s3.said = p2.said AND s3.c1 = p2.c1 AND s3.c2 = p2.c2
  LEFT JOIN t3 ON t3.said = p2.said AND t3.c1 = p2.c1 AND t3.c2 = p2.c2 AND t3.c = p2.c),
ratios AS (SELECT c2, c1, c, sum(CASE said WHEN 'allow' THEN ln(p) ELSE -ln(p) END) AS ratio FROM p3 GROUP BY ALL),
scores AS (SELECT row_no, avg(ratio) AS score FROM cells JOIN ratios USING (c2, c1, c) GROUP BY row_no),
scored AS (SELECT ruled.*, coalesce(score, 0) AS score FROM ruled LEFT JOIN scores USING (row_no)),
means AS (SELECT said, avg(score) AS mean FROM scored WHERE said IS NOT NULL GROUP BY said),
middle AS (SELECT CASE WHEN count(*) = 2 THEN avg(mean) ELSE 0 END AS threshold FROM means)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict FROM scored, middle
"""

OP7 = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS hash
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sources),
ranked AS (
  SELECT *, 3 * source_size / weight AS ratio, row_number() OVER (ORDER BY 3 * source_size / weight, source) AS k FROM weighed),
levels AS (
  SELECT k, ratio, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / sum(weight) OVER rest AS level
  FROM ranked WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
water AS (SELECT level FROM levels WHERE ratio >= level ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, least(weight * level, 3.0::DOUBLE * source_size) AS target FROM weighed, water),
plan AS (
  SELECT *, target - whole * source_size AS extra
  FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets)),
alike AS (SELECT source, hash, sum(size) AS alike, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto FROM docs GROUP BY source, hash),
taken AS (
  SELECT plan.*, hash, whole + CASE WHEN 2 * upto - alike <= 2 * extra AND extra > 0 THEN 1 ELSE 0 END AS times
  FROM alike JOIN plan ON alike.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target, CAST(size * times AS BIGINT) AS taken
FROM docs JOIN taken ON docs.source IS NOT DISTINCT FROM taken.source AND docs.hash = taken.hash
"""

OP11 = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP13 = r"""
WITH texts AS (SELECT 'd' AS kind, row_number() OVER () AS row_no, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), item_id, text FROM benchmark),
split AS (
  SELECT kind, row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts),
features AS (
  SELECT kind, row_no, unnest(words) AS feature FROM split
  UNION ALL SELECT kind, row_no, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM split WHERE len(words) > 1),
t0 AS (SELECT range AS n, range AS c FROM range(256)),
CRC_STEPS
crc AS (SELECT list(c ORDER BY n) AS lookup FROM t8),
spelled AS (
  SELECT feature, list_transform(range(octet_length(encode(feature))), lambda i: CAST('0x' || substr(hex(encode(feature)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS octets
  FROM (SELECT DISTINCT feature FROM features)),
hashed AS (
  SELECT feature, xor(list_reduce(list_concat([4294967295::BIGINT], octets), lambda a, o: xor(a >> 8, lookup[(xor(a, o) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM spelled, crc),
counts AS (
  SELECT bucket, count(*) FILTER (kind = 'd')::DOUBLE AS s, count(*) FILTER (kind = 't')::DOUBLE AS t FROM features JOIN hashed USING (feature) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM counts, totals),
weights AS (
  SELECT row_no, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM features JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row_no),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT * FROM texts WHERE kind = 'd') LEFT JOIN weights USING (row_no)),
placed AS (
  SELECT *, n_features >= 39 AS eligible, row_number() OVER (ORDER BY n_features >= 39 DESC, score DESC, doc_id NULLS LAST, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM placed WHERE eligible) // 100 THEN place END AS rank
FROM placed
"""

# The table of CRC-32 (reflected polynomial 0xEDB88320), eight shifts per byte.
CRC_STEPS = "\n".join(
    f"t{i} AS (SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM t{i - 1})," for i in range(1, 9)
)
OP2, OP13 = (text.replace("CRC_STEPS", CRC_STEPS) for text in (OP2, OP13))

# From every pair of rows in `pairs(a, b)` (both directions) to the smallest id that links lead to.
REACH = """reach(id, other) AS (SELECT a, b FROM pairs UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON p.a = r.other),
roots AS (SELECT id, least(id, min(other)) AS root FROM reach GROUP BY id),
counts AS (SELECT a AS id, count(*) AS n_links FROM pairs GROUP BY a)"""

OP3 = f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.98),
{REACH}
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.id = vec_id LEFT JOIN roots ON roots.id = vec_id
"""

OP8 = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' ')))) AS grams
  FROM split WHERE len(words) > 0),
grams AS (SELECT doc_id, len(grams) AS size, unnest(grams) AS gram FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.size, y.size HAVING 5 * count(*) >= 4 * (x.size + y.size - count(*))),
{REACH},
alike AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY grams) AS class_id FROM sets)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(root, doc_id) AS component_id
FROM documents LEFT JOIN alike USING (doc_id) LEFT JOIN counts ON counts.id = doc_id LEFT JOIN roots ON roots.id = doc_id
"""

SQL = {
    "op2_quality_rules": OP2, "op2_quality_rules_full": OP2, "op3_hnsw_dedup": OP3, "op4_url_markov": OP4, "op7_source_mix": OP7, "op8_ngram_jaccard": OP8,
    "op10_line_dedup": OP10, "op11_hard_negatives": OP11, "op13_importance_resampling": OP13,
}
