"""SQL twins of the corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

OP2 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win SEMI JOIN twice USING (s)),
runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
spans AS (SELECT doc_id, r, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY doc_id, r),
edge AS (SELECT doc_id, r, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY r), 0) AS after FROM spans),
part AS (SELECT doc_id, string_agg(substr(h, 2 * after + 1, 2 * (s - after)), '' ORDER BY r) || substr(any_value(h), 2 * max(e) + 1) AS kept, sum(e - s) AS n, count(*) AS k FROM edge JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN part ON d.doc_id = part.doc_id
"""

OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, range(20) t(j)),
words AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id
"""

OP10 = r"""
WITH dw AS (SELECT doc_id, i, w[i] AS x, len(w) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7F])+') AS w FROM documents))),
iw AS (SELECT item_id, i, w[i] AS x, len(w) AS n FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7F])+') AS w FROM benchmark))),
same AS (SELECT doc_id, item_id, dw.i - iw.i AS diag, dw.i - 1 AS p, greatest(0, dw.i - iw.i) AS low, least(dw.n, dw.i - iw.i + iw.n) AS high, least(13, iw.n) AS need FROM dw JOIN iw ON dw.x = iw.x),
diag AS (SELECT doc_id, item_id, diag, any_value(low) AS low, any_value(high) AS high, any_value(need) AS need, list(p) AS ps FROM same GROUP BY doc_id, item_id, diag
  HAVING count(*) >= ceil(0.8 * any_value(need)) AND any_value(high) - any_value(low) >= any_value(need)),
starts AS (SELECT *, unnest(range(low, high - need + 1)) AS s FROM diag),
good AS (SELECT doc_id, item_id, diag, ps, min(s) AS a, max(s) + any_value(need) AS b FROM starts WHERE len(list_filter(ps, lambda p: p >= s AND p < s + need)) >= ceil(0.8 * need) GROUP BY doc_id, item_id, diag, ps),
sized AS (SELECT doc_id, item_id, a AS first_word, b - a AS n_words, len(list_filter(ps, lambda p: p >= a AND p < b)) AS n_equal FROM good)
SELECT doc_id, item_id, CAST(first_word AS BIGINT) AS first_word, CAST(n_words AS BIGINT) AS n_words, CAST(n_equal AS BIGINT) AS n_equal FROM sized
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, n_words DESC, first_word) = 1
"""

OP4 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw, r FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, rhost || rpath AS rule, verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""

OP12 = r"""
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
