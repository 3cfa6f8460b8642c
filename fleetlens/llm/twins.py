"""SQL twins of the queries that DuckDB can express."""

OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS found FROM sets UNION SELECT r.doc_id, p.y FROM reach r JOIN pairs p ON p.x = r.found
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.found) AS component_id
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""

OP4 = r"""
WITH parts AS (
  SELECT CAST(page_id AS BIGINT) AS page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), known AS (
  SELECT doc_id AS page_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id
), hosts AS (
  SELECT host, count(bad) AS n, count(*) FILTER (bad) AS b FROM parts LEFT JOIN known USING (page_id) GROUP BY host
), named AS (
  SELECT host, n, b, regexp_matches(host, '^([0-9.]*|\[.*)(:[0-9]*)?$') AS own,
         regexp_matches(host, '^.+\.(ac|co|com|edu|gov|net|or|org)\.[^.]{2}$') AS country FROM hosts
), levels AS (
  SELECT host, n, b,
    CASE WHEN own THEN host WHEN country THEN regexp_extract(host, '[^.]*\.[^.]*$') ELSE regexp_extract(host, '[^.]*$') END AS suffix,
    CASE WHEN own THEN host WHEN country THEN regexp_extract(host, '([^.]*\.){0,2}[^.]*$')
         ELSE regexp_extract(host, '([^.]*\.)?[^.]*$') END AS domain
  FROM named
), total AS (SELECT (sum(b) + 0.5e0) / (sum(n) + 1e0) AS rate FROM levels
), s0 AS (SELECT suffix, sum(n) AS n, sum(b) AS b, any_value(rate) AS prior FROM levels, total GROUP BY suffix
), s1 AS (SELECT coalesce((sum((b - n * prior) * (b - n * prior)) - sum(n * prior * (1 - prior)))
                          / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.5e0) AS rho FROM s0
), s2 AS (SELECT suffix, (b + k * prior) / (n + k) AS rate FROM s0, (SELECT 1 / least(0.5e0, greatest(0.001e0, rho)) - 1 AS k FROM s1)
), d0 AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b, any_value(rate) AS prior FROM levels JOIN s2 USING (suffix) GROUP BY domain, suffix
), d1 AS (SELECT coalesce((sum((b - n * prior) * (b - n * prior)) - sum(n * prior * (1 - prior)))
                          / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.5e0) AS rho FROM d0
), d2 AS (SELECT domain, suffix, (b + k * prior) / (n + k) AS rate FROM d0, (SELECT 1 / least(0.5e0, greatest(0.001e0, rho)) - 1 AS k FROM d1)
), h0 AS (SELECT host, n, b, rate AS prior FROM levels JOIN d2 USING (domain, suffix)
), h1 AS (SELECT coalesce((sum((b - n * prior) * (b - n * prior)) - sum(n * prior * (1 - prior)))
                          / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.5e0) AS rho FROM h0
), h2 AS (SELECT host, n, b, k, (b + k * prior) / (n + k) AS rate FROM h0, (SELECT 1 / least(0.5e0, greatest(0.001e0, rho)) - 1 AS k FROM h1)
), h3 AS (SELECT host, n, b, greatest(0e0, rate - 1.645e0 * sqrt(rate * (1 - rate) / (n + k + 1))) AS low FROM h2
), ruled AS (
  SELECT page_id, host, path, n, b, low,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts JOIN h3 USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN low > 0.25e0 THEN 'block' ELSE 'allow' END AS verdict,
       n AS n_labelled, b AS n_bad, round(low, 6) AS bad_rate_low
FROM ruled
"""

OP5 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), rows AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text DESC) AS r, count(*) OVER () AS n FROM docs
), both_texts AS (
  SELECT a.r, a.n, a.doc_id, a.text,
         left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
  FROM rows a JOIN rows b ON b.r = a.r % a.n + 1
), sides AS (
  SELECT r, 0 AS side, text FROM both_texts UNION ALL SELECT r, 1, edited FROM both_texts
), terms AS (
  SELECT r, side, unnest(list_distinct(string_split_regex(lower(text), '[\x20\x09-\x0D]+'))) AS term FROM sides
), lexicon AS (
  SELECT term FROM terms WHERE side = 0 AND term <> '' GROUP BY term
  HAVING ln((SELECT greatest(count(*), 2) FROM docs)::DOUBLE / count(*)) / ln((SELECT greatest(count(*), 2) FROM docs)::DOUBLE)
         BETWEEN 0.2e0 AND 0.9e0
), parts AS (
  SELECT term, s FROM lexicon, range(16) AS t(s) WHERE substring(md5(term), 2 * s + 1, 2) IN ('00', '01', '02', '03')
), hashes AS (
  SELECT r, side, s, left(md5(string_agg(term, ' ' ORDER BY term COLLATE "binary")), 8) AS hash
  FROM terms JOIN parts USING (term) GROUP BY r, side, s
), prints AS (
  SELECT r, side, string_agg(coalesce(hash, ''), '-' ORDER BY s) AS print, count(hash) AS found
  FROM (SELECT r, side, s FROM sides, range(16) AS t(s)) LEFT JOIN hashes USING (r, side, s) GROUP BY r, side
), done AS (
  SELECT r, side, CASE WHEN found = 0 THEN md5(text) ELSE print END AS print FROM prints JOIN sides USING (r, side)
), three AS (
  SELECT t.r, t.doc_id, length(t.text) AS n_chars, sha256(t.edited) AS edited_sha256,
         a.print AS fingerprint, b.print AS edited_fingerprint, c.print AS next_print
  FROM both_texts t JOIN done a ON a.r = t.r AND a.side = 0 JOIN done b ON b.r = t.r AND b.side = 1
  JOIN done c ON c.r = t.r % t.n + 1 AND c.side = 0
), zipped AS (
  SELECT *, list_zip(string_split(fingerprint, '-'), string_split(edited_fingerprint, '-')) AS e,
         list_zip(string_split(fingerprint, '-'), string_split(next_print, '-')) AS x FROM three
), counted AS (
  SELECT *, len(list_filter(e, lambda p: p[1] <> '' OR p[2] <> '')) AS eu, len(list_filter(e, lambda p: p[1] <> '' AND p[1] = p[2])) AS es,
         len(list_filter(x, lambda p: p[1] <> '' OR p[2] <> '')) AS xu, len(list_filter(x, lambda p: p[1] <> '' AND p[1] = p[2])) AS xs FROM zipped
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN 1e0 WHEN contains(fingerprint, '-') AND contains(edited_fingerprint, '-')
       THEN es / eu::DOUBLE ELSE 0e0 END AS near_edited,
  CASE WHEN fingerprint = next_print THEN 1e0 WHEN contains(fingerprint, '-') AND contains(next_print, '-')
       THEN xs / xu::DOUBLE ELSE 0e0 END AS near_next
FROM counted
"""

OP12 = r"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS xs
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), items AS MATERIALIZED (
  SELECT row, (i - 1) // (len(xs) // 16) AS part, (i - 1) % (len(xs) // 16) AS pos, xs[i] AS x
  FROM kept, range(1, len(xs) + 1) AS t(i)
), book0 AS MATERIALIZED (
  SELECT part, row AS entry, pos, x FROM items WHERE row < 64
), near0 AS MATERIALIZED (
  SELECT row, part, entry, dist FROM (
    SELECT row, part, entry, dist, row_number() OVER (PARTITION BY row, part ORDER BY dist, entry) AS r
    FROM (SELECT i.row, part, c.entry, sum((i.x - c.x) * (i.x - c.x)) AS dist
          FROM items i JOIN book0 c USING (part, pos) GROUP BY i.row, part, c.entry)) WHERE r = 1
), sums0 AS (
  SELECT part, n.entry, pos, CAST(sum(i.x) AS BIGINT) AS s, count(*) AS n
  FROM items i JOIN near0 n USING (row, part) GROUP BY part, n.entry, pos
), book1 AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE (s - (s % n + n) % n) // n END AS x
  FROM book0 LEFT JOIN sums0 USING (part, entry, pos)
), near1 AS MATERIALIZED (
  SELECT row, part, entry, dist FROM (
    SELECT row, part, entry, dist, row_number() OVER (PARTITION BY row, part ORDER BY dist, entry) AS r
    FROM (SELECT i.row, part, c.entry, sum((i.x - c.x) * (i.x - c.x)) AS dist
          FROM items i JOIN book1 c USING (part, pos) GROUP BY i.row, part, c.entry)) WHERE r = 1
), sums1 AS (
  SELECT part, n.entry, pos, CAST(sum(i.x) AS BIGINT) AS s, count(*) AS n
  FROM items i JOIN near1 n USING (row, part) GROUP BY part, n.entry, pos
), book2 AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE (s - (s % n + n) % n) // n END AS x
  FROM book1 LEFT JOIN sums1 USING (part, entry, pos)
), near2 AS MATERIALIZED (
  SELECT row, part, entry, dist FROM (
    SELECT row, part, entry, dist, row_number() OVER (PARTITION BY row, part ORDER BY dist, entry) AS r
    FROM (SELECT i.row, part, c.entry, sum((i.x - c.x) * (i.x - c.x)) AS dist
          FROM items i JOIN book2 c USING (part, pos) GROUP BY i.row, part, c.entry)) WHERE r = 1
), coded AS (
  SELECT row, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM near2 GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (row)
"""

OP13 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copied
  FROM documents
), failing AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN copied THEN 16 ELSE 0 END AS failed
  FROM texts
), known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), cells AS MATERIALIZED (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing LEFT JOIN known USING (doc_id) GROUP BY part, failed
), letters AS (
  SELECT substr('ABCDE', i, 1) AS letter, 1 << (i - 1) AS bit FROM (SELECT CAST(i AS INTEGER) AS i FROM range(1, 6) AS t(i))
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
  FROM orders, range(1, 6) AS t(step)
), counted AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (failed & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (failed & before = 0 AND failed & bit > 0), 0) AS removed,
         coalesce(sum(n) FILTER (failed & before > 0 AND failed & bit > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (failed = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (failed & before = 0 AND failed & bit > 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (failed & before = 0 AND failed & bit > 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""

ORACLES = {
    "op3_ngram_jaccard": OP3,
    "op4_url_reputation": OP4,
    "op5_imatch": OP5,
    "op12_limb_codes": OP12,
    "op13_filter_paths": OP13,
}
