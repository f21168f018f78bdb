"""The queries that SQL can express, restated in DuckDB's SQL from their definitions."""

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

WARC = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
    SELECT page_id, n, h, max(page_id) OVER (PARTITION BY h, n) AS original, CAST(unhex(h) AS BIT)::VARCHAR AS b FROM p
)
SELECT page_id, n AS payload_bytes,
    list_reduce(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * CAST(substr(b, i + 1, 1) AS INT) + 8 * CAST(substr(b, i + 2, 1) AS INT) + 4 * CAST(substr(b, i + 3, 1) AS INT)
          + 2 * CAST(substr(b, i + 4, 1) AS INT) + CAST(substr(b, i + 5, 1) AS INT), 1)), lambda x, y: x || y) AS payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to
FROM bits
"""

LINES = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, """ + WORDS.format(text="text") + r""" AS w FROM documents
), c AS (
    SELECT doc_id, w, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, string_split(t, chr(10)) AS every_line FROM d
), windows AS (
    SELECT doc_id, unnest(range(1, n_words - 1)) AS i, w FROM c WHERE n_words >= 3
), counted AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows
), covered AS (
    SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM counted WHERE n > 1) GROUP BY doc_id
), l AS (
    SELECT doc_id, line, regexp_replace(line, '^[\x20\x09\x0B-\x0D]+|[\x20\x09\x0B-\x0D]+$', '', 'g') AS bare FROM (SELECT doc_id, unnest(every_line) AS line FROM c)
), m AS (
    SELECT doc_id, line, bare, length(bare) AS size, regexp_extract_all(bare, '[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+') AS w FROM l
), judged AS (
    SELECT doc_id, size, size > 0 AND (
        (len(w) >= 3 AND length(regexp_replace(bare, '[^|»›>•]', '', 'g')) >= 0.4::DOUBLE * len(w))
        OR (len(w) <= 15 AND regexp_matches(bare, '\b(cookies?|privacy policy|terms of (use|service)|all rights reserved|javascript|subscribe|sign (in|up)|log ?in|lorem ipsum|licen[sc]ed under|copyright|click here|read more)\b', 'i'))
        OR length(regexp_replace(bare, '[^#*$%&|<>]', '', 'g')) > 0.1::DOUBLE * size
        OR (len(w) >= 5 AND bare = upper(bare) AND bare <> lower(bare))
        OR (len(w) >= 8 AND 3 * len(list_distinct(w)) <= len(w))
        OR (len(w) >= 6 AND NOT regexp_matches(bare, '[.!?:;…"'')”»。！？]$'))) AS fails FROM m
), losses AS (
    SELECT doc_id, CASE WHEN sum(size) > 0 THEN CAST(coalesce(sum(size) FILTER (fails), 0) AS DOUBLE) / CAST(sum(size) AS DOUBLE) ELSE 0.0::DOUBLE END AS lost FROM judged GROUP BY 1
), base AS (
    SELECT doc_id, n_words, word_chars, n_symbols, list_filter(every_line, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.4::DOUBLE AS kept, lost
FROM base JOIN losses USING (doc_id)
"""

KNN = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score FROM v AS q JOIN v AS x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

JACCARD = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, """ + WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + r""" AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM d
), e AS (
    SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT doc_id, doc_id AS root FROM s UNION SELECT links.b AS doc_id, reach.root FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.root < links.b
)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""

CODES = """
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT r, vec_id, label, p, len(v) // 8 AS w, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) AS t(p)
), b0 AS MATERIALIZED (
    SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 16
)""" + "".join(
    f""", a{k} AS MATERIALIZED (
    SELECT r, parts.p, any_value(x) AS x, any_value(w) AS w, min(16 * CAST(list_sum(list_transform(range(1, w + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) + e) AS m FROM parts JOIN b{k} USING (p) GROUP BY r, parts.p
)"""
    + ("" if k == 6 else f""", s{k} AS (
    SELECT p, m % 16 AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, w + 1)) AS i FROM a{k}) GROUP BY 1, 2, 3
), b{k + 1} AS MATERIALIZED (
    SELECT p, e, coalesce(f.c, b{k}.c) AS c FROM b{k} LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY 1, 2) AS f USING (p, e)
)""")
    for k in range(7)
) + """, coded AS (
    SELECT vec_id, any_value(label) AS label, string_agg('0' || substr('0123456789abcdef', CAST(m % 16 AS INT) + 1, 1), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a6 JOIN (SELECT r, p, vec_id, label FROM parts) USING (r, p) GROUP BY r, vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b6) AS codebooks_sha256
FROM coded
"""

TURNS = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hashed AS (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda z, j: xor(z >> 1, 3988292384 * (z & 1))))) % 20 AS what FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
    FROM hashed, range(2) AS t(copy) WHERE what <> 0 AND (copy = 0 OR what = 3)
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char, left(role, 1) AS initial FROM damaged
), faulty AS (
    SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM numbered
), told AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1
), ways AS (
    -- w: for each grammar state (nothing, after s, after u, after a) the cheapest way to the end as (cost, edits, repaired lines)
    SELECT conv_id, n AS i, [{'c': 0, 's': '', 't': ''}, {'c': 6, 's': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}, {'c': 3, 's': 'I', 't': 'assistant:' || chr(10)}, {'c': 0, 's': '', 't': ''}] AS w FROM told
    UNION ALL
    SELECT conv_id, i - 1, list_transform([1, 2, 3, 4], lambda q: list_min([a[q], {'c': 3 + b[[3, 3, 4, 3][q]].c, 's': 'I' || b[[3, 3, 4, 3][q]].s, 't': CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || chr(10) || b[[3, 3, 4, 3][q]].t}])) AS w
    FROM (
        SELECT conv_id, i, a, list_transform([1, 2, 3, 4], lambda q: list_min([a[q], {'c': 3 + a[[3, 3, 4, 3][q]].c, 's': 'I' || a[[3, 3, 4, 3][q]].s, 't': CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || chr(10) || a[[3, 3, 4, 3][q]].t}])) AS b
        FROM (
            SELECT ways.conv_id, ways.i, list_transform([1, 2, 3, 4], lambda q: list_min([
                {'c': 4 + w[q].c, 's': 'D' || w[q].s, 't': w[q].t},
                CASE WHEN fault IN ('', 'truncated') AND ((initial = 's' AND q = 1) OR (initial = 'u' AND q <> 3) OR (initial = 'a' AND q = 3)) THEN
                    {'c': more + w[CASE WHEN initial = 's' THEN 2 ELSE [3, 3, 4, 3][q] END].c, 's': 'K' || w[CASE WHEN initial = 's' THEN 2 ELSE [3, 3, 4, 3][q] END].s, 't': role || ':' || text || chr(10) || w[CASE WHEN initial = 's' THEN 2 ELSE [3, 3, 4, 3][q] END].t} END,
                CASE WHEN fault IN ('', 'truncated') THEN
                    {'c': 3 + more + w[[3, 3, 4, 3][q]].c, 's': 'R' || w[[3, 3, 4, 3][q]].s, 't': CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || text || chr(10) || w[[3, 3, 4, 3][q]].t} END])) AS a
            FROM ways JOIN (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM faulty) AS f ON f.conv_id IS NOT DISTINCT FROM ways.conv_id AND f.i = ways.i
        )
    )
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(w[1].c, 0) AS BIGINT) AS cost, coalesce(w[1].s, '') AS audit, sha256(coalesce(left(w[1].t, length(w[1].t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ways ON ways.conv_id IS NOT DISTINCT FROM c.conv_id AND ways.i = 0
"""

ORACLE_SQL = {"op11_turn_repair": TURNS, "op12_vector_codes": CODES, "op4_warc": WARC, "op7_line_rules": LINES, "op8_knn_join": KNN, "op10_ngram_join": JACCARD}
