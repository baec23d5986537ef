"""What some of the registered queries return, said in DuckDB's SQL. Nothing here is shared with the operators."""

from __future__ import annotations

CHAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS t(k)
), shown AS (
  SELECT *, '<|im_start|>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS formatted FROM rows_
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

HAMMING = """
WITH codes AS (SELECT vec_id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), '') AS BIT) AS code FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance FROM codes q, codes c WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

ARCHIVES = """
WITH paid AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
-- five hexadecimal digits are four letters
lettered AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT)) AS fives FROM paid),
of AS (SELECT html, max(page_id) AS last FROM paid GROUP BY 1)
SELECT page_id, octet_length(encode(l.html)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((fives[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM lettered l JOIN of USING (html)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM worded
), named AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(0))) AS class, s FROM sets),
classes AS (SELECT class, any_value(n) AS n, any_value(s) AS s FROM named WHERE n > 0 GROUP BY 1),
tokens AS (SELECT class, n, unnest(s) AS token FROM classes),
links AS (
  SELECT a.class AS a, b.class AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.class < b.class
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT class AS a, class AS b FROM classes UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b),
first AS (SELECT r.a AS class, min(n.doc_id) AS component_id FROM reached r JOIN named n ON n.class = r.b AND n.n > 0 GROUP BY 1)
SELECT d.doc_id, d.n AS n_shingles, coalesce(f.component_id, d.doc_id) AS component_id FROM named d LEFT JOIN first f ON f.class = d.class AND d.n > 0
"""

REPEATS = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT r, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS k FROM (SELECT r, h, unnest(range(0, greatest(0, CAST(length(h) // 2 AS BIGINT) - 199))) AS i FROM texts)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM strings) WHERE n > 1),
begun AS (SELECT r, i, CASE WHEN i > lag(i) OVER w + 200 THEN 1 ELSE 0 END AS new FROM repeated WINDOW w AS (PARTITION BY r ORDER BY i)),
numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM begun),
runs AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY r, run),
pieces AS (SELECT runs.r, lo, hi, substr(h, CAST(2 * lag(hi, 1, 0) OVER w + 1 AS BIGINT), CAST(2 * (lo - lag(hi, 1, 0) OVER w) AS BIGINT)) AS piece FROM runs JOIN texts USING (r) WINDOW w AS (PARTITION BY runs.r ORDER BY lo)),
cut AS (SELECT r, sum(hi - lo) AS gone, count(*) AS n, max(hi) AS last, string_agg(piece, '' ORDER BY lo) AS kept FROM pieces GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)
"""

RESAMPLED = r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), byte_crcs AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
worded AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT kind, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM worded
), spelled AS (
  SELECT w, list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM (SELECT DISTINCT w FROM words)
), bucket_of AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM spelled, byte_crcs
), placed AS (SELECT kind, r, bucket FROM words JOIN bucket_of USING (w)),
sums AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM placed GROUP BY 1),
sizes AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS all_s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS all_t FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1.0::DOUBLE) * (all_s + 10000)) / ((s + 1.0::DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain FROM sums, sizes),
weighed AS (SELECT r, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY 1),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM worded LEFT JOIN weighed USING (r) WHERE kind = 'd'
), eligible AS (SELECT *, n_features >= 20 AS enough FROM scored),
placed_by AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY enough) AS many FROM eligible)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 10 * many // 100 THEN place END AS rank FROM placed_by
"""

MIDDLES = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
lined AS (
  SELECT *, string_split(text, chr(10)) AS lines, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS n,
    list_transform(range(4), lambda k: CAST('0x' || substr(d, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM hashed
), cut AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 AS plain FROM lined),
placed AS (
  SELECT *, least(length(text), CAST(coalesce(list_sum(list_transform(lines[1:a], lambda x: length(x) + 1)), 0) AS BIGINT)) AS p, least(length(text), CAST(coalesce(list_sum(list_transform(lines[1:b], lambda x: length(x) + 1)), 0) AS BIGINT)) AS q FROM cut
), parts AS (SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, q - p) AS middle, substr(text, q + 1) AS suffix, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN NOT plain THEN p END AS prefix_chars, CASE WHEN NOT plain THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
