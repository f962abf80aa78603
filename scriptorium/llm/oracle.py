"""SQL of the llm queries that SQL can express."""

from __future__ import annotations

from .quality_rules import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))

QUALITY_RULES = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
tokens AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split),
windows AS (SELECT doc_id, pos, word, lag(word) OVER w AS before, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w || ' ' || lead(word, 4) OVER w || ' ' || lead(word, 5) OVER w || ' ' || lead(word, 6) OVER w || ' ' || lead(word, 7) OVER w AS win FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows WHERE win IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, pos + i AS p FROM again, (SELECT unnest(range(0, 8)) AS i)) GROUP BY doc_id),
stops AS (SELECT doc_id, count(*) FILTER (translate(lower(word), '.,;:!?', '') IN ({_STOPS})) AS n_stop, count(*) FILTER (word = before) AS n_adjacent FROM windows GROUP BY doc_id),
counts AS (SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
 CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_stop, 0) AS n_stop, coalesce(n_adjacent, 0) AS n_adjacent
 FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id LEFT JOIN stops p ON s.doc_id = p.doc_id),
rules AS (SELECT *, greatest(n_words, 1) AS least_one FROM counts),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', CASE WHEN n_words < 20 THEN 'few_words' END, CASE WHEN word_chars / least_one < 2 OR word_chars / least_one > 20 THEN 'mean_word_length' END,
 CASE WHEN n_symbols / least_one > 0.5 THEN 'symbols_per_word' END, CASE WHEN n_repeat_words / least_one > 0.3 THEN 'repeated_windows' END, CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.5 THEN 'duplicate_lines' END,
 CASE WHEN n_adjacent / least_one > 0.3 THEN 'adjacent_repeats' END, CASE WHEN (n_stop + 1) / least_one < 0.005 THEN 'stop_words' END) AS failed FROM rules)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM judged
"""

#: The checksum of the polynomial 0xEDB88320 over the bytes of a string, from a table made by its rule.
SPELLING = r"""
WITH RECURSIVE steps AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7),
bytes AS (SELECT *, hex(encode(id || ':' || run)) AS b FROM runs),
digests AS (SELECT run, xor(list_reduce(list_transform(range(0, length(b) // 2), lambda i: CAST('0x' || substr(b, 2 * i + 1, 2) AS BIGINT)), lambda c, x: xor(c >> 8, crc.t[CAST(xor(c & 255, x) AS INT) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM digests),
words AS (SELECT word, count(*) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
spots AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM spots a JOIN spots b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM spots a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM spots a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS form_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n, CASE WHEN b.form_n >= 10 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = b.form_n) END AS form FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, f.form_n, c.root FROM forms f JOIN (SELECT c.word, c.root FROM chain c JOIN forms e ON e.word = c.root WHERE e.form IS NULL) c ON c.word = f.word
"""

FEATURE_JOIN = """
WITH parts AS (SELECT *, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
versions AS (SELECT source, doc_id, n_chars, lang, CAST('0x' || h[1:8] AS BIGINT) % 200000 AS event, CAST('0x' || h[9:16] AS BIGINT) % 1200 - 60 AS late, CAST('0x' || h[17:24] AS BIGINT) % 900 AS kept FROM parts),
asks AS (SELECT row_number() OVER () AS ask, l.doc_id, CAST('0x' || sha256(CAST(l.doc_id AS VARCHAR))[25:32] AS BIGINT) % 200000 AS t, d.source FROM labels l LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) d ON d.doc_id = l.doc_id),
won AS (SELECT ask, max({'event': event, 'arrival': event + late, 'doc_id': v.doc_id, 'n_chars': n_chars, 'lang': lang}) AS v FROM asks a JOIN versions v ON v.source = a.source AND event <= t AND event + late <= t AND t < event + kept GROUP BY ask),
judged AS (SELECT a.doc_id, t, v.doc_id AS version_id, t - v.event AS age, CASE WHEN v IS NULL THEN 'none' WHEN t - v.event > 20 THEN 'stale' ELSE 'fresh' END AS status, v FROM asks a LEFT JOIN won w ON a.ask = w.ask)
SELECT doc_id, t, version_id, age, status, CASE WHEN status = 'fresh' THEN v.n_chars END AS n_chars, CASE WHEN status = 'fresh' THEN v.lang END AS lang FROM judged
"""
