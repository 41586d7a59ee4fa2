"""DuckDB SQL for those queries of this subpackage that SQL can express."""

_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
shown AS (
  SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>') OR contains(text, '\\') OR text LIKE '%\'
      THEN replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') ELSE text END AS body FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

_FIXITY = r"""
WITH replicas AS (
  SELECT 0 AS r, page_id, url, html FROM pages
  UNION ALL
  SELECT 1, page_id, url, CASE WHEN page_id % 97 = 13 THEN '#' || substr(html, 2) WHEN page_id % 211 = 7 THEN substr(html, 1, greatest(length(html) - 9, 0)) ELSE html END FROM pages WHERE page_id % 389 <> 101
  UNION ALL
  SELECT 1, page_id, url || '?again', html FROM pages WHERE page_id % 503 = 11),
shown AS (
  SELECT r, page_id, url, html, CAST(floor(page_id / 1000.0) AS BIGINT) AS file, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || html AS block FROM replicas),
rows AS (
  SELECT r, file, page_id, url, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:sha256:' || sha256(page_id || ' ' || url) || '>' || chr(13) || chr(10)
    || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'X-Page-ID: ' || page_id || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || sha256(html) || chr(13) || chr(10)
    || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || strlen(block) || chr(13) || chr(10) || chr(13) || chr(10) || block || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM shown),
placed AS (
  SELECT r, file, row_number() OVER w - 1 AS seq, page_id, url, strlen(record) AS length,
    CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY r, file ORDER BY page_id, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_byte, sha256(record) AS hash
  FROM rows WINDOW w AS (PARTITION BY r, file ORDER BY page_id, sha256(record))),
nth AS (SELECT *, row_number() OVER (PARTITION BY r, page_id, url ORDER BY hash) AS k FROM placed),
a AS (SELECT * FROM nth WHERE r = 0), b AS (SELECT * FROM nth WHERE r = 1)
SELECT coalesce(a.file, b.file) AS file, a.seq, coalesce(a.page_id, b.page_id) AS page_id, a.first_byte, a.length,
  CASE WHEN b.hash IS NULL THEN 'lost' WHEN a.hash IS NULL THEN 'added' ELSE 'changed' END AS state, a.hash AS expected_sha256, b.hash AS found_sha256
FROM a FULL JOIN b ON a.page_id = b.page_id AND a.url = b.url AND a.k = b.k WHERE a.hash IS DISTINCT FROM b.hash
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS key FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM items),
windows AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS key FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, w.k, i, item_id FROM windows w JOIN items t ON w.key = t.key AND w.k = t.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(f.l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
_REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
owners AS (SELECT key, min(doc_id) AS owner FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN owners USING (key) WHERE owner < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON r = a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

_TRIE = r"""
WITH t AS (SELECT conv_id, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS k FROM conversations WHERE conv_id IS NOT NULL),
counts AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
bits AS (SELECT conv_id, n, list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST([ascii(c), 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), CAST(4294967295 AS BIGINT)) AS b FROM counts),
heads AS (SELECT b.conv_id, xor(b, 4294967295) % 4 AS h, b.conv_id - b.conv_id % 20 AS source, coalesce(c.n, 0) AS n_source FROM bits b LEFT JOIN counts c ON c.conv_id = b.conv_id - b.conv_id % 20),
rebuilt AS (
  SELECT h.conv_id, t.k AS d, said, words FROM heads h JOIN t ON t.conv_id = h.source AND t.k <= h.h
  UNION ALL SELECT h.conv_id, least(h.h, h.n_source) + t.k - h.h, said, words FROM heads h JOIN t ON t.conv_id = h.conv_id AND t.k > h.h),
paths AS (SELECT conv_id, list(strlen(said) || ':' || said ORDER BY d) AS p, list(words ORDER BY d) AS w FROM rebuilt GROUP BY 1),
whole AS (SELECT conv_id, coalesce(p, CAST([] AS VARCHAR[])) AS p, coalesce(w, CAST([] AS BIGINT[])) AS w FROM heads LEFT JOIN paths USING (conv_id)),
members AS (SELECT conv_id, d, len(p) = d AS here, sha256(array_to_string(p[1:d], '')) AS key, sha256(array_to_string(p[1:d - 1], '')) AS up, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS words
  FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM whole)),
nodes AS (SELECT key, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (here), '')) AS ends FROM members GROUP BY 1, 2),
kids AS (SELECT up AS key, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
below AS (SELECT m.key, m.d, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids k ON k.key = n.key AND k.d = n.d JOIN members m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.up AND p.d = n.d - 1 LEFT JOIN kids k ON k.key = n.key AND k.d = n.d JOIN below b ON b.key = n.key AND b.d = n.d
"""
_INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u FROM d),
drawn AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""
_COPIES = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
best AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM best
"""

ORACLES: dict[str, str] = {"op2_decontaminate": _LEAKS, "op5_repeats": _REPEATS, "op6_minhash": _NEAR, "op8_fixity": _FIXITY, "op9_chat": _CHAT, "op11_prefix_trie": _TRIE, "op12_infill": _INFILL, "op13_extendible": _COPIES}
