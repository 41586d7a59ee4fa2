"""DuckDB SQL of the queries in `service_queries`, over the same tables."""

from __future__ import annotations

from .oracles import _BASE, _BM25, _DOCS, _PAIRS, _TS, _fused, _hybrid, _semantic, _tokens
from .plans.engine import GREETING
from .queries import AS_OF
from .service_queries import STAMP

_N = "chr(10)"
_FILES = """names AS (SELECT *, CASE WHEN doc_id % 13 = 4 THEN '~$' ELSE '' END || 'doc_' || doc_id || CASE WHEN doc_id % 7 = 1 THEN '.pdf' WHEN doc_id % 7 = 2 THEN '.EXE' WHEN doc_id % 7 = 3 THEN ''
    WHEN doc_id % 11 = 5 THEN '.20240101_101010.bak.txt' ELSE '.TXT' END AS file_name, CASE WHEN doc_id % 17 = 6 THEN 62914560 ELSE CAST(strlen(text) AS BIGINT) END AS file_size FROM documents),
files AS (SELECT *, lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) AS file_type, '/scan/' || file_name AS file_path FROM names),
checked AS (SELECT *, CASE WHEN file_name LIKE '~$%' THEN 'lock file' WHEN contains(file_name, '.bak.') THEN 'backup file' WHEN file_type NOT IN ('pdf', 'docx', 'txt', 'xlsx', 'xls', 'pptx') THEN 'unsupported type'
    WHEN file_size > 52428800 THEN 'too large' WHEN file_size = 0 THEN 'empty' END AS reject_reason FROM files)""".replace("\\\\", "\\")
_SCAN = """scan AS (SELECT id, CASE WHEN id % 17 = 2 THEN file_path || '.new.txt' ELSE file_path END AS file_path, CASE WHEN id % 7 = 3 THEN sha256(text || '!') ELSE file_hash END AS file_hash,
  CASE WHEN id % 5 = 1 THEN last_modified + INTERVAL 1 DAY ELSE last_modified END AS last_modified, text FROM docs WHERE id % 13 <> 5), good AS (SELECT * FROM scan WHERE id % 19 <> 0)"""
_TURNS = "turns AS (SELECT 'c' || conv_id || '.txt' AS file_path, turn AS chunk_id, coalesce(text, '') AS text, 'c' || conv_id || '.txt:' || turn AS chunk_key FROM conversations)"
_LINES = r"lines AS (SELECT doc_id, replace(regexp_replace(text, '[^\x20-\x7E]', ' ', 'g'), '. ', chr(10)) AS t FROM documents)"
_FLAT = r"flat AS (SELECT *, regexp_replace(text, '[\x09-\x0D ]+', ' ', 'g') AS t FROM documents)"
_BLOCKS = f"string_agg(text, {_N} ORDER BY text)"


def _cut(text: str, n: int, mark: str = "...") -> str:
    return f"CASE WHEN length({text}) > {n} THEN substr({text}, 1, {n}) || '{mark}' ELSE {text} END"


def _layout() -> str:
    frame = sum(map(len, ("[Page 1]\n[Region: full]\n", "\n[Region: left]\n", "\n[Region: right]\n")))
    right = max(80, min(160, 500 - frame - 200 - 140))
    parts = {"full": ("substr(t, 1, 300)", 200), "left": ("substr(t, 301, 100)", 140), "right": ("substr(t, 401, 50)", right)}
    shown = " || ".join(f"CASE WHEN trim({c}) <> '' THEN {_N} || '[Region: {k}]' || {_N} || rtrim(substr(trim({c}), 1, {n})) ELSE '' END" for k, (c, n) in parts.items())
    return f"WITH {_FLAT} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN rtrim(substr('[Page 1]' || {shown}, 1, 500), E' \\n') ELSE trim(substr(t, 1, 500)) END AS preview FROM flat WHERE length(text) > 600"


_EDITS = """edits AS (SELECT id, CASE WHEN id % 3 = 0 THEN regexp_replace(file_path, 'txt$', 'pdf') ELSE file_path END AS file_path, text, list_filter(['the', 'en'], lambda x: contains(substr(text, 1, 12000), x)) AS finds FROM docs)"""
_PRIORITY = "CAST(least(1000, greatest(0, floor(greatest(0.0, 400 - {age} * 10)) + floor(greatest(0.0, 200 - {size} / 1048576.0 * 2)))) AS INT)"
_SINGLE = f"""{_fused(40)},
named AS (SELECT pos, chunk_key, '/corpus/' || regexp_extract(file_path, '([^/]*)$', 1) AS file_path, text, score FROM found),
hits AS (SELECT * FROM named WHERE contains(lower(file_path), 'src1') OR NOT EXISTS (SELECT 1 FROM named WHERE contains(lower(file_path), 'src1'))),
f AS (SELECT file_path, count(*) AS n, min(pos) AS a FROM hits GROUP BY 1),
p AS (SELECT file_path, n / (SELECT sum(n) FROM f) >= 0.6 OR (SELECT count(*) FROM f) = 1 AS single FROM f ORDER BY n DESC, a LIMIT 1),
texts AS (SELECT '/corpus/' || source AS file_path, string_agg(text, chr(10) ORDER BY doc_id, text) AS block, count(*) AS chunks_found FROM documents GROUP BY 1),
blocks AS (SELECT h.file_path, string_agg(h.text, chr(10) ORDER BY chunk_key, h.text) AS block, round(avg(score), 3) AS relevance_score, count(*) AS chunks_found FROM hits h GROUP BY 1),
chosen AS (SELECT b.file_path, CASE WHEN p.single THEN t.block ELSE b.block END AS block, relevance_score, CASE WHEN p.single THEN t.chunks_found ELSE b.chunks_found END AS chunks_found
  FROM blocks b JOIN texts t USING (file_path), p WHERE NOT p.single OR p.file_path = b.file_path)"""
_SEMANTIC = f"""WITH {_semantic(40)}, found AS (SELECT rank AS pos, s.chunk_key, '/corpus/' || lang || '/' || source AS file_path, base_score AS score FROM sem s JOIN documents d ON s.chunk_key = d.doc_id WHERE trim(text) <> ''),
shape AS (SELECT *, count(*) OVER () > 12 AND (SELECT count(DISTINCT file_path) FROM found) > 1 AS cap, row_number() OVER (PARTITION BY file_path ORDER BY pos) AS k FROM found),
kept AS (SELECT *, row_number() OVER (ORDER BY pos) AS p FROM shape WHERE NOT cap OR k <= 4)"""
_LISTED = "processing_status IN ('indexed', 'metadata_only')"
_BACK = f"back AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position DESC) AS k FROM pairs)"


def _history(keep: int) -> str:
    return f"""WITH {_PAIRS}, {_BACK}, older AS (SELECT session_id, string_agg('User: ' || user_message || chr(10) || 'Assistant: ' || ai_response, chr(10) ORDER BY position) AS t FROM back WHERE k > {keep} GROUP BY 1),
rows AS (SELECT session_id, CAST(-1 AS BIGINT) AS position, 'system' AS role, 'Earlier: ' || right(t, 200) AS content FROM older
  UNION ALL SELECT session_id, CAST(position * 2 AS BIGINT), 'user', user_message FROM back WHERE k <= {keep} AND trim(user_message) <> ''
  UNION ALL SELECT session_id, CAST(position * 2 + 1 AS BIGINT), 'assistant', ai_response FROM back WHERE k <= {keep} AND trim(ai_response) <> '')"""


ORACLES: dict[str, str] = {
    "scan_files": f"WITH {_FILES} SELECT file_path, file_name, file_type, file_size, round(file_size / 1048576.0, 2) AS size_mb, sha256(text) AS file_hash, reject_reason FROM checked",
    "plain_texts": f"WITH {_FILES} SELECT file_path, sha256(CASE WHEN length('file:' || file_path) % 3 = 0 THEN 'é ' || regexp_replace(text, '[^\\x20-\\x7E]', '?', 'g') ELSE text END) AS text_sha256 FROM checked WHERE reject_reason IS NULL AND file_type = 'txt'",
    "scan_resume": f"""{_DOCS}, {_SCAN}, todo AS (SELECT * FROM good g WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.processing_status = 'indexed' AND d.file_path = g.file_path AND abs(epoch_us(d.last_modified) - epoch_us(g.last_modified)) < 2000000))
SELECT coalesce(d.file_path, t.file_path) AS file_path, CASE WHEN t.id IS NULL THEN d.processing_status ELSE 'metadata_only' END AS processing_status, CASE WHEN t.id IS NULL THEN d.chunks_count ELSE 0 END AS chunks_count,
  CASE WHEN t.id IS NULL THEN d.file_hash ELSE t.file_hash END AS file_hash FROM docs d FULL JOIN todo t ON d.file_path = t.file_path""",
    "cached_texts": f"""{_DOCS}, cache AS (SELECT file_hash, min('cached ' || id) AS cached_text, min(last_modified + to_hours(CAST(id % 5 - 2 AS BIGINT))) AS cached_at FROM docs WHERE id % 2 = 0 GROUP BY 1),
d AS (SELECT *, CASE WHEN id % 3 = 0 THEN ' ' ELSE text END AS t FROM docs)
SELECT d.id, sha256(CASE WHEN trim(d.t) = '' THEN coalesce(c.cached_text, d.t) ELSE d.t END) AS text_sha256 FROM d LEFT JOIN cache c ON d.file_hash = c.file_hash AND c.cached_at >= d.last_modified""",
    "scanned_files": "SELECT conv_id AS file_path, avg(length(trim(coalesce(text, '')))) < 120 AS is_scanned FROM conversations GROUP BY 1",
    "page_layout": f"""WITH parts AS (SELECT conv_id, turn // 4 + 1 AS page, turn % 4 AS r, string_agg(text, {_N} ORDER BY text) AS t FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2, 3),
pages AS (SELECT conv_id, page, '[Page ' || page || ']' || {_N} || string_agg('[Region: ' || CASE r WHEN 1 THEN 'left' WHEN 2 THEN 'right' ELSE 'full' END || ']' || {_N} || t, {_N} ORDER BY r) AS t FROM parts GROUP BY 1, 2)
SELECT CAST(conv_id AS VARCHAR) AS file_path, sha256(string_agg(t, {_N} || {_N} ORDER BY page)) AS text_sha256 FROM pages GROUP BY 1""",
    "docx_texts": f"WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS file_path, sha256(t) AS text_sha256, CAST(NULL AS VARCHAR) AS failure FROM lines",
    "pptx_texts": f"""WITH {_LINES}, each AS (SELECT doc_id, unnest(string_split(t, {_N})) AS line, unnest(range(len(string_split(t, {_N})))) AS i, greatest(3, CAST(ceil(len(string_split(t, {_N})) / 200.0) AS INT)) AS c FROM lines),
slides AS (SELECT doc_id, i // c + 1 AS slide, string_agg(trim(line), {_N} ORDER BY i) AS t FROM each WHERE trim(line) <> '' GROUP BY 1, 2),
whole AS (SELECT doc_id, string_agg('Slide ' || slide || ':' || {_N} || t, {_N} || {_N} ORDER BY slide) AS t FROM slides GROUP BY 1)
SELECT CAST(l.doc_id AS VARCHAR) AS file_path, sha256(coalesce(w.t, '')) AS text_sha256, CAST(NULL AS VARCHAR) AS failure FROM lines l LEFT JOIN whole w USING (doc_id)""",
    "xlsx_rows": "SELECT CAST(s_nationkey AS VARCHAR) AS file_path, 'Suppliers & more' AS sheet, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS row_no, s_suppkey || '|' || trim(s_name) AS cells FROM supplier",
    "mark_indexed": f"{_DOCS} SELECT CASE WHEN id % 4 < 2 AND processing_status <> 'error' THEN 'indexed' ELSE processing_status END AS processing_status, count(*) AS documents FROM docs GROUP BY 1",
    "chunk_upsert": f"WITH {_TURNS} SELECT chunk_key, sha256(CASE WHEN chunk_id % 2 = 0 THEN 'new ' || length(text) ELSE text END) AS text_sha256 FROM turns",
    "bm25_without": f"WITH {_BM25.replace('FROM documents)', 'FROM documents WHERE doc_id % 3 <> 0)')} SELECT tok, df, round(idf, 6) AS idf FROM idf",
    "bm25_stats": "SELECT count(*) AS chunks, count(*) > 0 AS built FROM documents",
    "ingest_run": f"""{_DOCS}, {_SCAN}, work AS (SELECT *, id % 23 <> 0 AND regexp_matches(text, '[^\\s\\x0B]') AS readable FROM good g WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.processing_status IN ('indexed', 'error') AND d.file_path = g.file_path AND d.file_hash = g.file_hash))
SELECT coalesce(d.file_path, w.file_path) AS file_path, CASE WHEN w.id IS NULL THEN d.processing_status WHEN w.readable THEN 'indexed' ELSE 'error' END AS processing_status, CASE WHEN w.id IS NULL THEN d.file_hash ELSE w.file_hash END AS file_hash,
  CASE WHEN d.id IS NULL THEN '{AS_OF}' ELSE {_TS.format('d.indexed_at')} END AS indexed_at, CASE WHEN w.id IS NULL THEN d.chunks_count > 0 ELSE w.readable END AS has_chunks FROM docs d FULL JOIN work w ON d.file_path = w.file_path""",
    "ingest_run_twice": "SELECT CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS more_chunks",
    "removed_files": f"""WITH {_TURNS}, kept AS (SELECT * FROM turns WHERE file_path NOT LIKE '%7.txt')
SELECT (SELECT count(*) FROM kept) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT chunk_key, unnest({_tokens('text')}) AS tok FROM kept)) AS postings, CAST(0 AS BIGINT) AS cleared, (SELECT count(*) FROM orders) AS sessions""",
    "rename_folder": f"{_DOCS} SELECT id, CASE WHEN starts_with(file_path, '/corpus/en/') THEN '/corpus/english' || substr(file_path, 11) ELSE file_path END AS file_path FROM docs",
    "edit_proposals": f"{_DOCS}, {_EDITS} SELECT id, array_to_string(finds, '|') AS finds, len(finds) || ' change(s)' AS summary, {_TS.format(f"TIMESTAMP '{STAMP}' + INTERVAL 1800 SECOND")} AS expires_at FROM edits WHERE id % 3 <> 0 AND len(finds) > 0",
    "edits_applied": f"""{_DOCS}, {_EDITS}, one AS (SELECT *, CASE WHEN list_contains(finds, 'the') THEN replace(text, 'the', 'THE') ELSE text END AS t1, CASE WHEN list_contains(finds, 'the') THEN (length(text) - length(replace(text, 'the', ''))) // 3 ELSE 0 END AS c1 FROM edits WHERE id % 3 <> 0 AND id % 5 <> 0 AND len(finds) > 0)
SELECT id, sha256(CASE WHEN list_contains(finds, 'en') THEN replace(t1, 'en', '') ELSE t1 END) AS text_sha256, CAST(c1 + CASE WHEN list_contains(finds, 'en') THEN (length(t1) - length(replace(t1, 'en', ''))) // 2 ELSE 0 END AS BIGINT) AS applied,
  CASE WHEN c1 + CASE WHEN list_contains(finds, 'en') THEN (length(t1) - length(replace(t1, 'en', ''))) // 2 ELSE 0 END > 0 THEN 'applied' ELSE 'nothing to change' END AS outcome FROM one""",
    "edit_paragraphs": f"""WITH a AS (SELECT doc_id AS id, replace(text, '. ', {_N}) AS t0 FROM documents), b AS (SELECT *, replace(t0, 'the', 'THE') AS t1 FROM a)
SELECT id, sha256(replace(t1, 'en', '')) AS text_sha256, CAST((length(t0) - length(replace(t0, 'the', ''))) // 3 + (length(t1) - length(replace(t1, 'en', ''))) // 2 AS BIGINT) AS applied FROM b""",
    "sessions_changed": f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey = 7 THEN 'Seven' ELSE o_orderpriority END AS title, '/dir/' || o_custkey AS directory_path, CASE WHEN o_orderkey = 7 THEN '{STAMP}' ELSE {_TS.format('CAST(o_orderdate AS TIMESTAMP)')} END AS updated_at FROM orders WHERE o_orderkey <> 3
UNION ALL SELECT -1, 'New Chat', '/dir/b', '{STAMP}'""",
    "answers_set": "SELECT event_id AS id, CASE WHEN event_id % 4 = 1 THEN 'answer ' || event_id END AS ai_response, CASE WHEN event_id % 4 = 1 THEN 0 ELSE 1 END AS n_sources, CASE WHEN event_id % 4 = 1 THEN 0.5 ELSE round(value, 6) END AS response_time FROM events",
    "link_rows": f"{_DOCS} SELECT d.id AS document_id, e.user_id AS chat_session_id, count(*) AS uses, {_TS.format('CAST(max(e.ts) AS TIMESTAMP)')} AS last_used FROM events e JOIN docs d ON d.file_path = '/corpus/en/src1/doc_' || (e.event_id % 500) || '.txt' GROUP BY 1, 2",
    "session_history": f"SELECT event_id AS id, {_TS.format('CAST(ts AS TIMESTAMP)')} AS timestamp FROM events WHERE user_id = 5",
    "one_document": f"{_DOCS} SELECT id, file_path FROM docs WHERE id = 3 UNION ALL SELECT id, file_path FROM docs WHERE file_path = '/corpus/en/src1/doc_1.txt'",
    "docs_in_error": f"{_DOCS} SELECT id, processing_status FROM docs WHERE processing_status IN ('error', 'metadata_only') ORDER BY id LIMIT 40",
    "layout_previews": _layout(),
    "suggestion_lines": r"""WITH l AS (SELECT conv_id, turn, replace(regexp_replace(text, '[\x09-\x0D "'']+', ' ', 'g'), '?', '') AS line FROM conversations WHERE length(text) > 60)
SELECT conv_id, turn, array_to_string(list_filter([ltrim(substr(line, 1, 30)) || '?', 'Is it so?', ltrim(substr(line, 31, 20)) || '?'], lambda x: length(x) > 8), '|') AS lines FROM l""",
    "tool_results": f"""{_DOCS} SELECT id, CASE WHEN id % 2 = 0 THEN '[About the folder as a whole; cite no document.]' || {_N} ELSE '' END || '{{"id":' || id || ',"file_type":"' || file_type || '"}}' AS result FROM docs""",
    "listing_rows": f"""{_DOCS}, l AS (SELECT *, {_BASE} AS filename, regexp_replace(content_preview, '(?i)^Page \\d+:\\n?', '') AS t FROM docs WHERE {_LISTED} AND document_category = 'REPORT')
SELECT filename, file_path, CASE WHEN processing_status = 'metadata_only' THEN '[Indexing in progress...] ' || filename WHEN trim(t) = '' AND chunks_count > 0 THEN '[' || chunks_count || ' chunks indexed] ' || filename ELSE substr(t, 1, 166) END AS content_snippet,
  chunks_count AS chunks_found, file_type, processing_status, document_category AS category FROM l""",
    "category_answers": f"""{_DOCS}, n AS (SELECT count(*) FILTER (document_category = 'DRAFT') AS d, count(document_category) AS a FROM docs WHERE {_LISTED})
SELECT 'draft' AS asked, CASE WHEN d > 0 THEN 'matched' WHEN a > 0 THEN 'none' ELSE 'generic' END AS kind, d AS documents FROM n UNION ALL SELECT 'unknown', CASE WHEN a > 0 THEN 'none' ELSE 'generic' END, 0 FROM n UNION ALL SELECT 'nothing', 'generic', 0""",
    "first_page_progress": f"""{_DOCS}, p AS (SELECT * FROM docs ORDER BY docs.indexed_at DESC, id DESC LIMIT 100)
SELECT count(*) AS total, count(*) FILTER (processing_status = 'indexed') AS indexed, count(*) FILTER (processing_status = 'metadata_only') AS metadata_only, count(*) FILTER (processing_status = 'error') AS error FROM p""",
    "token_usage": "SELECT CAST(sum(user_id) AS BIGINT) AS prompt_tokens, CAST(sum(event_id) FILTER (event_id % 3 > 0) AS BIGINT) AS completion_tokens, CAST(sum(user_id) + sum(event_id) FILTER (event_id % 3 > 0) AS BIGINT) AS total_tokens FROM events",
    "prompt_cuts": f"SELECT doc_id, sha256(CASE WHEN length(text) * 3 <= 15000 THEN repeat(text, 3) ELSE rtrim(substr(repeat(text, 3), 1, 15000), E' \\t\\n\\r') || {_N} || {_N} || '[Truncated.]' END) AS prompt_sha256, 83 AS budget, 500000 AS most FROM documents",
    "calendar_dates": "SELECT o_orderkey, strftime(o_orderdate, '%b') || CASE WHEN month(o_orderdate) = 5 THEN '' ELSE '.' END || strftime(o_orderdate, ' %-d, %Y') AS day FROM orders",
    "snippet_positions": """WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'nowhere to be found, ever' ELSE substr(text, 50, 30 + doc_id % 2 * 60) || ' and so on' END AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(coalesce(nullif(strpos(lower(text), lower(substr(s, 1, 80))), 0), nullif(strpos(lower(text), lower(substr(s, 1, 40))), 0), nullif(strpos(lower(text), lower(substr(s, 1, 20))), 0), 0) AS INT) AS place FROM s""",
    "shown_numbers": "WITH v AS (SELECT CAST(l_quantity * l_discount * 4 AS DOUBLE) AS v FROM lineitem) SELECT CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '\\.$', '') END AS shown, count(*) AS cells FROM v GROUP BY 1",
    "whole_files": f"""WITH {_TURNS}, w AS (SELECT file_path, string_agg(text, {_N} ORDER BY chunk_id, text) AS t, count(*) AS chunks_found FROM turns WHERE file_path = 'c3.txt' GROUP BY 1)
SELECT file_path, CASE WHEN length(t) > 400 THEN rtrim(substr(t, 1, 400), E' \\t\\n\\r') || {_N} || '[...]' ELSE t END AS block, {_cut('t', 300)} AS content_snippet, chunks_found FROM w""",
    "compressed_context": f"""{_hybrid('search')}, s AS (SELECT sum(length(text)) AS c, count(*) AS n FROM rows), e AS (SELECT chunk_key, text, CASE WHEN length(trim(substr(text, 11, 500))) < 30 THEN text ELSE substr(text, 11, 500) END AS t FROM rows)
SELECT chunk_key, sha256(CASE WHEN s.c >= 8000 AND s.n >= 2 THEN {_cut('t', 400, ' [...]')} ELSE text END) AS text_sha256 FROM e, s""",
    "answer_selected": f"{_hybrid('search')} SELECT file_path, sha256({_BLOCKS}) AS block_sha256, round(avg(score), 3) AS relevance_score, count(*) AS chunks_found FROM rows WHERE contains(file_path, '/en/') OR contains(file_path, '/de/') GROUP BY 1",
    "answer_single_file": f"{_SINGLE} SELECT file_path, sha256(block) AS block_sha256, relevance_score, {_cut('block', 300)} AS content_snippet, chunks_found FROM chosen",
    "joined_context": f"""{_hybrid('search')}, b AS (SELECT file_path, min(pos) AS pos, '[Document: ' || {_BASE} || ']' || {_N} || {_BLOCKS} AS block FROM rows GROUP BY file_path)
SELECT sha256(string_agg(block, {_N} || {_N} || '---' || {_N} || {_N} ORDER BY pos)) AS context_sha256 FROM b""",
    "semantic_only": f"{_SEMANTIC} SELECT pos, chunk_key, round(score, 6) AS score FROM kept WHERE NOT cap OR p <= 12",
    "files_named": f"WITH {_TURNS} SELECT DISTINCT file_path FROM turns WHERE starts_with(file_path, 'c12')",
    "hashed_vectors": f"SELECT doc_id AS chunk_key, 64 AS size, CASE WHEN len({_tokens('substr(text, 1, 1800)')}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS squared FROM documents",
    "ask_listing": f"""{_DOCS}, r AS (SELECT {_BASE} AS filename, file_path FROM docs WHERE {_LISTED} AND document_category = 'REPORT'), n AS (SELECT count(*) AS n FROM r), l AS (SELECT * FROM r ORDER BY lower(filename), file_path LIMIT 1000)
SELECT 'what are our reports' AS question, 'document_listing' AS query_type, any_value(n.n) || ' document(s) indexed as report:' || string_agg({_N} || '- ' || filename, '' ORDER BY lower(filename), file_path) AS message, count(*) AS found FROM l, n
UNION ALL SELECT 'how many invoices do we have', 'document_listing', 'No document is indexed as invoice.', 0 UNION ALL SELECT 'hello', 'greeting', '{GREETING}', 0""",
    "history_rows": f"{_history(1)} SELECT session_id, position, role, sha256(content) AS content_sha256 FROM rows",
    "model_messages": f"""{_history(2)}, s AS (SELECT session_id, coalesce(max(content) FILTER (role = 'system'), '') AS notes, count(*) FILTER (role <> 'system') AS n, string_agg(role || ': ' || content || {_N}, '' ORDER BY position) FILTER (role <> 'system') AS said FROM rows GROUP BY 1)
SELECT session_id, CAST(n + 2 AS INT) AS n, sha256('system: Be brief.' || CASE WHEN notes <> '' THEN {_N} || notes ELSE '' END || {_N} || coalesce(said, '') || 'user: and now?') AS messages_sha256 FROM s""",
    "last_sources": "WITH l AS (SELECT user_id AS session_id, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY 1) SELECT session_id, CASE WHEN id % 3 > 0 THEN '/d/' || id END AS file_path FROM l",
    "status_rows": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER w AS k, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k = 1 OR event_type IS DISTINCT FROM b",
    "accepted_events": """WITH e AS (SELECT 'f' || user_id || CASE WHEN event_id % 3 = 0 THEN '.exe' ELSE '.TXT' END AS f, 'g' || user_id || '.pdf' AS g, event_type AS t FROM events),
s AS (SELECT f AS file_path, CASE WHEN t IN ('error', 'signup') THEN 'deleted' ELSE 'modified' END AS event_type FROM e UNION ALL SELECT g, 'created' FROM e WHERE t = 'error')
SELECT file_path, event_type, count(*) AS events FROM s WHERE event_type = 'deleted' OR file_path NOT LIKE '%.exe' GROUP BY 1, 2""",
    "enqueued_files": f"{_DOCS} SELECT file_path, {_PRIORITY.format(age='(48.0 - id)', size='(file_size * 20000)')} AS priority FROM docs",
    "tasks_taken": f"""{_DOCS}, t AS (SELECT id, file_path, {_PRIORITY.format(age='(696.0 - id)', size='file_size')} AS p FROM docs), q AS (SELECT file_path FROM t WHERE id % 6 > 1 ORDER BY p DESC, file_path LIMIT 25)
SELECT file_path, 'active' AS state FROM t WHERE id % 6 = 0 UNION ALL SELECT file_path, 'active' FROM q""",
    "queue_counts": "SELECT count(*) FILTER (event_type = 'signup') AS pending, CAST(0 AS BIGINT) AS processing, count(*) FILTER (event_type NOT IN ('signup', 'error')) AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events",
    "waiting_events": "SELECT 'f' || user_id || '#' || event_id AS file_path FROM events ORDER BY ts, 'f' || user_id || '#' || event_id LIMIT 100",
}
