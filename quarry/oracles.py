"""DuckDB SQL of the registered queries, over the same tables."""

from __future__ import annotations

from .fixtures import DUCK_DOCUMENTS
from .functions.text import STOP_WORDS, TITLE_SCAN
from .operators.retrieval import POLICIES
from .plans import questions as nl
from .queries import AS_OF, KEYWORDS, QUESTIONS, SESSIONS_AS_OF, TAXONOMY

_DOCS = f"WITH docs AS ({DUCK_DOCUMENTS})"
_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_BASE = "regexp_extract(file_path, '([^/]*)$', 1)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _search(where: str, limit: int, offset: int) -> str:
    return f"""{_DOCS} SELECT id, file_path, file_type, file_size, {_ISO.format('last_modified')} AS last_modified, content_preview, document_category, chunks_count, processing_status,
  {_ISO.format('indexed_at')} AS indexed_at, count(*) OVER () AS total_count FROM docs WHERE {where} ORDER BY docs.indexed_at DESC, id DESC LIMIT {limit} OFFSET {offset}"""


_NUMBERS = "SELECT CAST(coalesce(avg({0}), 0) AS DOUBLE) AS average, CAST(coalesce(min({0}), 0) AS DOUBLE) AS least, CAST(coalesce(max({0}), 0) AS DOUBLE) AS most, CAST(coalesce(sum({0}), 0) AS DOUBLE) AS total FROM docs"
_PARTS = "list_filter(string_split(file_path, '/'), lambda x: x <> '')"
_USAGE = "usage AS (SELECT l_partkey AS document_id, l_orderkey AS chat_session_id, count(*) AS usage_count, min(l_shipdate) AS first_used, max(l_shipdate) AS last_used FROM lineitem GROUP BY 1, 2)"
_PAIRS = """pairs AS (SELECT conv_id AS session_id, turn AS position, trim(text) AS user_message, trim(answer) AS ai_response FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"""
_STOPS = ", ".join(_quoted(w) for w in STOP_WORDS)


def _tokens(text: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[.\\-#]+[a-z0-9]*)*'), lambda t: t NOT IN ({_STOPS}))"
    return f"flatten(list_transform({kept}, lambda t: list_concat([t], CASE WHEN regexp_matches(t, '[.#\\-]') THEN list_filter(regexp_split_to_array(t, '[.\\-#]+'), lambda p: length(p) > 2) ELSE [] END)))"


_BM25 = f"""toks AS (SELECT doc_id AS chunk_key, {_tokens('text')} AS t FROM documents),
lens AS (SELECT chunk_key, CAST(len(t) AS BIGINT) AS dl FROM toks),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT chunk_key, tok, count(*) AS tf FROM (SELECT chunk_key, unnest(t) AS tok FROM toks) GROUP BY 1, 2),
rawidf AS (SELECT tok, count(*) AS df, ln((SELECT n FROM tot) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post GROUP BY tok),
idf AS (SELECT tok, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM rawidf) ELSE r END AS idf FROM rawidf)"""


def _keyword(k: int) -> str:
    return f"""{_BM25}, asked AS (SELECT tok, count(*) AS qf FROM (SELECT unnest({_tokens(_quoted(KEYWORDS))}) AS tok) GROUP BY tok),
scored AS (SELECT p.chunk_key, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM tot)))) AS score FROM post p JOIN asked USING (tok) JOIN idf USING (tok) JOIN lens l ON p.chunk_key = l.chunk_key GROUP BY 1),
kw AS (SELECT * FROM (SELECT chunk_key, score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_key) AS rank FROM scored) WHERE rank <= {k} AND score > 0)"""


def _semantic(k: int) -> str:
    return f"""dist AS (SELECT vec_id AS chunk_key, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS distance FROM embeddings),
sem AS (SELECT * FROM (SELECT chunk_key, distance, greatest(0.0, 1 - distance) AS base_score, row_number() OVER (ORDER BY round(distance, 12), chunk_key) AS rank FROM dist) WHERE rank <= {k})"""


def _fused(k: int) -> str:
    return f"""WITH {_keyword(k)}, {_semantic(k)},
fused AS (SELECT chunk_key, rrf_score, semantic_rank, keyword_rank, row_number() OVER (ORDER BY round(rrf_score, 12) DESC, semantic_rank ASC NULLS LAST, keyword_rank) AS pos FROM (
  SELECT coalesce(s.chunk_key, w.chunk_key) AS chunk_key, s.rank AS semantic_rank, w.rank AS keyword_rank, coalesce(0.5 / (60 + s.rank), 0) + coalesce(0.5 / (60 + w.rank), 0) AS rrf_score
  FROM sem s FULL JOIN kw w ON s.chunk_key = w.chunk_key)),
found AS (SELECT pos, f.chunk_key, '/corpus/' || lang || '/' || source AS file_path, text, coalesce(base_score, 0.0) AS score FROM fused f JOIN documents d ON f.chunk_key = d.doc_id LEFT JOIN sem s ON s.chunk_key = f.chunk_key
  WHERE trim(text) <> '' AND EXISTS (SELECT 1 FROM sem))"""


def _hybrid(mode: str) -> str:
    p = POLICIES[mode]
    return f"""{_fused(p.top_k)},
shape AS (SELECT *, count(*) OVER () > {p.final_top_k} AND (SELECT count(DISTINCT file_path) FROM found) > 1 AS cap, row_number() OVER (PARTITION BY file_path ORDER BY pos) AS k FROM found),
kept AS (SELECT *, row_number() OVER (ORDER BY pos) AS p FROM shape WHERE NOT cap OR k <= 4),
rows AS (SELECT * FROM kept WHERE NOT cap OR p <= {p.final_top_k})"""


_ASKED = "asked(id, question) AS (VALUES " + ", ".join(f"({i}, {_quoted(q)})" for i, q in enumerate(QUESTIONS)) + ")"
_TALK = _ASKED + """, talk AS (SELECT * FROM asked UNION ALL SELECT conv_id * 100 + turn + 1000, CASE WHEN conv_id % 2 = 0 THEN question ELSE question || ' ' || text END
  FROM conversations JOIN asked ON asked.id = (conv_id + turn) % (SELECT count(*) FROM asked) WHERE role = 'user')"""
_NORMAL = r"lower(trim(regexp_replace(trim(coalesce(question, ''), E' \t\n\r'), '[?!.,]+$', ''), E' \t\n\r'))"


def _any(patterns) -> str:
    return _quoted(nl.any_of(patterns))


def _list(words) -> str:
    return ", ".join(map(_quoted, words))


def _rewritten() -> str:
    name = "'Plan.pdf'"
    cases = []
    for p in nl.PRONOUNS:
        it = " AND len(list_filter(regexp_split_to_array(trim(question), '\\s+'), lambda w: w <> '')) <= 8" if p == r"\bit\b" else ""
        cases.append(f"WHEN regexp_matches(question, {_quoted('(?i)' + p)}){it} THEN regexp_replace(question, {_quoted('(?i)' + p)}, {name})")
    usable = f"trim(question) <> '' AND length(trim(question)) <= 160 AND NOT contains(lower(question), lower({name})) AND (regexp_matches(lower(question), '\\b(that|this|it)\\b') OR contains(lower(question), 'document') OR contains(lower(question), 'file'))"
    return f"WITH {_TALK} SELECT id, CASE WHEN {usable} THEN CASE {' '.join(cases)} ELSE question END ELSE question END AS question FROM talk"


def _categories() -> str:
    names = ["DELIVERY RECEIPT", "DELIVERY-NOTE", "INVOICE", "PERMIT"]
    one = ", ".join(f"CASE WHEN regexp_matches(question, {_quoted('(?i)' + nl.category_pattern(t))}) THEN {_quoted(t.lower())} END" for t in names)
    return f"WITH {_TALK} SELECT id, nullif(array_to_string(list_filter([{one}], lambda x: x IS NOT NULL), ' or '), '') AS label FROM talk"


_SCAN = f"""{_DOCS}, scan AS (SELECT CASE WHEN id % 17 = 2 THEN file_path || '.new.txt' ELSE file_path END AS file_path, CASE WHEN id % 7 = 3 THEN sha256(text || '!') ELSE file_hash END AS file_hash,
  file_type, file_size, CASE WHEN id % 5 = 1 THEN last_modified + INTERVAL 1 DAY ELSE last_modified END AS last_modified FROM docs WHERE id % 13 <> 5)"""
_APART = "abs(epoch_us(s.last_modified) - epoch_us(d.last_modified)) < 2000000"
_TITLES = ", ".join(_quoted(t.upper()) for t in TAXONOMY)
_SHEET = """rows AS (SELECT '/books/' || (l_suppkey % 8) || '.xlsx' AS file_path, l_returnflag AS sheet, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 2 + CAST(l_linestatus = 'O' AS INT) AS row_no,
  [l_orderkey::VARCHAR, l_partkey::VARCHAR, l_linenumber::VARCHAR, l_linestatus] AS cells FROM lineitem),
placed AS (SELECT *, row_number() OVER w - 2 AS k, first(cells) OVER w AS header FROM rows WINDOW w AS (PARTITION BY file_path, sheet ORDER BY row_no)),
body AS (SELECT *, k // 20 AS g FROM placed WHERE k >= 0),
texts AS (SELECT file_path, sheet, g, '[File: ' || regexp_extract(file_path, '([^/]*)$', 1) || ' | Sheet: ' || sheet || ' | Rows: ' || (g * 20 + 1) || '-' || (g * 20 + count(*)) || ']' || chr(10)
  || 'Headers: ' || array_to_string(any_value(header), ' | ') || chr(10) || string_agg('Row ' || (k + 1) || ': ' || array_to_string(cells, ' | '), chr(10) ORDER BY k) AS text FROM body GROUP BY 1, 2, 3)"""

# Prose chunks, one step a row: a chunk ends behind the last sentence end in the 119 places before the window's end, else behind the last blank line in 239, else behind the
# last white space in 59, else where the window ends. The tables' texts hold no page marks.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_PROSE = rf"""WITH RECURSIVE docs AS ({DUCK_DOCUMENTS}),
texts AS (SELECT file_path, t, length(t) AS n FROM (SELECT file_path, regexp_replace(text, '\[Region: [^\]]*\]\n?', '', 'g') AS t FROM docs) WHERE length(t) > 0),
steps AS (SELECT file_path, t, n, 0 AS a, 0 AS z FROM texts
  UNION ALL
  SELECT file_path, t, n, b, CASE WHEN b + 1200 >= n THEN n ELSE b + 1200 - 239 + coalesce(
      list_max(list_filter(range(120, 239), lambda j: substr(r, j + 1, 1) IN ('!', '?') AND regexp_matches(substr(r, j + 2, 1), '{_SPACE}') OR substr(r, j + 1, 1) = '.' AND regexp_matches(substr(r, j + 2), '^ *(?:\p{{Lu}}|$)'))),
      list_max(list_filter(range(0, 239), lambda j: substr(r, j + 1, 1) = chr(10) AND substr(r, j + 2, 1) IN ('', chr(10)))),
      list_max(list_filter(range(180, 239), lambda j: regexp_matches(substr(r, j + 1, 1), '{_SPACE}'))), 238) + 1 END
  FROM (SELECT file_path, t, n, b, substr(t, b + 1200 - 239 + 1) AS r FROM (SELECT *, CASE WHEN z = 0 THEN 0 ELSE z - 200 END AS b FROM steps WHERE z < n))),
cut AS (SELECT file_path, a, regexp_replace(substr(t, a + 1, z - a), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text FROM steps WHERE z > 0),
good AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY a) - 1 AS k, count(*) OVER (PARTITION BY file_path) AS c FROM cut WHERE text <> '')
SELECT file_path, CAST(k AS INT) AS chunk_id, text, CAST(a AS INT) AS start_pos, CAST(a + length(text) AS INT) AS end_pos, CAST(NULL AS INT) AS page_number, CAST(c AS INT) AS total_chunks FROM good"""


ORACLES: dict[str, str] = {
    "prose_chunks": _PROSE,
    "prose_chunks_sql": _PROSE,
    "doc_search_page": _search("(lower(file_path) LIKE '%src1%' OR lower(content_preview) LIKE '%src1%') AND lower(file_type) = 'en'", 50, 20),
    "doc_search_date_range": _search("last_modified >= TIMESTAMP '2024-01-05' AND last_modified <= TIMESTAMP '2024-01-20'", 30, 0),
    "docs_by_type": f"{_DOCS} SELECT id, file_path, {_TS.format('indexed_at')} AS indexed_at FROM docs WHERE file_type = 'de'",
    "recent_docs": f"{_DOCS} SELECT id, file_path FROM docs WHERE indexed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY",
    "list_documents": f"{_DOCS} SELECT {_BASE} AS filename, file_path, CASE WHEN length(content_preview) > 1500 THEN substr(content_preview, 1, 1500) || '...' ELSE coalesce(content_preview, '') END AS preview, coalesce(chunks_count, 0) AS chunks, nullif(trim(document_category), '') AS category, processing_status AS status FROM docs WHERE processing_status IN ('indexed', 'metadata_only')",
    "docs_under_directory": f"{_DOCS} SELECT count(*) AS documents, count(*) > 0 AS found FROM docs WHERE starts_with(file_path, '/corpus/en/src1/')",
    "stats_by_status_type": f"{_DOCS} SELECT CASE WHEN grouping(processing_status) = 0 THEN 'status' WHEN grouping(file_type) = 0 THEN 'type' ELSE 'total' END AS kind, coalesce(processing_status, file_type) AS value, count(*) AS documents FROM docs GROUP BY GROUPING SETS ((processing_status), (file_type), ())",
    "file_size_stats": f"{_DOCS} {_NUMBERS.format('file_size')}",
    "chunk_stats": f"{_DOCS} {_NUMBERS.format('chunks_count')}",
    "index_stats": f"{_DOCS} SELECT count(*) AS files, CAST(coalesce(sum(chunks_count), 0) AS BIGINT) AS chunks, coalesce(sum(chunks_count) / count(*), 0.0) AS chunks_per_file FROM docs",
    "index_progress": f"{_DOCS} SELECT count(*) AS total, count(*) FILTER (processing_status = 'indexed') AS processed, count(*) FILTER (processing_status = 'error') AS failed, count(*) FILTER (processing_status = 'metadata_only') > 0 AS is_active FROM docs",
    "corpus_metadata": f"{_DOCS} SELECT lower(trim(file_type)) AS file_type, count(*) AS documents, {_TS.format('min(last_modified)')} AS oldest, {_TS.format('max(last_modified)')} AS newest FROM docs GROUP BY 1",
    "corpus_summary_text": f"""{_DOCS}, t AS (SELECT file_type, count(*) AS n, min(last_modified) AS a, max(last_modified) AS z FROM docs GROUP BY 1)
SELECT 'This folder contains ' || CAST(sum(n) AS BIGINT) || ' document(s). By type: ' || string_agg(upper(file_type) || ' (' || n || ')', ', ' ORDER BY n DESC, file_type) || '. Date range: ' || strftime(min(a), '%b %Y') || ' – ' || strftime(max(z), '%b %Y') || '.' AS summary FROM t""",
    "distinct_types": f"{_DOCS} SELECT DISTINCT file_type FROM docs WHERE file_type IS NOT NULL",
    "ui_filtered": f"{_DOCS} SELECT id, file_path FROM docs WHERE contains(lower({_BASE}), 'doc_12') AND file_type = 'fr'",
    "ui_sort": f"{_DOCS} SELECT id, file_path, file_size FROM docs ORDER BY coalesce(file_size, 0) DESC, file_path",
    "folder_tree": f"""{_DOCS}, p AS (SELECT {_PARTS} AS p FROM docs), l AS (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM p)
SELECT DISTINCT '/' || array_to_string(p[1:depth], '/') AS path, '/' || array_to_string(p[1:depth - 1], '/') AS parent, p[depth] AS name, CAST(depth AS INT) AS depth, depth = len(p) AS is_file FROM l""",
    "filename_prefix": f"{_DOCS} SELECT DISTINCT file_path FROM docs WHERE starts_with(lower({_BASE}), 'doc_7')",
    "autocomplete": f"{_DOCS} SELECT {_BASE} AS filename, file_path FROM docs WHERE starts_with(lower({_BASE}), 'doc_1') ORDER BY lower(filename), file_path LIMIT 10",
    "trie_stats": f"{_DOCS}, n AS (SELECT DISTINCT file_path, lower({_BASE}) AS n FROM docs), p AS (SELECT DISTINCT substr(n, 1, k) AS p FROM (SELECT n, unnest(range(1, length(n) + 1)) AS k FROM n)) SELECT (SELECT count(*) FROM n) AS files, (SELECT count(*) FROM p) + 1 AS nodes, (SELECT max(length(n)) FROM n) AS depth",
    "category_listing": f"{_DOCS} SELECT {_BASE} AS filename, file_path, document_category FROM docs WHERE processing_status IN ('indexed', 'metadata_only') AND document_category = 'DRAFT'",
    "cache_stats": f"{_DOCS} SELECT count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, round(sum(file_size) / 1048576.0, 2) AS megabytes, round((epoch(TIMESTAMP '{AS_OF}') - epoch(min(last_modified))) / 86400.0, 2) AS oldest_days, round((epoch(TIMESTAMP '{AS_OF}') - epoch(max(last_modified))) / 86400.0, 2) AS newest_days FROM docs",
    "session_message_counts": f"SELECT o_orderkey AS id, o_orderpriority AS title, {_TS.format('o_orderdate')} AS updated_at, count(l_orderkey) AS message_count FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
    "message_totals": "SELECT (SELECT count(*) FROM orders) AS sessions, count(*) AS messages, round(coalesce(avg(value), 0), 6) AS average_response_time FROM events",
    "week_activity": f"SELECT (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS sessions, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS messages FROM events",
    "daily_message_counts": f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS messages FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1",
    "response_trend": f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS average_response_time FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1",
    "active_directories": f"SELECT '/dir/' || o_custkey AS directory_path, count(*) AS sessions FROM orders WHERE o_orderdate >= TIMESTAMP '{SESSIONS_AS_OF}' - INTERVAL 365 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "usage_upsert": f"WITH {_USAGE} SELECT document_id, chat_session_id, usage_count, {_TS.format('first_used')} AS first_used, {_TS.format('last_used')} AS last_used FROM usage",
    "most_used_docs": f"WITH {_USAGE} SELECT p_partkey AS id, p_name AS file_path, count(*) AS sessions, CAST(sum(usage_count) AS BIGINT) AS uses FROM usage JOIN part ON document_id = p_partkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10",
    "chat_history_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "chat_role_list": f"WITH {_PAIRS} SELECT session_id, position * 2 AS position, 'user' AS role, user_message AS content FROM pairs WHERE user_message <> '' UNION ALL SELECT session_id, position * 2 + 1, 'assistant', ai_response FROM pairs WHERE ai_response <> ''",
    "last_six_pairs": "SELECT session_id, position, user_message FROM (SELECT user_id AS session_id, event_id AS position, event_type AS user_message, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 6",
    "last_message": f"SELECT id, session_id, {_TS.format('ts')} AS timestamp FROM (SELECT event_id AS id, user_id AS session_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "chat_titles": r"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS m FROM conversations WHERE role = 'user' GROUP BY 1),
b AS (SELECT conv_id, trim(m, E' \t\n\r') AS t, trim(regexp_extract(trim(m, E' \t\n\r'), '^[^.\n]*'), E' \t\n\r') AS s FROM f)
SELECT conv_id, CASE WHEN coalesce(t, '') = '' THEN 'New chat' WHEN length(CASE WHEN s = '' THEN t ELSE s END) <= 48 THEN CASE WHEN s = '' THEN t ELSE s END ELSE rtrim(substr(CASE WHEN s = '' THEN t ELSE s END, 1, 48), E' \t\n\r') || '…' END AS title FROM b""",
    "link_sources": f"{_DOCS}, c AS (SELECT '/corpus/en/src1/doc_' || (event_id % 50) || '.txt' AS file_path, substr(event_id::VARCHAR, 1, 500) AS s FROM events) SELECT file_path, max(s) AS content_preview, 'metadata_only' AS processing_status FROM c WHERE file_path NOT IN (SELECT file_path FROM docs) GROUP BY 1",
    "tokenize_docs": f"SELECT doc_id, CAST(len({_tokens('text')}) AS BIGINT) AS n_tokens, sha256(array_to_string({_tokens('text')}, ' ')) AS tokens_sha256 FROM documents",
    "bm25_term_stats": f"WITH {_BM25} SELECT tok, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {_keyword(40)} SELECT chunk_key, round(score, 6) AS score, rank FROM kw",
    "cosine_topk": f"WITH {_semantic(40)} SELECT chunk_key, round(distance, 6) + 0.0 AS distance, round(base_score, 6) AS base_score, rank FROM sem",
    "rrf_fuse": f"{_fused(40)} SELECT chunk_key, round(rrf_score, 9) AS rrf_score, semantic_rank, keyword_rank, pos FROM fused",
    "hybrid_topk": f"{_hybrid('search')} SELECT pos, chunk_key, file_path, round(score, 6) AS score FROM rows",
    "hybrid_filename_filter": f"{_fused(40)} SELECT pos, chunk_key, file_path FROM found WHERE contains(lower(file_path), 'src1') OR NOT EXISTS (SELECT 1 FROM found WHERE contains(lower(file_path), 'src1'))",
    "aggregation_mode_topk": f"{_hybrid('aggregation')} SELECT pos, chunk_key, file_path FROM rows",
    "selected_files_first": f"{_hybrid('search')} SELECT row_number() OVER (ORDER BY s DESC, p) AS pos, chunk_key, s AS selected FROM (SELECT pos AS p, chunk_key, contains(file_path, '/en/') OR contains(file_path, '/de/') AS s FROM rows)",
    "single_file_mode": f"""{_hybrid('search')}, f AS (SELECT file_path, count(*) AS n, min(pos) AS a FROM rows GROUP BY 1), s AS (SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS chunks FROM f)
SELECT file_path, n AS primary_chunks, files, chunks, files = 1 OR (n / chunks >= 0.8 AND n >= 3) AS single FROM f, s ORDER BY n DESC, a LIMIT 1""",
    "source_rows": f"""{_hybrid('search')} SELECT file_path, round(avg(score), 3) AS relevance_score, CASE WHEN length(string_agg(text, chr(10) ORDER BY text)) > 300 THEN substr(string_agg(text, chr(10) ORDER BY text), 1, 300) || '...' ELSE string_agg(text, chr(10) ORDER BY text) END AS content_snippet, count(*) AS chunks_found, '' AS file_type
FROM rows GROUP BY file_path ORDER BY 2 DESC, min(pos) LIMIT 25""",
    "context_blocks": """SELECT CAST(conv_id AS VARCHAR) AS file_path, min(conv_id * 100 + turn) AS pos, sha256(string_agg(text, chr(10) ORDER BY turn)) AS block_sha256, round(avg(turn / 10.0), 3) AS relevance_score,
CASE WHEN length(string_agg(text, chr(10) ORDER BY turn)) > 300 THEN substr(string_agg(text, chr(10) ORDER BY turn), 1, 300) || '...' ELSE string_agg(text, chr(10) ORDER BY turn) END AS content_snippet, count(*) AS chunks_found FROM conversations GROUP BY conv_id""",
    "truncate_context": r"""WITH s AS (SELECT conv_id AS id, turn AS pos, text, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT id, coalesce(string_agg(CASE WHEN k = 1 AND n > 500 THEN rtrim(substr(text, 1, 500), E' \t\n\r') WHEN n <= 500 THEN text END, chr(10) || chr(10) ORDER BY pos), '') AS context, max(n) > 500 AS omitted FROM s GROUP BY id""",
    "sheet_chunks": f"WITH {_SHEET} SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY sheet, g) - 1 AS INT) AS chunk_id, text, CAST(length(text) AS INT) AS end_pos, CAST(count(*) OVER (PARTITION BY file_path) AS INT) AS total_chunks FROM texts",
    "page_lookup": """WITH m AS (SELECT doc_id, 'Intro. ' || replace(text, '. ', '. [Page 3] ') AS t FROM documents), a AS (SELECT doc_id, t, unnest([0, 50, 100, 400, 2000]) AS place FROM m)
SELECT doc_id, place, CAST((length(t) - length(replace(t, '[Page 3]', ''))) // 8 AS BIGINT) AS marks, CASE WHEN strpos(t, '[Page 3]') > 0 AND strpos(t, '[Page 3]') - 1 <= place THEN 3 END AS page FROM a""",
    "doc_title": rf"""SELECT doc_id, list_filter(list_transform(string_split(substr(text, 1, {TITLE_SCAN}), chr(10)), lambda x: upper(regexp_replace(trim(x), '\s+', ' ', 'g'))), lambda x: x IN ({_TITLES}))[1] AS title FROM documents""",
    "listing_previews": rf"""{_DOCS}, p AS (SELECT *, regexp_replace(coalesce(content_preview, ''), '(?i)^Page \d+:\n?', '') AS t FROM docs)
SELECT id, CASE WHEN processing_status = 'metadata_only' THEN '[Indexing in progress...] ' || {_BASE} WHEN trim(t) = '' AND chunks_count > 0 THEN '[' || chunks_count || ' chunks indexed] ' || {_BASE} ELSE substr(t, 1, 120) END AS preview FROM p""",
    "classify_questions": f"""WITH {_ASKED}, every AS (SELECT * FROM asked UNION ALL SELECT conv_id * 100 + turn + 1000, text FROM conversations WHERE role = 'user'),
q AS (SELECT id, {_NORMAL} AS q FROM every), w AS (SELECT *, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS w FROM q)
SELECT id, CASE WHEN q = '' OR q IN ({_list(nl.CASUAL)}) OR (len(w) <= 4 AND (len(list_filter(w, lambda x: x NOT IN ({_list(nl.GREETING_WORDS)}))) = 0 OR q IN ({_list(nl.GREETING_WORDS)}))) THEN 'greeting'
  WHEN regexp_matches(q, {_any(nl.GENERAL)}) THEN 'general' WHEN regexp_matches(q, {_any(nl.LISTING)}) AND NOT regexp_matches(q, {_quoted(nl.VALUE_SEEKING)}) THEN 'document_listing' ELSE 'document_search' END AS route FROM w""",
    "rewrite_questions": _rewritten(),
    "aggregation_intent": f"WITH {_TALK} SELECT id, regexp_matches(lower(trim(question)), {_any(nl.AGGREGATION)}) AS aggregation FROM talk",
    "detect_filename": f"WITH {_TALK} SELECT id, coalesce(nullif(regexp_extract(question, '\"([^\"]+)\"', 1), ''), nullif(regexp_extract(question, {_quoted(nl.FILE_NAME)}, 1), '')) AS file_name FROM talk",
    "category_intent": _categories(),
    "coalesce_events": f"""WITH e AS (SELECT 'f' || user_id AS file_path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS event_type, ts, event_id FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY file_path ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY file_path ORDER BY ts) AS k FROM g)
SELECT file_path, arg_max(event_type, (ts, event_id)) AS event_type, {_TS.format('max(ts)')} AS last_ts, count(*) AS events FROM s GROUP BY file_path, k""",
    "stream_window_counts": f"SELECT {_TS.format('date_trunc(' + _quoted('day') + ', ts)')} AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "stream_dedup": "SELECT DISTINCT 'f' || user_id AS file_path, event_type AS file_hash FROM events",
    "update_priority": """SELECT doc_id, CAST(CASE WHEN doc_id % 97 = 0 THEN 1000 ELSE least(1000, greatest(0, CASE WHEN doc_id % 3 = 0 THEN 200 ELSE 0 END + floor(greatest(0, 400 - (doc_id % 60) * 10)) + floor(greatest(0, 200 - n_chars * 5000 / 1048576.0 * 2))
  + floor(greatest(0, (1 - (doc_id % 11)::DOUBLE / 10.0::DOUBLE) * 200)))) END AS INT) AS priority FROM documents""",
    "update_queue": "SELECT file_path, priority, enqueued_at FROM (SELECT 'f' || user_id AS file_path, CAST(max(event_id) % 1000 AS INT) AS priority, max(event_id) AS enqueued_at, min(event_id) AS came FROM events GROUP BY user_id ORDER BY came, file_path LIMIT 1000)",
    "queue_retention": """WITH s AS (SELECT event_id AS task_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'completed' END AS status, ts FROM events)
SELECT task_id, status FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY ts DESC, task_id DESC) AS k FROM s) WHERE status = 'pending' OR (status = 'completed' AND k <= 100) OR (status = 'failed' AND k <= 50)""",
    "ingest_diff": f"""{_SCAN} SELECT coalesce(s.file_path, d.file_path) AS file_path, CASE WHEN s.file_hash IS NULL THEN 'removed' WHEN d.file_hash IS NULL THEN 'new' WHEN d.processing_status <> 'indexed' THEN 'pending' WHEN s.file_hash <> d.file_hash THEN 'changed' WHEN {_APART} THEN 'unchanged' ELSE 'touched' END AS state
FROM scan s FULL JOIN docs d ON s.file_path = d.file_path""",
    "ingest_resume": f"{_SCAN} SELECT file_path FROM scan s WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.file_path = s.file_path AND processing_status = 'indexed' AND {_APART})",
    "ingest_upsert": f"""{_SCAN} SELECT coalesce(d.file_path, s.file_path) AS file_path, coalesce(s.file_hash, d.file_hash) AS file_hash, coalesce(CASE WHEN length(s.file_path) % 2 = 0 THEN 'NEW' END, d.document_category) AS document_category,
  CASE WHEN s.file_path IS NULL THEN d.processing_status ELSE 'metadata_only' END AS processing_status, CAST(CASE WHEN s.file_path IS NULL THEN d.chunks_count ELSE 0 END AS INT) AS chunks_count,
  {_TS.format('coalesce(s.last_modified, d.last_modified)')} AS last_modified, {_TS.format(f"coalesce(d.indexed_at, TIMESTAMP '{AS_OF}')")} AS indexed_at FROM docs d FULL JOIN scan s ON s.file_path = d.file_path""",
    "delete_cascade": f"{_DOCS} SELECT file_type, count(*) AS documents, CAST(sum(chunks_count) AS BIGINT) AS chunks FROM docs WHERE id % 3 <> 0 GROUP BY 1",
    "edit_apply_counts": """WITH a AS (SELECT doc_id AS id, text AS t0, contains(substr(text, 1, 12000), 'the') AS v1, contains(substr(text, 1, 12000), 'THE ') AS v2, contains(substr(text, 1, 12000), 'e ') AS v3, contains(substr(text, 1, 12000), 'never there') AS v4 FROM documents),
b AS (SELECT *, CASE WHEN v1 THEN replace(t0, 'the', 'THE') ELSE t0 END AS t1 FROM a), c AS (SELECT *, CASE WHEN v2 THEN replace(t1, 'THE ', '') ELSE t1 END AS t2 FROM b), d AS (SELECT *, CASE WHEN v3 THEN replace(t2, 'e ', '_') ELSE t2 END AS t3 FROM c)
SELECT id, sha256(CASE WHEN v4 THEN replace(t3, 'never there', 'x') ELSE t3 END) AS text_sha256, CAST(CASE WHEN v1 THEN (length(t0) - length(replace(t0, 'the', ''))) // 3 ELSE 0 END + CASE WHEN v2 THEN (length(t1) - length(replace(t1, 'THE ', ''))) // 4 ELSE 0 END
  + CASE WHEN v3 THEN (length(t2) - length(replace(t2, 'e ', ''))) // 2 ELSE 0 END + CASE WHEN v4 THEN (length(t3) - length(replace(t3, 'never there', ''))) // 11 ELSE 0 END AS BIGINT) AS applied FROM d""",
    "cell_values": '''WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS sheet, CAST(l_linenumber AS VARCHAR) AS cell, l_orderkey % 8 AS k, CAST(l_partkey AS VARCHAR) AS n, l_linenumber, l_returnflag FROM lineitem)
SELECT sheet, cell, CASE WHEN k < 2 THEN 'null' WHEN k < 4 THEN 'int' WHEN k IN (4, 6) THEN 'float' ELSE 'text' END AS kind,
  CASE k WHEN 2 THEN n WHEN 3 THEN CAST(-CAST(n AS BIGINT) AS VARCHAR) WHEN 4 THEN n || '.5' WHEN 5 THEN l_returnflag || n WHEN 6 THEN l_linenumber || '000.0' WHEN 7 THEN n || ' ' || n END AS value FROM c''',
    "reject_reasons": r'''WITH f AS (SELECT '/a.b/' || ['', '', '~$'][doc_id % 3 + 1] || doc_id || ['', '.20240101_101010.bak', '', '.x.bak', ''][doc_id % 5 + 1] || ['.docx', '.exe', '.PDF', '.txt', '', '.png', '.xls'][doc_id % 7 + 1] AS file_path,
  doc_id % 3 = 2 AS locked, doc_id % 5 = 1 AS saved, doc_id % 7 AS kind, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 11 < 3 THEN 52428800 + doc_id % 2 ELSE n_chars END AS length FROM documents)
SELECT file_path, CAST(length AS BIGINT) AS length, CASE WHEN locked THEN 'lock file' WHEN saved AND kind <> 4 THEN 'backup file' WHEN kind IN (1, 4, 5) THEN 'unsupported type' WHEN length > 52428800 THEN 'too large' WHEN length = 0 THEN 'empty' END AS reason FROM f''',
}
