"""Explicit schemas of the application's tables and records."""

from __future__ import annotations

CHAT_SESSIONS = "id long, title string, directory_path string, created_at timestamp, updated_at timestamp"
SOURCE = "struct<file_path:string,relevance_score:double,content_snippet:string,chunks_found:long,file_type:string,page_number:int>"
CHAT_MESSAGES = f"id long, session_id long, user_message string, ai_response string, sources array<{SOURCE}>, response_time double, timestamp timestamp"
INDEXED_DOCUMENTS = (
    "id long, file_path string, file_hash string, file_type string, file_size long, last_modified timestamp, content_preview string, "
    "document_category string, chunks_count int, processing_status string, indexed_at timestamp, last_processed timestamp"
)
DOCUMENT_CHAT_USAGE = "document_id long, chat_session_id long, usage_count long, first_used timestamp, last_used timestamp"
CHUNKS = "file_path string, chunk_id int, text string, start_pos int, end_pos int, page_number int, total_chunks int"
FILE_EVENTS = "file_path string, event_type string, ts timestamp"
