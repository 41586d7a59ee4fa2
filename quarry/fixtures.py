"""The application's tables as projections of the generic test tables; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import table

#: {h} is the SHA-256 function, {d} and {c} the statements that differ between the dialects.
DOCUMENTS_SQL = """
SELECT d.doc_id AS id, concat('/corpus/', d.lang, '/', d.source, '/doc_', CAST(d.doc_id AS {string}), '.txt') AS file_path, {h} AS file_hash,
  d.lang AS file_type, d.n_chars AS file_size, substr(d.text, 1, 1500) AS content_preview,
  CASE l.quality WHEN 1 THEN 'REPORT' WHEN 0 THEN 'DRAFT' END AS document_category,
  CASE WHEN d.doc_id % 20 = 0 THEN 'error' WHEN d.doc_id % 10 = 1 THEN 'metadata_only' ELSE 'indexed' END AS processing_status,
  {m} AS last_modified, {i} AS indexed_at,
  CAST(CASE WHEN d.doc_id % 20 = 0 OR d.doc_id % 10 = 1 THEN 0 ELSE ceil(d.n_chars / 1000.0) END AS INT) AS chunks_count, d.text AS text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
DUCK_DOCUMENTS = DOCUMENTS_SQL.format(
    string="VARCHAR", h="sha256(d.text)", m="TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id AS BIGINT))", i="TIMESTAMP '2024-01-02' + to_hours(CAST(d.doc_id AS BIGINT))"
)
_SPARK_DOCUMENTS = DOCUMENTS_SQL.format(
    string="STRING", h="sha2(d.text, 256)", m="TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, CAST(d.doc_id AS INT))", i="TIMESTAMP '2024-01-02 00:00:00' + make_dt_interval(0, CAST(d.doc_id AS INT))"
).replace("FROM documents d LEFT JOIN labels l", "FROM {documents} d LEFT JOIN {labels} l")


def indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPARK_DOCUMENTS, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderpriority AS title", "concat('/dir/', o_custkey) AS directory_path", "CAST(o_orderdate AS TIMESTAMP) AS created_at", "CAST(o_orderdate AS TIMESTAMP) AS updated_at"
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id AS session_id", "CAST(ts AS TIMESTAMP) AS timestamp", "value AS response_time")


def usage_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row each time a document was used in a session."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS document_id", "l_orderkey AS chat_session_id", "CAST(l_shipdate AS TIMESTAMP) AS used_at")


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('f', user_id) AS file_path", "CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS event_type", "CAST(ts AS TIMESTAMP) AS ts", "event_id"
    )
