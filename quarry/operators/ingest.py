"""Batch ingestion: what changed, metadata upserts, chunk replacement, deletion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PREVIEW, basename, document_title, layout_preview, suffix
from ..session import stored
from .chunking import SHEET_PREVIEW, prose_chunks, sheet_chunks, with_keys

# What is accepted.
EXTENSIONS = ("pdf", "docx", "txt", "xlsx", "xls", "pptx")
IMAGES = ("png", "jpg", "jpeg", "tiff", "bmp")
LOCK_FILE, BACKUP_FILE, MOST_BYTES, SAME_SECONDS = r"^~\$", r"\.\d{8}_\d{6}\.bak\.", 50 * 1024 * 1024, 2.0


def reject_reason(path: Column, length: Column, ocr: bool = False) -> Column:
    """Why a file is not ingested; null if it is. Checks go in this order."""
    allowed = (*EXTENSIONS, *IMAGES) if ocr else EXTENSIONS
    name = basename(path)
    return F.when(name.rlike(LOCK_FILE), "lock file").when(name.rlike(BACKUP_FILE), "backup file").when(~suffix(path).isin(*allowed), "unsupported type").when(length > MOST_BYTES, "too large").when(length == 0, "empty").otherwise(F.lit(None).cast("string"))


def diff(known: DataFrame, scan: DataFrame) -> DataFrame:
    """file_path and its state: new, unchanged (hash), touched (only the time), changed, removed; pending if known but not indexed. A file without a hash could not be read: unreadable.

    known: file_path, file_hash, last_modified, processing_status; scan: file_path, file_hash, last_modified.
    """
    k = known.select("file_path", F.col("file_hash").alias("old_hash"), F.col("last_modified").alias("old_time"), F.col("processing_status").alias("status"))
    both = scan.select("file_path", "file_hash", "last_modified", F.lit(True).alias("there")).join(k, "file_path", "full_outer")
    apart = F.abs(F.unix_micros("last_modified") - F.unix_micros("old_time")) / 1e6
    state = F.when(F.col("there").isNull(), "removed").when(F.col("file_hash").isNull(), "unreadable").when(F.col("old_hash").isNull(), "new").when(F.col("status") != "indexed", "pending").when(F.col("file_hash") != F.col("old_hash"), "changed").when(apart < SAME_SECONDS, "unchanged").otherwise("touched")
    return both.select("file_path", state.alias("state"))


def to_resume(known: DataFrame, scan: DataFrame) -> DataFrame:
    """Scanned files that still need their content read: all but indexed ones whose time is the same within two seconds."""
    done = known.filter("processing_status = 'indexed'").select(F.col("file_path").alias("p"), F.col("last_modified").alias("t"))
    return scan.join(done, (F.col("file_path") == F.col("p")) & (F.abs(F.unix_micros("last_modified") - F.unix_micros("t")) < SAME_SECONDS * 1e6), "left_anti")


def upsert(docs: DataFrame, rows: DataFrame, as_of: str) -> DataFrame:
    """docs after rows (file_path, file_hash, file_type, file_size, last_modified, content_preview, document_category, chunks_count, processing_status).

    Known paths keep id, file_type and indexed_at, and their category unless the new one is known. Of repeated new paths the last modified wins.
    """
    newest = Window.partitionBy("file_path").orderBy(F.desc("last_modified"), F.desc("file_hash"))
    new = rows.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")
    now = F.to_timestamp(F.lit(as_of))
    o, n = docs.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.file_path") == F.col("n.file_path"), "full_outer")
    given = F.col("n.file_path").isNotNull()
    pick = lambda c: F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(
        F.coalesce("o.id", F.xxhash64("n.file_path")).alias("id"), F.coalesce("o.file_path", "n.file_path").alias("file_path"), pick("file_hash"),
        F.coalesce("o.file_type", "n.file_type").alias("file_type"), pick("file_size"), pick("last_modified"), pick("content_preview"),
        F.coalesce("n.document_category", "o.document_category").alias("document_category"), pick("chunks_count"), pick("processing_status"),
        F.when(F.col("o.file_path").isNull(), now).otherwise(F.col("o.indexed_at")).alias("indexed_at"),
    )


def metadata_only(scan: DataFrame) -> DataFrame:
    """Rows for upsert before contents are read."""
    return scan.select("file_path", "file_hash", "file_type", "file_size", "last_modified", F.lit("").alias("content_preview"), F.lit(None).cast("string").alias("document_category"), F.lit(0).alias("chunks_count"), F.lit("metadata_only").alias("processing_status"))


def set_indexed(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """docs with the given paths marked indexed; rows in error stay in error."""
    hit = paths.select(F.col("file_path").alias("_p"), F.lit(True).alias("_hit")).distinct()
    status = F.when(F.col("_hit") & (F.col("processing_status") != "error"), "indexed").otherwise(F.col("processing_status"))
    return docs.join(hit, docs["file_path"] == hit["_p"], "left").withColumn("processing_status", status).drop("_p", "_hit")


def without(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """rows whose file_path is not among paths: deletion from any table, postings and vectors included."""
    return rows.join(paths.select("file_path"), "file_path", "left_anti")


def replace_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks with all chunks of the given documents (file_path, text) replaced, so that a shrunken file leaves none behind."""
    return without(chunks, docs).unionByName(with_keys(prose_chunks(docs)).select(chunks.columns))


def rename(rows: DataFrame, old: str, new: str) -> DataFrame:
    """A moved file or folder in any table with file_path."""
    p = F.col("file_path")
    return rows.withColumn("file_path", F.when(p == old, F.lit(new)).when(p.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new.rstrip("/")), F.substr(p, F.lit(len(old.rstrip("/")) + 1)))).otherwise(p))


def run(known: DataFrame, chunks: DataFrame, scan: DataFrame, read: Callable[[DataFrame], DataFrame], as_of: str, sheets: Callable[[DataFrame], DataFrame] | None = None, taxonomy: tuple[str, ...] = (), force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) after a scan (file_path, file_hash, file_type, file_size, last_modified, reject_reason and what `read` needs).

    Accepted files that are new, changed or not indexed yet (all, if forced) are read by `read` (file_path, text), spreadsheets by `sheets` (file_path,
    sheet, row_no, cells), and chunked; their old chunks go. Files without any text become errors, also on a later run, until they change.
    Each file is read once: texts and chunks are stored in the shared folder before anything is derived from them. Unchanged files cost neither reading nor chunking; a second run over the same scan changes nothing. Files that the scan does not have stay.
    """
    good = scan.filter("reject_reason is null")
    done = known.filter("processing_status in ('indexed', 'error')").select("file_path", "file_hash")
    work = good if force else good.join(done, ["file_path", "file_hash"], "left_anti")
    prose = stored(read(work).select("file_path", "text").filter(F.trim("text") != ""), "texts")  # a reader sees each file once, whatever is made of its text
    made = prose_chunks(prose)
    if sheets is not None:
        made = made.unionByName(sheet_chunks(stored(sheets(work), "cells")))
    made = stored(made, "chunks")
    counts = made.groupBy("file_path").agg(F.count("*").cast("int").alias("chunks_count"), F.min_by("text", "chunk_id").alias("first"))
    titles = prose.select("file_path", layout_preview(F.col("text"), PREVIEW).alias("shown"), document_title(F.col("text"), list(taxonomy)).alias("document_category"))
    rows = work.select("file_path", "file_hash", "file_type", "file_size", "last_modified").join(counts, "file_path", "left").join(titles, "file_path", "left")
    rows = rows.select(
        "file_path", "file_hash", "file_type", "file_size", "last_modified", F.coalesce("shown", F.substring("first", 1, SHEET_PREVIEW), F.lit("")).alias("content_preview"), "document_category",
        F.coalesce("chunks_count", F.lit(0)).alias("chunks_count"), F.when(F.col("chunks_count") > 0, "indexed").otherwise("error").alias("processing_status"),
    )
    return upsert(known, rows, as_of), without(chunks, work).unionByName(with_keys(made).select(chunks.columns))


def removed(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """All tables without some files: by file_path, or by the path in chunk_key where a table has only that (postings, vectors)."""
    path = F.regexp_extract("chunk_key", r"^(.*):[^:]*$", 1)
    gone = paths.select(F.col("file_path").alias("_gone")).distinct()
    return {k: t.join(gone, (F.col("file_path") if "file_path" in t.columns else path) == F.col("_gone"), "left_anti") for k, t in tables.items()}


def cleared(tables: dict[str, DataFrame], keep: tuple[str, ...] = ("sessions", "messages")) -> dict[str, DataFrame]:
    """All tables emptied but those to keep."""
    return {k: t if k in keep else t.limit(0) for k, t in tables.items()}


def latest_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks after new rows with the same columns, the new ones winning by chunk_key."""
    both = chunks.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("chunk_key").orderBy(F.desc("_new"), F.desc("text"))
    return both.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", "_new")
