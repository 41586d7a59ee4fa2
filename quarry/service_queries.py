"""Registered queries of sources, sinks, answers, history and streaming pieces, over whole tables like those in `queries`."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import text as tx
from .functions.batches import each, gathered
from .operators import catalog, chats, edit, ingest
from .operators import retrieval as rt
from .plans import history as hist
from .plans.engine import Corpus
from .queries import AS_OF, _both, _documents_as_chunks, _query_vector, _scan, _ts, _vectors
from .session import table
from .sources import files, office, office_write
from .streaming import events as ev
from .streaming import status as st

STAMP = "2024-01-05 00:00:00"


# --- sources ----------------------------------------------------------------------------------------------------------------


def _as_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of a scan: some locked, backed up, of other types, too large."""
    number = F.col("doc_id").cast("string")
    kind = F.when(F.col("doc_id") % 7 == 1, ".pdf").when(F.col("doc_id") % 7 == 2, ".EXE").when(F.col("doc_id") % 7 == 3, "").when(F.col("doc_id") % 11 == 5, ".20240101_101010.bak.txt").otherwise(".TXT")
    name = F.concat(F.when(F.col("doc_id") % 13 == 4, "~$").otherwise(""), F.lit("doc_"), number, kind)
    size = F.when(F.col("doc_id") % 17 == 6, 60 << 20).otherwise(F.octet_length("text")).cast("long")
    return table(spark, sf, "documents").select(F.concat(F.lit("file:/scan/"), name).alias("path"), F.to_timestamp(F.lit(STAMP)).alias("modificationTime"), size.alias("length"), F.encode("text", "UTF-8").alias("content"))


def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    return files.described(_as_files(spark, sf)).select("file_path", "file_name", "file_type", "file_size", "size_mb", "file_hash", "reject_reason")


def plain_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every third file is not UTF-8 but Latin-1, with a letter that shows it."""
    rows = _as_files(spark, sf)
    odd = F.encode(F.lit("é "), "ISO-8859-1")
    third = F.pmod(F.length("path"), F.lit(3)) == 0
    rows = rows.withColumn("content", F.when(third, F.concat(odd, F.encode(F.regexp_replace(F.decode("content", "UTF-8"), r"[^\x20-\x7E]", "?"), "ISO-8859-1"))).otherwise(F.col("content")))
    return files.plain_text(files.described(rows)).select("file_path", F.sha2("text", 256).alias("text_sha256"))


def scan_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after a second scan, before contents are read."""
    known, scan = fx.indexed_documents(spark, sf).drop("text"), _scan(spark, sf).withColumn("reject_reason", F.when(F.col("id") % 19 == 0, "too large"))
    docs, _ = files.scan_and_upsert(known, scan, AS_OF)
    return docs.select("file_path", "processing_status", "chunks_count", "file_hash")


def cached_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.indexed_documents(spark, sf).select("id", "file_hash", "last_modified", F.when(F.col("id") % 3 == 0, F.lit(" ")).otherwise(F.col("text")).alias("text"))
    cache = fx.indexed_documents(spark, sf).filter("id % 2 = 0").select("file_hash", F.concat(F.lit("cached "), F.col("id").cast("string")).alias("cached_text"), (F.col("last_modified") + F.make_dt_interval(F.lit(0), F.col("id").cast("int") % 5 - 2)).alias("cached_at"))
    one = cache.groupBy("file_hash").agg(F.min("cached_text").alias("cached_text"), F.min("cached_at").alias("cached_at"))
    return files.with_cached_text(d, one).select("id", F.sha2("text", 256).alias("text_sha256"))


def scanned_files(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("file_path"), F.coalesce("text", F.lit("")).alias("text"))
    return files.scanned(pages, 120)


def page_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as placed lines of pages of four."""
    t = table(spark, sf, "conversations").filter("trim(text) <> ''")
    left = F.when(F.col("turn") % 4 == 0, 10).when(F.col("turn") % 4 == 1, 20).when(F.col("turn") % 4 == 2, 60).otherwise(5)
    width = F.when(F.col("turn") % 4 == 0, 80).when(F.col("turn") % 4 == 3, 90).otherwise(20)
    spans = t.select(F.col("conv_id").cast("string").alias("file_path"), (F.floor(F.col("turn") / 4) + 1).alias("page"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), left.alias("x0"), (left + width).alias("x1"), (F.col("turn") % 4 * 25).alias("y"), "text")
    return files.layout(spans).select("file_path", F.sha2("text", 256).alias("text_sha256"))


def _printable(c: str):
    return F.regexp_replace(c, r"[^\x20-\x7E]", " ")


def _written(rows: DataFrame, kind: str) -> DataFrame:
    """(file_path, lines) as Office files."""
    size = lambda lines: max(3, -(-len(lines) // office.MOST_SLIDES))
    make = {"docx": office_write.docx, "pptx": lambda lines: office_write.pptx([lines[i : i + size(lines)] for i in range(0, len(lines), size(lines))])}[kind]

    schema = pa.schema([("file_path", pa.string()), ("file_type", pa.string()), ("content", pa.binary())])

    def run(batches):
        for b in batches:
            yield from gathered(((p, kind, make(lines)) for p, lines in each(b)), schema, lambda r: len(r[2]))

    return rows.select("file_path", "lines").mapInArrow(run, "file_path string, file_type string, content binary")


def docx_texts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.split(_printable("text"), r"\. ").alias("lines"))
    return office.texts(_written(lines, "docx")).select("file_path", F.sha2("text", 256).alias("text_sha256"), "failure")


def pptx_texts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.split(_printable("text"), r"\. ").alias("lines"))
    return office.texts(_written(lines, "pptx")).select("file_path", F.sha2("text", 256).alias("text_sha256"), "failure")


def xlsx_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook for each nation, its suppliers in one sheet, read back."""
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("file_path"), F.col("s_suppkey").alias("k"), F.array(F.col("s_suppkey").cast("string"), F.trim("s_name")).alias("cells"))
    books = rows.groupBy("file_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "cells"))), lambda x: x["cells"]).alias("rows"))  # a nation's suppliers fit one workbook

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"file_path": pdf["file_path"], "file_type": "xlsx", "content": [office_write.xlsx({"Suppliers & more": [list(r) for r in x]}) for x in pdf["rows"]]})

    return office.sheets(books.mapInPandas(run, "file_path string, file_type string, content binary")).select("file_path", "sheet", "row_no", F.array_join("cells", "|").alias("cells"))


# --- sinks ------------------------------------------------------------------------------------------------------------------


def mark_indexed(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.indexed_documents(spark, sf)
    return ingest.set_indexed(d, d.filter("id % 4 < 2").select("file_path")).groupBy("processing_status").agg(F.count("*").alias("documents"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as chunks of their conversations."""
    return table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("turn").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("chunk_key", F.concat_ws(":", "file_path", F.col("chunk_id").cast("string")))


def chunk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    return ingest.latest_chunks(t, t.filter("chunk_id % 2 = 0").withColumn("text", F.concat(F.lit("new "), F.length("text").cast("string")))).select("chunk_key", F.sha2("text", 256).alias("text_sha256"))


def bm25_without(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _documents_as_chunks(spark, sf)
    return rt.Bm25Index(chunks, keep=True).without(chunks.filter("chunk_key % 3 = 0")).term_stats().select("tok", "df", F.round("idf", 6).alias("idf"))


def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rt.Bm25Index(_documents_as_chunks(spark, sf)).stats()


def ingest_run(spark: SparkSession, sf: str) -> DataFrame:
    """The documents after a run over a second scan, in which some files have no text."""
    known, scan = fx.indexed_documents(spark, sf), _scan(spark, sf).withColumn("reject_reason", F.when(F.col("id") % 19 == 0, "too large"))
    texts = known.select("id", F.when(F.col("id") % 23 == 0, F.lit(" ")).otherwise(F.col("text")).alias("text"))
    none = spark.createDataFrame([], "chunk_key string, file_path string, chunk_id int, text string")
    docs, _ = ingest.run(known.drop("text"), none, scan, lambda work: work.join(texts, "id").select("file_path", "text"), AS_OF)
    return docs.select("file_path", "processing_status", "file_hash", _ts("indexed_at").alias("indexed_at"), (F.col("chunks_count") > 0).alias("has_chunks"))


def ingest_run_twice(spark: SparkSession, sf: str) -> DataFrame:
    """What a second run over the same scan would still read: nothing."""
    known, scan = fx.indexed_documents(spark, sf), fx.indexed_documents(spark, sf).withColumn("reject_reason", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "chunk_key string, file_path string, chunk_id int, text string")
    docs, chunks = ingest.run(known.drop("text").limit(0), none, scan, lambda work: work.select("file_path", "text"), AS_OF)
    again, more = ingest.run(docs, chunks, scan, lambda work: work.select("file_path", "text"), "2025-01-01 00:00:00")
    same = [c for c in docs.columns]
    return again.select(same).exceptAll(docs.select(same)).agg(F.count("*").alias("changed")).select("changed", (more.agg(F.count("*")).scalar() - chunks.agg(F.count("*")).scalar()).alias("more_chunks"))


def removed_files(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    postings = rt.Bm25Index(t).postings
    tables = ingest.removed({"chunks": t, "postings": postings}, t.filter("file_path like '%7.txt'").select("file_path"))
    kept = ingest.cleared({**tables, "sessions": fx.sessions(spark, sf)})
    count = lambda t: t.agg(F.count("*")).scalar()
    return spark.range(1).select(count(tables["chunks"]).alias("chunks"), count(tables["postings"]).alias("postings"), count(kept["chunks"]).alias("cleared"), count(kept["sessions"]).alias("sessions"))


def rename_folder(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.rename(fx.indexed_documents(spark, sf), "/corpus/en", "/corpus/english").select("id", "file_path")


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    made = F.array(F.struct(F.lit("the").alias("find"), F.lit("THE").alias("replace")), F.struct(F.lit(" ").alias("find"), F.lit("x").alias("replace")), F.struct(F.lit("en").alias("find"), F.lit("").alias("replace")))
    return fx.indexed_documents(spark, sf).select("id", F.when(F.col("id") % 3 == 0, F.regexp_replace("file_path", "txt$", "pdf")).otherwise(F.col("file_path")).alias("file_path"), F.col("text").alias("content"), made.alias("changes"))


def edit_proposals(spark: SparkSession, sf: str) -> DataFrame:
    p = edit.proposals(_changes(spark, sf), STAMP)
    return p.select("id", F.array_join(F.transform("changes", lambda c: c["find"]), "|").alias("finds"), "summary", _ts("expires_at").alias("expires_at"))


def edits_applied(spark: SparkSession, sf: str) -> DataFrame:
    rows = _changes(spark, sf)
    p = edit.proposals(rows, STAMP).withColumn("expires_at", F.when(F.col("id") % 5 == 0, F.to_timestamp(F.lit("2024-01-04 23:59:59"))).otherwise(F.col("expires_at")))
    return edit.applied_proposals(p, rows, STAMP).select("id", F.sha2("text", 256).alias("text_sha256"), "applied", "outcome")


def edit_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _changes(spark, sf).select("id", F.split("content", r"\. ").alias("paragraphs"), F.filter("changes", lambda c: F.trim(c["find"]) != "").alias("changes"))
    return edit.apply_to_paragraphs(rows).select("id", F.sha2(F.array_join("paragraphs", "\n"), 256).alias("text_sha256"), "applied")


def sessions_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions after one was added, one was named and one was deleted."""
    s = chats.set_title(chats.create_session(fx.sessions(spark, sf), -1, "/a/../dir/b/", STAMP), 7, "Seven", STAMP)
    s = chats.cascade_session(3, (s, "id"))[0]
    return s.select("id", "title", "directory_path", _ts("updated_at").alias("updated_at"))


def answers_set(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "events").selectExpr("event_id AS id", "cast(null as string) AS ai_response", "array(event_type) AS sources", "value AS response_time")
    a = m.filter("id % 4 = 1").select("id", F.concat(F.lit("answer "), F.col("id").cast("string")).alias("ai_response"), F.array().cast("array<string>").alias("sources"), F.lit(0.5).alias("response_time"))
    return chats.set_answers(m, a).select("id", "ai_response", F.size("sources").alias("n_sources"), F.round("response_time", 6).alias("response_time"))


def link_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Links of messages to the documents they cite, by session, as used from then on."""
    cited = F.array(F.struct(F.concat(F.lit("/corpus/en/src1/doc_"), (F.col("id") % 500).cast("string"), F.lit(".txt")).alias("file_path"), F.col("id").cast("string").alias("content_snippet")))
    docs = fx.indexed_documents(spark, sf)
    links, _ = chats.link_sources(fx.messages(spark, sf).withColumn("sources", cited), docs)
    return links.join(docs.select("id"), F.col("document_id") == F.col("id"), "left_semi").groupBy("document_id", "chat_session_id").agg(F.count("*").alias("uses"), _ts(F.max("used_at")).alias("last_used"))


# --- projections and filters ------------------------------------------------------------------------------------------------


def session_history(spark: SparkSession, sf: str) -> DataFrame:
    return chats.history(fx.messages(spark, sf), 5).select("id", _ts("timestamp").alias("timestamp"))


def one_document(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.indexed_documents(spark, sf)
    path = "/corpus/en/src1/doc_1.txt"
    return catalog.by_id(d, 3).select("id", "file_path").unionAll(catalog.by_path(d, path).select("id", "file_path")).unionAll(catalog.by_id(d, -1).select("id", "file_path"))


def docs_in_error(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_status(fx.indexed_documents(spark, sf), "error", "metadata_only", most=40).select("id", "processing_status")


def layout_previews(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as marked pages: a heading, two columns and a second page."""
    part = lambda a, n: F.regexp_replace(F.substring("flat", a, n), r"^ +| +$", "")
    marked = F.concat(F.lit("[Page 1]\n[Region: full]\n"), part(1, 300), F.lit("\n[Region: left]\n"), part(301, 100), F.lit("\n[Region: right]\n"), part(401, 50), F.lit("\n\n[Page 2]\n[Region: full]\nmore"))
    d = table(spark, sf, "documents").filter("length(text) > 600").select("doc_id", F.regexp_replace("text", r"[\x09-\x0D ]+", " ").alias("flat"))
    return d.select("doc_id", tx.layout_preview(F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.col("flat"))).alias("preview"))


def suggestion_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = F.regexp_replace(F.regexp_replace("text", r"[\x09-\x0D \"']+", " "), r"\?", "")
    said = F.concat(F.lit("- "), F.substring(line, 1, 30), F.lit("?\n2) \"Is it so?\"\n* no question\n1. Hm?\n•  "), F.substring(line, 31, 20), F.lit("?"))
    return table(spark, sf, "conversations").filter("length(text) > 60").select("conv_id", "turn", F.array_join(tx.clean_lines(said, 8, 4), "|").alias("lines"))


def tool_results(spark: SparkSession, sf: str) -> DataFrame:
    row = F.struct(F.col("id"), F.col("file_type"))
    return fx.indexed_documents(spark, sf).select("id", tx.tool_result(row, F.col("id") % 2 == 0).alias("result"))


def listing_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.indexed_documents(spark, sf)
    return catalog.listed_rows(d, hist.listing_budget("groq", 150), ["report"]).drop("relevance_score")


def category_answers(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.indexed_documents(spark, sf)
    asked = [("draft", d, ["draft"]), ("unknown", d, ["INVOICE"]), ("nothing", d.withColumn("document_category", F.lit(" ")), ["draft"])]
    out = [catalog.category_answer(x, types).select(F.lit(name).alias("asked"), "kind", "documents") for name, x, types in asked]
    return out[0].unionAll(out[1]).unionAll(out[2])


def first_page_progress(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.first_page_progress(fx.indexed_documents(spark, sf))


def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    return hist.token_usage(table(spark, sf, "events").selectExpr("user_id AS prompt_tokens", "CASE WHEN event_id % 3 > 0 THEN event_id END AS completion_tokens"))


def prompt_cuts(spark: SparkSession, sf: str) -> DataFrame:
    long = F.repeat(F.col("text"), 3)
    return table(spark, sf, "documents").select("doc_id", F.sha2(hist.truncated_prompt(long, "groq"), 256).alias("prompt_sha256"), F.lit(hist.listing_budget("openai", 600)).alias("budget"), F.lit(hist.limit("gemini", "context")).alias("most"))


def calendar_dates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", tx.calendar_date(F.col("o_orderdate").cast("timestamp")).alias("day"))


def snippet_positions(spark: SparkSession, sf: str) -> DataFrame:
    near = F.concat(F.substr("text", F.lit(50), (F.lit(30) + F.col("doc_id") % 2 * 60).cast("int")), F.lit(" and so on"))
    snippet = F.when(F.col("doc_id") % 5 == 0, F.lit("nowhere to be found, ever")).otherwise(near)
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", tx.snippet_position(F.col("text"), snippet).alias("place"))


def shown_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(tx.shown_number((F.col("l_quantity") * F.col("l_discount") * 4).cast("double")).alias("shown")).groupBy("shown").agg(F.count("*").alias("cells"))


# --- answers ----------------------------------------------------------------------------------------------------------------


def whole_files(spark: SparkSession, sf: str) -> DataFrame:
    return rt.whole_file(_turns(spark, sf), "c3.txt", 400)


def compressed_context(spark: SparkSession, sf: str) -> DataFrame:
    chunks, s, w = _both(spark, sf, 40)
    rows = rt.hybrid(chunks, s, w, rt.POLICIES["search"])
    return rt.compressed(rows, extract=lambda t: F.substring(t, 11, 500)).select("chunk_key", F.sha2("text", 256).alias("text_sha256"))


def answer_selected(spark: SparkSession, sf: str) -> DataFrame:
    chunks, s, w = _both(spark, sf, 40)
    policy = rt.POLICIES["search"]
    blocks = rt.answer_blocks(rt.hybrid(chunks, s, w, policy), chunks, policy, selected=("/en/", "/de/"))
    return blocks.select("file_path", F.sha2("block", 256).alias("block_sha256"), "relevance_score", "chunks_found")


def answer_single_file(spark: SparkSession, sf: str) -> DataFrame:
    """A source asked for by name: the whole context if most hits are in it, all of its chunks in order."""
    chunks, s, w = _both(spark, sf, 40)
    chunks = chunks.withColumn("file_path", F.concat(F.lit("/corpus/"), F.regexp_extract("file_path", r"([^/]*)$", 1))).withColumn("chunk_id", F.col("chunk_key"))
    policy = rt.POLICIES["file"]
    blocks = rt.answer_blocks(rt.hybrid(chunks, s, w, policy, "SRC1"), chunks, policy, explicit=True)
    return blocks.select("file_path", F.sha2("block", 256).alias("block_sha256"), "relevance_score", "content_snippet", "chunks_found")


def joined_context(spark: SparkSession, sf: str) -> DataFrame:
    chunks, s, w = _both(spark, sf, 40)
    return rt.joined_context(rt.context_blocks(rt.hybrid(chunks, s, w, rt.POLICIES["search"]))).select(F.sha2("context", 256).alias("context_sha256"))


def semantic_only(spark: SparkSession, sf: str) -> DataFrame:
    chunks, s = _documents_as_chunks(spark, sf), rt.cosine_topk(_vectors(spark, sf), _query_vector(spark, sf), 40)
    return rt.hybrid(chunks, s, None, rt.POLICIES["search"]).select("pos", "chunk_key", F.round("score", 6).alias("score"))


def files_named(spark: SparkSession, sf: str) -> DataFrame:
    return rt.files_named(_turns(spark, sf), "C12")


def hashed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of the default vectors: 1, or 0 where a text has no token."""
    v = rt.hashed_vectors(_documents_as_chunks(spark, sf))
    return v.select("chunk_key", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"))


def _corpus(spark: SparkSession, sf: str) -> Corpus:
    docs = fx.indexed_documents(spark, sf)
    chunks = docs.select(F.col("file_path").alias("chunk_key"), "file_path", F.lit(0).alias("chunk_id"), "text")
    return Corpus(docs, chunks, taxonomy=("REPORT", "DRAFT", "INVOICE"), keyword_index=False)


def ask_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to questions for categories, one of which nobody has, and to a greeting."""
    corpus = _corpus(spark, sf)
    found = [(q, corpus.ask(q)) for q in ("what are our reports", "how many invoices do we have", "hello")]
    return spark.createDataFrame([(q, a.query_type, a.message, a.retrieval_count) for q, a in found], "question string, query_type string, message string, found long")


# --- history ----------------------------------------------------------------------------------------------------------------


def history_rows(spark: SparkSession, sf: str) -> DataFrame:
    return hist.history(chats.message_pairs(table(spark, sf, "conversations")), keep=1).select("session_id", "position", "role", F.sha2("content", 256).alias("content_sha256"))


def model_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = hist.messages("Be brief.", hist.history(chats.message_pairs(table(spark, sf, "conversations")), keep=2), "and now?")
    return rows.select("session_id", F.size("messages").alias("n"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"), 256).alias("messages_sha256"))


def last_sources(spark: SparkSession, sf: str) -> DataFrame:
    cited = F.when(F.col("id") % 3 > 0, F.array(F.struct(F.lit(" ").alias("file_path")), F.struct(F.concat(F.lit("/d/"), F.col("id").cast("string")).alias("file_path")))).otherwise(F.array().cast("array<struct<file_path:string>>"))
    return chats.last_source(fx.messages(spark, sf).withColumn("sources", cited))


# --- streaming pieces -------------------------------------------------------------------------------------------------------


def accepted_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ".exe").otherwise(".TXT")).alias("file_path"), F.when(F.col("event_type") == "error", "moved").when(F.col("event_type") == "signup", "deleted").otherwise("modified").alias("event_type"), F.concat(F.lit("g"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("target"), F.col("ts").cast("timestamp").alias("ts"))
    return ev.accepted(e).groupBy("file_path", "event_type").agg(F.count("*").alias("events"))


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("id") % 6 == 0, "active").when(F.col("id") % 6 == 1, "completed").otherwise("pending")
    return ev.enqueued(fx.indexed_documents(spark, sf).select("id", "file_path", "file_size", "last_modified"), AS_OF).join(fx.indexed_documents(spark, sf).select("id", F.col("file_path").alias("p")), F.col("file_path") == F.col("p")).withColumn("state", state).drop("id", "p")


def enqueued_files(spark: SparkSession, sf: str) -> DataFrame:
    return ev.enqueued(fx.indexed_documents(spark, sf).withColumn("file_size", F.col("file_size") * 20_000), "2024-01-03 00:00:00").select("file_path", "priority")


def tasks_taken(spark: SparkSession, sf: str) -> DataFrame:
    return ev.active(ev.taken(_tasks(spark, sf), 25)).select("file_path", "state")


def queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("completed")
    return ev.queue_status(table(spark, sf, "events").select(status.alias("status")))


def status_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events that differ from the one before."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return st.changed(rows, "user_id", ("ts", "event_id"), "event_type").select("event_id", "user_id", "event_type")


def waiting_events(spark: SparkSession, sf: str) -> DataFrame:
    return ev.waiting(fx.file_events(spark, sf).select(F.concat("file_path", F.lit("#"), F.col("event_id").cast("string")).alias("file_path"), "event_type", "ts")).select("file_path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_files, plain_texts, scan_resume, cached_texts, scanned_files, page_layout, docx_texts, pptx_texts, xlsx_rows, mark_indexed, chunk_upsert, bm25_without, bm25_stats, ingest_run, ingest_run_twice,
        removed_files, rename_folder, edit_proposals, edits_applied, edit_paragraphs, sessions_changed, answers_set, link_rows, session_history, one_document, docs_in_error, layout_previews, suggestion_lines,
        tool_results, listing_rows, category_answers, first_page_progress, token_usage, prompt_cuts, calendar_dates, snippet_positions, shown_numbers, whole_files, compressed_context, answer_selected,
        answer_single_file, joined_context, semantic_only, files_named, hashed_vectors, ask_listing, history_rows, model_messages, last_sources, accepted_events, enqueued_files, tasks_taken,
        queue_counts, status_rows, waiting_events,
    )
}
