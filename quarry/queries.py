"""Registered queries: each applies operators of this package to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixtures as fx
from .functions import text as tx
from .operators import catalog, chats, chunking, edit, ingest
from .operators import retrieval as rt
from .plans import questions as nl
from .session import table
from .streaming import events as ev

AS_OF = "2024-01-30 00:00:00"
#: The newest orders, and so the fixed present of session queries.
SESSIONS_AS_OF = "1998-08-02 00:00:00"
KEYWORDS = "en thle est la the tion"
TAXONOMY = ["INVOICE", "DELIVERY-NOTE", "All rights reserved."]
QUESTIONS = [
    "hi", "Hello there!", "what's up?", "How are you", "thanks", "good morning", "", "   ", "ok cool great nice thanks", "What can you do?", "who are you", "help", "Help me",
    "how does this work", "what are your features", "tell me about yourself", "list all documents", "show me the files", "what documents do we have?", "what is in the folder",
    "overview of our files", "describe all documents", "how many files do we have", "how many delivery receipts do we have?", "count invoices", "what are our delivery receipts",
    "what are the total costs", "show me all the permits", "total value of all invoices", "sum of all receipts", "list all contracts by date", "combined amount of the orders",
    "add up all payments", "overall cost of permits", "what are our options?", "which file mentions cement?", "explain this document", "summarise that file", "what does it say",
    "when was that delivered?", "is it the case that this very long question about something else should stay", "open report.PDF please", 'compare "annual plan 2023" with it',
    "see notes.v2.txt", "what is BIP-12046", "how many delivery-notes are there", "what invoices do we have", "give me an invoice",
]


def _ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "id long, question string")


def _talk(spark: SparkSession, sf: str) -> DataFrame:
    """The questions alone, and one for each turn of a user, every second one with what the user said after it."""
    asked = _questions(spark)
    turns = table(spark, sf, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn") + 1000).alias("id"), "text", "conv_id", ((F.col("conv_id") + F.col("turn")) % len(QUESTIONS)).alias("k"))
    said = turns.join(F.broadcast(asked.withColumnRenamed("id", "k")), "k")  # a question list
    return asked.unionByName(said.select("id", F.when(F.col("conv_id") % 2 == 0, F.col("question")).otherwise(F.concat("question", F.lit(" "), "text")).alias("question")))


def doc_search_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search(fx.indexed_documents(spark, sf), limit=50, offset=20, query="src1", file_type="EN")


def doc_search_date_range(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search(fx.indexed_documents(spark, sf), limit=30, date_from="2024-01-05T00:00:00Z", date_to="2024-01-20", query="")


def docs_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_type(fx.indexed_documents(spark, sf), ".De").select("id", "file_path", _ts("indexed_at").alias("indexed_at"))


def recent_docs(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.recent(fx.indexed_documents(spark, sf), AS_OF, 7).select("id", "file_path")


def list_documents(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.listing(fx.indexed_documents(spark, sf))


def docs_under_directory(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.under(fx.indexed_documents(spark, sf), "/corpus/en/src1").agg(F.count("*").alias("documents"), (F.count("*") > 0).alias("found"))


def stats_by_status_type(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.breakdown(fx.indexed_documents(spark, sf))


def file_size_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.number_stats(fx.indexed_documents(spark, sf), "file_size")


def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.number_stats(fx.indexed_documents(spark, sf), "chunks_count")


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.index_stats(fx.indexed_documents(spark, sf))


def index_progress(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.progress(fx.indexed_documents(spark, sf))


def corpus_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.metadata(fx.indexed_documents(spark, sf)).select("file_type", "documents", _ts("oldest").alias("oldest"), _ts("newest").alias("newest"))


def corpus_summary_text(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.summary(fx.indexed_documents(spark, sf))


def distinct_types(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.file_types(fx.indexed_documents(spark, sf))


def ui_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ui_filter(fx.indexed_documents(spark, sf), "Doc_12", "fr").select("id", "file_path")


def ui_sort(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ui_sort(fx.indexed_documents(spark, sf), "size", descending=True).select("id", "file_path", "file_size")


def folder_tree(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.tree_order(catalog.folder_tree(fx.indexed_documents(spark, sf)))


def filename_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_prefix(fx.indexed_documents(spark, sf), " DOC_7", "txt")


def autocomplete(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.autocomplete(fx.indexed_documents(spark, sf), "doc_1")


def trie_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.name_stats(fx.indexed_documents(spark, sf))


def category_listing(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.category_listing(fx.indexed_documents(spark, sf), ["draft"])


def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.indexed_documents(spark, sf).select(F.col("file_size").alias("length"), F.col("last_modified").alias("modified"))
    return catalog.cache_stats(files, AS_OF)


def session_message_counts(spark: SparkSession, sf: str) -> DataFrame:
    uses = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"))
    return chats.sessions_with_counts(fx.sessions(spark, sf), uses).select("id", "title", _ts("updated_at").alias("updated_at"), "message_count")


def message_totals(spark: SparkSession, sf: str) -> DataFrame:
    return chats.message_totals(fx.messages(spark, sf), fx.sessions(spark, sf)).withColumn("average_response_time", F.round("average_response_time", 6))


def week_activity(spark: SparkSession, sf: str) -> DataFrame:
    return chats.recent_activity(fx.messages(spark, sf), fx.sessions(spark, sf), AS_OF)


def daily_message_counts(spark: SparkSession, sf: str) -> DataFrame:
    return chats.daily(fx.messages(spark, sf), AS_OF).select(F.col("day").cast("string").alias("day"), "messages")


def response_trend(spark: SparkSession, sf: str) -> DataFrame:
    return chats.daily(fx.messages(spark, sf), AS_OF, 14).select(F.col("day").cast("string").alias("day"), F.round("average_response_time", 6).alias("average_response_time"))


def active_directories(spark: SparkSession, sf: str) -> DataFrame:
    return chats.active_directories(fx.sessions(spark, sf), SESSIONS_AS_OF, 365)


def usage_upsert(spark: SparkSession, sf: str) -> DataFrame:
    links = fx.usage_links(spark, sf)
    old, new = links.filter("used_at < timestamp '1996-01-01'"), links.filter("used_at >= timestamp '1996-01-01'")
    nothing = spark.createDataFrame([], "document_id long, chat_session_id long, usage_count long, first_used timestamp, last_used timestamp")
    merged = chats.usage_merge(chats.usage_merge(nothing, old), new)
    return merged.select("document_id", "chat_session_id", "usage_count", _ts("first_used").alias("first_used"), _ts("last_used").alias("last_used"))


def most_used_docs(spark: SparkSession, sf: str) -> DataFrame:
    nothing = spark.createDataFrame([], "document_id long, chat_session_id long, usage_count long, first_used timestamp, last_used timestamp")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("file_path"))
    return chats.most_used(parts, chats.usage_merge(nothing, fx.usage_links(spark, sf)))


def chat_history_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return chats.message_pairs(table(spark, sf, "conversations"))


def chat_role_list(spark: SparkSession, sf: str) -> DataFrame:
    return chats.role_list(chats.message_pairs(table(spark, sf, "conversations")))


def last_six_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("position"), F.col("event_type").alias("user_message"))
    return chats.last_pairs(rows)


def last_message(spark: SparkSession, sf: str) -> DataFrame:
    return chats.last_message(fx.messages(spark, sf)).select("id", "session_id", _ts("timestamp").alias("timestamp"))


def chat_titles(spark: SparkSession, sf: str) -> DataFrame:
    return chats.titles(table(spark, sf, "conversations"))


def link_sources(spark: SparkSession, sf: str) -> DataFrame:
    cited = F.array(F.struct(F.concat(F.lit("/corpus/en/src1/doc_"), (F.col("id") % 50).cast("string"), F.lit(".txt")).alias("file_path"), F.col("id").cast("string").alias("content_snippet")))
    links, stubs = chats.link_sources(fx.messages(spark, sf).withColumn("sources", cited), fx.indexed_documents(spark, sf))
    return stubs.select("file_path", "content_preview", "processing_status")


def _documents_as_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_key"), "text", F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source").alias("file_path"), F.lit(0).alias("chunk_id"))


def tokenize_docs(spark: SparkSession, sf: str) -> DataFrame:
    t = tx.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha256"))


def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rt.Bm25Index(_documents_as_chunks(spark, sf), keep=True).term_stats().select("tok", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rt.Bm25Index(_documents_as_chunks(spark, sf), keep=True).search(KEYWORDS, 40).select("chunk_key", F.round("score", 6).alias("score"), "rank")


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    row = table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row["embedding"])


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_key"), "embedding")


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    out = rt.cosine_topk(_vectors(spark, sf), _query_vector(spark, sf), 40)
    return out.select("chunk_key", F.round(F.col("distance") + 0.0, 6).alias("distance"), F.round("base_score", 6).alias("base_score"), "rank")


def _both(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, semantic, keyword): documents stand for chunks, the vector of document d is that of vec_id d."""
    chunks = _documents_as_chunks(spark, sf)
    return chunks, rt.cosine_topk(_vectors(spark, sf), _query_vector(spark, sf), k), rt.Bm25Index(chunks, keep=True).search(KEYWORDS, k)


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    _, s, w = _both(spark, sf, 40)
    return rt.fuse(s, w).select("chunk_key", F.round("rrf_score", 9).alias("rrf_score"), "semantic_rank", "keyword_rank", "pos")


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    chunks, s, w = _both(spark, sf, 40)
    return rt.hybrid(chunks, s, w, rt.POLICIES["search"]).select("pos", "chunk_key", "file_path", F.round("score", 6).alias("score"))


def hybrid_filename_filter(spark: SparkSession, sf: str) -> DataFrame:
    chunks, s, w = _both(spark, sf, 40)
    return rt.hybrid(chunks, s, w, rt.POLICIES["file"], "SRC1").select("pos", "chunk_key", "file_path")


def aggregation_mode_topk(spark: SparkSession, sf: str) -> DataFrame:
    chunks, s, w = _both(spark, sf, 100)
    return rt.hybrid(chunks, s, w, rt.POLICIES["aggregation"]).select("pos", "chunk_key", "file_path")


def selected_files_first(spark: SparkSession, sf: str) -> DataFrame:
    chunks, s, w = _both(spark, sf, 40)
    return rt.prefer_files(rt.hybrid(chunks, s, w, rt.POLICIES["search"]), ["/en/", "/de/"]).select("pos", "chunk_key", "selected")


def single_file_mode(spark: SparkSession, sf: str) -> DataFrame:
    chunks, s, w = _both(spark, sf, 40)
    return rt.single_file(rt.hybrid(chunks, s, w, rt.POLICIES["search"]))


def source_rows(spark: SparkSession, sf: str) -> DataFrame:
    chunks, s, w = _both(spark, sf, 40)
    policy = rt.POLICIES["search"]
    return rt.sources(rt.context_blocks(rt.hybrid(chunks, s, w, policy)), policy)


def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("chunk_id"), "text", (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), (F.col("turn") / 10.0).alias("score"))
    return rt.context_blocks(turns).select("file_path", "pos", F.sha2("block", 256).alias("block_sha256"), "relevance_score", "content_snippet", "chunks_found")


def truncate_context(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.col("text").alias("block"))
    return rt.truncate_context(blocks, 500, 2)


def prose_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.indexed_documents(spark, sf).select("file_path", "text")
    return chunking.prose_chunks(docs)


def prose_chunks_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The chunker as a table function that SQL joins to the texts."""
    chunking.register_prose_chunks(spark)
    return spark.sql("SELECT d.file_path, c.* FROM {docs} d, LATERAL prose_chunks(d.text) c", docs=fx.indexed_documents(spark, sf).select("file_path", "text"))


def sheet_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").filter("l_linenumber is not null")
    cells = F.array(*[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_linestatus")])
    sheet = rows.select(F.concat(F.lit("/books/"), (F.col("l_suppkey") % 8).cast("string"), F.lit(".xlsx")).alias("file_path"), F.col("l_returnflag").alias("sheet"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 2 + (F.col("l_linestatus") == "O").cast("int")).alias("row_no"), cells.alias("cells"))
    return chunking.sheet_chunks(sheet).select("file_path", "chunk_id", "text", "end_pos", "total_chunks")


def page_lookup(spark: SparkSession, sf: str) -> DataFrame:
    marked = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Intro. "), F.regexp_replace("text", "\\. ", ". [Page 3] ")).alias("t"))
    places = marked.select("doc_id", F.explode(F.array(*[F.lit(x) for x in (0, 50, 100, 400, 2000)])).alias("pos"), F.regexp_count("t", F.lit(chunking.PAGE)).cast("long").alias("marks"))
    return chunking.pages_at(chunking.page_marks(marked, "doc_id", "t"), places, "doc_id").select("doc_id", F.col("pos").alias("place"), "marks", "page")


def doc_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.document_title(F.col("text"), TAXONOMY).alias("title"))


def listing_previews(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.indexed_documents(spark, sf)
    return docs.select("id", tx.listing_preview(F.col("processing_status"), F.col("content_preview"), F.col("chunks_count"), tx.basename(F.col("file_path")), 120).alias("preview"))


def classify_questions(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn") + 1000).alias("id"), F.col("text").alias("question"))
    return _questions(spark).unionByName(asked).select("id", nl.route(F.col("question")).alias("route"))


def rewrite_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _talk(spark, sf).select("id", nl.rewritten(F.col("question"), F.lit("Plan.pdf")).alias("question"))


def aggregation_intent(spark: SparkSession, sf: str) -> DataFrame:
    return _talk(spark, sf).select("id", nl.is_aggregation(F.col("question")).alias("aggregation"))


def detect_filename(spark: SparkSession, sf: str) -> DataFrame:
    return _talk(spark, sf).select("id", nl.explicit_file(F.col("question")).alias("file_name"))


def category_intent(spark: SparkSession, sf: str) -> DataFrame:
    found = nl.categories(F.col("question"), ["INVOICE", "DELIVERY-NOTE", "DELIVERY RECEIPT", "PERMIT"])
    return _talk(spark, sf).select("id", nl.category_label(found).alias("label"))


def coalesce_events(spark: SparkSession, sf: str) -> DataFrame:
    return ev.coalesce(fx.file_events(spark, sf), "2 hours").select("file_path", "event_type", _ts("last_ts").alias("last_ts"), "events")


def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts from a stream of the events; the newest days stay open until the watermark passes them, so the stream runs in complete mode."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(_folder(sf, "events"))
    timed = stream.selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type")
    return ev.collected(ev.window_counts(timed), "complete").select(_ts("window_start").alias("window_start"), "event_type", "events")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """First sight of each content of a file, from a stream."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(_folder(sf, "events"))
    changes = stream.selectExpr("concat('f', user_id) AS file_path", "event_type AS file_hash", "CAST(ts AS TIMESTAMP) AS ts")
    return ev.collected(ev.first_of_content(changes, "60 days")).select("file_path", "file_hash")


def _folder(sf: str, name: str) -> str:
    """A glob that file streams accept for a table, be it a file or a folder."""
    return f"{sf}/{name}.parque[t]"


def update_priority(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    p = ev.priority(F.col("n_chars") * 5000, F.col("doc_id") % 60, F.col("doc_id") % 3 == 0, (F.col("doc_id") % 11) / 10.0, F.col("doc_id") % 97 == 0)
    return d.select("doc_id", p.alias("priority"))


def update_queue(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "events").select(F.concat(F.lit("f"), "user_id").alias("file_path"), (F.col("event_id") % 1000).cast("int").alias("priority"), F.col("event_id").alias("enqueued_at"))
    return ev.queue(tasks)


def queue_retention(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("completed")
    return ev.retained(table(spark, sf, "events").select(F.col("event_id").alias("task_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("completed_at"))).select("task_id", "status")


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    """A second scan of the documents: some gone, some new, some changed, some only touched."""
    d = fx.indexed_documents(spark, sf).filter("id % 13 <> 5")
    moved = F.when(F.col("id") % 17 == 2, F.concat("file_path", F.lit(".new.txt"))).otherwise(F.col("file_path"))
    hashed = F.when(F.col("id") % 7 == 3, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("file_hash"))
    touched = F.when(F.col("id") % 5 == 1, F.col("last_modified") + F.make_dt_interval(F.lit(1))).otherwise(F.col("last_modified"))
    return d.select("id", moved.alias("file_path"), hashed.alias("file_hash"), "file_type", "file_size", touched.alias("last_modified"))


def ingest_diff(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.diff(fx.indexed_documents(spark, sf), _scan(spark, sf))


def ingest_resume(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.to_resume(fx.indexed_documents(spark, sf), _scan(spark, sf)).select("file_path")


def ingest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.indexed_documents(spark, sf).drop("text")
    new = ingest.metadata_only(_scan(spark, sf)).withColumn("document_category", F.when(F.length("file_path") % 2 == 0, "NEW"))
    out = ingest.upsert(docs, new, AS_OF)
    return out.select("file_path", "file_hash", "document_category", "processing_status", "chunks_count", _ts("last_modified").alias("last_modified"), _ts("indexed_at").alias("indexed_at"))


def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.indexed_documents(spark, sf)
    return ingest.without(docs, docs.filter("id % 3 = 0")).groupBy("file_type").agg(F.count("*").alias("documents"), F.sum("chunks_count").alias("chunks"))


def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """A file for every document: by its id a lock or backup file, of some type in either case, of no size, its text's size or one about the limit."""
    of = lambda k, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % k).cast("int") + 1)
    name = F.concat(F.lit("/a.b/"), of(3, "", "", "~$"), F.col("doc_id").cast("string"), of(5, "", ".20240101_101010.bak", "", ".x.bak", ""), of(7, ".docx", ".exe", ".PDF", ".txt", "", ".png", ".xls"))
    size = F.when(F.col("doc_id") % 11 == 0, 0).when(F.col("doc_id") % 11 < 3, (50 << 20) + F.col("doc_id") % 2).otherwise(F.col("n_chars")).cast("long")
    files = table(spark, sf, "documents").select(name.alias("file_path"), size.alias("length"))
    return files.select("file_path", "length", ingest.reject_reason(F.col("file_path"), F.col("length")).alias("reason"))


def edit_apply_counts(spark: SparkSession, sf: str) -> DataFrame:
    change = T.ArrayType(T.StructType([T.StructField("find", T.StringType()), T.StructField("replace", T.StringType())]))
    changes = F.lit('[{"find":"the","replace":"THE"},{"find":"THE ","replace":""},{"find":"e ","replace":"_"},{"find":" ","replace":"dropped"},{"find":"never there","replace":"x"}]')
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.from_json(changes, change).alias("changes"))
    return edit.apply_changes(rows).select("id", F.sha2("text", 256).alias("text_sha256"), "applied")


def cell_values(spark: SparkSession, sf: str) -> DataFrame:
    """A cell for every line item, written in one of eight ways."""
    n, k = F.col("l_partkey").cast("string"), F.col("l_orderkey") % 8
    ways = (F.lit(None).cast("string"), F.lit("  "), F.concat(F.lit(" "), n, F.lit(" ")), F.concat(F.lit("-"), n), F.concat(n, F.lit(".50")), F.concat(F.col("l_returnflag"), n), F.concat(F.col("l_linenumber").cast("string"), F.lit("e3")), F.concat(n, F.lit(" "), n))
    value = F.coalesce(*(F.when(k == i, w) for i, w in enumerate(ways)))
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("sheet"), F.col("l_linenumber").cast("string").alias("cell"), value.alias("value"))
    return edit.typed_cells(cells)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        doc_search_page, doc_search_date_range, docs_by_type, recent_docs, list_documents, docs_under_directory, stats_by_status_type, file_size_stats, chunk_stats, index_stats, index_progress,
        corpus_metadata, corpus_summary_text, distinct_types, ui_filtered, ui_sort, folder_tree, filename_prefix, autocomplete, trie_stats, category_listing, cache_stats, session_message_counts,
        message_totals, week_activity, daily_message_counts, response_trend, active_directories, usage_upsert, most_used_docs, chat_history_pairs, chat_role_list, last_six_pairs, last_message, chat_titles,
        link_sources, tokenize_docs, bm25_term_stats, bm25_topk, cosine_topk, rrf_fuse, hybrid_topk, hybrid_filename_filter, aggregation_mode_topk, selected_files_first, single_file_mode, source_rows,
        context_blocks, truncate_context, prose_chunks, prose_chunks_sql, sheet_chunks, page_lookup, doc_title, listing_previews, classify_questions, rewrite_questions, aggregation_intent, detect_filename, category_intent,
        coalesce_events, stream_window_counts, stream_dedup, update_priority, update_queue, queue_retention, ingest_diff, ingest_resume, ingest_upsert, delete_cascade, reject_reasons, edit_apply_counts, cell_values,
    )
}
