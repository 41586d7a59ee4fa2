"""Properties and edge cases of catalog, retrieval, ingest, edit and streaming operators."""

import io
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from quarry.operators import catalog, chats, edit, ingest
from quarry.operators import retrieval as rt
from quarry.plans.engine import Corpus
from quarry.sources import files, office
from quarry.streaming import events as ev


def test_fusion_bounds_and_ties(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_key string, rank long")
    w = spark.createDataFrame([("c", 1), ("b", 2)], "chunk_key string, rank long")
    rows = rt.fuse(s, w).orderBy("pos").collect()
    assert [r["chunk_key"] for r in rows] == ["b", "a", "c"]
    assert max(r["rrf_score"] for r in rows) <= 1 / 61 + 1e-12


def test_diversity_and_name_filters(spark):
    rows = spark.createDataFrame([(i, "f" if i < 8 else f"g{i}") for i in range(14)], "pos int, file_path string")
    kept = rt.diversity_cap(rows, 6).orderBy("pos").collect()
    assert [r["pos"] for r in kept] == [0, 1, 2, 3, 8, 9]
    assert rt.diversity_cap(rows.filter("file_path = 'f'"), 3).count() == 8
    assert rt.filename_filter(rows, "G9").count() == 1 and rt.filename_filter(rows, "none").count() == 14


def test_semantic_side_must_find_something(spark):
    none = spark.createDataFrame([], "chunk_key string, rank long, base_score double")
    w = spark.createDataFrame([("c", 1)], "chunk_key string, rank long")
    assert rt.only_if_semantic(rt.fuse(none, w)).count() == 0


def test_single_file_rules(spark):
    rows = lambda *names: spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, file_path string")
    single = lambda df, **k: rt.single_file(df, **k).first()["single"]
    assert single(rows("a"))
    assert not single(rows(*"aaabb")) and single(rows(*"aaabb"), explicit=True)
    assert single(rows(*"aaaab")) and not single(rows(*"aaaab"), aggregation=True)


def test_context_truncation(spark):
    blocks = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "bbbb"), (2, 0, "c" * 20)], "id long, pos int, block string")
    got = {r["id"]: (r["context"], r["omitted"]) for r in rt.truncate_context(blocks, 9, 2).collect()}
    assert got == {1: ("aaaa", True), 2: ("c" * 9, True)}
    assert rt.truncate_context(blocks.filter("id = 1"), 10, 2).first()["context"] == "aaaa\n\nbbbb"


def test_bm25_of_empty_index_and_query(spark):
    chunks = spark.createDataFrame([("a", "cement cement"), ("b", None), ("c", "steel rods")], "chunk_key string, text string")
    index = rt.Bm25Index(chunks)
    assert index.search("").count() == 0
    assert [r["chunk_key"] for r in index.search("Cement rods").collect()] == ["a", "c"] or index.search("Cement rods").count() == 2
    assert rt.Bm25Index(chunks.filter("false")).search("cement").count() == 0


def test_upsert_keeps_known_facts(spark):
    row = "file_path string, file_hash string, file_type string, file_size long, last_modified timestamp, content_preview string, document_category string, chunks_count int, processing_status string"
    t = datetime(2024, 1, 1)
    new = spark.createDataFrame([("/a", "h1", "txt", 1, t, "p", "REPORT", 2, "indexed"), ("/a", "h0", "txt", 1, datetime(2023, 1, 1), "old", None, 2, "indexed")], row)
    docs = ingest.upsert(spark.createDataFrame([], "id long, indexed_at timestamp, " + row), new, "2024-01-02 00:00:00")
    again = spark.createDataFrame([("/a", "h2", "pdf", 3, t, "q", None, 4, "error"), ("/b", "h", "txt", 1, t, "r", None, 0, "indexed")], row)
    got = {r["file_path"]: r for r in ingest.upsert(docs, again, "2024-02-02 00:00:00").collect()}
    assert (got["/a"]["file_type"], got["/a"]["document_category"], got["/a"]["file_hash"], got["/a"]["indexed_at"]) == ("txt", "REPORT", "h2", datetime(2024, 1, 2))
    assert got["/b"]["indexed_at"] == datetime(2024, 2, 2)
    twice = ingest.upsert(ingest.upsert(docs, again, "2024-02-02 00:00:00"), again, "2024-03-02 00:00:00")
    assert twice.count() == 2
    marked = ingest.set_indexed(twice, again.select("file_path")).collect()
    assert {r["file_path"]: r["processing_status"] for r in marked} == {"/a": "error", "/b": "indexed"}


def test_replaced_chunks_leave_none_behind(spark):
    from quarry.operators.chunking import prose_chunks, with_keys

    docs = lambda t: spark.createDataFrame([("/a", t)], "file_path string, text string")
    first = with_keys(prose_chunks(docs("A. " * 2000)))
    second = ingest.replace_chunks(first, docs("short"))
    assert first.count() > 1 and [r["text"] for r in second.collect()] == ["short"]
    assert ingest.rename(second, "/a", "/b/c").first()["file_path"] == "/b/c"


def test_edits(spark):
    changes = "array<struct<find:string,replace:string>>"
    rows = spark.createDataFrame([(1, "aaa b", [("a", "bb"), ("bb", "c"), ("zz", "y"), (" ", "x")]), (2, None, []), (3, "", None)], f"id int, content string, changes {changes}")
    got = {r["id"]: (r["text"], r["applied"]) for r in edit.apply_changes(rows).collect()}
    assert got[1] == ("bbbbbb b", 3)  # later changes are judged on the snapshot, so "bb" is unknown there
    paragraphs = spark.createDataFrame([(1, ["ab", "a"], [("a", "x")])], f"id int, paragraphs array<string>, changes {changes}")
    assert edit.apply_to_paragraphs(paragraphs).first()["paragraphs"] == ["xb", "x"]


def test_bursts_merge_at_the_gap_and_split_beyond(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("f", "deleted", at(0)), ("f", "created", at(2)), ("f", "modified", at(5))], "file_path string, event_type string, ts timestamp")
    got = sorted((r["last_ts"].second, r["event_type"]) for r in ev.coalesce(rows).collect())
    assert got == [(2, "created"), (5, "modified")]


def test_moves_priorities_and_retention(spark):
    moved = spark.createDataFrame([("a", "moved", "b", datetime(2024, 1, 1))], "file_path string, event_type string, target string, ts timestamp")
    assert sorted((r["file_path"], r["event_type"]) for r in ev.split_moves(moved).collect()) == [("a", "deleted"), ("b", "created")]
    p = lambda *v: spark.range(1).select(ev.priority(*[F.lit(x) for x in v]).alias("p")).first()["p"]
    assert p(0, 0.0, True, 0.0, False) == 1000 and p(0, 0.0, False, 0.0, True) == 1000
    assert p(200 << 20, 50.0, False, 1.0, False) == 0 and p(0, 0.55, False, 0.5, False) == 394 + 200 + 100
    done = spark.createDataFrame([(i, "completed", datetime(2024, 1, 1, 0, i % 60)) for i in range(120)] + [(200, "pending", None)], "task_id int, status string, completed_at timestamp")
    assert ev.retained(done).count() == 101


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.createDataFrame([("f", "created", datetime(2024, 1, 1)), ("f", "deleted", datetime(2024, 1, 1, 0, 0, 1)), ("g", "modified", datetime(2024, 1, 2))], "file_path string, event_type string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, ev.collected(ev.window_counts(stream), "complete").collect())) == sorted(map(tuple, ev.window_counts(rows).collect()))
    seen = []
    ev.ingest_stream(stream, lambda up, down: seen.append((sorted(r[0] for r in up.collect()), [r[0] for r in down.collect()])), str(tmp_path / "ck")).awaitTermination()
    assert seen == [(["g"], ["f"])]


def test_scan_and_text(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "d" / "b.TXT").write_text("é", encoding="utf-8")
    (tmp_path / "~$c.docx").write_text("x")
    (tmp_path / "e.txt").write_text("")  # left out by the scan itself
    scan = files.scan(spark, str(tmp_path))
    assert sorted((r["file_name"], r["reject_reason"]) for r in scan.filter("file_name <> 'x'").collect()) == [("a.txt", None), ("b.TXT", None), ("~$c.docx", "lock file")]
    assert sorted(r["text"] for r in files.plain_text(scan).collect()) == ["é", "é"]


def zipped(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), xml)
    return out.getvalue()


def test_office_files(spark):
    w = 'xmlns:w="urn:w"'
    docx = zipped(**{"word__document_DOT_xml": f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    assert office.docx(docx) == "one\ttwo\na\tb"
    a = 'xmlns:a="urn:a"'
    slide = lambda body: f"<s {a}>{body}</s>"
    p = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    table = f"<a:tbl><a:tr><a:tc>{p('h')}</a:tc></a:tr><a:tr><a:tc>{p('v')}</a:tc></a:tr></a:tbl>"
    pptx = zipped(**{"ppt__slides__slide10_DOT_xml": slide(p("ten")), "ppt__slides__slide2_DOT_xml": slide(p("two") + table), "ppt__slides__slide3_DOT_xml": slide("")})
    assert office.pptx(pptx) == "Slide 2:\ntwo\nHeaders: h\nRow 1: v\n\nSlide 10:\nten"
    xlsx = zipped(**{
        "xl__workbook_DOT_xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl___rels__workbook_DOT_xml_DOT_rels": '<R><x Id="r1" Target="worksheets/s.xml"/></R>',
        "xl__sharedStrings_DOT_xml": "<sst><si><t>name</t></si></sst>", "xl__worksheets__s_DOT_xml": '<ws><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v> 5 </v></c></row></sheetData></ws>',
    })
    assert office.xlsx(xlsx) == [("S", 1, ["name", "", "5"])]
    rows = spark.createDataFrame([("/a.docx", "docx", bytearray(docx)), ("/b.docx", "docx", bytearray(b"broken"))], "file_path string, file_type string, content binary")
    got = {r["file_path"]: (r["text"], r["failure"] is None) for r in office.texts(rows).collect()}
    assert got == {"/a.docx": ("one\ttwo\na\tb", True), "/b.docx": (None, False)}


def test_page_layout_and_scans(spark):
    rows = [("f", 1, 100.0, 100.0, 60.0, 90.0, 50.0, "right"), ("f", 1, 100.0, 100.0, 5.0, 40.0, 60.0, "left"), ("f", 1, 100.0, 100.0, 5.0, 95.0, 10.0, "title"), ("f", 2, 100.0, 100.0, 5.0, 95.0, 90.0, "footer")]
    spans = spark.createDataFrame(rows, "file_path string, page int, width double, height double, x0 double, x1 double, y double, text string")
    assert files.layout(spans).first()["text"] == "[Page 1]\n[Region: full]\ntitle\n[Region: left]\nleft\n[Region: right]\nright\n\n[Page 2]\n[Region: full]\nfooter"
    assert files.scanned(spark.createDataFrame([("f", "x" * 60), ("f", "")], "file_path string, text string")).first()["is_scanned"]


def test_sessions_cascade_and_sources(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "session_id long, x string")
    assert chats.cascade_session(1, (t, "session_id"))[0].count() == 2
    m = spark.createDataFrame([(1, 5, datetime(2024, 1, 1), [(None,), ("/p/x.pdf",)])], "id long, session_id long, timestamp timestamp, sources array<struct<file_path:string>>")
    assert chats.last_source(m).first()["file_path"] == "/p/x.pdf"


def test_empty_catalog(spark):
    schema = "id long, file_path string, file_type string, file_size long, last_modified timestamp, indexed_at timestamp, content_preview string, document_category string, processing_status string, chunks_count int"
    none = spark.createDataFrame([], schema)
    assert catalog.summary(none).first()["summary"] == "No documents are currently indexed."
    assert catalog.search(none).count() == 0 and catalog.number_stats(none, "file_size").first()["total"] == 0
    assert not catalog.has_more(20, 10, 10) and catalog.has_more(21, 10, 10)


def test_engine_answers(spark):
    docs = spark.createDataFrame(
        [(1, "/d/cement.txt", "Cement was delivered on Monday. " * 3, "txt"), (2, "/d/steel.pdf", "Steel rods cost 500 in total.", "pdf")], "id long, file_path string, text string, file_type string"
    ).select("*", F.lit(10).alias("file_size"), F.lit(datetime(2024, 1, 1)).alias("last_modified"), F.lit(datetime(2024, 1, 1)).alias("indexed_at"), F.col("text").alias("content_preview"), F.lit("REPORT").alias("document_category"), F.lit("indexed").alias("processing_status"), F.lit(1).alias("chunks_count"))
    corpus = Corpus(docs, taxonomy=("REPORT",))
    assert corpus.ask("hello").query_type == "greeting"
    listed = corpus.ask("what are our reports")
    assert [x["filename"] for x in listed.sources] == ["cement.txt", "steel.pdf"] and listed.message.startswith("2 document(s) indexed as report:")
    answer = corpus.ask("when was that delivered?", "cement.txt")
    assert answer.query_type == "document_search" and answer.sources[0]["file_path"] == "/d/cement.txt"
    assert [k for k, _ in corpus.ask_stream("hi")][0] == "meta"
    assert corpus.run_tools([("summarize_corpus", {}), ("unknown", {})])[1][1].startswith("error")


def test_history_and_messages(spark):
    from quarry.plans import history as h

    pairs = spark.createDataFrame([(1, i, f"q{i}", f"a{i}" if i else " ") for i in range(9)], "session_id long, position long, user_message string, ai_response string")
    rows = h.history(pairs).orderBy("position").collect()
    assert rows[0]["role"] == "system" and "q2" in rows[0]["content"] and len(rows) == 13
    asked = h.messages("Be brief.", h.history(pairs, keep=1), "and now?").first()["messages"]
    assert [m["role"] for m in asked] == ["system", "user", "assistant", "user"] and asked[0]["content"].startswith("Be brief.\nEarlier: ")
    assert h.history(pairs.filter("position < 3")).filter("role = 'system'").count() == 0
    assert h.listing_budget("groq", 1000) == 80 and h.limit("openai", "context") == 400_000
    assert h.token_usage(spark.createDataFrame([(1, 2), (3, None)], "prompt_tokens int, completion_tokens int")).first()["total_tokens"] == 6


def test_sessions_and_answers(spark):
    none = spark.createDataFrame([], "id long, title string, directory_path string, created_at timestamp, updated_at timestamp")
    s = chats.set_title(chats.create_session(none, 1, "/a/../b/", "2024-01-01 00:00:00"), 1, "T", "2024-01-02 00:00:00").first()
    assert (s["title"], s["directory_path"], s["updated_at"]) == ("T", "/b", datetime(2024, 1, 2))
    m = spark.createDataFrame([(1, "", None, 0.0), (2, "", None, 0.0)], "id long, ai_response string, sources array<string>, response_time double")
    got = {r["id"]: r["ai_response"] for r in chats.set_answers(m, spark.createDataFrame([(2, "yes", ["x"], 1.5)], m.schema)).collect()}
    assert got == {1: "", 2: "yes"}


def test_index_is_saved_loaded_and_cut(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "cement bags"), ("b", "steel rods"), ("c", "cement mixer"), ("d", "sand")], "chunk_key string, text string")
    rt.Bm25Index(chunks).save(str(tmp_path))
    index = rt.Bm25Index.load(spark, str(tmp_path))
    assert [r["chunk_key"] for r in index.search("steel").collect()] == ["b"]
    assert index.without(chunks.filter("chunk_key = 'b'")).search("steel").count() == 0


def test_compression_numbers_and_taxonomy(spark, tmp_path):
    from quarry.functions import text as tx

    rows = spark.createDataFrame([("x" * 5000,), ("y" * 5000,)], "text string")
    assert {len(r["text"]) for r in rt.compressed(rows).collect()} == {406} and rt.compressed(rows, filename="f").first()["text"] == "x" * 5000
    shown = spark.createDataFrame([(3.0,), (3.5,), (3.126,)], "v double").select(tx.shown_number(F.col("v")).alias("s"))
    assert [r["s"] for r in shown.collect()] == ["3", "3.5", "3.13"]
    (tmp_path / "t.json").write_text('{"standalone_types": [" invoice ", "", "Report"]}')
    assert files.load_taxonomy(str(tmp_path / "t.json")) == ["INVOICE", "REPORT"] and files.load_taxonomy("/missing") == []
