"""A directory from scan to answers: workspace, ingestion, engine tools and proposals."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.operators import edit
from quarry.plans import questions as nl
from quarry.plans.engine import Corpus
from quarry.plans.workspace import Outside, Workspace
from quarry.queries import QUESTIONS
from quarry.sources import office_write, readers
from quarry.streaming import events as ev

NOW, LATER = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_text("INVOICE\nCement was delivered on Monday. It cost 500.")
    (d / "sub" / "b.docx").write_bytes(office_write.docx(["Steel rods", "came late."]))
    (d / "c.xlsx").write_bytes(office_write.xlsx({"Costs": [["item", "cost"], ["sand", "7"]]}))
    (d / "scan.png").write_bytes(b"picture of text")
    (d / "plan.pdf").write_bytes(b"not really")
    (d / "~$a.txt").write_text("lock")
    return d


def workspace(spark, tmp_path, **more):
    return Workspace(spark, str(tmp_path / "tables"), taxonomy=("INVOICE",), **more)


def statuses(w):
    return {r["file_path"].rsplit("/", 1)[1]: (r["processing_status"], r["chunks_count"]) for r in w.table("documents").collect()}


def test_directory_is_opened_ingested_and_kept_up(spark, tmp_path, folder):
    w = workspace(spark, tmp_path)
    assert w.status()["ready"] is False and w.open(str(tmp_path / "docs" / "." ), NOW) == "opened"
    assert statuses(w) == {"a.txt": ("indexed", 1), "b.docx": ("indexed", 1), "c.xlsx": ("indexed", 1), "plan.pdf": ("error", 0)}
    row = w.document(str(folder / "a.txt")).first()
    assert row["document_category"] == "INVOICE" and row["content_preview"].startswith("INVOICE") and row["indexed_at"] == datetime(2024, 1, 1)
    assert "Row 1: sand | 7" in w.chunks_of(str(folder / "c.xlsx")).first()["text"]
    assert w.open(str(folder), LATER) == "same" and w.status() | {"ready": True, "total": 4, "processed": 3, "failed": 1, "watching": False} == w.status()
    before = sorted(map(repr, w.table("documents").collect()))
    from quarry.sources import files

    w.ingest(files.scan(spark, str(folder)), LATER)  # nothing changed
    assert sorted(map(repr, w.table("documents").collect())) == before and w.table("chunks").count() == 3
    (folder / "a.txt").write_text("short")
    w.ingest(files.scan(spark, str(folder)), LATER)
    assert [r["text"] for r in w.chunks_of(str(folder / "a.txt")).collect()] == ["short"] and w.document(str(folder / "a.txt")).first()["indexed_at"] == datetime(2024, 1, 1)
    w.rename(str(folder / "sub"), str(folder / "moved"))
    assert w.document(str(folder / "moved" / "b.docx")).count() == 1 and w.chunks_of(str(folder / "moved" / "b.docx")).first()["chunk_key"].endswith("moved/b.docx:0")
    w.remove(str(folder / "a.txt"))
    assert w.document(str(folder / "a.txt")).count() == 0 and w.chunks_of(str(folder / "a.txt")).count() == 0
    with pytest.raises(Outside):
        w.remove(str(tmp_path / "docs-2" / "x.txt"))
    w.clear()
    assert w.table("documents").count() == w.table("chunks").count() == 0
    w.opening = True
    assert w.open(str(folder), NOW) == "busy"


def test_readers_and_ocr_are_hooks(spark, tmp_path, folder):
    from quarry.sources import files

    scan = files.scan(spark, str(folder)).withColumn("reject_reason", F.when(F.col("file_type") != "png", F.col("reject_reason")))
    got = lambda **k: {r["file_path"].rsplit("/", 1)[1]: (r["text"], r["failure"]) for r in readers.texts(scan, **k).collect()}
    assert got()["plan.pdf"] == (None, "no reader for pdf") and got()["a.txt"][1] is None
    ocr = lambda content: ["", content.decode() + " seen"]
    both = got(readers={"pdf": lambda content: [" "]}, ocr=ocr)
    assert both["plan.pdf"][0] == "Page 2:\nnot really seen" and both["scan.png"][0] == "Page 2:\npicture of text seen"
    assert got(readers={"pdf": lambda content: content.missing})["plan.pdf"][1].startswith("AttributeError")


def test_file_events_reach_the_tables(spark, tmp_path, folder):
    w = workspace(spark, tmp_path)
    w.open(str(folder), NOW)
    (folder / "new.txt").write_text("fresh words")
    rows = [(str(folder / "new.txt"), "created", datetime(2024, 1, 1)), (str(folder / "a.txt"), "deleted", datetime(2024, 1, 1)), (str(folder / "x.exe"), "created", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "file_path string, event_type string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("file_path string, event_type string, ts timestamp").parquet(str(tmp_path / "events"))
    w.watch(stream, str(tmp_path / "checkpoint"), lambda: LATER, once=True).awaitTermination()
    assert statuses(w)["new.txt"] == ("indexed", 1) and "a.txt" not in statuses(w)
    w.stop()
    assert w.status()["watching"] is False


def corpus(spark, **more):
    rows = [(1, "/d/cement.txt", "Cement was delivered on Monday. " * 3, "txt"), (2, "/d/steel.txt", "Steel rods cost 500 in total.", "txt"), (3, "/d/steel2.pdf", "More steel rods.", "pdf")]
    docs = spark.createDataFrame(rows, "id long, file_path string, text string, file_type string").select("*", F.lit(10).alias("file_size"), F.lit(datetime(2024, 1, 1)).alias("last_modified"), F.lit(datetime(2024, 1, 1)).alias("indexed_at"), F.col("text").alias("content_preview"), F.lit("REPORT").alias("document_category"), F.lit("indexed").alias("processing_status"), F.lit(1).alias("chunks_count"))
    return Corpus(docs, taxonomy=("REPORT", "INVOICE"), **more)


def test_answers_use_files_history_and_selection(spark):
    said: list = []
    c = corpus(spark, model=lambda messages: said.append(messages) or "the answer")
    pairs = spark.createDataFrame([(9, i, f"q{i}", f"a{i}") for i in range(8)], "session_id long, position long, user_message string, ai_response string")
    a = c.ask("when was that delivered?", "cement.txt", pairs=pairs, session=9)
    assert a.message == "the answer" and [s["file_path"] for s in a.sources] == ["/d/cement.txt"] and a.messages == said[0]
    assert [m["role"] for m in said[0]] == ["system", *["user", "assistant"] * 6, "user"] and "Earlier: " in said[0][0]["content"]
    assert said[0][-1]["content"].startswith("[Document: cement.txt]\nCement was delivered") and said[0][-1]["content"].endswith("Question: when was cement.txt delivered?")
    assert {s["file_path"] for s in c.ask("which file mentions rods?", selected=("steel.txt",)).sources} == {"/d/steel.txt"}
    assert c.ask("how many invoices do we have").message == "No document is indexed as invoice."
    assert [r["file_path"] for r in c.files_of('what is in "steel"?').orderBy("file_path").collect()] == ["/d/steel.txt", "/d/steel2.pdf"] and c.files_of("anything").count() == 0
    assert corpus(spark, keyword_index=False).ask("which file mentions rods?").sources
    c.close()


def test_tools_fail_as_results(spark):
    c = corpus(spark, editor=lambda instruction, content: [{"find": "Cement", "replace": "Concrete"}, {"find": "absent", "replace": "x"}])
    slow = lambda: time.sleep(5)
    c.summarize = slow
    out = c.run_tools([("list_documents", {}), ("summarize_corpus", {}), ("search_documents", {"wrong": 1}), ("propose_edit", {"name": "cement.txt", "instruction": "rename", "as_of": NOW}), ("list_documents", {})], seconds=4)
    assert [n for n, _ in out] == ["list_documents", "summarize_corpus", "search_documents", "propose_edit"]
    assert out[0][1].count() == 3 and "longer" in out[1][1] and out[2][1].startswith("error: TypeError") and [len(r["changes"]) for r in out[3][1].collect()] == [1]
    assert set(out[3][1].columns) == {"proposal_id", "filename", "changes", "summary"}
    assert [k for k, _ in c.ask_stream("hi")][:2] == ["meta", "proposals"]
    applied = c.apply_edits("2024-01-01 00:10:00").first()
    assert applied["text"].startswith("Concrete was") and (applied["applied"], applied["outcome"]) == (3, "applied")
    found = [("search_documents", c.search("steel rods")[0]), ("x", "error")]
    assert c.sources_of(found).filter("file_path = '/d/steel.txt'").count() == 1 and c.sources_of([]).count() == 0


def test_suggestions(spark):
    c = corpus(spark)
    asked: list = []
    model = lambda prompt: asked.append(prompt) or '1. "What did the cement cost?"\n- no question\n* When came the steel?'
    assert c.suggestions(model) == ["What did the cement cost?", "When came the steel?"] and "- cement.txt: Cement was" in asked[0]
    assert c.follow_ups("q", "a" * 1000, model)[0].startswith("What") and "a" * 601 not in asked[1] and c.follow_ups("", "a", model) == []


def test_expired_proposals_and_other_types_change_nothing(spark):
    rows = spark.createDataFrame([(1, "/a.txt", "one two", [("one", "1")]), (2, "/b.pdf", "one", [("one", "1")]), (3, "/c.txt", "two", [("one", "1")])], "id long, file_path string, content string, changes array<struct<find:string,replace:string>>")
    p = edit.proposals(rows, NOW)
    assert [r["id"] for r in p.collect()] == [1] and edit.applied_proposals(p, rows, "2024-01-01 00:30:01").count() == 0
    assert edit.applied_proposals(p, rows, "2024-01-01 00:30:00").first()["text"] == "1 two"
    later = rows.withColumn("content", F.lit("changed meanwhile"))
    assert edit.applied_proposals(p, later, NOW).first()["outcome"] == "nothing to change"
    parsed = spark.createDataFrame([('Sure: [{"find": "a", "replace": "b"}] ok',), ("none",)], "t string").select(edit.parsed_changes(F.col("t")).alias("c")).collect()
    assert [len(r["c"]) for r in parsed] == [1, 0]


def test_states_are_told_when_they_change():
    assert list(ev.status_changes(iter([{"a": 1}, {"a": 1}, {"a": 2}, {"a": 1}]))) == [{"a": 1}, {"a": 2}, {"a": 1}]


# What each question must be taken for, in words of its own and not from the patterns.
ROUTES = ["greeting"] * 8 + ["document_search"] + ["general"] * 3 + ["document_search"] + ["general"] * 3 + ["document_listing"] * 7  # five words are too long for a greeting, "Help me" is more than "help"


def test_routes_by_hand(spark):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "id long, question string")
    got = {r["question"]: r["route"] for r in asked.select("question", nl.route(F.col("question")).alias("route")).collect()}
    assert [got[q] for q in QUESTIONS[:23]] == ROUTES
    listing = ["how many delivery receipts do we have?", "count invoices", "what are our delivery receipts", "show me all the permits", "what are our options?", "what invoices do we have"]
    search = ["what are the total costs", "total value of all invoices", "which file mentions cement?", "explain this document", "summarise that file", "when was that delivered?", "open report.PDF please", "what is BIP-12046", "give me an invoice", "how many delivery-notes are there"]  # a hyphen is no part of a category there
    assert {q: got[q] for q in listing + search} == dict.fromkeys(listing, "document_listing") | dict.fromkeys(search, "document_search")
