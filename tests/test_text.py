"""Scalar functions against small Python models and cases."""

import re

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.plans import questions as nl


def one(spark, column, **values):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(k, T.StringType() if isinstance(v, str) or v is None else T.LongType()) for k, v in values.items()])
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_tokens_keep_codes_and_parts(spark):
    got = one(spark, tx.tokens(F.col("t")), t="The BIP-12046 of G.P.# word. été")
    assert got == ["bip-12046", "bip", "12046", "g.p.#", "word.", "word", "t"]
    assert one(spark, tx.tokens(F.col("t")), t=None) == []


def test_document_titles(spark):
    title = lambda t, types=("INVOICE", "DELIVERY NOTE"): one(spark, tx.document_title(F.col("t"), list(types)), t=t)
    assert title("x", ()) is None and title(None) is None and title("") is None
    assert title("INVOICE") == "INVOICE"
    assert title("a\n  delivery \t note \nb") == "DELIVERY NOTE"
    assert title("delivery note\ninvoice") == "DELIVERY NOTE"
    assert title("nothing here") is None and title("INVOICE 12") is None


def test_chat_titles(spark):
    title = lambda t: one(spark, tx.chat_title(F.col("t")), t=t)
    assert title(None) == title("  ") == "New chat"
    assert title(" What? Yes! Next. More") == "What? Yes! Next"
    assert title(". only") == ". only"
    assert title("x" * 60) == "x" * 48 + "…"


def test_paths_types_and_cuts(spark):
    assert one(spark, tx.basename(F.col("t")), t="/a/b.c/d.TXT") == "d.TXT"
    assert one(spark, tx.suffix(F.col("t")), t="/a.b/d.tar.TXT") == "txt" and one(spark, tx.suffix(F.col("t")), t="/a.b/d") == ""
    assert one(spark, tx.type_label(F.col("t")), t="docx") == "Word" and one(spark, tx.type_label(F.col("t")), t="odt") == "ODT"
    assert one(spark, tx.normal_type(F.col("t")), t=" .PDF ") == "pdf" and one(spark, tx.normal_type(F.col("t")), t=" ") == "unknown"
    assert one(spark, tx.cut(F.col("t"), 3), t="abcd") == "abc..." and one(spark, tx.cut(F.col("t"), 4), t="abcd") == "abcd"
    assert one(spark, tx.iso(F.to_timestamp("t")), t="2024-01-02 03:04:05") == "2024-01-02T03:04:05Z"
    assert one(spark, tx.iso(F.to_timestamp("t")), t="2024-01-02 03:04:05.5") == "2024-01-02T03:04:05.500000Z"
    assert one(spark, tx.parse_iso(F.col("t")), t="nonsense") is None
    assert one(spark, tx.calendar_date(F.to_timestamp("t")), t="2026-05-07 00:00:00") == "May 7, 2026"
    assert one(spark, tx.calendar_date(F.to_timestamp("t")), t="2026-11-07 00:00:00") == "Nov. 7, 2026"


def test_layout_preview_shows_all_regions(spark):
    text = "[Page 1]\n[Region: full]\nHEAD\n[Region: left]\n" + "l" * 500 + "\n[Region: right]\nREFERENCES\n\n[Page 2]\n[Region: full]\nlater"
    got = one(spark, tx.layout_preview(F.col("t")), t=text)
    assert got == "[Page 1]\n[Region: full]\nHEAD\n[Region: left]\n" + "l" * 140 + "\n[Region: right]\nREFERENCES"
    assert one(spark, tx.layout_preview(F.col("t"), 5), t="  plain text") == "pla"
    assert one(spark, tx.layout_preview(F.col("t")), t=None) == ""


def test_suggestion_lines_and_snippets(spark):
    assert one(spark, tx.clean_lines(F.col("t"), 8, 2), t='- "What is the total?"\n2) Where is it kept?\nno\n* And who signed it then?') == ["What is the total?", "Where is it kept?"]
    assert one(spark, tx.snippet_position(F.col("t"), F.lit("BETA gamma delta epsilon zeta")), t="alpha beta gamma delta epsilon eta") == 7
    assert one(spark, tx.snippet_position(F.col("t"), F.lit("missing")), t="alpha") == 0


def test_rewriting(spark):
    rewrite = lambda q, f="a.pdf": one(spark, nl.rewritten(F.col("q"), F.lit(f)), q=q)
    assert rewrite("explain This Document now, this document") == "explain a.pdf now, this document"
    assert rewrite("a b c d e f it h") == "a b c d e f a.pdf h"
    assert rewrite("a b c d e f it h i") == "a b c d e f it h i"
    assert rewrite("a b c d e f it that h i") == "a b c d e f it a.pdf h i"
    assert rewrite("what is it in A.PDF") == "what is it in A.PDF"
    assert rewrite("what is it", None) == "what is it" and rewrite("x" * 170 + " it") == "x" * 170 + " it"


def test_routes(spark):
    route = lambda q: one(spark, nl.route(F.col("q")), q=q)
    for q, want in (("Hi!", "greeting"), (None, "greeting"), ("what's up?", "greeting"), ("help", "general"), ("List all documents?", "document_listing"), ("how many invoices do we have", "document_listing"), ("what is the total value of our files", "document_search"), ("who signed the permit", "document_search")):
        assert route(q) == want, q


def test_fixed_patterns_compile():
    for p in (*nl.GENERAL, *nl.LISTING, *nl.AGGREGATION, *nl.PRONOUNS, nl.VALUE_SEEKING):
        re.compile(p)
