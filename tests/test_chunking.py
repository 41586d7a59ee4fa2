"""The prose chunker against a direct model of its rules, and sheets."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import chunking as ck


def model(text: str, size: int, overlap: int) -> list[tuple[str, int]]:
    """Straight from the rules: at each step look back for a sentence end, a blank line, white space."""

    def boundary(start, end):
        span = end - start
        for share, good in ((10, sentence), (5, blank), (20, lambda i: text[i].isspace())):
            for i in range(end - 1, max(end - max(1, span // share), start), -1):
                if good(i):
                    return i + 1
        return end

    def sentence(i):
        if text[i] in "!?":
            return i + 1 < len(text) and text[i + 1].isspace()
        rest = text[i + 1 :].lstrip(" ")
        return text[i] == "." and (not rest or rest[0].isupper())

    def blank(i):
        return text[i] == "\n" and text[i + 1 : i + 2] in ("", "\n")

    if len(text) <= size:
        return [(text.strip(), 0)] if text.strip() else []
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            end = boundary(start, end)
        if text[start:end].strip():
            out.append((text[start:end].strip(), start))
        start = end - overlap
        if start >= len(text) - overlap:
            break
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab Z.!?\n é", max_size=400), st.integers(20, 60))
def test_chunks_match_the_model(text, size):
    got = [(c[1], c[2]) for c in ck.prose(text, size, size // 4)]
    assert got == model(text, size, size // 4)


@given(st.text(alphabet="ab C.\n", max_size=600))
@settings(max_examples=100, deadline=None)
def test_chunks_cover_every_word(text):
    covered = set()
    for _, chunk, start, end, _, total in ck.prose(text, 50, 10):
        covered.update(range(start, start + 50))
        assert end == start + len(chunk) and total >= 1
    assert all(text[i].isspace() or i in covered for i in range(len(text)))


def test_pages_and_regions():
    text = "[Page 1]\n[Region: left]\n" + "A. " * 300 + "[Page 2]" + " b" * 400
    chunks = ck.prose(text)
    assert chunks[0][4] == 1 and chunks[-1][4] == 2 and "Region" not in chunks[0][1]
    assert ck.page_at([(5, 1)], 4) is None and ck.page_at([(5, 1)], 5) == 1


def test_blank_and_single_texts():
    assert ck.prose(None) == ck.prose("  \n ") == []
    assert ck.prose("x" * 1200) == [(0, "x" * 1200, 0, 1200, None, 1)]
    assert len(ck.prose("x" * 1201)) == 1 + (1201 - 1200 > 0)


def test_sheets(spark):
    cells = lambda i: [f" a{i} ", None if i == 3 else "b", "", None]
    rows = [("/f.xlsx", "S", 1, [" ", None])] + [("/f.xlsx", "S", i, cells(i)) for i in range(2, 24)] + [("/f.xlsx", "T", 1, ["only header"])]
    df = spark.createDataFrame(rows, "file_path string, sheet string, row_no int, cells array<string>")
    out = ck.sheet_chunks(df).orderBy("chunk_id").collect()
    assert [r["total_chunks"] for r in out] == [2, 2]
    assert out[0]["text"].split("\n")[:3] == ["[File: f.xlsx | Sheet: S | Rows: 1-20]", "Headers: a2 | b", "Row 1: a3"]
    assert out[1]["text"].split("\n") == ["[File: f.xlsx | Sheet: S | Rows: 21-21]", "Headers: a2 | b", "Row 21: a23 | b"]


def test_pages_of_places(spark):
    """Marks and lookups against a scan of each text, with a text of very many marks, one without any, a null one and equal places."""
    many = "".join(f"[Page {i}]{'x' * (i % 7)}" for i in range(100_000))
    texts = {"many": many, "few": "ab[Page 12][Page 3] c", "none": "abc", "empty": "", "null": None}
    df = spark.createDataFrame(list(texts.items()), "name string, t string")
    found = ck.page_marks(df, "name", "t").orderBy("name", "pos").collect()
    assert [(r["name"], r["pos"], r["page"]) for r in found] == [(k, *m) for k in sorted(texts) for m in ck.pages(texts[k] or "")]
    places = [(k, p, i) for i, (k, p) in enumerate((k, p) for k in texts for p in (0, 0, 1, 2, 9, 10, 11, 12, 500_000, len(many)))]
    at = ck.pages_at(ck.page_marks(df, "name", "t"), spark.createDataFrame(places, "name string, pos int, n int"), "name").collect()
    pages = {k: ck.pages(t or "") for k, t in texts.items()}
    assert {(r["name"], r["pos"], r["n"], r["page"]) for r in at} == {(k, p, i, ck.page_at(pages[k], p)) for k, p, i in places}
    assert len(at) == len(places)
    assert ck.pages_at(ck.page_marks(df.limit(0), "name", "t"), spark.createDataFrame(places, "name string, pos int, n int"), "name").filter("page is null").count() == len(places)


def test_a_tokenizer_bounds_chunks(spark):
    def words():
        import re

        return lambda text: [m.end() for m in re.finditer(r"\S+", text)]

    text = " ".join(f"w{i}" for i in range(2000))
    plain, cut = ck.prose(text), ck.prose(text, tokenizer=words(), most=52)
    assert [c[2] for c in plain] == [c[2] for c in cut] and all(len(c[1].split()) == min(50, len(p[1].split())) for c, p in zip(cut, plain, strict=True))
    assert all(p[1].startswith(c[1]) and c[3] == c[2] + len(c[1]) for c, p in zip(cut, plain, strict=True))
    assert ck.prose(text, tokenizer=words(), most=10_000) == plain
    assert ck.trimmed("ab cd", lambda t: [0] * len(t), 3) == "" and ck.trimmed("ab", words(), 0) == ""  # tokens without letters end too
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", " ")], "file_path string, text string")
    got = ck.prose_chunks(docs, tokenizer=words, most=52).orderBy("chunk_id").collect()
    assert [tuple(r)[1:] for r in got] == cut
    with pytest.raises(Exception, match="no such text"):
        ck.prose_chunks(docs, tokenizer=lambda: lambda t: (_ for _ in ()).throw(ValueError("no such text"))).collect()


def test_letters_bound_chunks_without_a_tokenizer():
    assert [len(c[1]) for c in ck.prose("x" * 5000, 4000, 200)] == [2040, 1200]
    assert ck.prose("a" + " " * 2100 + "b" * 100, 4000, 200)[0][1] == "a"  # white space before the cut goes too


def test_a_tokenizer_file_in_tasks(spark):
    public_tokenizers, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    own = tokenizers.Tokenizer.from_file(path)
    docs = spark.createDataFrame([("a", "unquestionably 12345678901234567890 " * 200)], "file_path string, text string")
    rows = ck.prose_chunks(docs, tokenizer=ck.tokenizer_file(path), most=102).collect()
    free = ck.prose_chunks(docs).collect()
    assert len(rows) == len(free) and max(len(own.encode(r["text"], add_special_tokens=False).ids) for r in rows) <= 100 < len(own.encode(free[0]["text"], add_special_tokens=False).ids)


def test_the_chunker_in_sql(spark):
    ck.register_prose_chunks(spark)
    docs = spark.createDataFrame([("a", "One. Two. " * 300), ("b", None), ("c", "short")], "file_path string, text string")
    rows = spark.sql("SELECT d.file_path, c.* FROM {docs} d, LATERAL prose_chunks(d.text) c", docs=docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, ck.prose_chunks(docs).collect()))  # no page numbers, so rows can be sorted
    small = spark.sql("SELECT c.chunk_id, c.text FROM {docs} d, LATERAL prose_chunks(d.text, 40, 5) c WHERE d.file_path = 'a' ORDER BY 1", docs=docs).collect()
    assert [tuple(r) for r in small] == [c[:2] for c in ck.prose("One. Two. " * 300, 40, 5)]
