"""Text of Office documents (zipped XML), read with the standard library inside Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.batches import each, gathered

# Slides read at most.
MOST_SLIDES = 200

TEXTS = pa.schema([("file_path", pa.string()), ("text", pa.string()), ("failure", pa.string())])
SHEETS = pa.schema([("file_path", pa.string()), ("sheet", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string()))])


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def named(node: ET.Element, name: str):
    return (x for x in node.iter() if local(x.tag) == name)


def joined(node: ET.Element) -> str:
    """Text runs of a paragraph, with its tabs and breaks."""
    marks = {"t": lambda x: x.text or "", "tab": lambda x: "\t", "br": lambda x: "\n"}
    return "".join(marks[local(x.tag)](x) for x in node.iter() if local(x.tag) in marks)


def docx(content: bytes) -> str:
    """Paragraphs of the body, then table rows with tabs between cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(named(ET.fromstring(z.read("word/document.xml")), "body"))
    paragraphs = [joined(p) for p in body if local(p.tag) == "p"]
    rows = ["\t".join("\n".join(joined(p) for p in named(c, "p")) for c in r if local(c.tag) == "tc") for t in body if local(t.tag) == "tbl" for r in named(t, "tr")]
    return "\n".join([*paragraphs, *rows])


def slide_table(table: ET.Element) -> list[str]:
    rows = [[" ".join(joined(p) for p in named(c, "p")).strip() for c in named(r, "tc")] for r in named(table, "tr")]
    rows = [r for r in rows if any(r)]
    return [f"Headers: {' | '.join(rows[0])}", *(f"Row {i}: {' | '.join(r)}" for i, r in enumerate(rows[1:], 1))] if rows else []


def pptx(content: bytes, most: int = MOST_SLIDES) -> str:
    """Slides in order, empty ones left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in slides[:most]:
            root, lines = ET.fromstring(z.read(name)), []
            in_tables = {id(p) for t in named(root, "tbl") for p in named(t, "p")}
            lines += [t for p in named(root, "p") if id(p) not in in_tables and (t := joined(p).strip())]
            lines += [line for t in named(root, "tbl") for line in slide_table(t)]
            if lines:
                out.append("\n".join([f"Slide {number}:", *lines]))
    return "\n\n".join(out)


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx(content: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, cells as trimmed text) of every row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [joined(s) for s in named(ET.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in named(ET.fromstring(z.read("xl/workbook.xml")), "sheet"):
            target = rels[next(v for k, v in s.attrib.items() if local(k) == "id")]
            for i, row in enumerate(named(ET.fromstring(z.read("xl/" + target.removeprefix("/xl/"))), "row"), 1):
                cells: list[str] = []
                for c in named(row, "c"):
                    k = column_number(c.get("r", "")) or len(cells) + 1
                    cells += [""] * (k - len(cells))
                    value = next(named(c, "v"), None)
                    raw = "" if value is None else value.text or ""
                    cells[k - 1] = (shared[int(raw)] if c.get("t") == "s" and raw else joined(c) if c.get("t") == "inlineStr" else raw).strip()
                out.append((s.get("name"), int(row.get("r", i)), cells))
    return out


def texts(files: DataFrame) -> DataFrame:
    """file_path, text, failure of docx and pptx files (file_path, file_type, content); unreadable ones give a failure and no text."""
    read = {"docx": docx, "pptx": pptx}

    def one(kind, content):
        try:
            return read[kind](content), None
        except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration) as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for b in batches:
            yield from gathered(((p, *one(k, c)) for p, k, c in each(b)), TEXTS, lambda r: len(r[1] or ""))

    return files.filter(files["file_type"].isin(*read)).select("file_path", "file_type", "content").mapInArrow(run, "file_path string, text string, failure string")


def sheets(files: DataFrame) -> DataFrame:
    """file_path, sheet, row_no, cells of xlsx files; unreadable ones give no rows."""

    def one(path, content):
        try:
            return [(path, *r) for r in xlsx(content)]
        except (zipfile.BadZipFile, KeyError, ET.ParseError):
            return []

    def run(batches):
        for b in batches:
            yield from gathered((r for p, c in each(b) for r in one(p, c)), SHEETS, lambda r: sum(map(len, r[3])))

    return files.filter("file_type = 'xlsx'").select("file_path", "content").mapInArrow(run, "file_path string, sheet string, row_no int, cells array<string>")
