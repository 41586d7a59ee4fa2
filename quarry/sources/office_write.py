"""Minimal Office documents (zipped XML) from plain lines, slides and sheets."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)  # no clock in the bytes
    return out.getvalue()


def docx(paragraphs: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    return zipped({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>"})


def pptx(slides: list[list[str]]) -> bytes:
    one = lambda lines: "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in lines)
    return zipped({f"ppt/slides/slide{i}.xml": f"<p:sld {_A}><p:txBody>{one(lines)}</p:txBody></p:sld>" for i, lines in enumerate(slides, 1)})


def xlsx(sheets: dict[str, list[list[str]]]) -> bytes:
    names, rels, parts = "", "", {}
    for i, (name, rows) in enumerate(sheets.items(), 1):
        names += f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>'
        rels += f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
        cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in row) + "</row>" for row in rows)
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {_S}><sheetData>{cells}</sheetData></worksheet>"
    return zipped({"xl/workbook.xml": f"<workbook {_S}><sheets>{names}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>", **parts})
