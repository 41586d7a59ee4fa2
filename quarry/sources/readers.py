"""Text of scanned files of every kind: plain and Office files by this package, others by functions that the caller gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.batches import each, gathered
from ..operators.ingest import IMAGES
from . import files, office

#: A reader takes the bytes of a file and gives the texts of its pages.
Reader = Callable[[bytes], list[str]]


def paged(pages: list[str]) -> str:
    """Pages that are not blank, each under its number."""
    return "\n\n".join(f"Page {i}:\n{t.strip()}" for i, t in enumerate(pages, 1) if t and t.strip())


def read_by(rows: DataFrame, readers: dict[str, Reader], ocr: Reader | None = None) -> DataFrame:
    """file_path, text, failure of files (file_path, file_type, content) by their types' readers; a blank text is read again by OCR, images are by OCR alone."""

    def one(kind: str, content: bytes) -> tuple[str | None, str | None]:
        try:
            text = "" if kind in IMAGES else "\n".join(readers[kind](content))
            if not text.strip() and ocr is not None:
                text = paged(ocr(content))
            return text, None
        except Exception as e:  # a reader that fails on one file leaves the others alone; the failure is a column
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for b in batches:
            yield from gathered(((p, *one(k, c)) for p, k, c in each(b)), office.TEXTS, lambda r: len(r[1] or ""))

    kinds = [*readers, *(IMAGES if ocr is not None else ())]
    return rows.filter(rows["file_type"].isin(*kinds)).select("file_path", "file_type", "content").mapInArrow(run, "file_path string, text string, failure string")


def texts(scan: DataFrame, readers: dict[str, Reader] | None = None, ocr: Reader | None = None) -> DataFrame:
    """file_path, text, failure of all accepted files but spreadsheets; kinds that nobody reads fail."""
    from pyspark.sql import functions as F

    good = scan.filter("reject_reason is null")
    own = files.plain_text(good).withColumn("failure", F.lit(None).cast("string"))
    known = ["txt", "docx", "pptx", "xlsx", *(readers or {}), *(IMAGES if ocr is not None else ())]
    out = own.unionByName(office.texts(good))
    if readers or ocr is not None:
        out = out.unionByName(read_by(good, readers or {}, ocr))
    unread = good.filter(~F.col("file_type").isin(*known)).select("file_path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("no reader for "), "file_type").alias("failure"))
    return out.unionByName(unread)
