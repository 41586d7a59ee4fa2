"""Text edits by find and replace, cell edits, pending proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, cell_value, suffix

# Snapshot size, life of a proposal in seconds.
SNAPSHOT, LIFE = 12_000, 1_800
EDITABLE = ("txt", "docx")


def occurrences(text: Column, find: Column) -> Column:
    """How often find stands in text, without overlaps; 0 for a blank find."""
    return F.when(F.coalesce(F.length(find), F.lit(0)) == 0, F.lit(0)).otherwise(F.floor((F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.length(find))).cast("long")


def valid_changes(content: Column, changes: Column) -> Column:
    """The changes (find, replace) whose find is not blank and stands in the snapshot of the content."""
    snapshot = F.substring(content, 1, SNAPSHOT)
    return F.filter(changes, lambda c: (F.trim(c["find"]) != "") & snapshot.contains(c["find"]))


def applied(content: Column, changes: Column) -> Column:
    """(text, count) after the changes one after the other, each replacing all its occurrences."""
    start = F.struct(content.alias("text"), F.lit(0).cast("long").alias("count"))
    step = lambda s, c: F.struct(
        F.when(F.coalesce(F.length(c["find"]), F.lit(0)) == 0, s["text"]).otherwise(F.replace(s["text"], c["find"], F.coalesce(c["replace"], F.lit("")))).alias("text"),
        (s["count"] + occurrences(s["text"], c["find"])).alias("count"),
    )
    return F.aggregate(changes, start, step)


def apply_changes(rows: DataFrame) -> DataFrame:
    """id, text, applied of rows (id, content, changes array<struct<find,replace>>); unusable changes are dropped first."""
    out = applied(F.col("content"), valid_changes(F.col("content"), F.col("changes")))
    return rows.select("id", out.alias("o")).select("id", F.col("o.text").alias("text"), F.col("o.count").alias("applied"))


def apply_to_paragraphs(rows: DataFrame) -> DataFrame:
    """The same for (id, paragraphs, changes): a match cannot span paragraphs."""
    each = F.transform("paragraphs", lambda p: applied(p, F.col("changes")))
    return rows.select("id", each.alias("e")).select("id", F.transform("e", lambda x: x["text"]).alias("paragraphs"), F.aggregate("e", F.lit(0).cast("long"), lambda s, x: s + x["count"]).alias("applied"))


def typed_cells(edits: DataFrame) -> DataFrame:
    """(sheet, cell, value) with the kind and value that a workbook gets."""
    return edits.select("sheet", "cell", cell_value(F.col("value")).alias("v")).select("sheet", "cell", F.col("v.kind").alias("kind"), F.col("v.value").alias("value"))


def live_proposals(proposals: DataFrame, as_of: str) -> DataFrame:
    """Proposals (created_at) that have not expired."""
    return proposals.filter(F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(LIFE)) >= F.to_timestamp(F.lit(as_of)))


def proposals(rows: DataFrame, as_of: str) -> DataFrame:
    """Proposals of (id, file_path, content, changes): usable changes of files that can be edited, with expiry and a summary; files without any give none.

    The id of a proposal derives from file, changes and time, so a repeated task makes the same one.
    """
    usable = rows.filter(suffix(F.col("file_path")).isin(*EDITABLE)).withColumn("changes", valid_changes(F.col("content"), F.col("changes"))).filter(F.size("changes") > 0)
    now = F.to_timestamp(F.lit(as_of))
    number = F.sha2(F.concat_ws("\n", "file_path", F.to_json("changes"), F.lit(as_of)), 256)
    return usable.select(
        number.alias("proposal_id"), "id", "file_path", "changes", F.format_string("%d change(s)", F.size("changes")).alias("summary"), now.alias("created_at"),
        (now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(LIFE))).alias("expires_at"),
    )


def shown_proposals(proposals: DataFrame) -> DataFrame:
    """What a client sees: neither path nor expiry."""
    return proposals.select("proposal_id", basename(F.col("file_path")).alias("filename"), "changes", "summary")


def applied_proposals(proposals: DataFrame, docs: DataFrame, as_of: str) -> DataFrame:
    """id, file_path, text, applied, outcome of live proposals on the documents' present contents (id, content); applied files are to be ingested again, on request."""
    live = proposals.filter(F.col("expires_at") >= F.to_timestamp(F.lit(as_of)))
    out = applied(F.col("content"), F.col("changes"))
    rows = live.join(docs.select("id", "content"), "id").select("id", "file_path", out.alias("o"))
    return rows.select("id", "file_path", F.col("o.text").alias("text"), F.col("o.count").alias("applied"), F.when(F.col("o.count") > 0, "applied").otherwise("nothing to change").alias("outcome"))


def docx_snapshot(paragraphs: Column, cells: Column) -> Column:
    """What is shown of a document to be edited: its paragraphs and then its table cells that are not blank, with blank lines between."""
    return F.array_join(F.filter(F.concat(paragraphs, cells), lambda x: F.trim(x) != ""), "\n\n")


def parsed_changes(answer: Column) -> Column:
    """The first JSON array in a model's answer as changes; empty if there is none."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<struct<find:string,replace:string>>")
    return F.coalesce(found, F.array().cast("array<struct<find:string,replace:string>>"))
