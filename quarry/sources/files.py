"""Directory scans and plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, suffix
from ..operators.ingest import EXTENSIONS, IMAGES, MOST_BYTES, metadata_only, reject_reason, to_resume, upsert


def load_taxonomy(path: str) -> list[str]:
    """Upper-cased standalone types of a JSON file; none if it is missing or not as expected."""
    import json

    try:
        with open(path, encoding="utf-8") as f:
            types = json.load(f).get("standalone_types")
    except (OSError, ValueError, AttributeError):
        return []
    return sorted({str(t).strip().upper() for t in types if str(t).strip()}) if isinstance(types, list) else []


def scan(spark: SparkSession, directory: str | list[str], content: bool = True) -> DataFrame:
    """Every file below a directory (or the files of a list): file_path, file_name, file_type, file_size, size_mb, last_modified, file_hash, reject_reason, content.

    Files are listed without their content; only those of a type and size that can be read are opened, by a second listing whose glob and filters the source applies before it reads, so a file of
    any size costs nothing and fails nothing. The others have neither hash nor content. What vanishes or cannot be read between listing and reading is left out. Files without a byte are
    left out by the source.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    if not content:
        return described(rows.load(directory).drop("content"))
    either = lambda t: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in t)
    glob = "*.{" + ",".join(either(t) for t in (*EXTENSIONS, *IMAGES)) + "}"
    fits = F.col("file_type").isin(*EXTENSIONS, *IMAGES) & F.col("file_size").between(1, MOST_BYTES)
    opened = described(rows.option("pathGlobFilter", glob).load(directory).filter(F.col("length").between(1, MOST_BYTES))).filter(fits)
    listed = described(rows.option("pathGlobFilter", "*").load(directory).drop("content")).filter(~fits)
    return opened.unionByName(listed, allowMissingColumns=True)


def described(rows: DataFrame) -> DataFrame:
    """The columns of a scan from binaryFile rows (path, modificationTime, length and perhaps content)."""
    path, content = F.regexp_replace("path", "^file:/*", "/"), "content" in rows.columns
    out = rows.select(
        path.alias("file_path"), basename(path).alias("file_name"), suffix(path).alias("file_type"), F.col("length").alias("file_size"), F.round(F.col("length") / 1048576.0, 2).alias("size_mb"),
        F.col("modificationTime").alias("last_modified"), *([F.sha2("content", 256).alias("file_hash"), F.col("content")] if content else []),
    )
    return out.withColumn("reject_reason", reject_reason(F.col("file_path"), F.col("file_size")))


def scan_and_upsert(known: DataFrame, scanned: DataFrame, as_of: str, resume: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents with a metadata_only row for every accepted file whose content is to be read, these files). Without resume all are read again."""
    good = scanned.filter("reject_reason is null")
    todo = to_resume(known, good) if resume else good
    return upsert(known, metadata_only(todo), as_of), todo


def plain_text(files: DataFrame) -> DataFrame:
    """file_path, text of text files: UTF-8 if valid, else Latin-1."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.filter("reject_reason is null and file_type = 'txt'").select("file_path", text.alias("text"))


def with_cached_text(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (file_hash, last_modified, text) with blank texts filled from a cache (file_hash, cached_text, cached_at) that is not older."""
    c = cache.select(F.col("file_hash").alias("_h"), "cached_text", "cached_at")
    joined = files.join(c, (F.col("file_hash") == F.col("_h")) & (F.col("cached_at") >= F.col("last_modified")), "left")
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return joined.withColumn("text", F.when(blank, F.coalesce("cached_text", "text")).otherwise(F.col("text"))).drop("_h", "cached_text", "cached_at")


def scanned(pages: DataFrame, least: int = 50) -> DataFrame:
    """Files (file_path, text by page) that are pictures of text: under `least` characters a page on average."""
    return pages.groupBy("file_path").agg((F.avg(F.length(F.trim("text"))) < least).alias("is_scanned"))


def layout(spans: DataFrame) -> DataFrame:
    """Text of pages from placed lines (file_path, page, width, height, x0, x1, y, text): headings across the page first, then the left column,
    the right column and the rest; regions and pages are marked."""
    w = F.col("width")
    wide = (F.col("x1") - F.col("x0") >= 0.55 * w) | ((F.col("x0") <= 0.15 * w) & (F.col("x1") >= 0.85 * w))
    region = F.when(wide, F.when(F.col("y") <= 0.32 * F.col("height"), "1full").otherwise("4rest")).when((F.col("x0") + F.col("x1")) / 2 < w / 2, "2left").otherwise("3right")
    lines = spans.filter(F.trim("text") != "").withColumn("r", region)
    parts = lines.groupBy("file_path", "page", "r").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x0", "text"))), lambda s: s["text"]), "\n").alias("t"))
    name = F.when(F.col("r") == "4rest", "full").otherwise(F.substring("r", 2, 9))
    pages = parts.groupBy("file_path", "page").agg(F.sort_array(F.collect_list(F.struct("r", F.concat(F.lit("[Region: "), name, F.lit("]\n"), "t").alias("t")))).alias("p"))
    text = pages.select("file_path", "page", F.concat(F.format_string("[Page %d]\n", F.col("page").cast("int")), F.array_join(F.transform("p", lambda s: s["t"]), "\n")).alias("t"))
    return text.groupBy("file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "t"))), lambda s: s["t"]), "\n\n").alias("text"))
