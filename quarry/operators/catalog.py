"""Queries over the document catalog: search, breakdowns, statistics, summaries, folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PREVIEW, basename, cut, iso, listing_preview, normal_type, parse_iso, suffix, type_label

LISTED = ("indexed", "metadata_only")


def conditions(docs: DataFrame, query: str | None = None, file_type: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The rows that meet all given conditions. % and _ in the query are wildcards; unreadable dates are no condition."""
    on: list[Column] = []
    if query:
        like = f"%{query.lower()}%"
        on.append(F.coalesce(F.lower("file_path").like(like), F.lit(False)) | F.coalesce(F.lower("content_preview").like(like), F.lit(False)))
    if file_type:
        on.append(normal_type(F.col("file_type")) == normal_type(F.lit(file_type)))
    for text, test in ((date_from, lambda t: F.col("last_modified") >= t), (date_to, lambda t: F.col("last_modified") <= t)):
        if text:
            t = parse_iso(F.lit(text))
            on.append(t.isNull() | test(t))
    return docs.filter(reduce(Column.__and__, on)) if on else docs


def search(docs: DataFrame, limit: int = 50, offset: int = 0, **wanted) -> DataFrame:
    """A page of matching documents, newest indexed first, each with the total number of matches.

    The total is a scalar subquery and not a window, which would bring all matches to one task.
    """
    found = conditions(docs, **wanted)
    page = found.orderBy(F.desc("indexed_at"), F.desc("id")).offset(offset).limit(limit)
    return page.select(
        "id", "file_path", "file_type", "file_size", iso(F.col("last_modified")).alias("last_modified"), "content_preview", "document_category", "chunks_count", "processing_status",
        iso(F.col("indexed_at")).alias("indexed_at"), found.agg(F.count("*")).scalar().alias("total_count"),
    )


def has_more(total: int, limit: int, offset: int) -> bool:
    return offset + limit < total


def listing(docs: DataFrame) -> DataFrame:
    """Rows of the list tool."""
    shown = docs.filter(F.col("processing_status").isin(*LISTED))
    return shown.select(basename(F.col("file_path")).alias("filename"), "file_path", cut(F.coalesce("content_preview", F.lit("")), PREVIEW).alias("preview"), F.coalesce("chunks_count", F.lit(0)).alias("chunks"), F.nullif(F.trim("document_category"), F.lit("")).alias("category"), F.col("processing_status").alias("status"))


def by_type(docs: DataFrame, file_type: str) -> DataFrame:
    return conditions(docs, file_type=file_type).orderBy(F.desc("indexed_at"), F.desc("id"))


def recent(docs: DataFrame, as_of: str, days: int) -> DataFrame:
    since = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    return docs.filter(F.col("indexed_at") >= since).orderBy(F.desc("indexed_at"), F.desc("id"))


def by_status(docs: DataFrame, *statuses: str, most: int | None = None) -> DataFrame:
    out = docs.filter(F.col("processing_status").isin(*statuses))
    return out.orderBy("id").limit(most) if most else out


def under(docs: DataFrame, directory: str) -> DataFrame:
    """Documents inside a directory (not in a sibling whose name only starts alike)."""
    return docs.filter(F.col("file_path").startswith(directory.rstrip("/") + "/"))


def breakdown(docs: DataFrame) -> DataFrame:
    """Total, counts by status and counts by type in one pass: kind, value, documents."""
    sets = docs.groupingSets([[F.col("processing_status")], [F.col("file_type")], []], "processing_status", "file_type").agg(F.count("*").alias("documents"), F.grouping("processing_status").alias("s"), F.grouping("file_type").alias("t"))
    return sets.select(F.when(F.col("s") == 0, "status").when(F.col("t") == 0, "type").otherwise("total").alias("kind"), F.when(F.col("s") == 0, F.col("processing_status")).when(F.col("t") == 0, F.col("file_type")).alias("value"), "documents")


def number_stats(docs: DataFrame, column: str) -> DataFrame:
    """Mean, least, most and sum of a number; 0 where there is none."""
    return docs.agg(*(F.coalesce(f(column).cast("double"), F.lit(0.0)).alias(n) for n, f in (("average", F.avg), ("least", F.min), ("most", F.max), ("total", F.sum))))


def metadata(docs: DataFrame) -> DataFrame:
    """Documents by normalised type with the range of modification times."""
    return docs.groupBy(normal_type(F.col("file_type")).alias("file_type")).agg(F.count("*").alias("documents"), F.min("last_modified").alias("oldest"), F.max("last_modified").alias("newest"))


def summary(docs: DataFrame) -> DataFrame:
    """One sentence or three about the corpus (one row, column summary)."""
    # A row for each file type.
    types = metadata(docs).agg(
        F.sum("documents").alias("n"), F.min("oldest").alias("a"), F.max("newest").alias("z"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("documents")).alias("o"), "file_type"))), lambda x: F.concat(type_label(x["file_type"]), F.lit(" ("), (-x["o"]).cast("string"), F.lit(")"))), ", ").alias("t"),
    )
    month = lambda c: F.date_format(c, "MMM yyyy")
    text = F.concat_ws(" ", F.format_string("This folder contains %d document(s).", "n"), F.when(F.col("t") != "", F.concat(F.lit("By type: "), "t", F.lit("."))), F.when(F.col("a").isNotNull(), F.concat(F.lit("Date range: "), month("a"), F.lit(" – "), month("z"), F.lit("."))))
    return types.select(F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("No documents are currently indexed.")).otherwise(text).alias("summary"))


def index_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunks_count"), F.lit(0)).alias("chunks"), F.coalesce(F.try_divide(F.sum("chunks_count"), F.count("*")), F.lit(0.0)).alias("chunks_per_file"))


def sample_paths(docs: DataFrame, most: int = 20) -> DataFrame:
    return docs.select("file_path").orderBy("file_path").limit(most)


def progress(docs: DataFrame) -> DataFrame:
    count = lambda *s: F.count_if(F.col("processing_status").isin(*s))
    return docs.agg(F.count("*").alias("total"), count("indexed").alias("processed"), count("error").alias("failed"), (count("metadata_only") > 0).alias("is_active"))


def file_types(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("file_type").isNotNull()).select("file_type").distinct().orderBy("file_type")


def ui_filter(docs: DataFrame, text: str = "", file_type: str = "all") -> DataFrame:
    named = docs.filter(F.lower(basename(F.col("file_path"))).contains(text.lower())) if text else docs
    return named if file_type == "all" else named.filter(F.col("file_type") == file_type)


def ui_sort(docs: DataFrame, key: str = "name", descending: bool = False) -> DataFrame:
    """name, type, size, date (indexing time if the file has none) or chunks; blanks and nulls count as empty or 0."""
    keys = {
        "name": F.lower(basename(F.col("file_path"))), "type": F.coalesce("file_type", F.lit("")), "size": F.coalesce("file_size", F.lit(0)),
        "date": F.coalesce("last_modified", "indexed_at"), "chunks": F.coalesce("chunks_count", F.lit(0)),
    }
    return docs.orderBy(keys[key].desc() if descending else keys[key].asc(), "file_path")


def folder_tree(docs: DataFrame) -> DataFrame:
    """Every folder and file below the root once: path, parent, name, depth, is_file; hidden folders are left out."""
    parts = F.filter(F.split("file_path", "/"), lambda x: x != "")
    levels = docs.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth")).filter(F.size("p") > 0)
    path = lambda n: F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), n), "/"))
    rows = levels.select(path(F.col("depth")).alias("path"), path(F.col("depth") - 1).alias("parent"), F.element_at("p", F.col("depth")).alias("name"), "depth", (F.col("depth") == F.size("p")).alias("is_file"))
    return rows.filter(F.col("is_file") | ~F.col("name").startswith(".")).distinct()


def tree_order(tree: DataFrame) -> DataFrame:
    return tree.orderBy("parent", "is_file", F.lower("name"), "name")


def by_prefix(docs: DataFrame, prefix: str, file_type: str | None = None) -> DataFrame:
    """Files whose name starts like prefix, case aside; nothing for a blank prefix."""
    p = prefix.strip().lower()
    name = F.lower(basename(F.col("file_path")))
    out = docs.filter(name.startswith(p) if p else F.lit(False)).select("file_path").distinct()
    return out.filter(suffix(F.col("file_path")) == file_type.lower().lstrip(".")) if file_type else out


def autocomplete(docs: DataFrame, prefix: str, most: int = 10) -> DataFrame:
    names = by_prefix(docs, prefix).select(basename(F.col("file_path")).alias("filename"), "file_path")
    return names.orderBy(F.lower("filename"), "file_path").limit(most).select("filename", "file_path")


def name_stats(docs: DataFrame) -> DataFrame:
    """Files, distinct name prefixes (with the empty one) and the longest name."""
    names = docs.select("file_path").distinct().select(F.lower(basename(F.col("file_path"))).alias("n"))
    sizes = names.agg(F.count("*").alias("files"), F.coalesce(F.max(F.length("n")), F.lit(0)).cast("long").alias("depth"))
    nodes = names.distinct().filter(F.length("n") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("n")), lambda k: F.substr("n", F.lit(1), k))).alias("p"))
    return sizes.select("files", (nodes.agg(F.count_distinct("p")).scalar() + 1).alias("nodes"), "depth")


def cache_stats(files: DataFrame, as_of: str) -> DataFrame:
    """Count, size and ages in days of cached files (length, modified)."""
    age = lambda c: F.round((F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(c)) / 86400.0, 2)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1048576.0, 2).alias("megabytes"), age(F.min("modified")).alias("oldest_days"), age(F.max("modified")).alias("newest_days"))


def category_listing(docs: DataFrame, types: list[str]) -> DataFrame:
    """Listed documents of the given categories by name."""
    wanted = [t.strip().upper() for t in types]
    return docs.filter(F.col("processing_status").isin(*LISTED) & F.upper(F.trim("document_category")).isin(*wanted)).select(basename(F.col("file_path")).alias("filename"), "file_path", "document_category").orderBy(F.lower("filename"), "file_path")


def listed_rows(docs: DataFrame, budget: int, types: list[str] | None = None) -> DataFrame:
    """Sources of a listing answer by name: every listed document (of some categories) with a preview within the budget."""
    shown = docs.filter(F.col("processing_status").isin(*LISTED))
    if types:
        shown = shown.filter(F.upper(F.trim("document_category")).isin(*[t.strip().upper() for t in types]))
    name = basename(F.col("file_path"))
    preview = cut(listing_preview(F.col("processing_status"), F.col("content_preview"), F.col("chunks_count"), name, budget), 300)
    return shown.select(
        name.alias("filename"), "file_path", F.lit(1.0).alias("relevance_score"), preview.alias("content_snippet"), F.coalesce("chunks_count", F.lit(0)).alias("chunks_found"), "file_type", "processing_status",
        F.nullif(F.trim("document_category"), F.lit("")).alias("category"),
    ).orderBy(F.lower("filename"), "file_path")


def category_answer(docs: DataFrame, types: list[str]) -> DataFrame:
    """One row, kind and documents: the category's documents are listed (matched), there are none although others have categories (none), or nothing has one (generic)."""
    wanted = F.upper(F.trim("document_category")).isin(*[t.strip().upper() for t in types])
    counts = docs.filter(F.col("processing_status").isin(*LISTED)).agg(F.count_if(wanted).alias("documents"), F.count_if(F.coalesce(F.trim("document_category"), F.lit("")) != "").alias("any"))
    return counts.select(F.when(F.col("documents") > 0, "matched").when(F.col("any") > 0, "none").otherwise("generic").alias("kind"), "documents")


def by_path(docs: DataFrame, path: str) -> DataFrame:
    return docs.filter(F.col("file_path") == path).limit(1)


def by_id(docs: DataFrame, number: int) -> DataFrame:
    return docs.filter(F.col("id") == number).limit(1)


def first_page_progress(docs: DataFrame, most: int = 100) -> DataFrame:
    """Counts by status over the newest documents, as a progress bar shows them."""
    count = lambda s: F.count_if(F.col("processing_status") == s).alias(s)
    return docs.orderBy(F.desc("indexed_at"), F.desc("id")).limit(most).agg(F.count("*").alias("total"), count("indexed"), count("metadata_only"), count("error"))
