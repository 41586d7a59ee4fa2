"""Hybrid retrieval: BM25 and cosine top-k, reciprocal-rank fusion, filters, diversity, context."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import SNIPPET, cut, suffix, token_counts, tokens
from ..session import stored, unstored

#: Postings of one Arrow batch, at least.
EMITTED = 50_000
# BM25 parameters, fusion constant, caps.
K1, B, FLOOR = 1.5, 0.75, 0.25
RRF_K, PER_FILE, DOMINANT, STRONGLY_DOMINANT, PRIMARY_CHUNKS = 60, 4, 0.6, 0.8, 3

# Fixed value: what stands between documents of a context.
SEPARATOR = "\n\n---\n\n"


@dataclass(frozen=True)
class Policy:
    """How much is retrieved and passed on."""

    top_k: int
    final_top_k: int
    sources: int
    per_document: int  # characters, 0: no cap


# Fixed values of the modes.
POLICIES = {"listing": Policy(120, 120, 1000, 0), "aggregation": Policy(100, 50, 50, 2000), "search": Policy(40, 12, 25, 0), "file": Policy(40, 12, 20, 0)}


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_key, tok, tf, dl) of (chunk_key, text), a row for each distinct token of a key; dl is the number of the key's tokens. Null keys are a key.

    Texts are dealt and sorted by their key before they are tokenised: they are smaller than their tokens, and rows of one key follow each other, so counts need no exchange.
    """
    key = chunks.schema["chunk_key"].dataType
    dealt = chunks.select("chunk_key", "text").repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_key").sortWithinPartitions("chunk_key")

    def run(batches):
        names, schema = ["chunk_key", "tok", "tf", "dl"], to_arrow_type(key)
        keys, toks, tfs, dls = [], [], [], []
        for k, counts in counted(batches):
            keys += [k] * len(counts)
            toks += counts.keys()
            tfs += counts.values()
            dls += [counts.total()] * len(counts)
            if len(keys) >= EMITTED:
                yield pa.RecordBatch.from_arrays([pa.array(keys, schema), pa.array(toks, pa.string()), pa.array(tfs, pa.int64()), pa.array(dls, pa.int64())], names)
                keys, toks, tfs, dls = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, schema), pa.array(toks, pa.string()), pa.array(tfs, pa.int64()), pa.array(dls, pa.int64())], names)

    return dealt.mapInArrow(run, T.StructType([T.StructField("chunk_key", key), T.StructField("tok", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())]))


def counted(batches):
    """(key, token counts) of batches (key, text) sorted by key, each key once."""
    last, counts = None, None
    for b in batches:
        for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            more = token_counts(text.as_py())
            if counts is not None and k == last:
                counts.update(more)
            else:
                if counts is not None:
                    yield last, counts
                last, counts = k, more
    if counts is not None:
        yield last, counts


class Bm25Index:
    """Postings (chunk_key, tok, tf, dl) of (chunk_key, text); statistics derive from them.

    `keep` writes the postings, and from them statistics, to tables in the shared folder, so that texts are tokenised and counted once for all
    that is asked of them; `close` removes them.
    """

    def __init__(self, chunks: DataFrame, keep: bool = False):
        self.chunks = chunks.select("chunk_key")
        self.postings = postings(chunks)
        self.kept: dict[str, DataFrame] = {}
        if keep:
            self.postings = self.kept["postings"] = stored(self.postings, "postings")
            for name in ("totals", "term_stats"):
                self.kept[name] = stored(getattr(self, name)(), name)

    def close(self) -> None:
        for t in self.kept.values():
            unstored(t)
        self.kept = {}

    @classmethod
    def of(cls, postings: DataFrame, chunks: DataFrame) -> Bm25Index:
        out = cls.__new__(cls)
        out.postings, out.chunks, out.kept = postings, chunks, {}
        return out

    def save(self, folder: str) -> None:
        """Postings and chunk keys as tables; statistics are derived from them, so nothing else can go stale."""
        self.postings.write.mode("overwrite").parquet(f"{folder}/postings")
        self.chunks.write.mode("overwrite").parquet(f"{folder}/chunks")

    @classmethod
    def load(cls, spark, folder: str) -> Bm25Index:
        return cls.of(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/chunks"))

    def without(self, chunk_keys: DataFrame) -> Bm25Index:
        """The index without some chunks (chunk_key)."""
        return Bm25Index.of(*(t.join(chunk_keys.select("chunk_key"), "chunk_key", "left_anti") for t in (self.postings, self.chunks)))

    def stats(self) -> DataFrame:
        """chunks and whether anything is indexed."""
        return self.chunks.agg(F.count("*").alias("chunks"), (F.count("*") > 0).alias("built"))

    def lengths(self) -> DataFrame:
        """chunk_key, dl: tokens of every chunk that has any."""
        return self.postings.groupBy("chunk_key").agg(F.sum("tf").alias("dl"))

    def totals(self) -> DataFrame:
        """n chunks (also those without tokens) and their mean length."""
        if "totals" in self.kept:
            return self.kept["totals"]
        n = self.chunks.agg(F.count("*")).scalar()
        return self.postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).select(n.alias("n"), F.try_divide("tokens", n).alias("avgdl"))

    def term_stats(self) -> DataFrame:
        """tok, df, idf; negative idfs become a quarter of the mean over all terms."""
        if "term_stats" in self.kept:
            return self.kept["term_stats"]
        n = self.totals().select("n").scalar()
        raw = self.postings.groupBy("tok").agg(F.count("*").alias("df")).withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw")).scalar()
        return raw.select("tok", "df", F.when(F.col("raw") < 0, FLOOR * mean).otherwise(F.col("raw")).alias("idf"))

    def search(self, query: str, k: int = 15) -> DataFrame:
        """chunk_key, score, rank: the k best, of these only positive scores. Repeated query tokens count repeatedly."""
        spark = self.postings.sparkSession
        asked = spark.createDataFrame([(query,)], "q string").select(F.explode(tokens(F.col("q"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("qf"))
        avgdl = self.totals().select("avgdl").scalar()
        hits = self.postings.join(F.broadcast(asked), "tok")  # the words of one question
        if "dl" not in self.postings.columns:
            lengths = self.postings.join(hits.select("chunk_key").distinct(), "chunk_key", "left_semi").groupBy("chunk_key").agg(F.sum("tf").alias("dl"))
            hits = hits.join(lengths, "chunk_key")
        terms = self.term_stats().join(F.broadcast(asked.select("tok")), "tok", "left_semi")  # the words of one question
        hits = hits.join(F.broadcast(terms), "tok")
        part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
        best = hits.groupBy("chunk_key").agg(F.sum(part).alias("score")).orderBy(F.round("score", 9).desc(), "chunk_key").limit(k)
        return ranked(best, F.round("score", 9).desc(), F.col("chunk_key")).filter("score > 0")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rank from 1; only for rows already cut to a top k."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def cosine_distance(a: Column, b: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """chunk_key, distance, base_score, rank of the k nearest by cosine; exact."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select("chunk_key", cosine_distance(F.col("embedding"), q).alias("distance")).filter("distance is not null").orderBy(F.round("distance", 12), "chunk_key").limit(k)
    return ranked(best, F.round("distance", 12), F.col("chunk_key")).withColumn("base_score", F.greatest(F.lit(0.0), 1 - F.col("distance")))


def fuse(semantic: DataFrame, keyword: DataFrame, semantic_weight: float = 0.5, keyword_weight: float = 0.5, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (chunk_key, rank); ties: semantic order, then keyword order."""
    total = semantic_weight + keyword_weight
    s, w = semantic.select("chunk_key", F.col("rank").alias("semantic_rank")), keyword.select("chunk_key", F.col("rank").alias("keyword_rank"))
    part = lambda weight, rank: F.coalesce(F.lit(weight / total) / (k + F.col(rank)), F.lit(0.0))
    both = s.join(w, "chunk_key", "full_outer").withColumn("rrf_score", part(semantic_weight, "semantic_rank") + part(keyword_weight, "keyword_rank"))
    return ranked(both, F.round("rrf_score", 12).desc(), F.col("semantic_rank").asc_nulls_last(), F.col("keyword_rank")).withColumnRenamed("rank", "pos")


def only_if_semantic(fused: DataFrame) -> DataFrame:
    """Nothing at all unless the semantic side found something."""
    return fused.withColumn("_any", F.max(F.col("semantic_rank").isNotNull()).over(Window.partitionBy(F.lit(0)))).filter("_any").drop("_any")


def filename_filter(rows: DataFrame, name: str) -> DataFrame:
    """Rows of files whose path contains the name; all rows if none does."""
    match = F.lower("file_path").contains(name.lower())
    return rows.withColumn("_m", match).withColumn("_any", F.max("_m").over(Window.partitionBy(F.lit(0)))).filter("_m or not _any").drop("_m", "_any")


def diversity_cap(rows: DataFrame, final_top_k: int, per_file: int = PER_FILE) -> DataFrame:
    """In order of pos at most per_file rows a file and final_top_k in all, if there are several files and more rows than that."""
    all_rows = Window.partitionBy(F.lit(0))
    shape = rows.withColumn("_n", F.count("*").over(all_rows)).withColumn("_f", F.size(F.collect_set("file_path").over(all_rows)))
    of_file = shape.withColumn("_k", F.row_number().over(Window.partitionBy("file_path").orderBy("pos")))
    cap = (F.col("_f") > 1) & (F.col("_n") > final_top_k)
    kept = of_file.filter(~cap | (F.col("_k") <= per_file)).withColumn("_cap", cap).withColumn("_p", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pos")))
    return kept.filter(~F.col("_cap") | (F.col("_p") <= final_top_k)).drop("_n", "_f", "_k", "_cap", "_p")


def hybrid(chunks: DataFrame, semantic: DataFrame, keyword: DataFrame | None, policy: Policy, filename: str | None = None) -> DataFrame:
    """Fused, text-recovered, filtered and capped chunks: pos, chunk_key, file_path, chunk_id, text, score (cosine; 0 for keyword-only hits).

    Without a keyword index (None) the semantic order stands alone.
    """
    if keyword is None:
        keyword = semantic.select("chunk_key", "rank").limit(0)
    fused = only_if_semantic(fuse(semantic, keyword)).join(semantic.select("chunk_key", "base_score"), "chunk_key", "left")
    found = fused.join(chunks, "chunk_key").filter(F.trim("text") != "")
    rows = found.select("pos", "chunk_key", "file_path", "chunk_id", "text", F.coalesce("base_score", F.lit(0.0)).alias("score"), "rrf_score", *[c for c in chunks.columns if c == "page_number"])
    return filename_filter(rows, filename) if filename else diversity_cap(rows, policy.final_top_k)


def prefer_files(rows: DataFrame, selected: list[str]) -> DataFrame:
    """Chunks of selected files first, otherwise in order."""
    hit = F.exists(F.array(*[F.lit(s) for s in selected]).cast("array<string>"), lambda s: F.col("file_path").contains(s))
    return ranked(rows.withColumn("selected", hit).withColumnRenamed("pos", "before"), F.desc("selected"), F.col("before")).withColumnRenamed("rank", "pos").drop("before")


def single_file(rows: DataFrame, explicit: bool = False, aggregation: bool = False) -> DataFrame:
    """One row: the primary file (most chunks, first seen wins) and whether the context should be that file alone."""
    files = rows.groupBy("file_path").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    shape = files.agg(F.count("*").alias("files"), F.sum("n").alias("chunks"), F.max_by(F.struct("file_path", "n"), F.struct("n", -F.col("first"))).alias("p"))
    share, many = F.col("p.n") / F.col("chunks"), F.lit(not aggregation)
    alone = (F.col("files") == 1) | (F.lit(explicit) & many & (share >= DOMINANT)) | (many & (share >= STRONGLY_DOMINANT) & (F.col("p.n") >= PRIMARY_CHUNKS))
    return shape.select(F.col("p.file_path").alias("file_path"), F.col("p.n").alias("primary_chunks"), "files", "chunks", alone.alias("single"))


def capped(text: Column, most: int) -> Column:
    """The text of a document as it goes into a context: cut with a mark if there is a cap."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+$", ""), F.lit("\n[...]"))).otherwise(text) if most else text


def context_blocks(rows: DataFrame, per_document: int = 0) -> DataFrame:
    """file_path, pos, block, relevance_score, content_snippet, chunks_found, file_type (and page_number, if rows have it): a block a file, in first-seen order."""
    best = [F.max_by("page_number", F.struct("score", -F.col("pos"))).alias("page_number")] if "page_number" in rows.columns else []
    groups = rows.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))).alias("c"), F.min("pos").alias("pos"), F.round(F.avg("score"), 3).alias("relevance_score"), F.count("*").alias("chunks_found"), *best)
    groups = groups.withColumn("block", capped(F.array_join(F.transform("c", lambda x: x["text"]), "\n"), per_document))
    return groups.select("file_path", "pos", "block", "relevance_score", cut(F.col("block"), SNIPPET).alias("content_snippet"), "chunks_found", suffix(F.col("file_path")).alias("file_type"), *[b for b in ["page_number"] if best])


def whole_file(chunks: DataFrame, path: str, per_document: int = 0) -> DataFrame:
    """All chunks of a file as one block: file_path, block, content_snippet, chunks_found."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n")
    whole = chunks.filter(F.col("file_path") == path).groupBy("file_path").agg(text.alias("t"), F.count("*").alias("chunks_found"))
    return whole.select("file_path", capped(F.col("t"), per_document).alias("block"), cut(F.col("t"), SNIPPET).alias("content_snippet"), "chunks_found")


def selected_only(rows: DataFrame, selected: list[str]) -> DataFrame:
    return rows.filter(F.exists(F.array(*[F.lit(s) for s in selected]).cast("array<string>"), lambda s: F.col("file_path").contains(s)))


def files_named(chunks: DataFrame, name: str | None) -> DataFrame:
    """Paths of the files whose name starts like the one that a question names, case aside; nothing without a name."""
    if not name:
        return chunks.select("file_path").limit(0)
    return chunks.select("file_path").distinct().filter(F.startswith(F.lower(F.regexp_extract("file_path", r"([^/]*)$", 1)), F.lit(name.lower())))


def answer_blocks(rows: DataFrame, chunks: DataFrame, policy: Policy, explicit: bool = False, aggregation: bool = False, selected: tuple[str, ...] = ()) -> DataFrame:
    """The blocks an answer is written from: all of one file if the hits point at it (`single_file`), else the hits of each file (of selected ones alone, if any are selected).

    One row about the hits reaches the driver, which decides between the two.
    """
    ordered = prefer_files(rows, list(selected)).drop("selected") if selected else rows
    one = single_file(ordered, explicit, aggregation).first()
    if one is None or not one["single"]:
        return context_blocks(selected_only(ordered, list(selected)) if selected else ordered, policy.per_document)
    own = context_blocks(ordered.filter(F.col("file_path") == one["file_path"]))
    rest = [c for c in own.columns if c not in ("block", "content_snippet", "chunks_found")]
    names = own.columns
    return own.select(rest).join(whole_file(chunks, one["file_path"], policy.per_document), "file_path").select(names)


def sources(blocks: DataFrame, policy: Policy) -> DataFrame:
    names = ["file_path", "relevance_score", "content_snippet", "chunks_found", "file_type", *[c for c in blocks.columns if c == "page_number"]]
    return blocks.orderBy(F.desc("relevance_score"), "pos").limit(policy.sources).select(names)


def joined_context(blocks: DataFrame) -> DataFrame:
    """One row, context: every block under its document's name, in order."""
    named = F.concat(F.lit("[Document: "), F.regexp_extract("file_path", r"([^/]*)$", 1), F.lit("]\n"), "block")
    return blocks.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", named.alias("b")))), lambda x: x["b"]), SEPARATOR).alias("context"))


def truncate_context(blocks: DataFrame, most: int, separator: int, between: str | None = None) -> DataFrame:
    """(id, pos, block) -> (id, context, omitted): whole blocks while they fit, the first one cut if it alone is too long; line feeds between them, or that text."""
    w = Window.partitionBy("id").orderBy("pos")
    sized = blocks.withColumn("n", F.sum(F.length("block") + separator).over(w) - separator).withColumn("k", F.row_number().over(w))
    part = F.when((F.col("k") == 1) & (F.col("n") > most), F.regexp_replace(F.substring("block", 1, most), r"\s+$", "")).when(F.col("n") <= most, F.col("block"))
    rows = sized.withColumn("part", part).groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("pos", "part")))).alias("p"), F.max("n").alias("total"))
    return rows.select("id", F.array_join(F.transform("p", lambda x: x["part"]), "\n" * separator if between is None else between).alias("context"), (F.col("total") > most).alias("omitted"))


# When contexts are compressed.
COMPRESS_CHARS, COMPRESS_LEAST, KEPT_CHARS, SHORT = 8_000, 2, 400, 30


def compressed(rows: DataFrame, extract=lambda text: text, filename: str | None = None, aggregation: bool = False) -> DataFrame:
    """rows with their texts compressed by extract (a function of columns), if no file is named, nothing is added up and the context is long.

    Too short an extract falls back to the beginning of the text; long ones are cut.
    """
    if filename or aggregation:
        return rows
    every = Window.partitionBy(F.lit(0))  # a final top k at most
    sized = rows.withColumn("_c", F.sum(F.length("text")).over(every)).withColumn("_n", F.count("*").over(every))
    short = F.when(F.length(F.trim(extract(F.col("text")))) < SHORT, F.col("text")).otherwise(extract(F.col("text")))
    text = F.when((F.col("_c") >= COMPRESS_CHARS) & (F.col("_n") >= COMPRESS_LEAST), cut(short, KEPT_CHARS, " [...]")).otherwise(F.col("text"))
    return sized.withColumn("text", text).drop("_c", "_n")


def hashed_vectors(chunks: DataFrame, size: int = 64) -> DataFrame:
    """Deterministic default embedding: normalised hashed term frequencies (by Spark's xxhash64) of the first 1800 characters."""
    key = chunks.schema["chunk_key"].dataType

    def run(batches):
        import xxhash

        for b in batches:
            out = np.zeros((b.num_rows, size))
            for row, text in zip(out, b.column(1), strict=True):
                for t, n in token_counts(text.as_py()).items():
                    h = xxhash.xxh64_intdigest(t, seed=42)
                    row[(h - (1 << 64) if h >> 63 else h) % size] += n
            out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, out.size + 1, size, dtype=np.int32), out.ravel())], ["chunk_key", "embedding"])

    some = chunks.select("chunk_key", F.substring("text", 1, 1800).alias("text"))
    return some.mapInArrow(run, T.StructType([T.StructField("chunk_key", key), T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
