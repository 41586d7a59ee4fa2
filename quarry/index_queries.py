"""Registered queries of the commit log and the indexes that rest on it, over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .operators import chats
from .operators import retrieval as rt
from .operators.keyword import KeywordIndex, built
from .operators.names import NameIndex
from .operators.vectors import VectorIndex, scan_many
from .oracles import ORACLES as _BASE
from .plans import history as hist
from .plans.engine import Corpus
from .queries import KEYWORDS, _documents_as_chunks, _query_vector, _vectors
from .service_oracles import ORACLES as _SERVICE
from .session import shared_folder, table
from .sources.ledger import Change, Ledger


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def workspace_history(spark: SparkSession, sf: str) -> DataFrame:
    """All documents loaded, some removed, some changed, some added again by a second writer, each version read back."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("file_path"), "doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    kind, folder = "file_path string, doc_id long, n_chars long", _folder(spark, "history")
    first, second = Ledger(spark, folder), Ledger(spark, folder)

    def edited(paths: DataFrame, rows: DataFrame) -> Callable[[Change], None]:
        def work(change: Change) -> None:
            buckets = change.touched(paths.select("file_path"))
            change.replace("documents", change.table("documents", kind, buckets).join(paths.select("file_path"), "file_path", "left_anti").unionByName(rows), buckets=buckets)

        return work

    first.change("load", lambda c: c.replace("documents", docs))
    first.change("remove", edited(docs.filter("doc_id % 7 = 0"), docs.limit(0)))
    some = docs.filter("doc_id % 10 = 3 and doc_id % 7 <> 0")
    second.change("change", edited(some, some.withColumn("n_chars", F.col("n_chars") + 1)))
    second.change("add again", edited(docs.filter("doc_id % 14 = 0"), docs.filter("doc_id % 14 = 0")))
    every = [first.snapshot(v).table("documents").withColumn("version", F.lit(v).cast("long")) for v in first.versions()]
    rows = every[0]
    for t in every[1:]:
        rows = rows.unionByName(t)
    sums = rows.groupBy("version").agg(F.count("*").alias("documents"), F.sum("doc_id").alias("ids"), F.sum("n_chars").alias("chars"))
    told = second.history().select("version", "operation", F.col("rows").alias("told"))
    return told.join(sums, "version", "left")


def _updated_index(spark: SparkSession, sf: str) -> KeywordIndex:
    """An index that went another way to the documents as they are: a few came later, a few were other texts first, a few strangers went."""
    chunks = _documents_as_chunks(spark, sf).select(F.col("chunk_key").cast("string").alias("chunk_key"), "text")
    n = F.col("chunk_key").cast("long") % 100
    before = chunks.filter(n == 5).withColumn("text", F.concat(F.lit("the old words en la "), "text"))
    strangers = chunks.filter(n == 9).withColumn("chunk_key", F.concat(F.lit("x"), "chunk_key"))
    index = built(spark, _folder(spark, "keyword"), chunks.filter(~n.isin(5, 7)).unionByName(before).unionByName(strangers))
    change = lambda added, removed: index.ledger.change("update", lambda c: index.update(c, added, removed))
    change(chunks.filter(n == 7), strangers)
    change(chunks.filter(n == 5), before)
    return index


def bm25_after_updates(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents by an index that was updated, of which a search reads only promising groups."""
    best = _updated_index(spark, sf).search(KEYWORDS, 60)
    order = (F.round("score", 9).desc(), F.col("chunk_key").cast("long"))
    out = rt.ranked(best.drop("rank").orderBy(*order).limit(40), *order)
    return out.select(F.col("chunk_key").cast("long").alias("chunk_key"), F.round("score", 6).alias("score"), "rank")


def bm25_updated_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies added up over segments, after all of these have been merged."""
    index = _updated_index(spark, sf)
    index.ledger.change("merge", lambda c: index.merge(c, sorted(c.base.parts(index.name("blocks")), key=int)))
    return index.term_stats().select("tok", "df", F.round("idf", 6).alias("idf"))


def _vector_index(spark: SparkSession, sf: str) -> VectorIndex:
    """All vectors, in two changes; some are first other ones."""
    v = _vectors(spark, sf)
    index = VectorIndex(Ledger(spark, _folder(spark, "vectors")))
    n, none = F.col("chunk_key"), v.select("chunk_key").limit(0)
    other = v.filter(n % 50 == 3).withColumn("embedding", F.reverse("embedding"))
    index.ledger.change("vectors", lambda c: index.update(c, v.filter((n % 3 != 0) & (n % 50 != 3)).unionByName(other), none))
    index.ledger.change("vectors", lambda c: index.update(c, v.filter((n % 3 == 0) | (n % 50 == 3)), other))
    return index


def vector_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors by the stored index, lists being passed over only where they cannot hold any."""
    best = _vector_index(spark, sf).search(_query_vector(spark, sf), 60, exact=True)
    order = (F.round("distance", 12), F.col("chunk_key").cast("long"))
    out = rt.ranked(best.drop("rank").orderBy(*order).limit(40), *order)
    return out.select(F.col("chunk_key").cast("long").alias("chunk_key"), F.round(F.col("distance") + 0.0, 6).alias("distance"), F.round("base_score", 6).alias("base_score"), "rank")


def vector_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate searches for every 250th vector, counted against scans of everything: whether at least nine in ten of the 40 nearest are found."""
    index, v = _vector_index(spark, sf), _vectors(spark, sf)
    asked = v.filter("chunk_key % 250 = 0").select(F.col("chunk_key").cast("string").alias("query_key"), "embedding")
    exact, near = scan_many(v, asked, 40).select("query_key", "chunk_key"), index.search_many(asked, 40).select("query_key", "chunk_key", F.lit(1).alias("hit"))
    found = exact.join(near, ["query_key", "chunk_key"], "left")
    return asked.agg(F.count("*").alias("questions")).crossJoin(found.agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough")))  # a row each


def _name_index(spark: SparkSession, sf: str) -> NameIndex:
    """All names, in parts of some 200, after strangers that split parts have gone again and late ones have come."""
    docs = fx.indexed_documents(spark, sf).select("id", "file_path")
    none, late = docs.limit(0), F.col("id") % 9 == 4
    strangers = docs.select("id", F.concat(F.lit("/corpus/x/Doc_1"), (F.col("id") % 5).cast("string"), F.lit("/doc_1"), F.col("id").cast("string"), F.lit("~.md")).alias("file_path"))
    index = NameIndex(Ledger(spark, _folder(spark, "names")), part_rows=200)
    change = lambda added, removed: index.ledger.change("names", lambda c: index.update(c, added, removed))
    change(docs.filter(~late).unionByName(docs.filter("id % 2 = 0 and id % 9 <> 4")), none)
    change(strangers, none)
    change(docs.filter(late), strangers)
    return index


def names_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Files by a prefix of their name, from the parts of the index that can hold it."""
    return _name_index(spark, sf).search(" DOC_7", "txt")


def autocomplete_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return _name_index(spark, sf).autocomplete("doc_1")


def name_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The shape of the name tree, from neighbours in sorted parts."""
    return _name_index(spark, sf).stats()


def history_cached(spark: SparkSession, sf: str) -> DataFrame:
    """The history of every conversation with summaries that are kept: first of what had been said by the third turn, then of everything, then again."""
    pairs = chats.message_pairs(table(spark, sf, "conversations"))
    cache = hist.Summaries(Ledger(spark, _folder(spark, "summaries")))
    for said in (pairs.filter("position <= 3"), pairs):
        hist.history(said, keep=1, cache=cache)
    return hist.history(pairs, keep=1, cache=cache).select("session_id", "position", "role", F.sha2("content", 256).alias("content_sha256"))


def ask_search(spark: SparkSession, sf: str) -> DataFrame:
    """The sources that the engine names for a search question."""
    chunks = _documents_as_chunks(spark, sf)
    query = _query_vector(spark, sf)
    embed = lambda t: t.select("chunk_key", F.array(*(F.lit(float(x)) for x in query)).alias("embedding"))
    corpus = Corpus(chunks.withColumn("id", F.col("chunk_key")), chunks, embed, keywords=rt.Bm25Index(chunks, keep=True), vectors=_Scanned(_vectors(spark, sf)))
    return corpus.search(KEYWORDS)[1]


class _Scanned:
    """Vectors searched by a scan."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors

    def search(self, query: list[float], k: int) -> DataFrame:
        return rt.cosine_topk(self.vectors, query, k)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (workspace_history, bm25_after_updates, bm25_updated_terms, vector_index_topk, vector_index_recall, names_indexed, autocomplete_indexed, name_index_stats, history_cached, ask_search)}

ORACLES: dict[str, str] = {
    "workspace_history": """WITH v AS (
  SELECT 1 AS version, 'load' AS operation, doc_id, n_chars FROM documents
  UNION ALL SELECT 2, 'remove', doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT 3, 'change', doc_id, n_chars + CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT 4, 'add again', doc_id, n_chars + CASE WHEN doc_id % 10 = 3 AND doc_id % 7 <> 0 THEN 1 ELSE 0 END FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 14 = 0)
SELECT CAST(version AS BIGINT) AS version, operation, count(*) AS told, count(*) AS documents, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(n_chars) AS BIGINT) AS chars FROM v GROUP BY 1, 2""",
    "bm25_after_updates": _BASE["bm25_topk"],
    "bm25_updated_terms": _BASE["bm25_term_stats"],
    "vector_index_topk": _BASE["cosine_topk"],
    "vector_index_recall": "SELECT count(*) AS questions, CAST(sum((SELECT least(40, count(*)) FROM embeddings)) AS BIGINT) AS wanted, true AS enough FROM embeddings WHERE vec_id % 250 = 0",
    "names_indexed": _BASE["filename_prefix"],
    "autocomplete_indexed": _BASE["autocomplete"],
    "name_index_stats": _BASE["trie_stats"],
    "history_cached": _SERVICE["history_rows"],
    "ask_search": _BASE["source_rows"],
}
