"""Training-data pipeline over the documents table: five stages, each one operator applied to all that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents, whatever these are (names that clash with an
operator's own survive). The driver writes and rereads each stage's result; `run` does the same in the shared checkpoint folder.

An empty table passes every stage and gives no rows. Very long texts are never cut before they are judged. Each stage's docstring says what becomes
of nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, minhash, quality, repeats
from quarry.llm.common import prepare, sheltered, stored, table

#: A trained forest rejects some documents, automata and BPE are procedures: no SQL gives the rows of `run`.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality forest rejects.

    A null or empty text has all statistics 0 and is kept or dropped as the forest scores such a row; null ids are scored but not learned from;
    repeated rows are kept or dropped alike; a score of exactly the threshold is kept. Without usable labels every score is 0.5 and all rows stay.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates (five-word shingles, similarity 0.8).

    One row of a group stays, also of exactly repeated rows (of rows with equal ids the first by text and columns); rows with null ids take part and
    stay only if the group has no id. Null and empty texts are like nothing and all stay.
    """
    return minhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 and more words that a document with a smaller id has; everything else, white space included, stays as it is.

    Null and empty texts stay. Null ids own nothing and lose nothing; repeated rows of one id do not count against each other. n_chars follows a text that
    was cut and is left alone otherwise. A text all of whose words go becomes what white space it began with.
    """
    plain = tuple(c for c in ("doc_id", "text", "n_chars") if c in docs.columns)

    def cut(inner: DataFrame) -> DataFrame:
        out = repeats.remove_repeats(inner, layout=True).withColumn("text", F.col("kept_text"))
        if "n_chars" not in plain:
            return out
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))

    return sheltered(docs, cut, plain)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item (also of items without an id).

    Null and empty texts have no words and stay; null ids and repeated rows are judged each by its text; an empty benchmark drops nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to.

    A null or empty text has no tokens and the digest of the empty text; null ids and repeated rows keep their rows.
    """
    import public_tokenizers

    out = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
