"""The registered queries of this subpackage: each applies one operator to a whole table and derives digest columns from its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontaminate, extendible, infill, minhash, pitman_yor, prefix_trie, quality, repeats, toxicity, warc
from .common import table


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _sha(joined):
    return F.sha2(F.encode(joined, "UTF-8"), 256)


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _sha(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return repeats.remove_repeats(docs).select("doc_id", "n_words", "n_removed", _sha(F.col("kept_text")).alias("kept_sha256"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with damage to be found: a changed character in some pages, an end cut off in others, some records lost, some added."""
    changed, cut, number = F.col("page_id") % 97 == 13, F.col("page_id") % 211 == 7, F.col("page_id")
    html = F.when(changed, F.concat(F.lit("#"), F.substr("html", F.lit(2)))).when(cut, F.substr("html", F.lit(1), F.greatest(F.length("html") - 9, F.lit(0)))).otherwise(F.col("html"))
    left = pages.filter(F.coalesce(number % 389 != 101, F.lit(True))).withColumn("html", html)
    return left.unionByName(pages.filter(number % 503 == 11).withColumn("url", F.concat("url", F.lit("?again"))))


def op8_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.audit(pages, damaged(pages))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    out = chat.format_conversations(rows).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _sha(turns).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), _sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.conversations(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_starts(convs, F.expr("conv_id - conv_id % 20"), (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int"), 3))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.cut(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha(F.col("output")).alias("output_sha256"), _sha(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_extendible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.groups(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pitman_yor": op1_pitman_yor, "op2_decontaminate": op2_decontaminate, "op3_quality": op3_quality, "op4_toxicity": op4_toxicity, "op5_repeats": op5_repeats, "op6_minhash": op6_minhash, "op7_bpe": op7_bpe, "op8_fixity": op8_fixity, "op9_chat": op9_chat, "op10_neighbours": op10_neighbours, "op11_prefix_trie": op11_prefix_trie, "op12_infill": op12_infill, "op13_extendible": op13_extendible, "pipeline": pipeline}
