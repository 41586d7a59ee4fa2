"""The pipeline on the small tables: what each stage keeps, and that its decisions take effect."""

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stored(stage(spark, docs, SF), f"test{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if k == 2:
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    assert docs.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_run_gives_the_rows_of_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_empty_documents_pass_through_every_stage(spark):
    docs = table(spark, SF, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows and ids, ties, and columns named like those of the operators."""
    docs = table(spark, SF, "documents").select("*", F.lit("x").alias("score"), F.lit(1).alias("n_removed"), F.lit("k").alias("kept_text"), F.lit(2).alias("_node"), F.lit("c").alias("component_id"), F.lit("w").alias("words"))
    rows = docs.orderBy("doc_id").limit(40)
    one = docs.filter("doc_id = 3")
    odd = [
        one, one.withColumn("doc_id", F.lit(None).cast("long")), one.withColumn("text", F.lit(None).cast("string")), one.withColumn("text", F.lit("")), one.withColumn("text", F.lit(" \n ")),
        one.withColumn("doc_id", F.lit(900)).withColumn("text", F.repeat(F.lit("a long text of many words, and more "), 30_000)), one.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")),
    ]
    for x in odd:
        rows = rows.unionByName(x)
    return rows


def test_odd_rows_pass_every_stage(spark):
    docs = stored(odd_documents(spark), "odd")
    names, kinds = docs.columns, docs.dtypes
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, SF), f"odd{k}")
        if k == 4:
            assert out.count() == docs.count() and out.filter("n_tokens = 0").count() == docs.filter("coalesce(trim(text), '') in ('', '\n', ' \n ')").count()
            break
        assert out.columns == names and [t for _, t in out.dtypes] == [t for _, t in kinds], name
        nothing = "coalesce(trim(translate(text, '\n', ' ')), '') = ''"
        if k != 0:  # texts without words stay, whatever their ids
            assert out.filter(nothing).count() == docs.filter(nothing).count(), name
        if k == 1:
            assert out.filter("text is not null").groupBy("doc_id", "text").count().filter("count > 1").count() == 0
        if k == 2:
            changed = out.alias("o").join(docs.alias("d"), F.col("o.doc_id").eqNullSafe(F.col("d.doc_id")) & F.col("o.text").eqNullSafe(F.col("d.text")), "left_anti")
            assert changed.filter("doc_id is null").count() == 0 and out.count() == docs.count()
        docs = out


def test_layout_stays_where_passages_are_cut(spark):
    line = " ".join(f"word{i}" for i in range(15))
    docs = spark.createDataFrame([(1, line, "en", "s", 9), (2, f"First line.\n\n\t{line}\nLast  line.\n", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert got == {1: (line, 9), 2: ("First line.\n\n\tLast  line.\n", 26)}
