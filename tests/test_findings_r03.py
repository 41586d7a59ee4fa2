"""Findings of round 3: each test failed before its fix."""

import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry import service_queries, session
from quarry.functions import text as tx
from quarry.operators import chunking, keyword, pairs
from quarry.operators import retrieval as rt
from quarry.operators.vectors import VectorIndex, scan_many
from quarry.plans.engine import Corpus
from quarry.sources import office, office_write
from quarry.sources.ledger import Ledger
from quarry.streaming import events as ev

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_the_most_urgent_tasks_are_taken_whatever_their_path(spark):
    tasks = spark.createDataFrame([(f"f{i}", i * 10, i % 3) for i in range(9)], "file_path string, priority int, enqueued_at int").selectExpr("*", "if(file_path = 'f8', 'active', 'pending') AS state")
    assert [r["file_path"] for r in ev.active(ev.taken(tasks, 2)).orderBy("file_path").collect()] == ["f6", "f7", "f8"]


def test_layout_preview_computes_its_text_once(spark):
    rows = spark.createDataFrame([("[Page 1]\n[Region: full]\n a b \n[Region: left]\nc\n[Region: right]\n \n\n[Page 2]\n[Region: full]\nd",), (" plain ",), ("",), (None,)], "t string")
    shown = rows.select(tx.layout_preview(F.concat(F.col("t"), F.lit(" "))).alias("p"))
    assert [r["p"] for r in shown.collect()] == ["[Page 1]\n[Region: full]\na b\n[Region: left]\nc", "plain", "", ""]
    assert shown._jdf.queryExecution().analyzed().toString().count("concat(t") == 1


def test_token_counts_are_those_of_the_column(spark):
    texts = ["The BIP-12046 v2.0 end. a#b##cde İK ﬀ x", "", None, "no no if 1.2.345-678", "ÀÉ the-the abc.. --"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_key long, text string")
    for r in rows.select("text", tx.tokens(F.col("text")).alias("t")).collect():
        assert tx.token_counts(r["text"]) == Counter(r["t"])


def test_postings_of_a_repeated_key_are_added_up(spark):
    rows = spark.createDataFrame([(1, "red red"), (2, "blue"), (1, "red green"), (3, None), (None, "red")], "chunk_key long, text string")
    got = {(r["chunk_key"], r["tok"]): (r["tf"], r["dl"]) for r in rt.Bm25Index(rows).postings.collect()}
    assert got == {(1, "red"): (3, 4), (1, "green"): (1, 4), (2, "blue"): (1, 1), (None, "red"): (1, 1)}


def test_hashed_vectors_count_each_token_once(spark):
    rows = spark.createDataFrame([("a", "red blue red x-ray"), ("b", ""), ("c", None)], "chunk_key string, text string")
    v = rt.hashed_vectors(rows)
    assert "MapInArrow" in v._jdf.queryExecution().executedPlan().toString()
    place = lambda t: spark.sql(f"SELECT pmod(xxhash64('{t}'), 64) AS h").first()["h"]
    want = [0.0] * 64
    for t, n in (("red", 2), ("blue", 1), ("x-ray", 1), ("ray", 1)):
        want[place(t)] += n
    size = sum(x * x for x in want) ** 0.5
    got = {r["chunk_key"]: r["embedding"] for r in v.collect()}
    assert got["b"] == got["c"] == [0.0] * 64 and all(abs(x - y / size) < 1e-12 for x, y in zip(got["a"], want, strict=True))


def test_a_listing_makes_no_vectors(spark):
    def embed(chunks):
        raise AssertionError("vectors were made")

    docs = spark.createDataFrame([(1, "/d/a.txt", "text")], "id long, file_path string, text string")
    Corpus(docs, docs.selectExpr("file_path AS chunk_key", "file_path", "0 AS chunk_id", "text"), embed, keyword_index=False).close()


def test_a_semantic_search_makes_no_keyword_index(spark, monkeypatch):
    monkeypatch.setattr(rt, "Bm25Index", None)
    assert service_queries.semantic_only(spark, SF).count() == 12


def test_many_questions_find_what_each_finds_alone(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(f"k{i}", rng.normal(size=8).tolist()) for i in range(900)], "chunk_key string, embedding array<double>")
    index = VectorIndex(Ledger(spark, str(tmp_path)), list_rows=100)
    index.ledger.change("vectors", lambda c: index.update(c, rows, rows.limit(0)))
    asked = rows.filter("chunk_key in ('k1', 'k7', 'k500')").withColumnRenamed("chunk_key", "query_key")
    many, every = ([(r["query_key"], r["chunk_key"]) for r in t.collect()] for t in (index.search_many(asked, 20), scan_many(rows, asked, 20, part_rows=200)))
    for r in asked.collect():
        of = lambda found: {k for q, k in found if q == r["query_key"]}  # noqa: B023, E731
        assert of(many) == {x["chunk_key"] for x in index.search(r["embedding"], 20).collect()}
        assert of(every) == {x["chunk_key"] for x in rt.cosine_topk(rows, r["embedding"], 20).collect()}


def test_a_part_holds_its_points_and_no_queries(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TOGETHER", 2)
    point = lambda x: np.array([float(x), 0.0]).tobytes()
    points = spark.createDataFrame([(x % 2, x, point(x)) for x in range(10)], "part long, key long, point binary")
    queries = spark.createDataFrame([(p, x, point(x)) for x in range(7) for p in (0, 1, 2)], "part long, key long, point binary")
    got = sorted((r["query_key"], r["key"], r["score"]) for r in pairs.nearest_in_parts(points, queries, 2, own=False).collect())
    want = sorted((q, *r[::-1]) for q in range(7) for p in (0, 1) for r in sorted((abs(q - x), x) for x in range(p, 10, 2) if x != q)[:2])
    assert got == want


def test_blocks_are_made_from_texts_by_groups_of_keys(spark):
    rows = spark.createDataFrame([(f"k{i:04d}", f"red{' red' * (i % 3)} w{i}") for i in range(300)], "chunk_key string, text string")
    made = keyword.blocks(rows)
    red = {r["grp"]: r for r in made.filter("tok = 'red'").collect()}
    entries = sorted((e["chunk_key"], e["tf"], e["dl"]) for r in red.values() for e in r["entries"])
    assert entries == [(f"k{i:04d}", i % 3 + 1, i % 3 + 2) for i in range(300)]
    assert all(r["n"] == len(r["entries"]) <= keyword.GROUP and sorted((i["tf"], i["dl"]) for i in r["impacts"]) == sorted({(e["tf"], e["dl"]) for e in r["entries"]}) for r in red.values())
    again = keyword.regrouped(made.select("tok", F.inline("entries")))
    pairs_of = lambda t: sorted((r["tok"], e["chunk_key"], e["tf"], e["dl"]) for r in t.collect() for e in r["entries"])
    assert pairs_of(again) == pairs_of(made)


def test_long_rows_make_short_batches(spark):
    session.table(spark, SF, "documents")
    seen = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t")).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in batches), "rows long, bytes long").collect()
    assert sum(r["rows"] for r in seen) == 40 and max(r["bytes"] for r in seen) <= session.BATCH_BYTES + (2 << 20)


def test_files_that_expand_are_given_on_a_few_at_a_time(spark):
    """Texts a thousand times their file: what a task gathers is bounded by what it makes, not by what it reads."""
    from quarry.functions.batches import gathered

    taken = []
    found = gathered(((str(i), taken.append(i) or "x" * 1_000_000, None) for i in range(24)), office.TEXTS, lambda r: len(r[1]))
    assert next(found).num_rows == len(taken) == 5 and [b.num_rows for b in found] == [5, 5, 5, 4]
    assert [b.num_rows for b in gathered(((str(i), "", None) for i in range(700)), office.TEXTS, lambda r: 0)] == [512, 188] and not list(gathered([], office.TEXTS, len))
    rows = spark.createDataFrame([(f"/{i}", "docx", office_write.docx(["x" * 1_000_000])) for i in range(24)] + [("/no", "docx", b"?")], "file_path string, file_type string, content binary").coalesce(1)
    assert sorted((r["n"] or 0, r["f"] is None) for r in office.texts(rows).select(F.length("text").alias("n"), F.col("failure").alias("f")).collect()) == [(0, False)] + [(1_000_000, True)] * 24


def test_chunks_are_given_on_a_few_at_a_time():
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    read = pa.RecordBatch.from_pydict({"file_path": [f"/{i}" for i in range(20)] + ["/none"], "text": ["One two. " * 100_000] * 20 + [None]})
    given = list(chunking.prose_chunks(Docs())([read, read.slice(20)]))
    assert max(b.num_rows for b in given) <= session.BATCH_ROWS and max(b.nbytes for b in given) <= session.BATCH_BYTES
    assert [r[:3] for b in given for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == [(f"/{i}", *c[:2]) for i in range(20) for c in chunking.prose("One two. " * 100_000)]


def test_a_sheet_is_numbered_over_many_tasks(spark):
    sizes = {("/d/a.xlsx", "S"): 3000, ("/d/a.xlsx", "R"): 1, ("/d/a.xlsx", "T"): 21, ("/d/b.xlsx", None): 45, (None, "S"): 22, ("/d/c.xlsx", "only header"): 1}
    rows = spark.createDataFrame([(f, s, i * 7, [f" {i}", None if i % 5 else "x", " "]) for (f, s), n in sizes.items() for i in range(n)] + [("/d/a.xlsx", "S", -1, [" ", None]), ("/d/e.xlsx", "S", 0, [])], "file_path string, sheet string, row_no int, cells array<string>")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        out = chunking.sheet_chunks(rows.repartition(5))
        got = sorted(map(tuple, out.select("file_path", "chunk_id", "text", "end_pos", "total_chunks").collect()), key=repr)
    finally:
        spark.conf.unset(coalesce)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    line = lambda i: f"{i}" if i % 5 else f"{i} | x"
    want = []
    for f in {f for f, _ in sizes}:
        texts = []
        for s, n in sorted(((s, n) for (x, s), n in sizes.items() if x == f), key=lambda x: x[0] or ""):
            for a in range(1, n, 20):
                name, z = f and f.rpartition("/")[2], min(a + 19, n - 1)
                texts.append("\n".join([f"[File: {name or 'null'} | Sheet: {s or 'null'} | Rows: {a}-{z}]", f"Headers: {line(0)}", *(f"Row {i}: {line(i)}" for i in range(a, z + 1))]))
        want += [(f, i, t, len(t), len(texts)) for i, t in enumerate(texts)]
    assert got == sorted(want, key=repr) and not chunking.sheet_chunks(rows.limit(0)).count()
