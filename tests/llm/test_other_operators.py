"""Chat formatting, archives and vectors: round trips, brute force and edge cases."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import ann, chat, warc


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "###", "", "x\\"]), st.lists(st.sampled_from(["###", "</turn>", "\\", " ", "\n", "a", "Assistant:", "#", "</tur", "é"]), max_size=8).map("".join)), max_size=5))
def test_turns_read_back(turns):
    text = "".join(chat.render(r, t) for r, t in turns)
    parsed = chat.parse(text)
    assert [(r, t) for r, t, _, _ in parsed] == turns
    for _, t, a, z in parsed:
        assert chat.read(text[a:z] + "</turn>", 0, False)[0] == t


def test_plain_text_is_not_escaped():
    assert chat.render("user", r"C:\dir and 50 # of </p>") == r"### user: C:\dir and 50 # of </p></turn>" + "\n"
    for bad in ("### user: x", "user: x</turn>\n", "### user: ### </turn>\n", "### user:x</turn>\n", "### user: x</turn>"):
        with pytest.raises(chat.Malformed):
            chat.parse(bad)


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", None, 0), (1, 0, "user", "hi", 0), (1, 0, "user", "hi", 0), (2, None, None, "x </turn>", 0), (None, 0, "assistant", "### a", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_conversations(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "hi"), ("user", "hi"), ("assistant", "")]
    assert got[2]["turns"][0]["text"] == "x </turn>" and got[2]["loss"] == "" and got[None]["loss"] == "### a"
    assert chat.format_conversations(df.filter("false")).count() == 0


def test_whole_conversations_are_compared(spark, monkeypatch):
    """A rendering whose single turns read back but which merges turns is found out."""
    monkeypatch.setattr(chat, "render", lambda r, t, f=chat.render: f(r, t) * 2)
    with pytest.raises(Exception, match="does not read back"):
        chat.format_conversations(spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")).collect()


def pages(spark, n=70):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>", 1) for i in range(n)], "page_id long, url string, html string, seq int")


def test_fixity_finds_exactly_the_damage(spark):
    kept = pages(spark).unionByName(spark.createDataFrame([(None, None, None, 1), (3, "http://h/3", "<p>3</p>", 1)], "page_id long, url string, html string, seq int"))
    hurt = F.col("page_id").isin(5, 33, 69)
    replica = kept.withColumn("html", F.when(hurt, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    got = warc.audit(kept, replica, fanout=2, per_file=9).collect()
    assert sorted(r["page_id"] for r in got) == [5, 33, 69] and all(r["expected_sha256"] != r["found_sha256"] and r["state"] == "changed" for r in got)
    assert warc.audit(kept, kept, fanout=3, per_file=10).count() == 0
    empty = kept.filter("false")
    assert warc.audit(empty, empty).count() == 0 and {(r["state"], r["n"]) for r in warc.audit(kept, empty, per_file=10).groupBy("state").agg(F.count("*").alias("n")).collect()} == {("lost", 72)}
    assert {r["state"] for r in warc.audit(empty, kept, per_file=10).collect()} == {"added"}


@pytest.mark.parametrize("lost", [0, 1, 449, 450, 899])
def test_one_lost_or_added_record_is_exactly_one(spark, lost):
    """Wherever it stands, whatever lies behind it; its place in the kept file is told."""
    kept = pages(spark, 900)
    less = kept.filter(F.col("page_id") != lost)
    (r,) = warc.audit(kept, less, per_file=300).collect()
    where = warc.records(kept, per_file=300, contents=False).filter(F.col("page_id") == lost).first()
    assert (r["page_id"], r["state"], r["found_sha256"]) == (lost, "lost", None) and all(r[c] == where[c] for c in ("file", "seq", "first_byte", "length")) and r["expected_sha256"] == where["hash"]
    (r,) = warc.audit(less, kept, per_file=300).collect()
    assert (r["page_id"], r["state"], r["expected_sha256"], r["seq"]) == (lost, "added", None, None)


def test_equal_records_and_records_without_ids_are_counted(spark):
    rows = [(4, "u", "x")] * 5 + [(4, "u", "y"), (4, "v", "x")] + [(None, "u", "x")] * 3 + [(None, None, None)]
    kept = spark.createDataFrame(rows, "page_id long, url string, html string")
    state = lambda replica: sorted((r["page_id"], r["state"]) for r in warc.audit(kept, spark.createDataFrame(replica, kept.schema), per_file=10).collect())
    assert state(rows[2:]) == [(4, "lost"), (4, "lost")] and state([*rows, rows[0]]) == [(4, "added")] and state(rows) == []
    assert state([(4, "u", "z"), *rows[1:]]) == [(4, "changed")]
    assert [s for _, s in state(rows[:7] + rows[8:])] == ["lost"]


def test_equal_branches_are_not_read(spark, monkeypatch):
    """Levels below the roots are compared only where their parents differ."""
    seen, compare = [], warc.differing
    monkeypatch.setattr(warc, "differing", lambda a, b: seen.append(a.count()) or compare(a, b))
    kept = pages(spark, 256)
    assert warc.audit(kept, kept, fanout=4, per_file=64).count() == 0 and seen == [1]
    seen.clear()
    assert warc.audit(kept, kept.withColumn("html", F.when(F.col("page_id") == 77, F.lit("x")).otherwise(F.col("html"))), fanout=4, per_file=64).count() == 1
    assert seen == [1, 4, 4, 4, 4]


def test_record_bytes(spark):
    r = warc.records(pages(spark, 3), per_file=10).orderBy("seq").collect()
    body = r[1]["record"].encode()
    assert body.startswith(b"WARC/1.0\r\nWARC-Type: response\r\n") and len(body) == r[1]["length"] and r[1]["first_byte"] == r[0]["length"]
    head, block = body.split(b"\r\n\r\n", 1)
    size = int(head.rsplit(b"Content-Length: ", 1)[1])
    assert block[size:] == b"\r\n\r\n" and block[:size].endswith(b"<p>1</p>") and hashlib.sha256(body).hexdigest() == r[1]["hash"]


def test_archives_are_written_and_read_back(spark, tmp_path):
    odd = [(502, "http://a\r\nContent-Length: 3\r\n\r\nxyz", "forged"), (503, "http://h/a b%0Dc+d", "plain"), (504, "tab\there%41+", "form"), (500, "http://h/é", "a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"), (501, None, None), (None, "u", "x")]
    kept = pages(spark, 40).drop("seq").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    warc.write_archive(kept, str(tmp_path / "a"), per_file=20)
    back = warc.read_archive(spark, str(tmp_path / "a"))
    columns = ["file", "seq", "first_byte", "length", "hash"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, warc.records(kept, per_file=20).select(columns).collect()))
    assert sorted(map(repr, back.select("page_id", "url", "html").collect())) == sorted(map(repr, kept.fillna("").select("page_id", "url", "html").collect()))
    for path in (tmp_path / "a").rglob("part-*"):  # each file's bytes are its records, one after the other
        data = path.read_bytes()
        assert b"".join(r for _, r, _, _ in warc.parse(data)) == data
    warc.write_archive(kept, str(tmp_path / "b"), per_file=20)
    assert warc.audit_archives(spark, str(tmp_path / "a"), str(tmp_path / "b"), per_file=20).count() == 0
    (path,) = (p for p in (tmp_path / "b").rglob("part-*") if "file=1/" in str(p))
    data = bytearray(path.read_bytes())
    data[data.index(b"<p>25</p>") + 4] ^= 1  # one flipped bit
    path.write_bytes(data)
    for crc in path.parent.glob(".*.crc"):
        crc.unlink()
    (r,) = warc.audit_archives(spark, str(tmp_path / "a"), str(tmp_path / "b"), per_file=20).collect()
    assert (r["page_id"], r["state"]) == (25, "changed")
    at = data.index(b"WARC/1.0", data.index(b"<p>26</p>"))
    path.write_bytes(data[:at] + b"XXXX/1.0" + data[at + 8 :])  # a record that no longer parses
    got = warc.audit_archives(spark, str(tmp_path / "a"), str(tmp_path / "b"), per_file=20).collect()
    assert sorted((r["page_id"] or -1, r["state"]) for r in got) == [(-1, "added"), (25, "changed"), (27, "lost")]


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        d = ann.exact(x[ids.index(q)], x)
        rows = sorted((float(s), i) for i, s in zip(ids, d, strict=True) if i != q)
        out[q] = [(i, s) for s, i in rows[:k]]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 12)).round(2)
    x[:60] = x[0]  # copies and so ties
    rows = [(i, [float(v) for v in row], "x") for i, row in enumerate(x)] + [(2000, None, "x"), (2001, [0.0] * 12, "x"), (2002, [1.0, None] + [0.0] * 10, "x"), (2003, [float("nan")] * 12, "x"), (2004, [1.0], "x"), (None, [1.0] * 12, "x"), (2100, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, copy string")
    got: dict = {}
    for row in ann.neighbours(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"], row["rank"]))
    want = brute(list(range(900)), x, range(0, 900, 100), 10)
    assert set(got) == set(want) and all([v[2] for v in rows] == list(range(1, 11)) for rows in got.values())
    assert np.mean([len({i for i, _, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    assert [i for i, _, _ in got[0]] == list(range(1, 11)) and all(s == 0 for _, s, _ in got[0])
    few = df.filter("vec_id < 4 or vec_id >= 898")
    assert ann.neighbours(few, few.filter("vec_id = 0")).count() == 5
    assert ann.neighbours(df.filter("false"), df).count() == 0


def vectors_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def hard_tables():
    """Many equal vectors beside few others, tight clusters smaller than k, chains of clusters, plain Gaussian vectors, and far outliers."""
    r = np.random.default_rng(7)
    equal = np.repeat(r.normal(size=(1, 16)), 3_900, axis=0)
    clusters = np.repeat(r.normal(size=(20, 16)) * 10, 5, axis=0) + r.normal(size=(100, 16)) * 0.01
    yield "clusters of five", np.vstack([clusters, equal])
    yield "gaussian", np.vstack([r.normal(size=(100, 16)), equal])
    many = np.repeat(r.normal(size=(900, 16)) * 10, 5, axis=0) + r.normal(size=(4_500, 16)) * 0.01
    yield "many clusters of five", many[r.permutation(len(many))]
    yield "outliers", np.vstack([r.normal(size=(3_000, 16)), r.normal(size=(12, 16)) * 1e4])
    yield "line", np.outer(np.arange(1, 2_501), np.ones(16))


@pytest.mark.parametrize("name,x", list(hard_tables()), ids=[n for n, _ in hard_tables()])
def test_rows_are_complete_and_recall_holds_on_hard_tables(spark, monkeypatch, name, x):
    """Every query gets min(k, candidates) rows, ranked, and at least 0.9 of the true neighbours (queries: ids divisible by 20)."""
    monkeypatch.setattr(ann, "LIST_ROWS", 50)  # so that the small tables have many lists
    df = vectors_of(spark, x)
    queries = df.filter("vec_id % 20 = 0")
    found = ann.neighbours(df, queries).cache()
    counts = {r["query_id"]: (r["n"], r["top"]) for r in found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("top")).collect()}
    assert set(counts) == set(range(0, len(x), 20)) and set(counts.values()) == {(10, 10)}
    want = brute(list(range(len(x))), x, range(0, len(x), 20), 10)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    share = np.mean([len(got[q].keys() & {i for i, _ in want[q]}) / 10 for q in want])
    # Equal distances of distinct candidates are as good as the ones that ties prefer, so scores are compared too.
    near = np.mean([sum(a <= b + 1e-9 for a, b in zip(sorted(got[q].values()), [s for _, s in want[q]], strict=True)) / 10 for q in want])
    assert share >= 0.9 and near >= 0.9
    assert abs(ann.recall(found, df, queries) - share) < 1e-9


def test_repeated_ids_and_few_lists_still_give_k_candidates(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(400, 4))
    df = spark.createDataFrame([(i % 40, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.neighbours(df, df.filter("vec_id = 0")).collect()
    assert [g["rank"] for g in sorted(got, key=lambda g: g["rank"])] == list(range(1, 11)) and len({g["vec_id"] for g in got}) == 10


def test_lists_are_widened_until_they_hold_k():
    graph = ann.CentroidGraph(np.arange(20.0)[:, None])
    held = np.array([1] * 19 + [100])
    assert sorted(ann.visited(graph, np.array([0.0]), 0.0, held, 11)) == list(range(11))
    assert len(ann.visited(graph, np.array([3.0]), 0.0, held, 1)) == ann.LEAST_LISTS
    assert sorted(ann.visited(graph, np.array([0.0]), 0.0, held, 10_000)) == list(range(20))


def test_balanced_lists_and_graph_search():
    x = np.random.default_rng(2).normal(size=(2_000, 8))
    c = ann.balanced_centroids(x, 64)
    graph = ann.CentroidGraph(c)
    assert len(c) == 64
    hits = 0
    for q in x[:100]:
        d = np.sqrt(((c - q) ** 2).sum(axis=1))
        hits += len({i for _, i in graph.nearest(q, 8)} & set(np.argsort(d)[:8].tolist()))
    assert hits / 800 > 0.95


def test_the_distance_ratio_alone_chooses_the_lists():
    """On near-uniform vectors far more than 64 centroids are within the ratio, and all of them are visited."""
    x = np.random.default_rng(3).normal(size=(3_050, 64))
    graph, most = ann.CentroidGraph(ann.balanced_centroids(x[50:], 300)), 0
    for q in x[:50]:
        d = np.sqrt(((graph.c - q) ** 2).sum(axis=1))
        want = set(np.flatnonzero(d <= 1.15 * d.min()).tolist())
        assert {i for _, i in graph.within(q, 0.15)} == want
        most = max(most, len(want))
    assert most > 100
    one = ann.CentroidGraph(x[:1])
    assert one.within(x[1], 0.15)[0][1] == 0 and len(one.within(x[0], 0.15)) == 1
