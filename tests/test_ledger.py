"""The commit log, the indexes that rest on it, and workspaces that share a folder."""

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as rt
from quarry.operators.keyword import KeywordIndex, built
from quarry.operators.vectors import VectorIndex
from quarry.plans.workspace import Workspace
from quarry.sources import files
from quarry.sources.ledger import Conflict, Ledger

ROWS = "file_path string, n long"
NOW = "2024-01-01 00:00:00"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROWS)


def put(spark, *pairs):
    def work(change):
        new = rows(spark, *pairs)
        buckets = change.touched(new)
        change.replace("t", change.table("t", ROWS, buckets).join(new, "file_path", "left_anti").unionByName(new), buckets=buckets)

    return work


def content(snapshot):
    return {r["file_path"]: r["n"] for r in snapshot.table("t", ROWS).collect()}


def test_snapshots_are_reopened_and_kept(spark, tmp_path):
    a = Ledger(spark, str(tmp_path / "l"))
    a.change("one", put(spark, *((f"f{k}", k) for k in range(40))))
    before = a.snapshot()
    a.change("two", put(spark, ("f3", -3)))
    b = Ledger(spark, str(tmp_path / "l"), buckets=99)  # the folder's number counts
    assert content(b.snapshot())["f3"] == -3 and len(content(b.snapshot())) == 40 and content(before)["f3"] == 3 and content(b.snapshot(1))["f3"] == 3
    changed = [p for p in before.parts("t") if before.parts("t")[p] != b.snapshot().parts("t")[p]]
    assert len(changed) == 1 < len(before.parts("t"))
    assert [tuple(r) for r in b.history().orderBy("version").collect()][1] == (2, "two", "t", 40, 1)
    assert a.change("nothing", lambda c: None).version == 2 and content(a.snapshot(0)) == {}


def test_two_writers_never_overwrite_each_other(spark, tmp_path):
    a, b = Ledger(spark, str(tmp_path / "l")), Ledger(spark, str(tmp_path / "l"))
    a.change("start", put(spark, *((f"f{k}", 0) for k in range(30))))

    def add(ledger, path):
        def work(change):
            buckets = change.touched(rows(spark, (path, 0)))
            change.replace("t", change.table("t", ROWS, buckets).withColumn("n", F.col("n") + (F.col("file_path") == path).cast("long")), buckets=buckets)

        ledger.change(path, work, tries=50)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda x: add(*x), [(a, "f1"), (b, "f1"), (a, "f2"), (b, "f1")]))
    got = content(a.snapshot())
    assert (got["f1"], got["f2"], sum(got.values()), len(got)) == (3, 1, 4, 30) and a.versions() == list(range(1, 6))


def test_conflicts_are_told_and_other_parts_are_joined(spark, tmp_path):
    from quarry.sources.ledger import Change

    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.change("start", put(spark, *((f"f{k}", 0) for k in range(30))))
    base = ledger.snapshot()
    names = {p: spark.read.parquet(f"{ledger.folder}/{e[0]['path']}").first()["file_path"] for p, e in base.parts("t").items()}
    one, other = list(names.values())[:2]
    late, same = Change(base, "late"), Change(base, "same")
    put(spark, (other, 5))(late)
    put(spark, (one, 7))(same)
    ledger.change("first", put(spark, (one, 1)))
    assert content(ledger.commit(late)) | {one: 1, other: 5} == content(ledger.snapshot())
    with pytest.raises(Conflict):
        ledger.commit(same)
    everything = Change(base, "reads all")
    everything.table("t", ROWS)
    everything.part("u", "0", rows(spark, ("x", 1)))
    with pytest.raises(Conflict):
        ledger.commit(everything)
    with pytest.raises(ValueError, match="does not replace"):
        Change(base, "wrong").replace("t", rows(spark, (one, 1)), buckets=[])


def test_killed_commits_leave_the_last_snapshot_and_are_swept_up(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.change("start", put(spark, ("a", 1), ("b", 2)))

    def killed(change):
        put(spark, ("a", 9))(change)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        ledger.change("killed", killed)
    assert content(Ledger(spark, ledger.folder).snapshot()) == {"a": 1, "b": 2} and ledger.versions() == [1]
    assert ledger.vacuum() == 0 and ledger.vacuum(grace=0) == 1  # a young folder may belong to a commit that is under way
    for k in range(3):
        ledger.change("again", put(spark, ("a", k)))
    assert ledger.vacuum(keep=1, grace=0) > 0 and ledger.versions() == [4] and content(ledger.snapshot()) == {"a": 2, "b": 2}
    assert ledger.put_if_absent(ledger._log(9), json.dumps({})) and not ledger.put_if_absent(ledger._log(9), "other")


# --- keyword index ----------------------------------------------------------------------------------------------------------


def chunk_rows(n, seed=0):
    r = random.Random(seed)
    common = [f"common{i}" for i in range(5)]
    return {f"/d/f{k // 9}.txt:{k % 9}": " ".join([*r.choices(common, k=r.randrange(0, 30)), *(f"word{int(r.paretovariate(0.6)) % 400}" for _ in range(r.randrange(0, 40)))]) for k in range(n)}


def as_chunks(spark, chunks):
    return spark.createDataFrame(list(chunks.items()) if isinstance(chunks, dict) else chunks, "chunk_key string, text string")


def rounded(df):
    return [(r["chunk_key"], round(r["score"], 9), r["rank"]) for r in df.orderBy("rank").collect()]


QUESTIONS = ["common0 word3 word7", "word1", "common1 common2 common3", "nothing known", "", "word399 word398 word3 word3"]


def test_updates_give_the_scores_of_a_fresh_index(spark, tmp_path, monkeypatch):
    from quarry.operators import keyword

    monkeypatch.setattr(keyword, "GROUP", 8)
    state = chunk_rows(600)
    index = built(spark, str(tmp_path / "k"), as_chunks(spark, state))
    r = random.Random(3)
    for step in range(4):
        gone = dict(r.sample(sorted(state.items()), 7))
        new = {k: f"{v} word{step} common1" for k, v in list(gone.items())[:4]} | {f"/new/{step}.txt:{j}": f"word{j} word{step} fresh{step}" for j in range(5)}
        before = index.ledger.snapshot()
        index.ledger.change("update", lambda c, n=new, g=gone: index.update(c, as_chunks(spark, n), as_chunks(spark, g)))
        after = index.ledger.snapshot()
        assert all(after.parts("keyword_blocks").get(p) == e for p, e in before.parts("keyword_blocks").items()) and len(after.parts("keyword_blocks")) == step + 2
        state = {k: v for k, v in state.items() if k not in gone} | new
    check = lambda: [rounded(index.search(q, 12)) for q in QUESTIONS]
    fresh = rt.Bm25Index(as_chunks(spark, state), keep=True)
    want = [rounded(fresh.search(q, 12)) for q in QUESTIONS]
    assert check() == want and [len(x) for x in want] == [12, 12, 12, 0, 0, 12]
    stats = lambda df: sorted((x["tok"], x["df"], round(x["idf"], 9)) for x in df.collect())
    assert stats(index.term_stats()) == stats(fresh.term_stats())
    index.tidy()
    assert len(index.ledger.snapshot().parts("keyword_blocks")) < 4 and check() == want and stats(index.term_stats()) == stats(fresh.term_stats())
    index.ledger.change("merge all", lambda c: index.merge(c, sorted(c.base.parts("keyword_blocks"), key=int)))
    assert check() == want and not index.ledger.snapshot().parts("keyword_dead")
    fresh.close()


def test_groups_that_cannot_win_are_not_read(spark, tmp_path, monkeypatch):
    from quarry.operators import keyword

    monkeypatch.setattr(keyword, "GROUP", 16)
    chunks = {f"/d/f{k:05d}.txt:0": "common " * 3 + f"filler{k % 50} " * 20 + ("rare rare " if k in (77, 1500) else "") for k in range(3000)}
    index = built(spark, str(tmp_path / "k"), as_chunks(spark, chunks))
    reads = index.reads("rare common filler7", 2)
    assert reads["asked"] > 3000 and reads["read"] < reads["asked"] / 10 < reads["all"]
    fresh = rt.Bm25Index(as_chunks(spark, chunks), keep=True)
    for q, k in (("rare common filler7", 2), ("common", 40), ("rare", 5), ("common filler1 filler2", 70)):  # ties go by key
        assert rounded(index.search(q, k)) == rounded(fresh.search(q, k))
    monkeypatch.setattr(keyword, "PUSHED", 3)
    assert rounded(index.search("common", 40)) == rounded(fresh.search("common", 40))
    fresh.close()


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_merges_exchange_only_what_is_left_of_sparse_groups(spark, tmp_path, monkeypatch, broadcast):
    import pyarrow.parquet as pq

    from quarry.operators import keyword

    exchanged, regrouped = [], keyword.regrouped
    monkeypatch.setattr(keyword, "GROUP", 8)
    monkeypatch.setattr(keyword, "BROADCAST", broadcast, raising=False)
    monkeypatch.setattr(keyword, "regrouped", lambda p: exchanged.append(p.count()) or regrouped(p))
    state = chunk_rows(400)
    index = built(spark, str(tmp_path / "k"), as_chunks(spark, state))
    for f in (tmp_path / "k" / "keyword_blocks").glob("*/*.parquet"):
        at = [(r["tok"], r["grp"]) for r in pq.read_table(f, columns=["tok", "grp"]).to_pylist()]
        assert at == sorted(at)
    gone = {k: state[k] for i, k in enumerate(sorted(state)) if i < 20 or i % 19 == 0}  # whole groups, and some of others
    new = {k: f"{v} word3 common1" for k, v in list(gone.items())[15:25]} | {"/new/1.txt:0": "word1 fresh"}
    index.ledger.change("update", lambda c: index.update(c, as_chunks(spark, new), as_chunks(spark, gone)))
    state = {k: v for k, v in state.items() if k not in gone} | new
    index.ledger.change("merge", lambda c: index.merge(c, sorted(c.base.parts("keyword_blocks"), key=int)))
    snapshot = index.ledger.snapshot()
    found = snapshot.table("keyword_blocks").collect()
    got = sorted((b["tok"], *e) for b in found for e in b["entries"])
    assert got == sorted((p["tok"], p["chunk_key"], p["tf"], p["dl"]) for p in rt.postings(as_chunks(spark, state)).collect())
    assert len(exchanged) == 1 and 0 < exchanged[0] < len(got) / 3
    assert len({(b["tok"], b["grp"]) for b in found}) == len(found) and list(snapshot.parts("keyword_blocks")) == ["3"] and not snapshot.parts("keyword_dead")
    groups = {}
    for b in found:
        assert b["n"] == len(b["entries"]) and sorted(map(tuple, b["impacts"])) == sorted((tf, min(e["dl"] for e in b["entries"] if e["tf"] == tf)) for tf in {e["tf"] for e in b["entries"]})
        groups.setdefault(b["grp"], set()).update(e["chunk_key"] for e in b["entries"])
    assert max(map(len, groups.values())) <= 8 and sum(map(len, groups.values())) == len({k for _, k, _, _ in got})


def test_empty_keyword_index(spark, tmp_path):
    index = built(spark, str(tmp_path / "k"), as_chunks(spark, []))
    assert index.search("anything").count() == 0 and index.term_stats().count() == 0


# --- vectors ----------------------------------------------------------------------------------------------------------------


def vector_rows(n, seed=0):
    import numpy as np

    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    return [(f"/d/f{k}.txt:0", [float(x) for x in centres[k % 12] + 0.25 * r.normal(size=16)]) for k in range(n)]


def as_vectors(spark, pairs):
    return spark.createDataFrame(pairs, "chunk_key string, embedding array<double>")


def test_vector_lists_find_what_a_scan_finds(spark, tmp_path):
    data = vector_rows(1500)
    odd = [("zero", [0.0] * 16), ("none", None), ("nan", [float("nan")] * 16)]
    index = VectorIndex(Ledger(spark, str(tmp_path / "v")), list_rows=60)
    change = lambda added, removed: index.ledger.change("vectors", lambda c: index.update(c, as_vectors(spark, added), as_chunks(spark, [(k, "") for k in removed])))
    change(data[:1000] + odd, [])
    change(data[1000:], [k for k, _ in data[:50]])
    change([(data[60][0], data[61][1])], [data[60][0]])
    living = [*data[50:60], (data[60][0], data[61][1]), *data[61:]]
    keys = lambda df: [x["chunk_key"] for x in df.orderBy("rank").collect()]
    snapshot, found, read = index.ledger.snapshot(), 0, 0
    for q in (data[3][1], data[700][1], data[1400][1], [1.0] * 16):
        want = keys(rt.cosine_topk(as_vectors(spark, living), q, 20))
        assert keys(index.search(q, 20, exact=True)) == want
        found += len(set(want) & set(keys(index.search(q, 20))))
        read += sum(x["rows"] for x in index.visited(snapshot, q, 20, False, 1.25))
    assert found >= 0.9 * 80 and read < 4 * 750
    assert len(keys(index.search([1.0] * 16, 2000))) == len(living)
    index.ledger.change("refit", index.refit)
    assert index.ledger.snapshot().version == snapshot.version  # it has not grown enough
    change(vector_rows(4000, 5)[1500:], [])
    assert index.ledger.change("refit", index.refit).version == snapshot.version + 1 + (0 if index.ledger.snapshot().version == snapshot.version + 1 else 1)
    assert len(keys(index.search([1.0] * 16, 9000))) == len(living) + 2500


def test_empty_vector_index(spark, tmp_path):
    index = VectorIndex(Ledger(spark, str(tmp_path / "v")))
    index.ledger.change("vectors", lambda c: index.update(c, as_vectors(spark, []), as_chunks(spark, [])))
    assert index.search([1.0, 0.0], 3).count() == 0


# --- workspaces -------------------------------------------------------------------------------------------------------------


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    for k in range(6):
        (d / f"f{k}.txt").write_text(f"File number {k} is about cement{k}. " * 3)
    return d


def test_workspace_is_reopened_by_another_process(spark, tmp_path, folder):
    a = Workspace(spark, str(tmp_path / "tables"))
    assert a.open(str(folder), NOW) == "opened"
    b = Workspace(spark, str(tmp_path / "tables"))
    assert b.directory == str(folder) and b.open(str(folder), NOW) == "same" and b.table("documents").count() == 6
    b.remove(str(folder / "f1.txt"))
    assert a.table("documents").count() == 5 and a.table("documents", 2).count() == 6
    (folder / "f2.txt").write_text("Nothing but gravel")
    a.ingest(files.scan(spark, str(folder)).filter("file_name <> 'f1.txt'"), NOW)
    found = b.corpus().ask("which file mentions gravel?")
    assert str(folder / "f2.txt") in {s["file_path"] for s in found.sources}
    keys = lambda w, q: {x["chunk_key"].rsplit("/", 1)[1] for x in w.keywords.search(q).collect()}
    assert keys(b, "cement1 cement2 gravel") == {"f2.txt:0"} and keys(a, "cement4") == {"f4.txt:0"}
    chunks = b.table("chunks").select("chunk_key", "text")
    fresh = rt.Bm25Index(chunks, keep=True)
    assert rounded(b.keywords.search("file about cement3")) == rounded(fresh.search("file about cement3"))
    assert b.vectors.search(b.embed(chunks).first()["embedding"], 50, exact=True).count() == 5
    operations = [x["operation"] for x in b.history().filter("table_name = 'documents'").orderBy("version").collect()]
    assert operations == ["scan", "ingest", "remove", "ingest"]
    b.rename(str(folder / "f4.txt"), str(folder / "g4.txt"))
    assert keys(a, "cement4") == {"g4.txt:0"}
    b.clear()
    assert a.table("documents").count() == 0 and keys(a, "cement4") == set()


def test_every_file_is_read_once(spark, tmp_path):
    d, calls = tmp_path / "docs", tmp_path / "calls"
    d.mkdir(), calls.mkdir()
    for k in range(4):
        (d / f"p{k}.pdf").write_bytes(b"x" * (k + 1))

    def reader(data, calls=str(calls)):
        import uuid

        open(f"{calls}/{len(data)}-{uuid.uuid4().hex}", "w").close()
        return [f"page of {len(data)} letters"]

    w = Workspace(spark, str(tmp_path / "tables"), readers={"pdf": reader})
    w.open(str(d), NOW)
    assert sorted(p.name.split("-")[0] for p in calls.iterdir()) == ["1", "2", "3", "4"] and w.table("chunks").count() == 4


def test_files_of_any_size_and_type_are_listed(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("text")
    for name, size in (("movie.exe", 3 << 30), ("huge.txt", 3 << 30), ("big.pdf", 51 << 20), ("~$a.txt", 5)):
        with open(tmp_path / name, "wb") as f:
            f.truncate(size)  # a hole: it costs no disk
    got = {r["file_name"]: (r["reject_reason"], r["file_hash"] is not None, r["content"]) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["a.TXT"] == (None, True, b"text") and got["movie.exe"] == ("unsupported type", False, None) and got["huge.txt"] == ("too large", False, None) and got["big.pdf"][0] == "too large"
    assert got["~$a.txt"][0] == "lock file" and len(got) == 5


def test_results_of_tools_are_complete(spark):
    from test_workspace import corpus

    c = corpus(spark)
    c.list_documents = lambda: spark.range(5000).toDF("n")
    ((_, t),) = c.run_tools([("list_documents", {})])
    assert t.count() == 5000
    c.close()
