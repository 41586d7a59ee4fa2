"""Prefix trie, fill-in-the-middle and the extendible-hash index against brute force, with nulls, long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import extendible, infill, prefix_trie
from quarry.llm.queries import QUERIES

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

# --- prefix trie ------------------------------------------------------------------------------------------------------------


def brute_trie(convs):
    """Rows of the trie of {conv_id: [(turn, words)]}, node by node."""
    paths = {c: tuple(t for t, _ in turns) for c, turns in convs.items()}
    words = {tuple(t for t, _ in turns[: d + 1]): turns[d][1] for turns in convs.values() for d in range(len(turns))}
    nodes = {p[:d] for p in paths.values() for d in range(len(p) + 1)}
    member = {n: sorted(c for c, p in paths.items() if p[: len(n)] == n) for n in nodes}
    kids = {n: [m for m in nodes if len(m) == len(n) + 1 and m[:-1] == n] for n in nodes}
    rows = []
    for n in nodes:
        under = [m for m in nodes if m[: len(n)] == n]
        saved = sum((len(member[m]) - 1) * words.get(m, 0) for m in under)
        ends = sha(",".join(str(c) for c in member[n] if paths[c] == n))
        rows.append((member[n][0], len(n), member[n[:-1]][0] if n else None, len(member[n]), len(kids[n]), sum(not kids[m] for m in under), saved, ends))
    return sorted(rows, key=repr)


def swept_in_parts(convs, parts, fan_in, seed=0):
    """Rows of the trie by sweeps and stitching alone, over runs of any sizes."""
    ordered = sorted((([prefix_trie.hashlib.md5(t.encode()).digest() for t, _ in turns], [w for _, w in turns], c) for c, turns in convs.items()), key=lambda x: (x[0], x[2]))
    r = random.Random(seed)
    cuts = sorted(r.randrange(len(ordered) + 1) for _ in range(parts - 1))
    runs = [ordered[a:z] for a, z in itertools.pairwise([0, *cuts, len(ordered)])]
    rows = [row for k, run in enumerate(runs) for row in prefix_trie.sweep(k, run)]
    nodes, level = [], [row for row in rows if row["kind"] == "open"]
    while True:
        final, got = len(level) <= fan_in, []
        for k in range(0, len(level), fan_in):
            got += prefix_trie.stitch(k, map(prefix_trie._stack_of, level[k : k + fan_in]), final)
        nodes += [row for row in got if row["kind"] == "node"]
        level = [row for row in got if row["kind"] == "open"]
        if final:
            break
    return rows, nodes


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(-5, 60), st.lists(st.sampled_from("aab"), max_size=5), min_size=1, max_size=25), st.integers(1, 9), st.integers(2, 4), st.integers(0, 99))
def test_stacks_are_stitched_as_if_never_cut(convs, parts, fan_in, seed):
    convs = {c: [(t, ord(t) - 95) for t in turns] for c, turns in convs.items()}
    rows, nodes = swept_in_parts(convs, parts, fan_in, seed)
    got = sorted((r["depth"], r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in [*nodes, *(x for x in rows if x["kind"] == "node")])
    assert got == sorted((r[1], r[0], *r[3:7]) for r in brute_trie(convs))
    assert {r["key"] for r in rows if r["kind"] == "place"} == {r["key"] for r in nodes}
    inner = {r["conv_id"] for r in rows if r["kind"] == "ids"}
    assert inner <= set(convs)


def frame(spark, convs):
    turns = [(c, d, "user", f"{t} " * w, "x", 1) for c, said in convs.items() for d, (t, w) in enumerate(said)]
    return prefix_trie.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, path string, words int"))


def rows_of_trie(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_trie_with_hot_groups_and_long_conversations(spark, monkeypatch, parts):
    """A third of the conversations are copies, another third share their first turn, one has 300 turns; blocks of ids are small and rounds are several."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "FAN_IN", 3)
    r = random.Random(parts)
    convs = {k: [("hot", 2), ("same", 1)] for k in range(100, 160)}
    convs |= {k: [("hot", 2), (f"t{r.randrange(20)}", 3), (f"t{r.randrange(3)}", 1)][: r.randrange(1, 4)] for k in range(200, 260)}
    convs |= {k: [(f"t{r.randrange(4)}", 1) for _ in range(r.randrange(1, 6))] for k in range(-20, 20)}
    convs[7] = [(f"x{d % 7}", 1) for d in range(300)]
    convs[8] = convs[7][:250]
    assert rows_of_trie(prefix_trie.trie(frame(spark, convs), parts=parts)) == brute_trie(convs)


def test_trie_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, None, None), (1, 2, "user", "a b"), (1, 2, "user", "a b"), (2, 5, "", ""), (2, 6, "user", "a b"), (None, 0, "user", "lost"), (3, 0, "use", "ra b"), (4, 1, "user", "w " * 200_000)]
    got = rows_of_trie(prefix_trie.trie(prefix_trie.conversations(spark.createDataFrame(rows, schema)), parts=2))
    blank, ab = ("0:", 0), ("4:userab", 2)
    assert got == brute_trie({1: [blank, ab, ab], 2: [blank, ab], 3: [("3:use", 2)], 4: [("long", 200_000)]})
    empty = spark.createDataFrame([], schema)
    assert prefix_trie.trie(prefix_trie.conversations(empty)).count() == 0


def test_shared_starts(spark):
    """Copied first turns, sources that are absent or too short, and conversations that are left without turns."""
    convs = {20: ["a", "b"], 21: ["p", "q", "r", "s"], 22: ["p"], 45: ["x"], 46: ["x", "y", "z", "u"], -3: ["m", "n"], 0: ["o", "o2", "o3", "o4"]}
    df = frame(spark, {c: [(t, 1) for t in said] for c, said in convs.items()})
    head = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    got = prefix_trie.with_shared_starts(df, F.expr("conv_id - conv_id % 20"), head, 3)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    source = {c: c - int(np.fmod(c, 20)) for c in convs}
    want = {c: [(t, 1) for t in [*convs.get(source[c], [])[: h[c]], *said[h[c] :]]] for c, said in convs.items()}
    assert rows_of_trie(prefix_trie.trie(got, parts=3)) == brute_trie(want)
    assert any(not t for t in want.values()) and {len(r["path"]) for r in got.collect()} == {len(t) for t in want.values()}


# --- fill in the middle -----------------------------------------------------------------------------------------------------


def brute_cut(doc_id, text, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in infill.MARKS):
        return len(units), "plain", None, None, text
    a, z = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    spm = h[3] % 100 < spm_percent
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def draws(doc_id):
    return [int(sha(f"7:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="a\n<PSM>é€😀", max_size=30), max_size=8), st.integers(1, 9), st.integers(0, 3))
def test_cuts_of_small_chunks(texts, chunk, skip):
    """Any chunk size gives the cuts of the whole text, also in a slice of a batch."""
    ids = list(range(len(texts)))
    plain = [not t or any(m in t for m in infill.MARKS) for t in texts]
    h = [draws(k) for k in ids]
    columns = [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64()), pa.array(plain, pa.bool_()), pa.array([x[3] % 100 < 50 for x in h], pa.bool_())]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "first", "second", "plain", "spm"]).slice(skip)
    got = infill.cut_batch(batch, chunk).to_pylist()
    assert [tuple(r.values())[1:] for r in got] == [brute_cut(k, t) for k, t in zip(ids, texts, strict=True)][skip:]


def test_infill_of_odd_documents(spark):
    texts = [None, "", "\n", "one line", "a\nb\nc", "é\n€uro\n😀\n" * 5000, "x" * 300_000, "say <M> no", "\r\n\r\n", "<P", "a<\n<b\nM>\n"]
    rows = [(k, t, "psm", 5) for k, t in enumerate(texts)] + [(4, "a\nb\nc", "x", 1), (4, "other\ntext", "x", 1), (None, "a\nb", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    out = infill.cut(docs, chunk=1000).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: repr(r)
    assert sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out], key=key) == sorted([(d, *brute_cut(d, t)) for d, t, _, _ in rows], key=key)
    assert sorted(r["back"] for r in out) == sorted(t or "" for _, t, _, _ in rows)
    assert infill.cut(docs.filter("false")).count() == 0
    assert {r["form"] for r in infill.cut(docs, fim_percent=0).collect()} == {"plain"} and {r["form"] for r in infill.cut(docs, spm_percent=100).collect()} == {"plain", "spm"}


# --- extendible-hash index --------------------------------------------------------------------------------------------------


def body(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_groups(rows):
    out = []
    for d, t in rows:
        same = [(e, u or "") for e, u in rows if body(u) == body(t)]
        keep = min(same, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        out.append((d, keep[0], len(same), sha(body(t))))
    return sorted(out, key=repr)


def some_rows():
    r = random.Random(1)
    rows = [(k, " ".join(f"w{r.randrange(50)}" for _ in range(30))) for k in range(120)]
    rows += [(200 + k, "the\thot  text" + " " * (k % 5)) for k in range(90)] + [(400 + k, rows[k][1].replace(" ", "\n" if k % 2 else "  ")) for k in range(0, 120, 4)]
    return rows + [(None, rows[0][1] + " " * 9), (None, None), (500, ""), (501, " \t\x0b\x0c\r\n"), (3, rows[3][1]), (3, "same id, other text"), (-8, "é x"), (-9, "éx"), (-10, "é x "), (600, "z" * 200_000), (601, "z" * 200_000)]


def indexed(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, h string, bucket int, text_sha256 string")


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.pmod(F.length(c), F.lit(3)) * F.lit(1 << 61), lambda c: F.lit(5).cast("long")], ids=["hash", "three values", "one value"])
@pytest.mark.parametrize("bucket_mb", [0.002, 100.0])
def test_groups_match_brute_force(spark, hashed, bucket_mb):
    """Buckets that split, overfull hashes with pages of their own, and hashes shared by different texts."""
    rows = some_rows()
    got = extendible.groups(indexed(spark, rows), bucket_mb, hashed).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == brute_groups(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({body(t) for _, t in rows}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_directory_doubles_until_buckets_fit(spark):
    rows = some_rows()
    index = extendible.build(indexed(spark, rows), 0.002)
    slots = index.directory.collect()
    assert index.depth > 2 and len({r["slot"] for r in slots}) == len(slots) <= 1 << index.depth and len({r["local_depth"] for r in slots}) > 1
    for r in slots:
        assert r["slot"] >> (index.depth - r["local_depth"]) == r["bucket"] >> (index.depth - r["local_depth"])
    hot = {r["h"] for r in index.overfull.collect()}
    weight = index.pages.filter(~F.col("h").isin(*hot)).join(index.directory, extendible.slot(F.col("h"), index.depth) == F.col("slot")).groupBy("bucket").agg(F.sum(F.col("n_bytes") + extendible.ROW_BYTES).alias("w"))
    assert hot and weight.agg(F.max("w")).first()[0] <= 2000 and index.overfull.filter("salts < 2").count() == 0
    assert index.pages.join(index.directory, extendible.slot(F.col("h"), index.depth) == F.col("slot")).count() == len(rows)
    assert extendible.build(indexed(spark, rows), 100.0).depth == 0


def test_rows_that_stay_keep_their_columns(spark):
    rows = some_rows()
    docs = indexed(spark, rows)
    left = extendible.drop_copies(docs, 0.002)
    assert left.columns == docs.columns and left.schema["h"].dataType == docs.schema["h"].dataType and left.count() == len({body(t) for _, t in rows})
    assert {r["text"] for r in left.collect()} <= {t for _, t in rows} and left.filter("text like 'the%'").first()["text"].endswith(" " * 4)
    assert extendible.groups(docs.filter("false")).count() == 0 and extendible.drop_copies(docs.filter("false")).count() == 0


def test_main_path_is_native(spark):
    """No Python in the plans of the index."""
    plan = QUERIES["op13_extendible"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
