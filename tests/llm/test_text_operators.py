"""Operators on documents against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, minhash, pitman_yor, quality, repeats, toxicity
from quarry.llm.common import pack, pack_sorted, rolling, unpack, unpack_sorted
from quarry.llm.components import connected_components

DOCS = "doc_id long, text string, label string, n_words long, _block int, node string, bucket string, score string"


def docs(spark, texts, first=0):
    """Rows with clashing extra columns."""
    return spark.createDataFrame([(first + i if not isinstance(t, tuple) else t[0], t[1] if isinstance(t, tuple) else t, "x", 1, 2, "n", "b", "s") for i, t in enumerate(texts)], DOCS)


def words(n, seed):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, 500, n)]


@pytest.fixture(scope="module")
def corpus():
    base = words(120, 1)
    near = [*base[:60], "changed", *base[61:]]
    shared = words(40, 2)
    return [
        " ".join(base), " ".join(base), " ".join(near), None, "", "  \n ", "one two", "one two", "ONE two", " ".join(words(30, 3) + shared + words(20, 4)), " ".join(words(10, 5) + shared),
        " ".join(shared[:12]), " ".join(words(60_000, 6)), "the " * 300, "the " * 40 + "end", " ".join(shared) + " " + " ".join(base[:20]), (3, " ".join(base)), (3, " ".join(base)), (None, " ".join(base)), (None, None),
    ]


def rows_of(spark, corpus):
    return [(r["doc_id"], r["text"]) for r in docs(spark, corpus).select("doc_id", "text").collect()]


# --- packing and components -------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=50, deadline=None)
def test_packing_round_trips(values):
    v = np.array(sorted(values), np.uint64)
    assert (unpack_sorted(pack_sorted(v)) == v).all() and (unpack(pack(v), np.uint64) == v).all()


def test_rolling_hash_tells_order():
    h = np.arange(1, 6, dtype=np.uint64)
    assert len(set(rolling(h, 3).tolist())) == 3 and rolling(h[::-1].copy(), 5)[0] != rolling(h, 5)[0] and len(rolling(h, 6)) == 0


def test_components_of_a_long_chain_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(7, 7), (3, 1), (None, 4)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").filter("u is not null")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 50)) and len(got) == 61 + 49
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------------


def brute_hits(rows, items, n):
    cut = lambda t: decontaminate.words(t)
    windows = {}
    for item, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(None if item is None else str(item))
    out = []
    for doc_id, t in rows:
        w, hit, found = cut(t), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= own
        out.append((doc_id, len(w), len(hit), sorted(found, key=lambda x: (x is None, x or ""))))
    return sorted(out, key=repr)


def test_decontamination_matches_brute_force(spark, corpus):
    items = [(1, " ".join(words(120, 1)[40:52])), (12, "One, TWO!"), (3, None), (4, "—"), (5, " ".join(words(40, 2)[5:25])), (None, "the the"), (None, " ".join(words(120, 1)[60:75])), (5, "ONE")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_hits(docs(spark, corpus), bench).collect()
    plain = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr)
    assert plain == brute_hits(rows_of(spark, corpus), items, 10)
    assert all(r["contaminated"] == (r["n_hit"] > 0) == bool(r["spans"]) for r in got)
    kept = decontaminate.decontaminate(docs(spark, corpus), bench)
    assert kept.columns == docs(spark, corpus).columns and kept.count() == sum(not r["contaminated"] for r in got)
    cut = decontaminate.decontaminate(docs(spark, corpus), bench, remove="spans")
    assert cut.count() == len(corpus) and decontaminate.find_hits(cut, bench).filter("n_words > 0 and doc_id = 8").count() == 0
    assert decontaminate.find_hits(docs(spark, corpus), bench.filter("false")).filter("contaminated").count() == 0
    assert decontaminate.find_hits(docs(spark, []), bench).count() == 0


def test_digests_of_items_without_ids(spark, monkeypatch):
    """The query's columns for a leak of an item without an id, beside an item with one."""
    from quarry.llm import queries

    tables = {"documents": docs(spark, ["x y z", "y z", "none"]), "benchmark": spark.createDataFrame([(None, "x y"), (7, "y z"), (None, "z")], "item_id long, text string")}
    monkeypatch.setattr(queries, "table", lambda spark, sf, name: tables[name])
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in queries.op2_decontaminate(spark, "").collect()}
    seven, nothing = (hashlib.sha256(x).hexdigest() for x in (b"7", b""))
    assert got == {0: (3, 2, seven, True), 1: (2, 2, seven, True), 2: (0, 0, nothing, False)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.lists(st.sampled_from(["a", "b", "B!", "é", "cc"]), max_size=14).map(" ".join)), max_size=6), st.lists(st.sampled_from(["a", "b", "é", "cc", "zz"]), max_size=20), st.integers(1, 4), st.integers(1, 9), st.booleans())
def test_compiled_windows_find_what_they_should(items, doc, n, most, clash):
    """Windows in flat arrays, items cut into pieces, and windows that share a hash, against a plain search."""
    hasher = decontaminate.WordHasher()
    if clash:
        hasher = lambda w: np.full(len(w), 7, np.uint64)
    want_mask, want = np.zeros(len(doc), bool), set()
    for item, text in items:
        w = [x.decode() for x in decontaminate.words(text)]
        for i in range(max(1, len(w) - n + 1) if w else 0):
            window = w[i : i + n]
            for s in range(len(doc) - len(window) + 1):
                if doc[s : s + len(window)] == window:
                    want_mask[s : s + len(window)] = True
                    want.add(None if item is None else str(item))
    for parts in ([items], [p for row in items for p in decontaminate.pieces([row], n, most)]):
        mask, found = np.zeros(len(doc), bool), set()
        for part in parts:
            with pytest.MonkeyPatch.context() as patch:
                if clash:
                    patch.setattr(decontaminate, "WordHasher", lambda: hasher)
                patch.setattr(decontaminate, "SLICE", 3)
                compiled = decontaminate.compile_items(part, n)
            m, f = decontaminate.scan([x.encode() for x in doc], compiled, hasher)
            mask, found = mask | m, found | f
        assert (mask == want_mask).all() and found == want


def test_benchmark_in_parts_gives_the_same(spark, corpus, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(words(120, 1)[i * 20 : i * 20 + 15])) for i in range(6)], "item_id long, text string")
    whole = sorted(map(repr, decontaminate.find_hits(docs(spark, corpus), bench).collect()))
    monkeypatch.setattr(decontaminate, "parts", lambda b, most=0, f=decontaminate.parts: f(b, 60))
    assert sorted(map(repr, decontaminate.find_hits(docs(spark, corpus), bench).collect())) == whole


def test_only_one_part_of_the_benchmark_is_held(spark, corpus, monkeypatch):
    import os

    bench = spark.createDataFrame([(i, " ".join(words(120, 1)[i * 20 : i * 20 + 15])) for i in range(4)], "item_id long, text string")
    modes = ("documents", "spans")
    whole = [sorted(map(repr, decontaminate.decontaminate(docs(spark, corpus), bench, remove=m).collect())) for m in modes]
    made, make = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: made.append(make(v)) or made[-1])
    monkeypatch.setattr(decontaminate, "parts", lambda b, most=0, f=decontaminate.parts: f(b, 60))
    for m, want in zip(modes, whole, strict=True):
        made.clear()
        assert sorted(map(repr, decontaminate.decontaminate(docs(spark, corpus), bench, remove=m).collect())) == want
        assert len(made) == 4 and [os.path.exists(b._path) for b in made] == [False, False, False, True]


# --- substring dedup --------------------------------------------------------------------------------------------------------


def brute_repeats(rows, width=13):
    own = {}
    for d, t in rows:
        w = (t or "").encode().split()
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                own[k] = min(own.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is None or own[tuple(w[i : i + width])] < d:
                if d is not None or tuple(w[i : i + width]) in own:
                    gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_mb", [0.4, 0.0001])
def test_repeats_match_brute_force(spark, corpus, block_mb):
    """With one block a document nearly, and with all documents in some blocks; null ids keep all their words."""
    out = repeats.remove_repeats(docs(spark, corpus), block_mb=block_mb)
    rows = out.collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows if r["doc_id"] is not None), key=repr)
    assert got == brute_repeats(rows_of(spark, [c for c in corpus if not isinstance(c, tuple) or c[0] is not None]))
    assert Counter((r["text"], r["n_removed"], r["kept_text"]) for r in rows if r["doc_id"] is None) == Counter((t, 0, " ".join((t or "").split())) for d, t in rows_of(spark, corpus) if d is None)
    assert set(docs(spark, corpus).columns) - {"_block"} <= set(out.columns)
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_the_layout_of_a_text_can_stay(spark):
    line = " ".join(words(20, 77))
    out = repeats.remove_repeats(docs(spark, [line, f"  a\nb\t{line}\n\nc  d\n", None, " x\n"]), layout=True).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in out] == [line, "  a\nb\tc  d\n", None, " x\n"] and out[1]["n_removed"] == 20


def by_automaton(texts, width=4, shown=()):
    return [int(m.sum()) for m in repeats.removed_words(list(range(len(texts))), [t.encode() for t in texts], [(i, t.encode()) for i, t in shown], width)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=8))
def test_automaton_matches_brute_force_on_periodic_texts(texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert list(enumerate(by_automaton([t for _, t in rows]))) == [(d, gone) for d, _, gone, _ in brute_repeats(rows, 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=2, max_size=8))
def test_passages_shown_by_other_blocks_give_the_same(texts):
    """Every second document lies in another block, whose words arrive only as the passages that were asked for."""
    width, w = 4, [" ".join(t).encode() for t in texts]
    blocks = [repeats.Block(list(range(k, len(w), 2)), w[k::2], width) for k in (0, 1)]
    own = [dict(zip(v.tolist(), least.tolist(), strict=True)) for v, least, _ in (b.owners() for b in blocks)]
    got = {}
    for k in (0, 1):
        mine, other = own[k], own[1 - k]
        asked = np.array(sorted(h for h in mine if other.get(h, 99) < mine[h]), np.uint64)
        shown = [(i, t) for _, ids, texts_ in repeats.wanted_passages(blocks[1 - k], [(asked, np.zeros(len(asked), np.uint32))], width) for i, t in zip(ids, texts_, strict=True)] if len(asked) else []
        got |= dict(zip(range(k, len(w), 2), (int(m.sum()) for m in repeats.removed_words(list(range(k, len(w), 2)), w[k::2], shown, width)), strict=True))
    assert [got[d] for d in range(len(w))] == [x[2] for x in brute_repeats([(i, " ".join(t)) for i, t in enumerate(texts)], width)]


def test_the_automaton_decides_by_words(monkeypatch):
    """Windows with equal hashes but other words stay, and without the automaton nothing is found."""
    texts, shown = ["a b c d e", "p q r s t", "a b c d e x"], [(-5, "k l m n o")]
    assert by_automaton([*texts, "k l m n"], shown=shown) == [0, 0, 5, 4]
    monkeypatch.setattr(repeats, "rolling", lambda h, n: np.full(max(0, len(h) - n + 1), 7, np.uint64))  # every window has the same hash
    assert by_automaton(["p q r s t", "a b c d e"], shown=shown) == [0, 0]
    monkeypatch.undo()
    monkeypatch.setattr(repeats, "word_hashes", lambda text, begin, end: (end - begin).astype(np.uint64))  # words of one length have the same hash
    assert by_automaton(["p q r s t", "a b c d e"], shown=shown) == [0, 0] and by_automaton(["a b c d", "a b c d"]) == [0, 4]
    monkeypatch.undo()
    monkeypatch.setattr(repeats.Phrases, "occurrences", lambda self, word, n: iter(()))
    assert by_automaton([*texts, "k l m n"], shown=shown) == [0, 0, 0, 0]


@given(st.lists(st.binary(max_size=12), max_size=20))
@settings(max_examples=100, deadline=None)
def test_word_hashes_tell_words_apart(texts):
    w = [x for t in texts for x in t.split()]
    b = repeats.Block([0], [b" ".join(w)], 1)
    assert len(set(b.word.tolist())) == len(set(w)) and b.lengths.tolist() == [len(w)] and [b.slice(i, 1) for i in range(len(w))] == w


def test_more_distinct_words_than_letters(monkeypatch):
    long = " ".join(f"w{i}" for i in range(1_200_000))
    assert by_automaton([long, "new " + long], 13) == [0, 1_200_000]
    monkeypatch.setattr(repeats, "LETTERS", 3)
    monkeypatch.setattr(repeats, "PHRASE", 2)
    assert by_automaton(["a b c d e f", "c d e f g", "z a b c d", "a b c"], 4) == [0, 4, 4, 0]


# --- MinHash ----------------------------------------------------------------------------------------------------------------


def brute_groups(rows, width):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, (d, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_match_brute_force(spark, corpus, width):
    got = minhash.components(docs(spark, corpus), width=width).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_groups(rows_of(spark, corpus), width)
    assert minhash.components(docs(spark, [])).count() == 0
    kept = minhash.one_of_each(docs(spark, corpus), width)
    assert kept.columns == docs(spark, corpus).columns


def test_chains_and_large_buckets_lose_no_link(spark, monkeypatch):
    """A chain of texts in which only neighbours are alike enough, and a small block size, so that every path runs."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    base = words(200, 9)
    chain = []
    for k in range(12):
        base = base[6:] + words(6, 100 + k)
        chain.append(" ".join(base))
    rows = rows_of(spark, chain)
    got = minhash.components(docs(spark, chain), width=4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_groups(rows, 4)
    assert len({r["component_id"] for r in got}) == 1


def test_near_copies_without_ids_are_linked(spark):
    """Texts whose only row has a null id: one joins two numbered documents that are not alike enough, two have only each other."""
    base, other = words(200, 21), words(150, 22)
    middle = [*base[:9], *words(9, 23), *base[18:]]
    end = [*middle[:170], *words(9, 24), *middle[179:]]
    rows = [(1, " ".join(base)), (None, " ".join(middle)), (2, " ".join(end)), (None, " ".join(other)), (None, " ".join([*other[:70], "new", *other[71:]])), (7, " ".join(words(90, 25)))]
    got = minhash.components(docs(spark, rows), width=4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_groups(rows, 4)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]} == {1: 1, 2: 1, 7: 7}


def test_one_row_of_each_group_stays(spark, corpus):
    """Ids repeated with other texts, equal rows and null ids, against brute force; groups stand for their texts."""
    lone, pair = words(80, 31), words(90, 32)
    odd = [(60, " ".join(words(120, 1))), (60, " ".join(lone)), (61, " ".join(pair)), (61, " ".join(pair)), (None, " ".join(pair)), (None, " ".join(words(70, 33))), (None, " ".join([*words(70, 33)[:69], "end"])), (None, None)]
    for texts in ([*corpus, *odd], [t for t in corpus if not isinstance(t, tuple)]):
        rows = rows_of(spark, texts)
        numbered = {t: brute for (_, t), brute in zip(rows, range(len(rows)), strict=True)}
        by_number = [(numbered[t], t) for _, t in rows]
        group = {t: min(c for d, _, c in brute_groups(by_number, 5) if d == numbered[t]) if (t or "").split() else t for _, t in rows}
        want = Counter((d, t) for d, t in rows if not (t or "").split())
        for g in {g for t, g in group.items() if (t or "").split()}:
            want[min(((d for d, t in rows if group[t] == g)), key=lambda d: (d is None, d)), g] += 1
        got = minhash.one_of_each(docs(spark, texts))
        assert got.columns == docs(spark, texts).columns
        assert Counter((r["doc_id"], group[r["text"]]) for r in got.collect()) == want


# --- BPE --------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t, P.path("word_bpe_49k.json")


ODD = ["ΑΣ Σίσυφος", "<|endoftext|>hi<|startoftext|> don't I'll  \x1c\x85 x", "日本語 🤖 é ﬁ İstanbul ǅ", "a" * 3000 + " 1234 5.6!!...?", "it's 'S 'T they'VE", "zero​width­ ½ Ⅷ", "ẞ ß", "\x00 \x07\t\n", "ç reê", "\U00010d50\ua7cbx \u1c89", "a\U00011935\U00011930 \U00011938e\u0301"]


def test_bpe_matches_the_library(spark, corpus, tokenizer):
    t, path = tokenizer
    every = [*corpus, *ODD]
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in bpe.encode(docs(spark, every), path).collect()), key=repr)
    want = []
    for d, x in rows_of(spark, every):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, ids, t.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert bpe.encode(docs(spark, []), path).count() == 0


def test_other_tokenizer_settings_are_refused(tokenizer, tmp_path):
    import json

    j = json.load(open(tokenizer[1], encoding="utf-8"))
    for change in ({"normalizer": None}, {"normalizer": {"type": "Lowercase"}}, {"decoder": {"type": "ByteLevel"}}, {"model": j["model"] | {"byte_fallback": True}}, {"added_tokens": [j["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(j | change))
        with pytest.raises(bpe.Unsupported):
            bpe.load(str(tmp_path / "t.json"))


@pytest.fixture(scope="module")
def encoder(tokenizer):
    return bpe.Encoder(bpe.load(tokenizer[1]))


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_bpe_of_any_text(tokenizer, encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.encode([text])[0] == tokenizer[0].encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(word=st.text(alphabet="abcdehilnorstéßΣ'", min_size=1, max_size=120))
def test_side_by_side_merging_equals_merging_alone(encoder, word):
    units = encoder.units(word.lower())
    assert encoder.exact_many([units, units[:1]])[0] == encoder.exact_long(units)


# --- language model ---------------------------------------------------------------------------------------------------------


def brute_base(rows):
    """One result a row, whatever its id."""
    count, texts = Counter(), [(d, [*(t or "").encode().lower().split(), "end"]) for d, t in rows]
    for d, w in texts:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return [(d, d is None or zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for d, w in texts]


def test_language_model_base_and_gain(spark, corpus):
    got = pitman_yor.score(docs(spark, corpus)).collect()
    told = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(told, key=repr) == sorted(brute_base(rows_of(spark, corpus)), key=repr)
    assert all(r["score"] < 0 and math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"])) for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert pitman_yor.score(docs(spark, [])).count() == 0


def test_scores_do_not_depend_on_the_number_of_shards(spark, monkeypatch):
    """Also with contexts so frequent that they are spread; the overall perplexity is that of all tokens."""
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.3, 120) % 400) for _ in range(120)]
    means = []
    for shards in (1, 7, 20):
        monkeypatch.setattr(pitman_yor, "parts_of", lambda df, mb, least, n=shards: n if least == 32 else 1)
        out = pitman_yor.score(docs(spark, texts)).cache()
        rows = out.collect()
        means.append([np.sum([x["score"] for x in rows if x["held_out"] == h]) / np.sum([x["n_tokens"] for x in rows if x["held_out"] == h]) for h in (False, True)])
        whole = {x["held_out"]: x["perplexity"] for x in pitman_yor.perplexity(out).collect()}
        assert all(math.isclose(whole[h], 10 ** -means[-1][h], rel_tol=1e-9) for h in (False, True))
    assert np.ptp(means, axis=0).max() < 0.005


def seated_one_by_one(rows, d1, d0, theta, sweeps, kept):
    """A plain Chinese-restaurant sampler, customer by customer, and the mean log10 probability a token of held-out and training texts."""
    r = np.random.default_rng(0)
    texts = [([*t.split(), "<end>"], zlib.crc32(str(d).encode()) % 10 != 0) for d, t in rows]
    pairs = [(v, w) for t, learn in texts if learn for v, w in zip(["<start>", *t], t, strict=False)]
    vocabulary = len({w for _, w in pairs})
    tables: dict = {}  # (restaurant, dish) -> sizes of its tables
    sums = {"": [0, 0]}

    def p(rest, w, base, d):
        c, t = sums.get(rest, (0, 0))
        own = tables.get((rest, w), [])
        return (sum(own) - d * len(own) + (theta + d * t) * base) / (theta + c)

    top = lambda w: p("", w, 1 / (vocabulary + 1), d0)

    def sit(rest, w, base, d):
        own = tables.setdefault((rest, w), [])
        n = sums.setdefault(rest, [0, 0])
        weights = np.array([*(x - d for x in own), (theta + d * n[1]) * base])
        k = int(r.choice(len(weights), p=weights / weights.sum()))
        n[0] += 1
        if k < len(own):
            own[k] += 1
            return False
        own.append(1)
        n[1] += 1
        return True

    def leave(rest, w):
        own, n = tables[rest, w], sums[rest]
        k = int(r.choice(len(own), p=np.array(own) / sum(own)))
        own[k] -= 1
        n[0] -= 1
        if own[k] == 0:
            own.pop(k)
            n[1] -= 1
            return True
        return False

    chance = [np.zeros(len(t)) for t, _ in texts]
    for sweep in range(sweeps):
        for v, w in pairs:
            if sweep and leave(("c", v), w):
                leave("", w)
            if sit(("c", v), w, top(w), d1):
                sit("", w, 1 / (vocabulary + 1), d0)
        if sweep >= sweeps - kept:
            for k, (t, _) in enumerate(texts):
                chance[k] += [p(("c", v), w, top(w), d1) / kept for v, w in zip(["<start>", *t], t, strict=False)]
    return [np.concatenate([np.log10(c) for c, (_, learn) in zip(chance, texts, strict=True) if learn == own]).mean() for own in (False, True)]


def test_scores_are_near_those_of_a_plain_sampler(spark):
    r = np.random.default_rng(14)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.5, 40) % 60) for _ in range(100)]
    rows = rows_of(spark, texts)
    pairs = Counter((v, w) for d, t in rows if zlib.crc32(str(d).encode()) % 10 for v, w in zip(["<start>", *t.split()], [*t.split(), "<end>"], strict=True))
    d1 = pitman_yor.discount(sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    served = Counter(w for _, w in pairs)
    want = seated_one_by_one(rows, d1, pitman_yor.discount(sum(c == 1 for c in served.values()), sum(c == 2 for c in served.values())), pitman_yor.THETA, 25, 10)
    got = pitman_yor.score(docs(spark, texts)).collect()
    mean = [sum(x["score"] for x in got if x["held_out"] != own) / sum(x["n_tokens"] for x in got if x["held_out"] != own) for own in (False, True)]
    assert np.abs(np.array(mean) - want).max() < 0.02


def test_language_model_without_training_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = pitman_yor.score(docs(spark, [(held, "some words")])).first()
    assert (r["train_tokens"], r["n_known"], r["score"], r["base_score"]) == (0, 0, 0.0, 0.0)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=2, max_size=8), st.integers(0, 100))
def test_probabilities_sum_to_one(counts, seed):
    """A restaurant's predictive probabilities over all dishes sum to one if its parent's do, whatever the averaged tables are."""
    r = np.random.default_rng(seed)
    c = np.array(counts)
    tables = np.where(c > 0, 1 + r.random(len(c)) * (c - 1).clip(0), 0.0)
    parent = r.dirichlet(np.ones(len(c)))
    p = pitman_yor.predictive(c, tables, np.full(len(c), c.sum()), np.full(len(c), tables.sum()), parent, 0.7)
    assert math.isclose(p.sum(), 1, rel_tol=1e-9) and (p > 0).all()


def test_seating_follows_its_conditional():
    """Empirical table counts of small dishes against the enumerated conditional."""
    d, theta, c, parent, elsewhere = 0.5, 1.0, 4, 0.3, 2
    numbers = pitman_yor.stirling(d, pitman_yor.EXACT)
    weight = np.array([np.exp(numbers[c, t]) * parent**t * np.prod([theta + d * (elsewhere + k) for k in range(t)]) for t in range(1, c + 1)])
    draws = pitman_yor.seat(np.full(40_000, c), np.ones(40_000, np.int64), np.full(40_000, elsewhere), np.full(40_000, parent), d, theta, numbers, np.random.default_rng(0))
    assert np.abs(np.bincount(draws, minlength=c + 1)[1:] / 40_000 - weight / weight.sum()).max() < 0.01
    big = pitman_yor.seat(np.full(50, 100_000), np.ones(50, np.int64), np.full(50, elsewhere), np.full(50, parent), d, theta, numbers, np.random.default_rng(0))
    assert (big >= 1).all() and (big < 100_000).all()


# --- classifiers ------------------------------------------------------------------------------------------------------------


def labelled(spark, n=400, seed=3):
    r = np.random.default_rng(seed)
    texts, quality_, toxic = [], [], []
    for i in range(n):
        w = [f"w{x}" for x in r.integers(0, 300, 60)]
        good, bad = i % 4 != 0, i % 5 == 1
        if not good:
            w = [x.upper() + "!!" for x in w]
        if bad:
            w[int(r.integers(60))] = ["idiot", "id-iot", "Moron!", "moron", "worthless"][int(r.integers(5))]
        texts.append(" ".join(w))
        quality_.append(int(good))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(quality_, toxic, strict=True))] + [(None, 1, 1), (9999, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs(spark, texts), labels, quality_, toxic


def test_quality_on_held_out_rows(spark, corpus):
    d, labels, truth, _ = labelled(spark)
    forest = quality.train(d, labels)
    rows = quality.score(d, forest).filter("held_out").collect()
    assert len(rows) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.97
    odd = quality.score(docs(spark, corpus), forest).collect()
    assert len(odd) == len(corpus) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in odd)
    kept = quality.keep_good(d, forest)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] for r in quality.score(d, forest).collect())
    assert quality.score(docs(spark, []), forest).count() == 0
    none = quality.train(d, labels.filter("false"))
    assert {r["score"] for r in quality.score(docs(spark, corpus), none).collect()} == {0.5}


def test_forest_traversal_equals_walking():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 5))
    f = quality.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), trees=10, depth=3)
    for i in range(20):
        total = f.start
        for t in range(10):
            k = 0
            for _ in range(3):
                k = 2 * k + 1 + int(x[i, f.feature[t, k]] > f.threshold[t, k])
            total += f.leaf[t, k - 7]
        assert math.isclose(f.scores(x[i : i + 1])[0], 1 / (1 + math.exp(-total)))


def test_toxicity_on_held_out_rows(spark, corpus):
    d, labels, _, truth = labelled(spark)
    machine = toxicity.train(d, labels)
    rows = toxicity.score(d, machine).filter("held_out").collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.95
    gapped = toxicity.score(docs(spark, ["w1 w2 idxiot w3 " + " ".join(words(40, 8)), "w1 i d i o t w3 " + " ".join(words(40, 8)), "w1 w2 " + " ".join(words(40, 8))]), machine).orderBy("doc_id").collect()
    assert [r["predicted"] for r in gapped] == [1, 1, 0]
    odd = toxicity.score(docs(spark, corpus), machine).collect()
    assert len(odd) == len(corpus) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(docs(spark, []), machine).count() == 0
    none = toxicity.train(d, labels.filter("toxic = 0"))
    assert max(r["score"] for r in toxicity.score(d, none).collect()) < 1e-9


def brute_kernel(a, b):
    """Weighted subsequences that two terms share, character by character."""
    from itertools import combinations

    def subsequences(w):
        w = toxicity.padded(w)
        out = Counter()
        for at in combinations(range(len(w)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN:
                out["".join(w[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        weights = [toxicity.DECAY ** (at[-1] - at[0] + 1) for at in combinations(range(len(w)), toxicity.ORDER) if at[-1] - at[0] < toxicity.SPAN]
        return out, math.sqrt(sum(x * x for x in weights))

    (x, n), (y, m) = subsequences(a), subsequences(b)
    return sum(v * y[k] for k, v in x.items()) / n / m


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcé傻瓜", min_size=1, max_size=9), st.text(alphabet="abcé傻瓜", min_size=1, max_size=9))
def test_kernel_equals_brute_force(a, b):
    a, b = toxicity.padded(a), toxicity.padded(b)
    assert math.isclose(toxicity.against([a], toxicity.vector(b))[0], brute_kernel(a, b), rel_tol=1e-9, abs_tol=1e-12)


def test_sentences_and_terms():
    got = toxicity.sentences("You are an id-iot! Is it s c u m now?\nNo. 傻瓜。ok")
    assert [sorted(x.strip("\x02\x03") for x in t) for t in got[:3]] == [["an", "are", "id-iot", "idiot", "you"], ["c", "is", "it", "m", "now", "s", "u"], ["no"]]
    assert "scum" in got[-1] and any(toxicity.padded("傻瓜") in t for t in got) and toxicity.sentences(None) == toxicity.sentences(" \n ") == []
    assert all(len(w) >= toxicity.ORDER for t in ("a", "ab", "abc", "abcd") for w in toxicity.terms(t))
    assert toxicity.against(["\x02pig\x03"], toxicity.vector("\x02pig\x03"))[0] > 2 * toxicity.against(["\x02big\x03"], toxicity.vector("\x02pig\x03"))[0]


@pytest.mark.parametrize("insults", [["sod", "git", "pig"], ["zq", "vx"], ["傻瓜", "你是傻瓜吗", "他真是笨蛋啊", "笨蛋"]], ids=["three letters", "two letters", "without blanks"])
def test_short_insults_are_learned(insults):
    """Held-out texts with words under four characters, or within a run of characters without blanks, beside clean ones."""
    r, rows = np.random.default_rng(8), []
    words_, other = [f"{a}{b}{c}" for a in "bdkl" for b in "aeiou" for c in "mnrst"] + ["of", "to", "an"], ["你好世界", "今天天气很好", "他们去学校"]
    for i in range(600):
        w = [*r.choice(words_, 60), *r.choice(other, 3)]
        r.shuffle(w)
        if i % 4 == 0:
            for _ in range(2):
                w[int(r.integers(len(w)))] = insults[int(r.integers(len(insults)))]
        rows.append((int(i % 4 == 0), " ".join(w)))
    machine = toxicity.fit([(y, [tuple(sorted(x)) for x in toxicity.sentences(t)]) for y, t in rows[:400]])
    found = machine.scores(toxicity.Scorer(machine).summaries([t for _, t in rows[400:]])[0]) >= 0.5
    assert np.mean(found == np.array([y for y, _ in rows[400:]], bool)) > 0.95


def test_scores_of_texts_are_those_of_their_sentences(spark, corpus):
    """The scorer's arrays against terms, sentences and values one by one."""
    d, labels, *_ = labelled(spark)
    machine = toxicity.train(d, labels)
    texts = [t[1] if isinstance(t, tuple) else t for t in corpus if t is None or not isinstance(t, str) or len(t) < 5000] + ["What an idiot! You mo-ron.\nFine.", "i d i o t"]
    got, best = toxicity.Scorer(machine).summaries(texts)
    for t, row, term in zip(texts, got, best, strict=True):
        values = [max(machine.margins(sorted(x))) for x in toxicity.sentences(t)]
        assert np.allclose(row, toxicity.summary(np.array(values)))
        assert (term is None) == (not values)


def test_folded_table_equals_kernel():
    a, b = "idiot", "ixdiot"
    assert math.isclose(toxicity.against([b], toxicity.vector(a))[0], float(toxicity.vector(a) @ toxicity.vector(b)))
    assert toxicity.against(["idiot"], toxicity.vector("idiot"))[0] > toxicity.against(["ixdiot"], toxicity.vector("idiot"))[0] > toxicity.against(["thation"], toxicity.vector("idiot"))[0]


def test_digests_are_those_of_the_contract(spark):
    from quarry.llm.queries import _sha

    assert spark.range(1).select(_sha(F.lit("é,b"))).first()[0] == hashlib.sha256("é,b".encode()).hexdigest()


@pytest.mark.parametrize(("size", "most"), [(0.5e9, 10.0), (30e9, 10.5), (1e12, 11.0)])
def test_messages_stay_full(size, most):
    """Bytes a window that blocks send to shards, with 24 bytes for each row, on random hashes and owners."""
    shards, blocks = repeats.dealing(int(size), 0.4, 4.0)
    windows, documents = int(size / 0.51e9 * 140e6 / blocks), int(size / 0.51e9 * 256_410 / blocks)
    r, width, n, sent = np.random.default_rng(1), (1 << 64) // shards, 0, 0
    for k in range(200):
        m = r.poisson(windows / shards)
        hashes = np.sort(r.integers(0, width, m, dtype=np.uint64)) + np.uint64(k * width % (1 << 63))
        owners = r.integers(0, documents, m) * blocks + 7
        sent += len(pack_sorted(hashes)) + len(pack(owners.astype(np.int64))) + 24
        n += m
    assert sent / n <= most and size / shards < 60e6
