"""Language-model scoring with a hierarchical Pitman-Yor model.

Every previous word has a context restaurant whose dishes are next words; all context restaurants share one parent, whose own
parent is uniform over the known words and one unknown word. Text is lower-cased (A-Z), split at ASCII white space and closed by an
end token; the first word's context is a start token.

The model is spread over shards by context, so a restaurant's customers, tables and dishes lie together. Contexts that hold
more than a quarter of a shard's share of all words (judged on a sample, for placement only) are spread over all shards by dish instead.

1. Documents become packed occurrences (context, word, document, count), dealt to the shards once: word numbers of a block, sorted and
   compressed, some 6 bytes an occurrence. This one exchange serves counting, seating and scoring.
2. Each shard tells how many contexts serve each of its words. The parent, spread over buckets of words, adds these up and answers every shard for
   just the words that the shard asked for: the parent's seating with one table a context, the same whatever the number of shards.
3. Each shard seats the training customers by Gibbs sampling: given the number of tables elsewhere in the restaurant and the parent's probability,
   the tables of a dish are drawn from their exact conditional, with generalised Stirling numbers (dishes of over EXACT
   customers extend a seating of EXACT customers in growing blocks). Tables are the parent's customers.
4. The parent gathers counts and customers of each word from all shards, is seated the same way, and answers again.
5. Each shard repeats its (seeded, order-free) seating and computes averaged predictive probabilities of all pairs it holds, and sums them by row.

Messages between shards and parent hold each word of a shard once; there are buckets for one in 32 shards (8 at least), and no empty messages.
What all shards need (numbers of words, dishes, tables) is added up beside them.

P(w | v) = (c - d t) / (theta + C) + (theta + d T) / (theta + C) * P0(w), with t and T averaged over the kept samples, so every
distribution sums to one. Discounts follow from the numbers of dishes served once and twice (the parent's: of
words that one and two contexts serve). A text's perplexity is 10 to the power of minus
its score for each of its tokens.

Null and empty texts have only the end token. Every row is scored, also rows of one id (training or held out alike); null ids count
as held out. An empty table gives no rows; without training documents every probability is 1. Very long texts are cut into no parts and bound a task's
memory from below. Extra columns are ignored. Rows are told apart by their place in the input, which has to be read alike if a task is repeated (as
files are).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, held_out, lower_words, mix64, pack, pack_sorted, parts_of, prepare, unpack, unpack_sorted

START, END = b"\n<start>", b"\n<end>"
FOLDS, THETA = 10, 1.0
SWEEPS, KEPT = 4, 3
#: Customers of a dish up to which its tables are drawn from the exact conditional.
EXACT = 200
#: Occurrences in a block before it is sent.
BLOCK_TOKENS = 1_500_000
NO_ID = -(2**63)
OCCURRENCES = "shard int, words binary, v binary, w binary, doc binary, n binary, ids binary, rows binary, train binary"
#: Shards for each bucket of the parent's words, and buckets at least.
SHARDS_A_BUCKET, LEAST_BUCKETS = 32, 8


def stirling(d: float, n: int) -> np.ndarray:
    """Logs of generalised Stirling numbers S(c, t), c and t from 0 to n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, n):
        t = np.arange(1, c + 1)
        grown = out[c, 1 : c + 1] + np.log(c - d * t)
        out[c + 1, 1 : c + 2] = np.logaddexp(np.append(grown, -np.inf), out[c, 0 : c + 1])
    return out


def seat(count: np.ndarray, tables: np.ndarray, elsewhere: np.ndarray, parent: np.ndarray, d: float, theta: float, numbers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One Gibbs draw of the tables of each dish (count > 0), given the tables elsewhere in its restaurant."""
    out = tables.copy()
    small = np.flatnonzero((count > 1) & (count <= EXACT))
    order = small[np.argsort(count[small], kind="stable")]
    bounds = np.searchsorted(count[order], np.arange(2, EXACT + 2))
    big = np.flatnonzero(count > EXACT)
    for c, part in [*((c, order[bounds[c - 2] : bounds[c - 1]]) for c in range(2, EXACT + 1)), (EXACT, big)]:
        for at in np.array_split(part, len(part) * c // 500_000 + 1):
            if len(at):
                k = np.arange(c)
                weight = np.log(theta + d * (elsewhere[at][:, None] + k[None, :])).cumsum(axis=1) + (k + 1) * np.log(parent[at])[:, None] + numbers[c, 1 : c + 1]
                out[at] = 1 + (weight - np.log(rng.exponential(size=weight.shape))).argmax(axis=1)
    if len(big):
        t, seated, goal = out[big].astype(float), np.full(len(big), float(EXACT)), count[big].astype(float)
        while (go := seated < goal).any():
            some = np.minimum(np.maximum(1, seated[go] // 8), goal[go] - seated[go])
            new = (theta + d * (elsewhere[big][go] + t[go])) * parent[big][go]
            t[go] += rng.binomial(some.astype(np.int64), new / (new + np.maximum(seated[go] - d * t[go], 1e-9)))
            seated[go] += some
        out[big] = t.astype(out.dtype)
    return out


def discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5


def predictive(count, tables, customers, laid, parent, d: float, theta: float = THETA):
    """Probability of dishes with so many customers at so many tables, in restaurants with `customers` at `laid` tables; the parent's in an empty one."""
    return (count - d * tables + (theta + d * laid) * parent) / (theta + customers)


def pack_block(docs: list[tuple[int, int, bool, list[bytes]]], n_shards: int, hot: np.ndarray, hasher: WordHasher):
    """Rows of OCCURRENCES for some documents (id, row number, whether to learn from it, words)."""
    end, start = hasher([END])[0], hasher([START])[0]
    hashes = [hasher(w) for *_, w in docs]
    w_all = np.concatenate([x for h in hashes for x in (h, [end])]).astype(np.uint64)
    v_all = np.concatenate([x for h in hashes for x in ([start], h)]).astype(np.uint64)
    doc = np.repeat(np.arange(len(docs)), [len(h) + 1 for h in hashes])
    words, number = np.unique(np.concatenate([w_all, v_all]), return_inverse=True)
    w, v = number[: len(w_all)].astype(np.int64), number[len(w_all) :].astype(np.int64)
    spread = np.isin(words, hot)
    shard_of = (mix64(words) % np.uint64(n_shards)).astype(np.int64)
    shard = shard_of[v]
    some = spread[v]
    shard[some] = (mix64(w_all[some] + mix64(v_all[some])) % np.uint64(n_shards)).astype(np.int64)
    key = (shard * len(words) + v) * len(words) + w if n_shards * len(words) ** 2 < 2**62 else None
    order = np.lexsort((w, v, shard)) if key is None else np.argsort(key, kind="stable")  # documents stay in order within a pair
    shard, v, w, doc = shard[order], v[order], w[order], doc[order]
    new = np.concatenate(([True], (np.diff(shard) != 0) | (np.diff(v) != 0) | (np.diff(w) != 0) | (np.diff(doc) != 0)))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(new)))
    shard, v, w, doc = shard[first], v[first], w[first], doc[first]
    ids, rows, train = (np.array(x, kind) for x, kind in zip(list(zip(*docs, strict=True))[:3], (np.int64, np.int64, np.uint8), strict=True))
    cuts = np.searchsorted(shard, np.arange(n_shards + 1))
    for s in range(n_shards):
        a, z = cuts[s], cuts[s + 1]
        if z > a:
            used, local = np.unique(np.concatenate([v[a:z], w[a:z]]), return_inverse=True)
            here, where = np.unique(doc[a:z], return_inverse=True)
            small = np.uint16 if len(used) < 65536 and len(here) < 65536 else np.uint32
            yield (
                s, pack_sorted(words[used]), pack(np.diff(local[: z - a], prepend=0).astype(np.uint32)), pack(local[z - a :].astype(np.uint32)),
                pack(where.astype(np.uint32)), pack(n[a:z].astype(np.uint32)), pack(ids[here]), pack(rows[here]), pack(train[here]),
            )


class Shard:
    """The occurrences of a shard: its words, distinct pairs (v, w), and for each occurrence its pair, document and count."""

    def __init__(self, pdf: pd.DataFrame):
        dictionaries = [unpack_sorted(x) for x in pdf["words"]]
        self.words = np.unique(np.concatenate(dictionaries))
        keys, doc, n, ids, rows, train, base = [], [], [], [], [], [], 0
        size = len(self.words)
        for i, d in enumerate(dictionaries):
            r = pdf.iloc[i]
            to = np.searchsorted(self.words, d)
            v = np.cumsum(unpack(r["v"], np.uint32), dtype=np.int64)
            keys.append(to[v] * size + to[unpack(r["w"], np.uint32).astype(np.int64)])
            doc.append(unpack(r["doc"], np.uint32).astype(np.int32) + base)
            n.append(unpack(r["n"], np.uint32))
            ids.append(unpack(r["ids"], np.int64))
            rows.append(unpack(r["rows"], np.int64))
            train.append(unpack(r["train"], np.uint8))
            base += len(ids[-1])
        self.doc, self.n = np.concatenate(doc), np.concatenate(n)
        self.ids, self.rows, self.train = np.concatenate(ids), np.concatenate(rows), np.concatenate(train).astype(bool)
        pairs, self.pair = np.unique(np.concatenate(keys), return_inverse=True)
        self.v, self.w = pairs // size, pairs % size
        learned = self.train[self.doc]
        self.count = np.bincount(self.pair[learned], self.n[learned], len(pairs)).astype(np.int64)

    def sizes(self) -> np.ndarray:
        """For the restaurant of each word what its tables here are about in proportion to: the sum of its dishes' customers to the power of the discount."""
        on = np.flatnonzero(self.count)
        d = discount(int((self.count == 1).sum()), int((self.count == 2).sum()))
        return np.bincount(self.v[on], self.count[on] ** d, len(self.words))

    def seated(self, parent: np.ndarray, sizes: np.ndarray, d: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(tables of each pair in the last sample, their mean over the kept samples), given the parent's probability of each word.

        sizes: the sums of `sizes` over all shards, which tell how many tables stand in other shards.
        """
        rng = np.random.default_rng(seed)
        on = np.flatnonzero(self.count)
        c, v, size = self.count[on], self.v[on], len(self.words)
        numbers, p = stirling(d, EXACT), np.minimum(parent[self.w[on]], 1.0)
        t, total = np.ones(len(on), np.int64), np.zeros(len(on))
        here = self.sizes()
        factor = np.maximum(sizes, here) / np.maximum(here, 1e-9)
        for sweep in range(SWEEPS):
            elsewhere = (np.bincount(v, t, size) * factor)[v] - t
            t = seat(c, t, elsewhere, p, d, THETA, numbers, rng)
            if sweep >= SWEEPS - KEPT:
                total += t
        last, mean = np.zeros(len(self.count), np.int64), np.zeros(len(self.count))
        last[on], mean[on] = t, total / KEPT
        return last, mean


def by_range(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the parts of the hash range in sorted hashes."""
    return np.concatenate(([0], np.searchsorted(hashes, np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)), [len(hashes)]))


def hot_contexts(docs: DataFrame, n_shards: int) -> np.ndarray:
    """Hashes of the words so frequent that one shard should not hold their restaurant; from a sample, as it only decides placement."""
    one_in = parts_of(docs, 4.0, 1)

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            h, n = np.unique(np.concatenate([hasher([START, *lower_words(t)]) for t in b.column(0).to_pylist()] or [np.empty(0, np.uint64)]), return_counts=True)
            at = np.argsort(-n, kind="stable")[: 64 * n_shards]  # far more than can be hot
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(n[at].astype(np.int64)), pa.array(np.full(len(at), n.sum(), np.int64))], ["h", "n", "total"])

    counted = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text").mapInArrow(run, "h long, n long, total long")
    sums = counted.groupBy("h").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = sums.filter(F.col("n") > total / (4 * n_shards)).limit(4 * n_shards).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def messages(s: Shard, key: int, buckets: int, spread: np.ndarray, numbers: dict[str, np.ndarray], of_contexts: dict[str, np.ndarray], once: dict[str, int], always: dict[str, int]) -> pd.DataFrame:
    """What a shard tells each bucket that has any of its words: numbers by word, and by spread context what this shard holds of it; some facts go with the first alone."""
    asked = np.unique(s.w)
    hot = np.flatnonzero(spread & (np.bincount(s.v, s.count, len(s.words)) > 0))
    a, h, rows = by_range(s.words[asked], buckets), by_range(s.words[hot], buckets), []
    for b in range(buckets):
        x, y = asked[a[b] : a[b + 1]], hot[h[b] : h[b + 1]]
        if len(x) or len(y):
            told = always | (once if not rows else dict.fromkeys(once, 0))
            rows.append({"bucket": b, "sender": key, "hashes": pack_sorted(s.words[x]), **{k: pack(n[x].astype(np.int64)) for k, n in numbers.items()}, "hv": s.words[y].tobytes(), **{k: n[y].astype(float).tobytes() for k, n in of_contexts.items()}, **told})
    return pd.DataFrame(rows)


class Gathered:
    """What the shards told one bucket: words, sums of their numbers, and spread contexts with theirs."""

    def __init__(self, pdf: pd.DataFrame, numbers: list[str], of_contexts: list[str]):
        self.sender, self.lists = pdf["sender"].tolist(), [unpack_sorted(x) for x in pdf["hashes"]]
        self.words, self.back = np.unique(np.concatenate(self.lists), return_inverse=True)
        self.sums = {k: np.bincount(self.back, np.concatenate([unpack(x, np.int64) for x in pdf[k]]), len(self.words)).astype(np.int64) for k in numbers}
        self.hot, back = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hv"]]), return_inverse=True)
        self.of_hot = {k: np.bincount(back, np.concatenate([np.frombuffer(x) for x in pdf[k]]), len(self.hot)) for k in of_contexts}

    def answers(self, bucket: int, numbers: dict[str, np.ndarray], facts: dict[str, int]) -> pd.DataFrame:
        """A row for each shard that asked, with the numbers of its words, and one with the bucket's facts (to = -1)."""
        rows, at, hot = [], 0, {"hv": self.hot.tobytes(), **{k: x.tobytes() for k, x in self.of_hot.items()}}
        for to, words in zip(self.sender, self.lists, strict=True):
            x = self.back[at : at + len(words)]
            at += len(words)
            rows.append({"to": to, "bucket": bucket, **{k: pack(n[x]) for k, n in numbers.items()}, **hot})
        return pd.DataFrame([*rows, {"to": -1, "bucket": bucket, **facts}]).astype(dict.fromkeys(facts, "Int64"))


class Told:
    """The answers to a shard: numbers of its words, of its spread contexts, and facts about all shards."""

    def __init__(self, s: Shard, pdf: pd.DataFrame, numbers: list[str], of_contexts: list[str], facts: list[str]):
        whole, pdf = pdf[pdf["bucket"] < 0].iloc[0], pdf[pdf["bucket"] >= 0].sort_values("bucket")
        self.facts = {k: int(whole[k]) for k in facts}
        size, asked = len(s.words), np.unique(s.w)
        self.of = {k: np.zeros(size) for k in numbers}
        for k in numbers:
            self.of[k][asked] = np.concatenate([unpack(x, np.int64) for x in pdf[k]])
        hot = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hv"]])
        at = np.searchsorted(s.words, hot)
        self.mine = (at < size) & (s.words[np.minimum(at, size - 1)] == hot)
        self.at = at[self.mine]
        self.of_hot = {k: np.concatenate([np.frombuffer(x) for x in pdf[k]])[self.mine] for k in of_contexts}


def with_facts(answers: DataFrame, facts: list[str], shards: int) -> DataFrame:
    """The answers, and the sums of all buckets' facts for every shard (bucket = -1)."""
    whole = answers.filter("to < 0").agg(*[F.sum(k).alias(k) for k in facts]).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("bucket", F.lit(-1))
    return answers.filter("to >= 0").drop(*facts).unionByName(whole, allowMissingColumns=True)


def score(docs: DataFrame, folds: int = FOLDS, shard_mb: float = 3.5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s_all = parts_of(docs, shard_mb, 32)
    buckets = max(LEAST_BUCKETS, s_all // SHARDS_A_BUCKET)
    hot_shared = spark.sparkContext.broadcast(hot_contexts(docs, s_all))

    def occurrences(batches):
        from pyspark import TaskContext

        hasher, hot, held, size = WordHasher(), hot_shared.value, [], 0
        names = [x.split()[0] for x in OCCURRENCES.split(", ")]
        row = TaskContext.get().partitionId() << 40

        def send():
            columns = list(zip(*pack_block(held, s_all, hot, hasher), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)

        for b in batches:
            for i, t, out in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held.append((NO_ID if i is None else i, row, not out, lower_words(t)))
                row += 1
                size += len(held[-1][3]) + 1
                if size >= BLOCK_TOKENS:
                    yield send()
                    held.clear()
                    size = 0
        if held:
            yield send()

    def count(key, pdf: pd.DataFrame) -> pd.DataFrame:
        s = Shard(pdf)
        on, size = s.count > 0, len(s.words)
        facts = {"ones": int((s.count == 1).sum()), "twos": int((s.count == 2).sum())}
        return messages(s, int(key[0]), buckets, np.isin(s.words, hot_shared.value), {"m": np.bincount(s.w[on], minlength=size)}, {"hd": s.sizes()}, facts, {})

    def add_up(key, pdf: pd.DataFrame) -> pd.DataFrame:
        g = Gathered(pdf, ["m"], ["hd"])
        m = g.sums["m"]
        return g.answers(int(key[0]), {"m": m}, {"kinds": int((m > 0).sum()), "m_all": int(m.sum()), "k1": int((m == 1).sum()), "k2": int((m == 2).sum()), "ones": int(pdf["ones"].sum()), "twos": int(pdf["twos"].sum())})

    first_facts, last_facts = ["kinds", "m_all", "k1", "k2", "ones", "twos"], ["n_all", "v_all", "m_all", "s_all"]

    def seating(key: int, pdf: pd.DataFrame, told: pd.DataFrame):
        s = Shard(pdf)
        t = Told(s, told, ["m"], ["hd"], first_facts)
        sizes = s.sizes()
        sizes[t.at] = t.of_hot["hd"]
        d = discount(t.facts["ones"], t.facts["twos"])
        return s, t, d, *s.seated(t.of["m"] / max(1, t.facts["m_all"]), sizes, d, key)

    def learn(key, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame()
        s, t, _, last, mean = seating(int(key[0]), pdf, told)
        size = len(s.words)
        return messages(
            s, int(key[0]), buckets, np.isin(s.words, hot_shared.value), {"c": np.bincount(s.w, s.count, size), "m": np.bincount(s.w, last, size)},
            {"hc": np.bincount(s.v, s.count, size), "ht": np.bincount(s.v, mean, size)}, {}, {k: t.facts[k] for k in ("kinds", "k1", "k2")},
        )

    def parent(key, pdf: pd.DataFrame) -> pd.DataFrame:
        g, every = Gathered(pdf, ["c", "m"], ["hc", "ht"]), max(1, int(pdf["kinds"].max()))
        c, m = g.sums["c"], g.sums["m"]
        on = np.flatnonzero(m)
        d = discount(int(pdf["k1"].max()), int(pdf["k2"].max()))
        numbers, rng = stirling(d, EXACT), np.random.default_rng(10**6 + int(key[0]))
        t, total, factor = np.ones(len(on), np.int64), np.zeros(len(m), np.int64), every / max(1, len(on))
        for sweep in range(SWEEPS):
            t = seat(m[on], t, t.sum() * factor - t, np.full(len(on), 1.0 / (every + 1)), d, THETA, numbers, rng)
            if sweep >= SWEEPS - KEPT:
                total[on] += t
        facts = (int(c.sum()), int((c > 0).sum()), int(m.sum()), int(total.sum()))
        return g.answers(int(key[0]), {"c": c, "m": m, "s": total}, dict(zip(last_facts, facts, strict=True)))

    def tell(key, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame()
        again = told["of_counts"].astype(bool)
        s, before, d1, _, mean = seating(int(key[0]), pdf, told[again])
        t, size = Told(s, told[~again], ["c", "m", "s"], ["hc", "ht"], last_facts), len(s.words)
        c, f = t.of["c"], t.facts
        root = predictive(t.of["m"], t.of["s"] / KEPT, f["m_all"], f["s_all"] / KEPT, 1 / (f["v_all"] + 1), discount(before.facts["k1"], before.facts["k2"]))
        customers, laid = np.bincount(s.v, s.count, size).astype(float), np.bincount(s.v, mean, size)
        customers[t.at], laid[t.at] = t.of_hot["hc"], t.of_hot["ht"]
        log_p = np.log10(predictive(s.count, mean, customers[s.v], laid[s.v], root[s.w], d1))
        log_base = np.log10((c + 0.1) / (f["n_all"] + 0.1 * (f["v_all"] + 1)))
        rows, first, number = np.unique(s.rows, return_index=True, return_inverse=True)
        of, w = number[s.doc], s.w[s.pair]
        sums = [np.bincount(of, s.n * x, len(rows)) for x in (log_p[s.pair], log_base[w], (c > 0)[w].astype(float), np.ones(len(w)))]
        bucket = (mix64(rows.view(np.uint64)) % np.uint64(s_all)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(s_all + 1))
        out = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            x = order[cuts[b] : cuts[b + 1]]
            out.append((b, f["n_all"], pack(s.ids[first[x]]), pack(rows[x]), pack(sums[0][x]), pack(sums[1][x]), pack(sums[2][x].astype(np.uint32)), pack(sums[3][x].astype(np.uint32))))
        return pd.DataFrame(out, columns=["bucket", "n_all", "ids", "rows", "score", "base", "known", "tokens"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, first, back = np.unique(np.concatenate([unpack(x, np.int64) for x in pdf["rows"]]), return_index=True, return_inverse=True)
        ids = np.concatenate([unpack(x, np.int64) for x in pdf["ids"]])[first]
        add = lambda name, kind: np.bincount(back, np.concatenate([unpack(x, kind) for x in pdf[name]]), len(rows))
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64") if not (ids == NO_ID).any() else pd.array([None if i == NO_ID else int(i) for i in ids], "Int64"),
            "n_tokens": add("tokens", np.uint32).astype(np.int64), "n_known": add("known", np.uint32).astype(np.int64), "train_tokens": np.full(len(ids), int(pdf["n_all"].iloc[0])),
            "base_score": add("base", np.float64), "score": add("score", np.float64),
        })

    longs = lambda names: "".join(f", {k} long" for k in names)
    blobs = lambda names: "".join(f", {k} binary" for k in names)
    dealt = docs.withColumn("held_out", held_out(folds)).mapInArrow(occurrences, OCCURRENCES)
    asked = dealt.groupBy("shard").applyInPandas(count, "bucket int, sender int" + blobs(["hashes", "m", "hv", "hd"]) + longs(["ones", "twos"]))
    counted = with_facts(asked.groupBy("bucket").applyInPandas(add_up, "to int, bucket int" + blobs(["m", "hv", "hd"]) + longs(first_facts)), first_facts, s_all)
    seated = dealt.groupBy("shard").cogroup(counted.groupBy("to")).applyInPandas(learn, "bucket int, sender int" + blobs(["hashes", "c", "m", "hv", "hc", "ht"]) + longs(["kinds", "k1", "k2"]))
    answers = with_facts(seated.groupBy("bucket").applyInPandas(parent, "to int, bucket int" + blobs(["c", "m", "s", "hv", "hc", "ht"]) + longs(last_facts)), last_facts, s_all)
    both = counted.withColumn("of_counts", F.lit(True)).unionByName(answers.withColumn("of_counts", F.lit(False)), allowMissingColumns=True)
    sums = dealt.groupBy("shard").cogroup(both.groupBy("to")).applyInPandas(tell, "bucket int, n_all long" + blobs(["ids", "rows", "score", "base", "known", "tokens"]))
    out = sums.groupBy("bucket").applyInPandas(total, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return out.withColumn("held_out", held_out(folds)).select(*names, F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, documents, n_tokens and the perplexity of all their tokens together."""
    sums = scored.groupBy("held_out").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("s"))
    return sums.select("held_out", "documents", "n_tokens", F.pow(F.lit(10.0), -F.col("s") / F.col("n_tokens")).alias("perplexity"))
