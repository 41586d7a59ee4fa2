"""MinHash near-duplicate detection.

Every document's set of distinct word shingles gets `BANDS * ROWS` minima under multiply-shift universal hash functions.
Documents with the same set are one node from the start, so a group of exact copies costs one row. Nodes that agree in a
band share a bucket; in each bucket all nodes are compared with the smallest one (a star, not all pairs) and links are
confirmed on full shingle sets. What these links connect needs no further comparison. Only in buckets that still hold several
components, nodes outside the bucket's main component are compared with nodes of other components: estimated from the
signatures inside the join's condition (which drops pairs over five standard deviations below the threshold) and again
confirmed on full sets; large buckets block by block, most likely pairs first, skipping what is connected by then. Components come from large-star/small-star.

With 36 bands of 5 rows a pair at similarity 0.8 shares no bucket with probability under 1e-6.

A text that is null or has no words has no shingles, is linked with nothing and is kept. Repeated rows (same id and text) fall in
one group and carry the same component id; ids may repeat with different texts. Null ids take part but never name a group
unless nothing else does. Extra columns are ignored by `components`, kept by `one_of_each`,
which decides row by row: one row of each group stays, whether its ids are null, repeated or neither.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, lower_words, prepare, rolling, sheltered, stored
from .components import connected_components

BANDS, ROWS = 36, 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Signature agreement below which a pair is not confirmed: five standard deviations under the threshold.
LEAST_AGREEING = 0.65
#: Buckets up to this size are compared by an SQL join, larger ones in blocks of this many nodes.
BLOCK = 64


def functions(k: int = BANDS * ROWS, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, k, dtype=np.uint64)


def shingle_set(text: str | None, width: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; one for the whole sequence if it is shorter than a shingle."""
    h = hasher(lower_words(text))
    return np.unique(rolling(h, min(width, len(h)))) if len(h) else np.empty(0, np.uint64)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(s), 2048):
        out = np.minimum(out, (a[:, None] * s[None, i : i + 2048] + b[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def node_of(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (hash of the whole set, null without one) and signature (its minima)."""

    def run(batches):
        hasher, (a, b) = WordHasher(), functions()
        for batch in batches:
            n, node, sig = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, width, hasher)
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                sig.append(minima(s, a, b).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "node", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, node long, sig array<int>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node and its whole shingle set, for the documents given."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            sets = [s for t in batch.column(0).to_pylist() if len(s := shingle_set(t, width, hasher))]
            for i in range(0, len(sets), 64):
                part = sets[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in part], pa.int64()), pa.array([s.view(np.int64) for s in part], pa.list_(pa.int64()))], ["node", "set"])

    return docs.select("text").mapInArrow(run, "node long, set array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) linked by their full sets."""
    a, b = sets.select(F.col("node").alias("u"), F.col("set").alias("su")), sets.select(F.col("node").alias("v"), F.col("set").alias("sv"))
    both = F.size(F.array_intersect("su", "sv")).cast("long")
    short, long = F.least(F.size("su"), F.size("sv")), F.greatest(F.size("su"), F.size("sv"))
    return (
        pairs.join(a, "u").join(b, "v").filter(100 * short >= percent * long)
        .withColumn("both", both).filter(100 * F.col("both") >= percent * (F.size("su") + F.size("sv") - F.col("both"))).select("u", "v")
    )


def agreeing(x, y):
    """Share of equal minima of two signatures, in SQL."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda same: same)) / F.lit(float(BANDS * ROWS))


def in_blocks(rest: DataFrame, least: float, percent: int) -> DataFrame:
    """Confirmed links of large buckets: blocks of stray nodes against the blocks of their bucket, each pair in its first common band.

    The likeliest pairs come first, and what a block's links connect already is not compared again, so a block gives
    fewer links than it has nodes.
    """
    import pandas as pd

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    def run(key, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        x = np.stack(left["sig"])
        y = np.stack(right["sig2"])
        band, other, comp = int(left["band"].iloc[0]), right["other"].to_numpy(), right["comp2"].to_numpy()
        sx, sy, nodes, comps = left["set"].tolist(), right["set2"].tolist(), left["node"].tolist(), left["comp"].tolist()
        rows, cols, like = [], [], []
        for i, c in enumerate(comps):
            at = np.flatnonzero(comp != c)
            share = (y[at] == x[i]).mean(axis=1)
            at, share = at[share >= least], share[share >= least]
            first = (y[at] == x[i]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            rows.append(np.full(int(first.sum()), i))
            cols.append(at[first])
            like.append(share[first])
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        root: dict[int, int] = {}

        def find(c):
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for k in np.argsort(-np.concatenate(like), kind="stable").tolist():
            i, j = int(rows[k]), int(cols[k])
            a, b = find(comps[i]), find(int(comp[j]))
            if a != b and linked(sx[i], sy[j]):
                root[a] = b
                out.append((min(nodes[i], int(other[j])), max(nodes[i], int(other[j]))))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    n_blocks = F.ceil(F.col("m") / (BLOCK * 16))
    block = F.pmod(F.xxhash64("node"), n_blocks)
    every = F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1))
    left = rest.filter("stray").select("bucket", block.alias("i"), every.alias("j"), "node", "sig", "set", "comp", "band")
    right = rest.select(F.col("bucket").alias("bucket2"), every.alias("i2"), block.alias("j2"), F.col("node").alias("other"), F.col("sig").alias("sig2"), F.col("set").alias("set2"), F.col("comp").alias("comp2"))
    return left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket2", "i2", "j2")).applyInPandas(run, "u long, v long")


def labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node, component (a node, null without one), component_id, kept for every document."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(docs, width), "signatures")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.min("sig").alias("sig"))
    bands = [F.xxhash64(F.lit(i), F.slice("sig", ROWS * i + 1, ROWS)) for i in range(BANDS)]
    keys = nodes.select("node", F.posexplode(F.array(*bands)).alias("band", "bucket"))
    groups = keys.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("m")).filter("m > 1")
    shared = stored(keys.join(groups, "bucket"), "buckets")  # only nodes that share a bucket
    stars = shared.filter("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
    wanted = signed.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = full_sets(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), width)
    nameless = full_sets(docs.filter("doc_id is null"), width).join(wanted.filter("doc_id is null").select("node"), "node", "left_semi")  # no id leads to them
    sets = stored(named.union(nameless).dropDuplicates(["node"]), "sets")
    links = stored(confirmed(stars, sets, percent), "stars")

    # What the stars connect is settled; other components of a bucket are compared with each other.
    settled = stored(connected_components(links), "settled")
    told = shared.join(settled, "node", "left").select("bucket", "band", "node", "centre", "m", F.coalesce("component", "node").alias("comp"))
    sizes = told.groupBy("bucket", "comp").count()
    mixed = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("n")).filter("n > 1")
    signs = signed.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("sig").alias("sig"))
    rest = told.filter("node <> centre and m > 2").join(mixed, "bucket").join(signs, "node").select("bucket", "band", "node", "m", "comp", "sig", (F.col("comp") != F.col("main")).alias("stray"))
    small = rest.filter(F.col("m") <= BLOCK)
    x, y = small.filter("stray").alias("x"), small.alias("y")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.stray") | (F.col("x.node") < F.col("y.node")))
    near = x.join(y, apart & (agreeing(F.col("x.sig"), F.col("y.sig")) >= LEAST_AGREEING)).select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"))
    large = in_blocks(rest.filter(F.col("m") > BLOCK).join(sets, "node"), LEAST_AGREEING, percent)
    more = stored(confirmed(near.distinct(), sets, percent).union(large).distinct(), "more")

    labels = connected_components(settled.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    named = nodes.select("node", "first_doc").join(labels, "node", "left").select("node", "first_doc", F.coalesce("component", "node").alias("component"))
    first = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    ids = named.join(first, "component").select("node", "component", "component_id")
    return signed.select("doc_id", "n_shingles", "node").join(ids, "node", "left").select(
        "doc_id", "n_shingles", "node", "component", F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def components(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return labelled(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def with_nodes(docs: DataFrame, width: int) -> DataFrame:
    """docs with the column _node."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            sets = [shingle_set(t, width, hasher) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.append_column("_node", pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())]))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each near-duplicate group, with all its columns, and all rows without shingles.

    The row with the smallest id stays; null ids come last, and of several texts with that id the smallest node stays. Ids that stand
    in one row are decided by the id; rows with a null or repeated id each by id and node.
    """
    return sheltered(docs, lambda inner: _one_of_each(inner, width, percent))


def _one_of_each(docs: DataFrame, width: int, percent: int) -> DataFrame:
    rows = stored(labelled(docs, width, percent), "labelled")
    alone = F.col("doc_id").isNotNull() & (F.count("*") == 1)
    marks = rows.groupBy("doc_id").agg(alone.alias("_alone"), F.bool_and("kept").alias("_stays")).filter("not (_alone and _stays)").select(F.col("doc_id").alias("_id"), "_alone")
    marks, own = stored(marks, "marks"), docs["doc_id"].cast("long")
    plain = docs.filter(own.isNotNull()).join(marks, own == marks["_id"], "left_anti")
    if marks.filter("not _alone").isEmpty():
        return plain
    unclear = docs.filter(own.isNull()).union(docs.join(marks.filter("not _alone"), own == marks["_id"], "left_semi"))
    unclear = stored(with_nodes(unclear, width), "unclear")
    best = rows.filter("node is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("_id"), F.col("best.node").alias("_best"))
    order = ["text", *(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind)]
    equal = Window.partitionBy("_node", F.col("doc_id").cast("long")).orderBy(*order)
    first = unclear.filter("_node is not null").withColumn("_nth", F.row_number().over(equal)).filter("_nth = 1").drop("_nth")
    first = first.join(best, (F.col("_node") == F.col("_best")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    return plain.union(unclear.filter("_node is null").drop("_node")).union(first.drop("_node"))
