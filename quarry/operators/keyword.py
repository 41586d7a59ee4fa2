"""A keyword index that is kept up by segments and searched without reading all postings of a question's words.

Every change of the corpus writes one segment: the postings of the chunks added, in blocks of a word and a group of GROUP neighbouring chunks, in runs of some hundred thousand
blocks sorted by word and group; the change of each word's document frequency and of the totals; and the keys of the chunks that are no longer there, whose postings in older segments are dead from then on. Statistics
are sums over segments, so scores are those of an index built afresh. Segments of like size are merged, TIER at a time, without their dead postings.

A block's head holds, for each term frequency in it, the shortest chunk that has it, so that the best score of any of its chunks is known exactly for any mean length. The heads of
a question's words give an upper bound for each group of chunks. The groups with the highest bounds are scored first; their k-th best score rules out all
groups below it, whose postings are never read.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import stored, unstored
from ..sources.ledger import Change, Ledger, Snapshot
from .retrieval import FLOOR, K1, B, counted, postings, ranked

#: Chunks of a group, segments of like size that are merged, groups whose numbers are pushed into the scan at most, what rounding may add to a bound.
GROUP, TIER, PUSHED, SLACK = 128, 4, 2_000, 1e-6
#: Postings of a run, at least, and blocks of one Arrow batch; groups and keys of chunks that went that a merge sends to every task at most.
RUN, SLICE, BROADCAST = 1 << 19, 4_096, 500_000
BLOCKS = "tok string, grp long, n int, impacts array<struct<tf:long,dl:long>>, entries array<struct<chunk_key:string,tf:long,dl:long>>, segment long"
TERMS, TOTALS, DEAD = "tok string, df long", "chunks long, tokens long", "chunk_key string, segment long"


def blocks(texts: DataFrame) -> DataFrame:
    """BLOCKS without segment of (chunk_key, text). Texts are dealt and sorted by key, GROUP keys are a group, and a group's blocks are made from its texts: postings are not exchanged."""
    return in_order(texts.select("chunk_key", "text")).mapInArrow(grouped(lambda batches: ((k, c, c.total()) for k, c in counted(batches))), unnumbered(texts))


def regrouped(postings: DataFrame) -> DataFrame:
    """BLOCKS without segment of (chunk_key, tok, tf, dl): postings are dealt and sorted by key once."""

    def keys(batches):
        last, counts, n = None, None, 0
        for b in batches:
            for k, t, tf, dl in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if counts is None or k != last:
                    if counts is not None:
                        yield last, counts, n
                    last, counts, n = k, {}, dl
                counts[t] = counts.get(t, 0) + tf
        if counts is not None:
            yield last, counts, n

    return in_order(postings.select("chunk_key", "tok", "tf", "dl")).mapInArrow(grouped(keys), unnumbered(postings))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_key").sortWithinPartitions("chunk_key")


def unnumbered(rows: DataFrame) -> str:
    return f"tok string, grp long, n int, impacts array<struct<tf:long,dl:long>>, entries array<struct<chunk_key:{rows.schema['chunk_key'].dataType.simpleString()},tf:long,dl:long>>"


def grouped(keys: Callable) -> Callable:
    """Makes blocks of what `keys` gives from Arrow batches: (key, counts of its tokens, number of them), sorted by key. They come in runs sorted by word and group; a task holds one run."""

    def run(batches):
        first, row, held = TaskContext.get().partitionId() << 33, 0, Run(GROUP)
        for kept in keys(batches):
            held.add(*kept)
            row += 1
            if row % GROUP == 0 and len(held.ids) >= RUN:
                yield from held.blocks(first // GROUP)
                first, row, held = first + row, 0, Run(GROUP)
        yield from held.blocks(first // GROUP)

    return run


class Run:
    """Postings of some groups, as numbers of words and of chunks."""

    def __init__(self, group: int):
        self.group, self.names, self.lengths, self.sizes, self.ids, self.tfs = group, [], [], [], array("q"), array("q")
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__

    def add(self, key, counts: dict[str, int], length: int) -> None:
        self.names.append(key)
        self.lengths.append(length)
        self.sizes.append(len(counts))
        self.ids.extend(map(self.words.__getitem__, counts))
        self.tfs.extend(counts.values())

    def blocks(self, first: int) -> Iterator[pa.RecordBatch]:
        """Arrow batches of BLOCKS without segment, sorted by word and group; groups are numbered from first on."""
        if not self.ids:
            return
        toks = list(self.words)
        self.words.default_factory = None  # it refers to the words, which would stay until a collection of cycles
        order = np.array(sorted(range(len(toks)), key=toks.__getitem__))
        rank, groups = np.argsort(order), len(self.sizes) // self.group + 1
        chunk = np.repeat(np.arange(len(self.sizes)), self.sizes)
        block = rank[np.frombuffer(self.ids, np.int64)] * groups + chunk // self.group
        by = np.argsort(block, kind="stable")
        block, chunk, tf = block[by], chunk[by], np.frombuffer(self.tfs, np.int64)[by]
        dl = np.array(self.lengths)[chunk]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        ends, which = np.append(starts, len(block)), np.repeat(np.arange(len(starts)), np.diff(starts, append=len(block)))
        by = np.lexsort((dl, tf, which))
        heads = by[(np.diff(which[by], prepend=-1) != 0) | (np.diff(tf[by], prepend=-1) != 0)]
        head_ends = np.searchsorted(which[heads], np.arange(len(starts) + 1))
        words, names = pa.array(toks, pa.string()), pa.array(self.names)
        listed = lambda ends, columns, of: pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.StructArray.from_arrays(columns, of))
        for a in range(0, len(starts), SLICE):
            numbers, at, top = block[starts[a : a + SLICE]], ends[a : a + SLICE + 1], head_ends[a : a + SLICE + 1]
            every, best = slice(at[0], at[-1]), heads[top[0] : top[-1]]
            impacts = listed(top, [pa.array(tf[best]), pa.array(dl[best])], ["tf", "dl"])
            entries = listed(at, [names.take(pa.array(chunk[every])), pa.array(tf[every]), pa.array(dl[every])], ["chunk_key", "tf", "dl"])
            columns = [words.take(pa.array(order[numbers // groups])), pa.array(first + numbers % groups), pa.array(np.diff(at), pa.int32()), impacts, entries]
            yield pa.RecordBatch.from_arrays(columns, ["tok", "grp", "n", "impacts", "entries"])


def impact(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


@dataclass
class KeywordIndex:
    """The index of a ledger's tables blocks, terms, totals and dead, each part a segment."""

    ledger: Ledger
    prefix: str = "keyword"
    known: dict[int, tuple[int, float, float]] = field(default_factory=dict)

    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    # --- keeping up ---

    def next_segment(self, base: Snapshot) -> int:
        return max((int(p) for t in ("blocks", "totals", "dead") for p in base.parts(self.name(t))), default=0) + 1

    def update(self, change: Change, added: DataFrame, removed: DataFrame) -> None:
        """One segment: chunks (chunk_key, text) that are new, and those (with the text they were indexed by) that go; a changed chunk is in both."""
        segment = self.next_segment(change.base)
        new = change.part(self.name("blocks"), str(segment), blocks(added).withColumn("segment", F.lit(segment).cast("long")), **PAGES)
        old = stored(postings(removed).select("tok", "tf"), "postings")
        signed = new.select("tok", F.col("n").cast("long").alias("s")).unionByName(old.select("tok", F.lit(-1).cast("long").alias("s")))
        change.part(self.name("terms"), str(segment), signed.groupBy("tok").agg(F.sum("s").alias("df")).filter("df <> 0").sort("tok"))
        count = lambda chunks, tfs, sign: chunks.agg(F.count("*").alias("chunks")).crossJoin(tfs.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))).select((sign * F.col("chunks")).alias("chunks"), (sign * F.col("tokens")).alias("tokens"))
        every = new.select(F.explode("entries.tf").alias("tf"))
        change.part(self.name("totals"), str(segment), count(added, every, 1).unionByName(count(removed, old, -1)))  # one row each
        change.part(self.name("dead"), str(segment), removed.select("chunk_key", F.lit(segment).cast("long").alias("segment")))
        unstored(old)

    def clear(self, change: Change) -> None:
        for t in ("blocks", "terms", "totals", "dead"):
            change.drop(self.name(t))

    def due(self, snapshot: Snapshot) -> list[str]:
        """The smallest segments of like size (none over TIER times another) of which there are TIER."""
        sizes = sorted((sum(e["rows"] for e in entries), p) for p, entries in snapshot.parts(self.name("blocks")).items())
        for least, _ in sizes:
            like = [p for rows, p in sizes if least <= rows <= TIER * max(least, 1)]
            if len(like) >= TIER:
                return sorted(like, key=int)
        return []

    def merge(self, change: Change, segments: list[str]) -> None:
        """Some segments become one, with their living postings; keys that no older segment can hold are forgotten.

        Groups of which over half of GROUP chunks live stay as they are, without the postings of those that went: their blocks are read and written in order, and only what is left of the other
        groups is exchanged to make full groups of it.
        """
        new = self.next_segment(change.base)
        for t, kind in (("terms", TERMS), ("totals", TOTALS)):
            rows, names = change.table(self.name(t), kind, segments), [c.split()[0] for c in kind.split(", ")]
            sums = [F.sum(c).alias(c) for c in names if c != "tok"]
            merged = rows.groupBy("tok").agg(*sums).filter("df <> 0").sort("tok") if "tok" in names else rows.agg(*sums)
            change.part(self.name(t), str(new), merged)
            change.drop(self.name(t), segments)
        change.table(self.name("dead"), DEAD)
        rows = change.table(self.name("blocks"), BLOCKS, segments)
        groups = stored(self.groups(change.base, rows), "groups")
        held, sparse = groups.agg(F.count("*") + F.coalesce(F.sum(F.size("gone")), F.lit(0)), F.count_if(F.col("living").between(1, GROUP // 2))).first()
        near = F.broadcast if held <= BROADCAST else lambda t: t
        after, end = {}, 0
        for r in groups.groupBy("segment").agg(F.max("grp").alias("grp")).orderBy("segment").collect():  # a row for each segment
            after[r["segment"]], end = end, end + r["grp"] + 1
        merged, small = None, None
        if after:
            merged = kept_blocks(rows.join(near(groups.filter(F.col("living") > GROUP // 2).drop("living")), ["segment", "grp"]))
            number = F.col("grp") + F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in after.items() for x in pair)), F.col("segment"))
            merged = merged.select("tok", number.alias("grp"), "n", "impacts", "entries")
            if held > BROADCAST:  # the join may have dealt the blocks anew
                merged = merged.sort("tok", "grp")
        if sparse:
            few = rows.join(near(groups.filter(F.col("living").between(1, GROUP // 2)).drop("living")), ["segment", "grp"])
            small = stored(few.select("tok", "gone", F.inline("entries")).filter(~went(F.col("gone"), F.col("chunk_key"))).drop("gone"), "postings")
            merged = merged.unionByName(regrouped(small).withColumn("grp", F.col("grp") + end))
        change.part(self.name("blocks"), str(new), (rows.drop("segment").limit(0) if merged is None else merged).withColumn("segment", F.lit(new).cast("long")), **PAGES)
        for t in (groups, small):
            if t is not None:
                unstored(t)
        left = [int(p) for p in change.base.parts(self.name("blocks")) if p not in segments]
        change.drop(self.name("blocks"), segments)
        change.drop(self.name("dead"), [p for p in change.base.parts(self.name("dead")) if int(p) <= min(left, default=new)])

    def groups(self, snapshot: Snapshot, blocks: DataFrame) -> DataFrame:
        """segment, grp, living, gone: how many chunks of each group live, and the keys of those that went in a later segment."""
        chunks = blocks.select("segment", "grp", F.explode("entries.chunk_key").alias("chunk_key")).distinct()
        last = snapshot.table(self.name("dead"), DEAD).groupBy("chunk_key").agg(F.max("segment").alias("_went"))
        late = F.coalesce(F.col("_went") > F.col("segment"), F.lit(False))
        return chunks.join(last, "chunk_key", "left").groupBy("segment", "grp").agg(F.count_if(~late).alias("living"), F.collect_list(F.when(late, F.col("chunk_key"))).alias("gone"))

    def tidy(self) -> None:
        """Merges as long as a tier is full."""
        while segments := self.due(self.ledger.snapshot()):
            self.ledger.change("merge keyword segments", lambda c, s=segments: self.merge(c, s))

    # --- searching ---

    def living(self, snapshot: Snapshot, rows: DataFrame) -> DataFrame:
        """Rows (chunk_key, segment) but those of chunks that went in a later segment."""
        if not snapshot.rows(self.name("dead")):
            return rows
        went = snapshot.table(self.name("dead"), DEAD).groupBy("chunk_key").agg(F.max("segment").alias("_went"))
        return rows.join(went, "chunk_key", "left").filter("_went is null or _went <= segment").drop("_went")

    def totals(self, snapshot: Snapshot) -> tuple[int, float, float]:
        """Chunks, their mean length and the mean of all words' raw idf; summed up once for a version."""
        if snapshot.version not in self.known:
            t = snapshot.table(self.name("totals"), TOTALS).agg(F.sum("chunks").alias("n"), F.sum("tokens").alias("t")).first()
            n = t["n"] or 0
            mean = self.frequencies(snapshot).agg(F.avg(raw_idf(n))).first()[0] if n else None
            self.known = {snapshot.version: (n, (t["t"] or 0) / n if n else 0.0, mean or 0.0)}
        return self.known[snapshot.version]

    def frequencies(self, snapshot: Snapshot) -> DataFrame:
        return snapshot.table(self.name("terms"), TERMS).groupBy("tok").agg(F.sum("df").alias("df")).filter("df > 0")

    def term_stats(self, snapshot: Snapshot | None = None) -> DataFrame:
        """tok, df, idf of all words; negative idfs become a quarter of the mean."""
        snapshot = snapshot or self.ledger.snapshot()
        n, _, mean = self.totals(snapshot)
        return self.frequencies(snapshot).select("tok", "df", F.when(raw_idf(n) < 0, FLOOR * mean).otherwise(raw_idf(n)).alias("idf"))

    def asked(self, snapshot: Snapshot, query: str) -> dict[str, float]:
        """The question's words that are indexed and their weights (idf by how often they are asked)."""
        spark = self.ledger.spark
        words = spark.createDataFrame([(query,)], "q string").select(F.explode(tokens(F.col("q"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("qf")).collect()
        often = {r["tok"]: r["qf"] for r in words}
        if not often:
            return {}
        n, _, mean = self.totals(snapshot)
        rows = snapshot.table(self.name("terms"), TERMS).filter(F.col("tok").isin(*often)).groupBy("tok").agg(F.sum("df").alias("df")).filter("df > 0").withColumn("raw", raw_idf(n)).collect()
        return {r["tok"]: often[r["tok"]] * (FLOOR * mean if r["raw"] < 0 else r["raw"]) for r in rows}

    def heads(self, snapshot: Snapshot, weights: dict[str, float]) -> DataFrame:
        """segment, grp, bound, n: an upper bound of the scores of each group's chunks, and the postings that it costs to score them."""
        weight, avgdl = weight_of(weights), self.totals(snapshot)[1]
        best = F.array_max(F.transform("impacts", lambda x: impact(x["tf"], x["dl"], avgdl)))
        rows = snapshot.table(self.name("blocks"), BLOCKS).filter(F.col("tok").isin(*weights)).select("segment", "grp", "n", F.greatest(F.lit(0.0), weight * best).alias("b"))
        return rows.groupBy("segment", "grp").agg(F.sum("b").alias("bound"), F.sum("n").alias("n"))

    def scores(self, snapshot: Snapshot, weights: dict[str, float], groups: DataFrame, pushed: list[int] | None) -> DataFrame:
        """chunk_key, score of the living chunks of some groups (segment, grp) that have a word of the question."""
        rows = snapshot.table(self.name("blocks"), BLOCKS).filter(F.col("tok").isin(*weights))
        if pushed is not None:
            rows = rows.filter(F.col("grp").isin(*pushed))
        entries = rows.join(groups.select("segment", "grp"), ["segment", "grp"], "left_semi").select("tok", "segment", F.inline("entries"))
        part = weight_of(weights) * impact(F.col("tf"), F.col("dl"), self.totals(snapshot)[1])
        return self.living(snapshot, entries).groupBy("chunk_key").agg(F.sum(part).alias("score"))

    def promising(self, snapshot: Snapshot, weights: dict[str, float], k: int) -> tuple[DataFrame, list[int] | None]:
        """The groups that can hold one of the k best chunks, and their numbers if they are few."""
        heads = self.heads(snapshot, weights)
        first = heads.orderBy(F.desc("bound"), "segment", "grp").limit(k).collect()
        spark = self.ledger.spark
        local = lambda rows: spark.createDataFrame([(r["segment"], r["grp"]) for r in rows], "segment long, grp long")
        numbers = lambda rows: sorted({r["grp"] for r in rows})
        found = self.scores(snapshot, weights, local(first), numbers(first)).orderBy(F.desc("score")).limit(k).collect() if first else []
        if len(found) == k:
            heads = heads.filter(F.col("bound") >= found[-1]["score"] - SLACK)
        few = heads.limit(PUSHED + 1).collect()
        return (local(few), numbers(few)) if len(few) <= PUSHED else (heads, None)

    def search(self, query: str, k: int = 15, snapshot: Snapshot | None = None) -> DataFrame:
        """chunk_key, score, rank: the k best, of these only positive scores; the rows that scoring every posting would give. k numbers of groups and k scores reach the driver."""
        snapshot = snapshot or self.ledger.snapshot()
        weights = self.asked(snapshot, query)
        if not weights:
            return self.ledger.spark.createDataFrame([], "chunk_key string, score double, rank long")
        order = F.round("score", 9).desc()
        best = self.scores(snapshot, weights, *self.promising(snapshot, weights, k)).orderBy(order, "chunk_key").limit(k)
        return ranked(best, order, F.col("chunk_key")).filter("score > 0")

    def reads(self, query: str, k: int = 15) -> dict[str, int]:
        """Postings of the index, of the question's words, and of these the ones that a search reads."""
        snapshot = self.ledger.snapshot()
        weights = self.asked(snapshot, query)
        groups, _ = self.promising(snapshot, weights, k)
        every = snapshot.table(self.name("blocks"), BLOCKS)
        heads = self.heads(snapshot, weights)
        total = lambda df: df.agg(F.sum("n")).first()[0] or 0
        return {"all": total(every), "asked": total(heads), "read": total(heads.join(groups.select("segment", "grp"), ["segment", "grp"], "left_semi"))}


#: Small pages, so that filters on word and group pass over most of a file.
PAGES = {"parquet.page.row.count.limit": "512"}


def went(gone: Column, key: Column) -> Column:
    return F.coalesce(F.array_contains(gone, key), F.lit(False))


def kept_blocks(rows: DataFrame) -> DataFrame:
    """Blocks without the postings of the chunks of `gone`; heads are made anew where one went."""
    hit = F.coalesce(F.arrays_overlap("entries.chunk_key", "gone"), F.lit(True))
    left = F.when(~hit, F.col("entries")).otherwise(F.filter("entries", lambda e: ~went(F.col("gone"), e["chunk_key"])))
    rows = rows.withColumn("entries", left).filter(F.size("entries") > 0)
    shortest = lambda tf: F.array_min(F.transform(F.filter("entries", lambda e: e["tf"] == tf), lambda e: e["dl"]))
    anew = F.transform(F.array_distinct("entries.tf"), lambda tf: F.struct(tf.alias("tf"), shortest(tf).alias("dl")))
    return rows.withColumn("impacts", F.when(F.size("entries") == F.col("n"), F.col("impacts")).otherwise(anew)).withColumn("n", F.size("entries"))


def raw_idf(n: int) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def weight_of(weights: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("tok"))


def built(spark: SparkSession, folder: str, chunks: DataFrame) -> KeywordIndex:
    """An index of chunks (chunk_key, text) in a folder of its own."""
    index = KeywordIndex(Ledger(spark, folder))
    kept: Callable[[Change], None] = lambda c: index.update(c, chunks.select("chunk_key", "text"), chunks.select("chunk_key", "text").limit(0))
    index.ledger.change("index", kept)
    return index
