r"""Exact duplicates by an extendible-hash index on shared files; DataFrame functions only.

Texts are equal when they are identical without the characters `[\x20\x09-\x0D]`. Every row is written once to the pages of the index, in the shared
folder: its 64-bit hash, its digest and its text without white space. The directory's doubling starts at one bucket for all hashes; a bucket whose
rows weigh more than `capacity` splits by the next bit of the hash, and the directory has as many slots as the deepest bucket asks for. All
doublings are one pass over a histogram of the hashes' first 20 bits (2^20 rows at most). A hash that is overfull by itself cannot split: it gets an overflow chain
of `salts` pages that are dealt apart (there are at most 262,144 such hashes, as capacity follows the table).

A bucket is a range of hashes, and each page of it one owner's. Owners group the texts of a hash by their bytes; different texts of one hash are
the links of its chain. Links of overflow pages meet once more, again by their bytes. The rows then look up their link by hash and digest: chains of
overfull hashes are broadcast, all others are joined; a chain that holds one digest twice (two texts, one SHA-256) is an error.

Of equal texts the row with the most code points in the original text stays, then the smallest doc_id, a null id last, and of rows that are the same in
both the first one. A null text counts as empty, and empty texts are equal. Repeated rows and ids are rows of their own. An empty table gives no rows. Columns
other than doc_id and text are ignored by `groups` and kept by `drop_copies`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

WHITE = " \t\n\x0b\x0c\r"
#: Bits that the directory can grow to, megabytes of a bucket, most buckets that their size aims at, what a row weighs beside its text, megabytes of one owner task.
MOST_DEPTH, BUCKET_MB, MOST_BUCKETS, ROW_BYTES, TASK_MB = 20, 8.0, 1 << 18, 64, 64.0


@dataclass
class Index:
    """Tables in the shared folder. pages: rid, doc_id, n_chars, h, sha, body, n_bytes (and row); directory: slot, bucket, local_depth; overfull: h, salts; chains: bucket, h, link, sha, n, best."""

    pages: DataFrame
    directory: DataFrame
    depth: int
    overfull: DataFrame
    chains: DataFrame


def normalised(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def slot(h: Column, depth: int) -> Column:
    """The first `depth` bits of a hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def pages(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64, rows: bool = False) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row")] if rows else []
    out = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n_chars"), normalised(text).alias("body"), *kept)
    return stored(out.select("*", hashed(F.col("body")).cast("long").alias("h"), F.sha2("body", 256).alias("sha"), F.octet_length("body").alias("n_bytes")), "index-pages")


def buckets(histogram: DataFrame, capacity: float) -> DataFrame:
    """prefix, local_depth of the buckets that doubling ends with, from (prefix of MOST_DEPTH bits, weight)."""
    levels = histogram.select("prefix", "weight", F.explode(F.sequence(F.lit(0), F.lit(MOST_DEPTH))).alias("local_depth"))
    levels = levels.groupBy("local_depth", F.expr(f"shiftright(prefix, {MOST_DEPTH} - local_depth)").alias("prefix")).agg(F.sum("weight").alias("weight"))
    full = (F.col("weight") > capacity) & (F.col("local_depth") < MOST_DEPTH)
    split = levels.filter(full).select((F.col("local_depth") + 1).alias("local_depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    halves = levels.filter(~full).join(split, ["local_depth", "prefix"], "left_semi")
    return halves.unionByName(levels.filter(~full & (F.col("local_depth") == 0))).select("prefix", "local_depth")


def build(docs: DataFrame, bucket_mb: float = BUCKET_MB, hashed: Callable[[Column], Column] = F.xxhash64, rows: bool = False) -> Index:
    prepare(docs.sparkSession)
    kept = pages(docs, hashed, rows)
    weight = F.sum(F.col("n_bytes") + ROW_BYTES).alias("weight")
    fine = slot(F.col("h"), MOST_DEPTH).alias("prefix")
    everything = stored(kept.groupBy(fine).agg(weight), "index-histogram")
    total = everything.agg(F.sum("weight")).first()[0] or 0
    capacity = max(bucket_mb * 1e6, total / MOST_BUCKETS)
    heavy = kept.groupBy("h").agg(weight).filter(F.col("weight") > capacity)
    overfull = stored(heavy.select("h", "weight", F.ceil(F.col("weight") / capacity).cast("int").alias("salts")), "index-overfull")
    light = everything.unionByName(overfull.select(fine, (-F.col("weight")).alias("weight"))).groupBy("prefix").agg(F.sum("weight").alias("weight"))
    found = stored(buckets(light, capacity), "index-buckets")
    depth = found.agg(F.max("local_depth")).first()[0] or 0
    first = F.expr(f"shiftleft(prefix, {depth} - local_depth)")
    slots = F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - local_depth)") - 1)
    directory = stored(found.select(F.explode(slots).alias("slot"), first.alias("bucket"), "local_depth"), "index-directory")
    return Index(kept, directory, depth, overfull, stored(chained(kept, directory, depth, overfull, int(total / (TASK_MB * 1e6)) + 1), "index-chains"))


def chained(kept: DataFrame, directory: DataFrame, depth: int, overfull: DataFrame, tasks: int) -> DataFrame:
    """The links of every hash, made by the owners of its bucket's pages. The directory has at most 2^20 rows, the overfull hashes are at most MOST_BUCKETS: both are broadcast."""
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("rid").alias("rid"))).alias("best")
    dealt = kept.select("rid", "doc_id", "n_chars", "h", "sha", "body", slot(F.col("h"), depth).alias("slot"))
    dealt = dealt.join(F.broadcast(directory.select("slot", "bucket")), "slot").join(F.broadcast(overfull.select("h", "salts")), "h", "left")
    dealt = dealt.withColumn("page", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("rid"), F.col("salts")))).repartition(tasks, "bucket", "page")
    links = dealt.groupBy("bucket", "page", "h", "body", "sha").agg(F.count("*").alias("n"), best)
    links = links.groupBy("bucket", "h", "sha", F.when(F.col("page").isNotNull(), F.col("body")).alias("body")).agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    chain = links.groupBy("bucket", "h").agg(F.sort_array(F.collect_list(F.struct("sha", "n", "best"))).alias("links"))  # texts that share 64 bits
    twice = F.size("links") != F.size(F.array_distinct(F.transform("links", lambda x: x["sha"])))
    sound = chain.select("bucket", "h", F.when(twice, F.raise_error(F.lit("two texts of one hash have one SHA-256"))).otherwise(F.col("links")).alias("links"))
    return sound.select("bucket", "h", F.posexplode("links").alias("link", "x")).select("bucket", "h", "link", "x.*")


def looked_up(index: Index) -> DataFrame:
    """Every page row with its link: keep_id, group_size, kept."""
    rows = index.pages.drop("body", "n_bytes").join(F.broadcast(index.overfull.select("h", "salts")), "h", "left")
    links = index.chains.select("h", "sha", "n", "best").join(F.broadcast(index.overfull.select("h", "salts")), "h", "left")
    of = lambda df, there: df.filter(F.col("salts").isNotNull() if there else F.col("salts").isNull()).drop("salts")
    found = of(rows, True).join(F.broadcast(of(links, True)), ["h", "sha"]).unionByName(of(rows, False).join(of(links, False), ["h", "sha"]))
    return found.withColumn("keep_id", F.bitwise_not("best.id")).withColumn("kept", F.col("rid") == F.bitwise_not("best.rid")).withColumnsRenamed({"n": "group_size", "sha": "text_sha256"})


def groups(docs: DataFrame, bucket_mb: float = BUCKET_MB, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return looked_up(build(docs, bucket_mb, hashed)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, bucket_mb: float = BUCKET_MB) -> DataFrame:
    """The rows that stay, with all their columns."""
    out = looked_up(build(docs, bucket_mb, rows=True)).filter("kept").select("row.*")
    return out.toDF(*docs.columns)
