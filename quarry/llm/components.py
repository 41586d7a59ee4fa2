"""Connected components by alternating large-star and small-star steps, entirely on DataFrames.

Edges are pairs of long node ids. Every step is a minimum per node (combined before the shuffle) joined back to the edges,
so a node with very many neighbours is no more than one key of a join that adaptive execution can split. Each round ends in
a table of the shared checkpoint folder, and the table of the round before goes. Rounds end when nothing changes; every round that changes something
brings nodes nearer to their smallest one, so they do end. No edges, self loops, repeated and reversed edges are all fine; null ends are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, unstored


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node with an edge, the smallest node it can reach."""
    prepare(edges.sparkSession)
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    print_of = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).first()
    before, after = None, print_of(now)
    while after != before:
        last, now = now, stored(small_star(large_star(now)), "links")
        before, after = after, print_of(now)
        unstored(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
