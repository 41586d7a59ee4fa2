"""A stored index of vectors for nearest-neighbour search by cosine: lists around centroids, of which a search reads the near ones.

Vectors are normalised, so cosine and Euclidean order agree. Centroids come from Spark's k-means on a bounded sample (`SAMPLE` vectors, the smallest hashes of their keys); every vector is stored in the
list of its nearest centroid, a list being a part of a ledger's table, so a search opens only the files of the lists it visits. Later vectors join the lists that are there; chunks that go
are marked in `dead` as in the keyword index. `refit` deals all living vectors anew when there are several times as many as the centroids were made for.

A search visits lists in the order of their centroids' distances from the question. A list at distance d with radius r holds nothing nearer than d - r: an exact search reads all
lists with d - r up to the k-th distance found, so its rows are those of a scan of everything; an approximate one reads only lists with d up to `ratio` times the nearest list's
distance, but lists with k vectors at least. Vectors without a direction (null, empty, all zero, not finite) are not indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound
from ..session import stored, unstored
from ..sources.ledger import Change, Ledger, Snapshot
from .pairs import distances, nearest_in_parts, packed
from .retrieval import cosine_topk

#: Vectors that centroids are made from at most, vectors of a list aimed at, lists at most, how far beyond the nearest list an approximate search goes, growth that asks for new centroids.
SAMPLE, LIST_ROWS, MOST_LISTS, RATIO, GROWTH = 20_000, 200, 4_096, 1.25, 4
LISTS = "chunk_key string, embedding array<double>, list long, distance double, segment long"
CENTROIDS = "list long, centroid array<double>, made_for long"
RADII, DEAD = "list long, radius double, rows long", "chunk_key string, segment long"


def normalised(vectors: DataFrame) -> DataFrame:
    """chunk_key, embedding (as given, in doubles), unit; only vectors with a direction."""
    v = vectors.select("chunk_key", F.col("embedding").cast("array<double>").alias("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    sound = v.withColumn("_n", norm).filter(F.col("_n").isNotNull() & (F.col("_n") > 0) & (F.col("_n") < float("inf")))
    return sound.select("chunk_key", "embedding", F.transform("embedding", lambda x: x / F.col("_n")).alias("unit"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest_list(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """rows with list and distance of the nearest centroid; the centroids (at most MOST_LISTS) go along with every task. A vector of another length goes to the first list, without a distance."""
    found = centroids.select("list", "centroid").orderBy("list").collect()  # at most MOST_LISTS
    if not found:
        return rows.limit(0).withColumn("list", F.lit(None).cast("long")).withColumn("distance", F.lit(None).cast("double"))
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r["list"] for r in found]), np.array([r["centroid"] for r in found])))
    at = rows.columns.index("unit")

    def run(batches):
        lists, c = shared.value
        for b in batches:
            unit = b.column(at)
            sound = np.array([len(v) == c.shape[1] for v in unit], bool)
            to, far = np.full(b.num_rows, lists[0]), np.full(b.num_rows, np.nan)
            if sound.any():
                x = unit.filter(pa.array(sound)).flatten().to_numpy().reshape(-1, c.shape[1])
                near = distances(x, c).argmin(axis=1)
                to[sound], far[sound] = lists[near], np.sqrt(((x - c[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int64()), pa.array(far, pa.float64(), mask=~sound)], [*b.schema.names, "list", "distance"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("list", T.LongType()), T.StructField("distance", T.DoubleType())]))


@dataclass
class VectorIndex:
    ledger: Ledger
    prefix: str = "vector"
    sample: int = SAMPLE
    list_rows: int = LIST_ROWS

    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def next_segment(self, base: Snapshot) -> int:
        return max((int(p) for p in base.parts(self.name("dead"))), default=0) + 1

    def fit(self, unit: DataFrame) -> DataFrame:
        """CENTROIDS of a bounded sample of (chunk_key, unit)."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector, vector_to_array

        spark, n = self.ledger.spark, unit.count()
        k = max(1, min(MOST_LISTS, self.sample // 4, n // self.list_rows))
        some = unit.orderBy(F.xxhash64("chunk_key"), "chunk_key").limit(self.sample).select(array_to_vector("unit").alias("features"))
        if k == 1:
            return some.limit(1).select(F.lit(0).cast("long").alias("list"), vector_to_array("features").alias("centroid"), F.lit(n).cast("long").alias("made_for"))
        model = KMeans(k=k, seed=1, maxIter=10, initSteps=2).fit(some)
        return spark.createDataFrame([(i, [float(x) for x in c], n) for i, c in enumerate(model.clusterCenters())], CENTROIDS)

    def update(self, change: Change, added: DataFrame, removed: DataFrame) -> None:
        """Vectors (chunk_key, embedding) that are new and the keys of chunks that go; a changed one is in both."""
        segment = self.next_segment(change.base)
        new = stored(normalised(added), "vectors")
        centroids = change.table(self.name("centroids"), CENTROIDS)
        if not change.base.rows(self.name("centroids")) and not new.isEmpty():
            centroids = stored(self.fit(new.select("chunk_key", "unit")), "centroids")
            change.part(self.name("centroids"), "0", centroids)
        dealt = stored(nearest_list(new, centroids).select("chunk_key", "embedding", "list", "distance", F.lit(segment).cast("long").alias("segment")), "vectors")
        change.append(self.name("lists"), dealt, "list")
        radii = dealt.groupBy("list").agg(F.max("distance").alias("radius"), F.count("*").alias("rows"))
        change.part(self.name("radii"), str(segment), radii)
        change.part(self.name("dead"), str(segment), removed.select("chunk_key", F.lit(segment).cast("long").alias("segment")))
        unstored(new)

    def clear(self, change: Change) -> None:
        for t in ("lists", "centroids", "radii", "dead"):
            change.drop(self.name(t))

    def refit(self, change: Change) -> None:
        """New centroids for what is there now, if that is GROWTH times what the old ones were made for; dead vectors go."""
        base = change.base
        made = change.table(self.name("centroids"), CENTROIDS).agg(F.max("made_for")).first()[0]
        if not made or base.rows(self.name("lists")) < GROWTH * made:
            return
        for t, kind in (("dead", DEAD), ("radii", RADII)):
            change.table(self.name(t), kind)
        living = stored(self.living(base, change.table(self.name("lists"), LISTS)).select("chunk_key", "embedding"), "vectors")
        unit, segment = normalised(living), self.next_segment(base)
        centroids = stored(self.fit(unit.select("chunk_key", "unit")), "centroids")
        dealt = stored(nearest_list(unit, centroids).select("chunk_key", "embedding", "list", "distance", F.lit(segment).cast("long").alias("segment")), "vectors")
        self.clear(change)
        change.part(self.name("centroids"), "0", centroids)
        change.replace_parts(self.name("lists"), dealt, "list")
        change.part(self.name("radii"), str(segment), dealt.groupBy("list").agg(F.max("distance").alias("radius"), F.count("*").alias("rows")))
        change.part(self.name("dead"), str(segment), self.ledger.spark.createDataFrame([], DEAD))

    def living(self, snapshot: Snapshot, rows: DataFrame) -> DataFrame:
        if not snapshot.rows(self.name("dead")):
            return rows
        went = snapshot.table(self.name("dead"), DEAD).groupBy("chunk_key").agg(F.max("segment").alias("_went"))
        return rows.join(went, "chunk_key", "left").filter("_went is null or _went <= segment").drop("_went")

    def lists(self, snapshot: Snapshot, query: list[float]) -> list:
        """Rows (list, d, radius, rows) of the lists by their distance from the question; at most MOST_LISTS."""
        size = sum(float(x) * float(x) for x in query) ** 0.5 or 1.0
        q = F.array(*(F.lit(float(x) / size) for x in query))
        radii = snapshot.table(self.name("radii"), RADII).groupBy("list").agg(F.max("radius").alias("radius"), F.sum("rows").alias("rows"))
        return snapshot.table(self.name("centroids"), CENTROIDS).join(radii, "list").select("list", distance(F.col("centroid"), q).alias("d"), "radius", "rows").orderBy("d", "list").collect()

    def read(self, snapshot: Snapshot, lists: list, query: list[float], k: int) -> DataFrame:
        rows = snapshot.table(self.name("lists"), LISTS, [str(x["list"]) for x in lists])
        return cosine_topk(self.living(snapshot, rows), query, k)

    def visited(self, snapshot: Snapshot, query: list[float], k: int, exact: bool, ratio: float) -> list:
        """The lists that a search reads."""
        near, far, have = self.lists(snapshot, query), 0, 0
        while far < len(near) and (have < k or near[far]["d"] <= ratio * near[0]["d"]):
            have, far = have + near[far]["rows"], far + 1
        if not exact or far == len(near):
            return near[:far]
        found = self.read(snapshot, near[:far], query, k).collect()
        if len(found) < k:
            return near
        edge = (2 * max(0.0, max(r["distance"] for r in found))) ** 0.5 + 1e-9  # of unit vectors: the squared distance is twice the cosine distance
        return near[:far] + [x for x in near[far:] if x["d"] - x["radius"] <= edge]

    def search(self, query: list[float], k: int, snapshot: Snapshot | None = None, exact: bool = False, ratio: float = RATIO) -> DataFrame:
        """chunk_key, distance, base_score, rank of the k nearest by cosine. Lists without enough living vectors lead to a search of all."""
        snapshot = snapshot or self.ledger.snapshot()
        lists = self.visited(snapshot, query, k, exact, ratio)
        out = self.read(snapshot, lists, query, k)
        if snapshot.rows(self.name("dead")) and len(lists) < len(snapshot.parts(self.name("lists"))) and out.count() < k:
            out = self.read(snapshot, self.lists(snapshot, query), query, k)
        return out

    def search_many(self, queries: DataFrame, k: int, snapshot: Snapshot | None = None, ratio: float = RATIO) -> DataFrame:
        """query_key, chunk_key, score, rank: approximate searches for many questions (query_key string, embedding) at once; each reads the lists that `search` would. Score is the distance of unit vectors.

        Questions are dealt to their lists by a shuffle; only the centroids (at most MOST_LISTS) go along with every task. Lists without enough living vectors give fewer than k rows.
        """
        snapshot = snapshot or self.ledger.snapshot()
        radii = snapshot.table(self.name("radii"), RADII).groupBy("list").agg(F.sum("rows").alias("rows"))
        near = snapshot.table(self.name("centroids"), CENTROIDS).join(radii, "list").orderBy("list").collect()
        if not near:
            return self.ledger.spark.createDataFrame([], "query_key string, chunk_key string, score double, rank int")
        shared = self.ledger.spark.sparkContext.broadcast((np.array([r["list"] for r in near]), np.array([r["rows"] for r in near]), np.array([r["centroid"] for r in near])))

        def route(batches):
            lists, rows, centroids = shared.value
            for b in batches:
                for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    d = np.sqrt(((centroids - np.asarray(v)) ** 2).sum(axis=1))
                    order = np.lexsort((lists, d))
                    before = np.concatenate([[0], np.cumsum(rows[order])[:-1]])
                    at = lists[order][(before < k) | (d[order] <= ratio * d[order[0]])]
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([key] * len(at), pa.string()), pa.array([np.asarray(v).tobytes()] * len(at), pa.binary())], ["part", "key", "point"])

        unit = normalised(queries.select(F.col("query_key").alias("chunk_key"), "embedding")).select("chunk_key", "unit")
        asked = unit.mapInArrow(route, PART)
        points = in_parts(normalised_lists(self.living(snapshot, snapshot.table(self.name("lists"), LISTS))))
        return many_best(points, asked, k)


PART = "part long, key string, point binary"


def normalised_lists(rows: DataFrame) -> DataFrame:
    """(part, key, unit) of rows of LISTS."""
    return rows.select(F.col("list").alias("part"), F.col("chunk_key").cast("string").alias("key"), unit_of(F.col("embedding")).alias("unit"))


def unit_of(e: Column) -> Column:
    return bound(F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(e, lambda x: x / n))


def in_parts(rows: DataFrame) -> DataFrame:
    """(part, key, unit) with the vectors as bytes."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(b.column(2).to_pylist())], ["part", "key", "point"])

    return rows.mapInArrow(run, PART)


def many_best(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    found = nearest_in_parts(points, asked, k, own=True).toDF("query_key", "chunk_key", "score")
    order = Window.partitionBy("query_key").orderBy("score", "chunk_key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scan_many(vectors: DataFrame, queries: DataFrame, k: int, part_rows: int = 32_768) -> DataFrame:
    """query_key, chunk_key, score, rank: for many questions (query_key string, embedding) the k nearest of all vectors, exactly.

    The work grows with questions times vectors. Vectors are dealt to parts of some part_rows by their keys and every question goes to every part, so a task holds one part and a few questions.
    """
    all_ = normalised(vectors.select(F.col("chunk_key").cast("string").alias("chunk_key"), "embedding"))
    parts = max(1, -(-all_.count() // part_rows))
    dealt = all_.select(F.pmod(F.xxhash64("chunk_key"), F.lit(parts)).alias("part"), F.col("chunk_key").alias("key"), "unit")
    every = normalised(queries.select(F.col("query_key").alias("chunk_key"), "embedding")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.col("chunk_key").alias("key"), "unit")
    return many_best(in_parts(dealt), in_parts(every), k)
