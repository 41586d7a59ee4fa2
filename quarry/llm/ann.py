"""Approximate nearest neighbours with balanced posting lists.

Centroids come from balanced two-way splits of a bounded sample of the distinct vectors (`sample_rows`, the smallest hashes of the ids),
one list for every LIST_ROWS distinct vectors, but at most one for FITTED_ROWS vectors of the sample (5,000 lists by default: from a million distinct vectors on lists grow with the
table, and `sample_rows` should grow with it too). Every vector of the table is indexed: it goes to its nearest list and is replicated to every
further list whose centroid is at most (1 + `closure`) times as far (up to `replicas` lists), so boundary vectors are found from either side.
Lists that hold more than BLOCK_ROWS vectors are cut into blocks, each scanned by a task of its own, so tasks are balanced whatever the lists are.

Queries walk an in-memory graph over the centroids best-first and visit every list whose centroid is at most (1 + ratio) times as far as the
nearest one, however many these are. The ratio is calibrated on the table itself: a bounded number of sampled vectors is answered exactly in
one pass over all rows, and the ratio is the smallest that leads to the share REACH of their neighbours; so recall holds while tables grow.
A query visits LEAST_LISTS lists at least, and goes on to the next nearest lists until those it visits are certain to hold k candidates, so it
gets k rows, or all candidates if there are fewer. Distances to all vectors of the visited lists are exact.

Of exactly equal vectors only the k + 1 smallest ids can ever be among the k nearest (ties go to smaller ids), so copies beyond
these are set aside before the lists are built, by a group limit that works before the shuffle.

Vectors that are null, empty, zero, of another length than most of the sample, or that hold null or non-finite components take no
part, nor do null ids. A repeated id is one candidate with its nearest distance, and one query for the vectors near any of its own. With fewer
candidates than k all are returned; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pairs import distances, exact, nearest_in_parts, packed
from .common import mix64, prepare, stored

#: Bound of the sample that centroids are fitted on.
SAMPLE_ROWS = 20_000
#: Distinct vectors a list should hold, sampled vectors a centroid needs, and vectors in one block of a list.
LIST_ROWS, FITTED_ROWS, BLOCK_ROWS = 200, 4, 4_000
#: Closest centroids that a search follows at least, before distances end it; lists that it visits at least.
WIDTH, LEAST_LISTS = 64, 4
#: Sampled vectors that calibrate the ratio, the share of their neighbours that it must lead to, and queries of one block of an exact search.
CALIBRATING, REACH, EXACT_BLOCK = 128, 0.98, 256
#: Rows that a query is sent on in at once.
ROUTED = 4_096


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.coalesce(good & F.exists("embedding", lambda x: x != 0), F.lit(False)))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 10) -> np.ndarray:
    """Means of the leaves of balanced two-way splits."""
    rng, todo, out = np.random.default_rng(seed), [(x, lists)], []
    while todo:
        part, n = todo.pop()
        if n <= 1 or len(part) < 2:
            out.append(part.mean(axis=0))
            continue
        a, b = part[rng.choice(len(part), 2, replace=False)]
        cut = len(part) * (n // 2) // n
        for _ in range(6):
            order = np.argsort(part @ (a - b), kind="stable")
            a, b = part[order[cut:]].mean(axis=0), part[order[:cut]].mean(axis=0)
        todo += [(part[order[cut:]], n - n // 2), (part[order[:cut]], n // 2)]
    return np.array(out)


class CentroidGraph:
    """Neighbour graph over the centroids, searched best-first from several entries."""

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.c = centroids
        k, links = min(degree, len(centroids) - 1), [set() for _ in centroids]
        for i in range(0, len(centroids), 256):  # rows at a time: the whole matrix of distances is never held
            d = distances(centroids[i : i + 256], centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            for j, near in enumerate(np.argsort(d, axis=1, kind="stable")[:, :k].tolist(), i):
                for other in near:  # both ways: a centroid that is nobody's neighbour is found from its own
                    links[j].add(other)
                    links[other].add(j)
        self.links = [np.array(sorted(x), np.int64) for x in links]
        self.entries = np.linspace(0, len(centroids) - 1, min(len(centroids), 16)).astype(int)

    def nearest(self, q: np.ndarray, n: int) -> list[tuple[float, int]]:
        far = lambda at: np.sqrt(((self.c[at] - q) ** 2).sum(axis=1))
        seen = set(self.entries.tolist())
        open_ = [(float(d), int(i)) for d, i in zip(far(self.entries), self.entries, strict=True)]
        best = [(-d, i) for d, i in open_]
        heapq.heapify(open_)
        heapq.heapify(best)
        while len(best) > n:
            heapq.heappop(best)
        while open_:
            d, i = heapq.heappop(open_)
            if len(best) >= n and d > -best[0][0]:
                break
            new = [j for j in self.links[i].tolist() if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(far(np.array(new)).tolist(), new, strict=True):
                if len(best) < n or e < -best[0][0]:
                    heapq.heappush(open_, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > n:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def within(self, q: np.ndarray, ratio: float) -> list[tuple[float, int]]:
        """All centroids the graph leads to that are at most (1 + ratio) times as far as the nearest; their number has no bound."""
        found = self.nearest(q, WIDTH)
        limit = (1 + ratio) * found[0][0]
        seen, todo = {i for _, i in found}, [i for _, i in found]
        out = [(d, i) for d, i in found if d <= limit]
        while todo:
            new = np.setdiff1d(np.concatenate([self.links[i] for i in todo]), list(seen))
            seen.update(new.tolist())
            d = np.sqrt(((self.c[new] - q) ** 2).sum(axis=1))
            near = d <= limit
            todo = new[near].tolist()
            out += zip(d[near].tolist(), todo, strict=True)
        least = min(out)[0]
        return sorted((d, i) for d, i in out if d <= (1 + ratio) * least)


def nearest_of(points: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score and lists of the k nearest other rows of each query, by an exact pass over all points; at most k rows a query and task are shuffled."""
    shared = points.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = shared.value
        best: list[list[tuple]] = [[] for _ in ids]
        for pdf in batches:
            pdf = pdf[pdf["embedding"].map(len) == q.shape[1]]
            if not len(pdf):
                continue
            x, own, lists = np.stack(pdf["embedding"]), pdf["vec_id"].to_numpy(), pdf["lists"].tolist()
            rough, slack = distances(q, x), 1e-6 * (np.abs(q).sum(axis=1).max() + np.abs(x).sum(axis=1).max())  # only to leave out what cannot be among the nearest
            for i, row in enumerate(rough):
                limit = best[i][-1][0] if len(best[i]) == k else np.inf
                if k < len(row):
                    limit = min(limit, np.partition(row, k)[k])
                at = np.flatnonzero((row <= limit + slack) & (own != ids[i]))
                d = exact(q[i], x[at])
                best[i] = sorted([*best[i], *((float(s), int(own[j]), lists[j]) for s, j in zip(d, at, strict=True))], key=lambda r: r[:2])[:k]
        yield pd.DataFrame([(int(i), j, s, m) for i, rows in zip(ids, best, strict=True) for s, j, m in rows], columns=["query_id", "vec_id", "score", "lists"])

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = points.select("vec_id", "embedding", "lists").mapInPandas(run, "query_id long, vec_id long, score double, lists array<int>")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def query_blocks(queries: DataFrame, rows: int = EXACT_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a query table, so many at a time."""
    ids, vectors = [], []
    for r in usable(queries).toLocalIterator():
        if vectors and len(r["embedding"]) != len(vectors[0]):
            continue
        ids.append(r["vec_id"])
        vectors.append(r["embedding"])
        if len(ids) == rows:
            yield np.array(ids), np.array(vectors)
            ids, vectors = [], []
    if ids:
        yield np.array(ids), np.array(vectors)


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10) -> float:
    """Share of the queries' true k nearest neighbours that `found` (the result of `neighbours`) holds; a block of queries a pass over the vectors."""
    hits = total = 0
    points = usable(vectors).withColumn("lists", F.array().cast("array<int>"))
    for ids, q in query_blocks(queries):
        true = nearest_of(points, ids, q, k).select("query_id", "vec_id")
        total += true.count()
        hits += true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hits / total if total else 1.0


def calibrated(placed: DataFrame, graph: CentroidGraph, ids: np.ndarray, q: np.ndarray, k: int) -> float:
    """The smallest ratio that leads the sampled queries to the share REACH of their true neighbours."""
    at = dict(zip(ids.tolist(), q, strict=True))
    needed = []
    for r in nearest_of(placed, ids, q, k).collect():  # k rows a sampled query
        d = np.sqrt(((graph.c - at[r["query_id"]]) ** 2).sum(axis=1))
        order = np.sort(d)
        best = d[r["lists"]].min()
        needed.append(0.0 if best <= order[min(LEAST_LISTS, len(order)) - 1] else best / max(order[0], 1e-300) - 1)
    return float(np.quantile(needed, REACH, method="higher")) * (1 + 1e-9) if needed else 0.0


def visited(graph: CentroidGraph, q: np.ndarray, ratio: float, held: np.ndarray, least: int) -> list[int]:
    """Lists to visit: all within the ratio, LEAST_LISTS at least, then the next nearest until they hold `least` vectors (held: how many a list is nearest to)."""
    lists = [j for _, j in graph.within(q, ratio)]
    if len(lists) < min(LEAST_LISTS, len(graph.c)) or held[lists].sum() < least:
        seen = set(lists)
        for j in np.argsort(((graph.c - q) ** 2).sum(axis=1), kind="stable").tolist():
            if len(lists) >= LEAST_LISTS and held[lists].sum() >= least:
                break
            if j not in seen:
                lists.append(j)
    return lists


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, closure: float = 0.05, replicas: int = 4, ratio: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other vectors that the visited lists hold; without a ratio it is calibrated."""
    spark = prepare(vectors.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double"
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    points = stored(usable(vectors).withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1), "points")
    distinct = points.filter("copy = 1")
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    if not len(sample):
        return spark.createDataFrame([], schema)
    size = int(sample["embedding"].map(len).mode().iloc[0])
    sample = sample[sample["embedding"].map(len) == size]
    x = np.stack(sample["embedding"]).astype(float)
    graph = CentroidGraph(balanced_centroids(x, int(max(1, min(distinct.count() // LIST_ROWS, len(x) // FITTED_ROWS)))))
    shared = spark.sparkContext.broadcast(graph)

    def assign(batches):
        c = shared.value.c
        for pdf in batches:
            pdf = pdf[pdf["embedding"].map(len) == size]
            if len(pdf):
                d = distances(np.stack(pdf["embedding"]), c)
                near = np.argpartition(d, replicas - 1, axis=1)[:, :replicas] if replicas < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
                dn = np.take_along_axis(d, near, axis=1)
                order = np.lexsort((near, dn), axis=1)
                near, dn = np.take_along_axis(near, order, axis=1), np.take_along_axis(dn, order, axis=1)
                n = (dn <= (1 + closure) * dn[:, :1]).sum(axis=1)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "embedding": pdf["embedding"], "lists": [row[:m] for row, m in zip(near.astype(np.int32), n, strict=True)]})

    placed = stored(points.select("vec_id", "embedding").mapInPandas(assign, "vec_id long, embedding array<double>, lists array<int>"), "placed")
    if ratio is None:
        few = sample.iloc[:CALIBRATING]
        ratio = calibrated(placed, graph, few["vec_id"].to_numpy(), np.stack(few["embedding"]).astype(float), k)
    # One row a list: how many vectors are nearest to it, and how many it holds with replicas.
    each = placed.select(F.posexplode("lists").alias("pos", "list")).groupBy("list").agg(F.count_if(F.col("pos") == 0).alias("own"), F.count("*").alias("all")).collect()
    held, blocks = np.zeros(len(graph.c), np.int64), np.ones(len(graph.c), np.int64)
    for r in each:
        held[r["list"]], blocks[r["list"]] = r["own"], -(-r["all"] // BLOCK_ROWS)
    repeats = placed.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1  # rows that one candidate can have
    plan, least = spark.sparkContext.broadcast((held, blocks)), (k + 1) * int(repeats)

    def post(batches):
        _, blocks = plan.value
        for pdf in batches:
            n = pdf["lists"].map(len).to_numpy()
            lists, ids = np.concatenate([*pdf["lists"], np.empty(0, np.int32)]).astype(np.int64), np.repeat(pdf["vec_id"].to_numpy(), n)
            block = (mix64(ids.astype(np.int64).view(np.uint64)) % blocks[lists].astype(np.uint64)).astype(np.int64)
            points = packed(pdf["embedding"]).take(pa.array(np.repeat(np.arange(len(pdf)), n)))
            yield pd.DataFrame({"part": lists << 32 | block, "key": ids, "point": points.to_pylist()})

    def route(batches):
        g, (held, blocks) = shared.value, plan.value
        for pdf in batches:
            pdf = pdf[pdf["embedding"].map(len) == size]
            for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                parts = np.concatenate([j << 32 | np.arange(blocks[j]) for j in visited(g, np.asarray(v), ratio, held, least)])
                point = np.asarray(v, np.float64).tobytes()
                for at in range(0, len(parts), ROUTED):  # a query's own rows, and not those of all queries of a batch, are what is held
                    some = parts[at : at + ROUTED]
                    yield pd.DataFrame({"part": some, "key": i, "point": [point] * len(some)})

    kind = "part long, key long, point binary"
    postings = placed.mapInPandas(post, kind)
    asked = usable(queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).mapInPandas(route, kind)
    found = nearest_in_parts(postings, asked, k * int(repeats), own=False).toDF("query_id", "vec_id", "score")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
