"""Nearest points of many queries, part by part: each query meets the points of the parts that it is sent to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Queries whose distances to a part are held at once, rows of one Arrow batch of results.
TOGETHER, EMITTED = 64, 20_000


def packed(rows: list) -> pa.Array:
    """Vectors as the bytes of their doubles."""
    return pa.array([np.asarray(v, np.float64).tobytes() for v in rows], pa.binary())


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :]))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, term by term."""
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def nearest_in_parts(points: DataFrame, queries: DataFrame, n: int, own: bool) -> DataFrame:
    """query_key, key, score: of each query and part its n nearest points by Euclidean distance, ties to smaller keys; with own also points that have the query's key.

    points and queries: (part long, key, point binary), vectors of one length. A part's points come before its queries in a sorted partition: the points of one part are held, queries pass by a
    few at a time, however many there are.
    """
    key = points.schema["key"].dataType
    lined = points.select("part", F.lit(0).alias("kind"), "key", "point").unionByName(queries.select("part", F.lit(1).alias("kind"), "key", "point"))

    def best(qk, q, keys, x):
        rough, slack = distances(q, x), 1e-6 * (np.abs(q).sum(axis=1).max() + np.abs(x).sum(axis=1).max())  # only to leave out what cannot be among the nearest
        limits = np.partition(rough, n, axis=1)[:, n] + slack if n < len(x) else np.full(len(q), np.inf)
        for i, k in enumerate(qk):
            at = np.flatnonzero(rough[i] <= limits[i])
            for d, j in sorted((d, keys[a]) for d, a in zip(exact(q[i], x[at]).tolist(), at.tolist(), strict=True) if own or keys[a] != k)[:n]:
                yield k, j, d

    def run(batches):
        kind_of, part, points, held, out = to_arrow_type(key), None, [], None, []

        def told(rows):
            qk, k, d = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(qk, kind_of), pa.array(k, kind_of), pa.array(d, pa.float64())], ["query_key", "key", "score"])

        for b in batches:
            parts, kinds, keys, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_pylist()
            edges = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(parts)]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                v = np.frombuffer(b"".join(raw[s:e]), np.float64).reshape(e - s, -1)
                if parts[s] != part:
                    part, points, held = parts[s], [], None
                if kinds[s] == 0:
                    points.append((keys[s:e], v))
                    continue
                if held is None and points:
                    held, points = ([k for ks, _ in points for k in ks], np.concatenate([x for _, x in points])), []
                if held is None:
                    continue
                for i in range(0, e - s, TOGETHER):
                    out += best(keys[s + i : min(e, s + i + TOGETHER)], v[i : i + TOGETHER], *held)
                    if len(out) >= EMITTED:
                        yield told(out)
                        out = []
        yield told(out)

    schema = T.StructType([T.StructField("query_key", key), T.StructField("key", key), T.StructField("score", T.DoubleType())])
    return lined.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, schema)
