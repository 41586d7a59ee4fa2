"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_ROWS, shared_folder, stored, unstored  # noqa: F401


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the Arrow operators rely on; the checkpoint folder is the session's, on one machine a temporary one if it has none, on a cluster without one an error."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(folds: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo folds, is 0 (a null id counts as the empty text, whose crc32 is 0)."""
    return F.crc32(id_text(col)) % folds == 0


#: Estimates beyond this are the planner's way to say that it does not know.
UNKNOWN = 1 << 55


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size, from its files; measured where there is none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN:
        return size
    texts = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(8))
    return df.agg(F.sum(texts)).first()[0] or 0


def parts_of(df: DataFrame, mb: float, least: int) -> int:
    """In how many parts of about `mb` megabytes a table is dealt: follows the data, not the cluster."""
    return max(least, min(1 << 30, int(input_bytes(df) / (mb * 1e6)) + 1))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise; x is uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, remembered while the number of distinct words stays bounded."""

    def __init__(self, most: int = 400_000):
        import xxhash

        self.digest, self.known, self.most = xxhash.xxh3_64_intdigest, {}, most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known, digest = self.known, self.digest
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def lower_words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def raw_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive entries of h (order matters); empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + m]
    return mix64(out)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 as zstd-compressed, byte-transposed deltas."""
    import zstandard

    d = np.diff(values, prepend=np.uint64(0)) if len(values) else values
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Any fixed-width array as zstd-compressed transposed bytes."""
    import zstandard

    w = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, w).T.tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    w = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(w, -1).T).view(dtype).ravel()


def texts(batch: pa.RecordBatch, name: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def sheltered(docs: DataFrame, work: Callable[[DataFrame], DataFrame], plain: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """What work makes of docs, whose columns but the plain ones have other names meanwhile, so that they clash with nothing; work may add columns, which go."""
    inner = [c if c in plain else f"_column_{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*inner)).select(inner).toDF(*docs.columns)
