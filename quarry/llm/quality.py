"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts only. Trees are grown on the driver from a bounded sample of labelled rows (`max_rows`,
the smallest by a hash of the id, so it does not depend on partitioning), as complete binary trees of fixed depth whose
splits and leaves lie in flat arrays; scoring walks all trees for a batch of documents at once with numpy.

A null or empty text has all statistics 0 and gets the score of such a row. Labels of ids without a document, null labels
and null ids are not learned from; an id labelled twice counts once (the larger label). With no usable label every score
is `prior`. Repeated rows get equal scores; extra columns are ignored by `score`, kept by `keep_good`.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, prepare

STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_words", "adjacent_repeats", "top_word", "upper", "digits", "punctuation", "symbols",
    "marks", "pipes", "lines", "line_length", "repeated_lines", "short_words", "symbol_ends", "distinct_pairs", "title_words", "longest_word", "sentence_ends",
)
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
PUNCTUATION, SYMBOLS = b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{}~|"
MAX_ROWS, FOLDS, THRESHOLD = 20_000, 5, 0.3


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda drop, of=raw: (len(of) - len(of.translate(None, drop))) / size
    letters = len(text)
    return [
        float(np.log1p(letters)), float(np.log1p(n)), (size - raw.count(b" ")) / n, len(counts) / n, sum(map(bytes.__eq__, words, words[1:])) / n, max(counts.values()) / n,
        sum(map(str.isupper, text)) / letters, share(DIGITS), share(PUNCTUATION), share(SYMBOLS), raw.count(b"!!") / n, raw.count(b" | ") / n,
        len(lines) / n, float(np.log1p(size / len(lines))), 1 - len(set(lines)) / len(lines), sum(len(w) < 4 for w in words) / n,
        sum(w[-1] in SYMBOLS for w in words) / n, len(set(zip(words, words[1:], strict=False))) / n, sum(w[:1].isupper() for w in words) / n, float(np.log1p(max(map(len, words)))), raw.count(b".") / n,
    ]


class Forest:
    """Complete trees of one depth: feature and threshold of inner node k of tree t at [t, k], its children 2k+1 and 2k+2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, start: float):
        self.feature, self.threshold, self.leaf, self.start = feature, threshold, leaf, start

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if len(self.feature):
            depth, inner = int(np.log2(self.leaf.shape[1])), self.feature.shape[1]
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
            at = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
            total += self.leaf[trees, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, prior: float = 0.5) -> Forest:
    """Second-order boosting of the logistic loss on quantile histograms."""
    inner = 2**depth - 1
    if len(y) == 0:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(prior / (1 - prior))))
    p = float(np.clip(y.mean(), 0.01, 0.99))
    start = np.log(p / (1 - p))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, feature, threshold, leaf = np.full(len(y), start), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, where = np.full(width, 1e-6), np.full((width, 2), -1)
            local = at - first
            for f in range(x.shape[1]):
                m = len(edges[f]) + 1
                if m < 2:
                    continue
                key = local * m + binned[:, f]
                gs = np.bincount(key, g, width * m).reshape(width, m).cumsum(axis=1)
                hs = np.bincount(key, h, width * m).reshape(width, m).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                k = gain[:, :-1].argmax(axis=1)
                better = gain[np.arange(width), k] > best
                best[better] = gain[np.arange(width), k][better]
                where[better] = np.stack([np.full(width, f), k], axis=1)[better]
            split = where[:, 0] >= 0
            feature[t, first : first + width][split] = where[split, 0]
            threshold[t, first : first + width][split] = [edges[f][k] for f, k in where[split]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        gl, hl = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaf[t] = -rate * gl / (hl + l2)
        margin += leaf[t][at - inner]
    return Forest(feature, threshold, leaf, float(start))


def sampled_labels(labels: DataFrame, column: str, max_rows: int, folds: int) -> DataFrame:
    """At most max_rows labelled ids outside the held-out fold: those with the smallest hashes."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(folds))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(column) > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = FOLDS) -> Forest:
    """Grows the trees from a bounded sample; only its statistics (under 200 bytes a row) reach the driver."""
    prepare(docs.sparkSession)
    sample = sampled_labels(labels, "quality", max_rows, folds)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(0).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
        .select("text", "label").mapInArrow(run, "label int, x array<double>").toPandas()
    )
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(STATISTICS))
    order = np.lexsort([*x.T, rows["label"]]) if len(x) else []  # the same trees whatever the order of arrival
    return fit(x[order], rows["label"].to_numpy(float)[order]) if len(x) else fit(x, np.zeros(0))


def score(docs: DataFrame, forest: Forest, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics of every document, in the pass over the documents."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
            s = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "held_out", "score", "predicted", "statistics"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(folds).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, statistics array<double>")


def keep_good(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(shared.value.scores(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
