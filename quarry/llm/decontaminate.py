"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window.

Words are maximal runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. A test item gives one
window for each `n` consecutive words, or one window of all its words if it has fewer. The windows' hashes are broadcast
(the test set is small by nature; a larger one is taken in bounded parts, one pass over the documents for each, and only one
part is held at a time, in flat arrays of some 30 bytes a word; an item that is longer than a part goes in pieces that share n - 1 words), each hash hit is verified word by word, and the covered words become spans.

Null or empty texts have no words and are clean; repeated rows are judged each by itself; an empty benchmark leaves every
document clean. Items without an id count like any other: their windows hit words, and all of them together are one item, which stands as
a null at the end of `items`. Repeated item ids are one item with the windows of all its texts. Very long texts are scanned like others; extra columns
are kept by `decontaminate` and ignored by `find_hits`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, prepare, sheltered, stored, unstored

#: Everything but a-z, 0-9 and bytes over 0x7F becomes a blank, A-Z become a-z.
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Most bytes of benchmark text in one broadcast, bytes whose words are objects at once, bits of a word's hash that mark it as known.
PART_BYTES, SLICE, MARK = 16 << 20, 1 << 20, np.uint64((1 << 20) - 1)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def hashed(flat: bytes, hasher: WordHasher) -> np.ndarray:
    """Hashes of the words of blanked text, a slice at a time, so that only a slice's words are objects at once."""
    out, at = [], 0
    while at < len(flat):
        end = flat.find(b" ", at + SLICE)
        end = len(flat) if end < 0 else end
        out.append(hasher(flat[at:end].split()))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


@dataclass
class Windows:
    """All distinct windows of one length, sorted by hash: the number of their first word, and in owners[at[k]:at[k + 1]] the items that have window k."""

    hashes: np.ndarray
    first: np.ndarray
    at: np.ndarray
    owners: np.ndarray


@dataclass
class Compiled:
    """A part of the test set in flat arrays: its blanked text, where its words begin, its windows by length, and a table of 2^20 marks that passes over words it cannot have."""

    flat: bytes
    starts: np.ndarray
    items: list
    lengths: dict[int, Windows]
    marks: np.ndarray

    def window(self, first: int, n: int) -> list[bytes]:
        end = int(self.starts[first + n]) if first + n < len(self.starts) else len(self.flat)
        return self.flat[int(self.starts[first]) : end].split()


def compile_items(rows: list[tuple], n: int) -> Compiled:
    """The windows of some items (id, text). Memory is some 30 bytes a word, whatever the words are."""
    flats, hashes, hasher, numbers = [], [], WordHasher(), {}
    item_of, words_of = [], []
    for item, text in rows:
        flat = (text or "").encode("utf-8", "surrogatepass").translate(TABLE) + b" "
        h = hashed(flat, hasher)
        if len(h):
            flats.append(flat)
            hashes.append(h)
            item_of.append(numbers.setdefault(None if item is None else str(item), len(numbers)))
            words_of.append(len(h))
    flat, h = b"".join(flats), np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    blank = np.frombuffer(flat, np.uint8) == 32
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))).astype(np.int64 if len(flat) >> 31 else np.int32) if flat else np.empty(0, np.int32)
    marks = np.zeros(1 << 20, bool)
    marks[(h & MARK).astype(np.int64)] = True
    out, counts = Compiled(flat, starts, list(numbers), {}, marks), np.array(words_of, np.int64)
    begin, owner = np.concatenate(([0], np.cumsum(counts)))[:-1], np.array(item_of, np.int32)
    for k in {min(c, n) for c in words_of}:
        mine = np.flatnonzero(counts >= n if k == n else counts == k)
        per = np.maximum(counts[mine] - n, 0) + 1
        first = (np.repeat(begin[mine] - np.concatenate(([0], np.cumsum(per)[:-1])), per) + np.arange(per.sum())).astype(np.int32 if len(h) < 1 << 31 else np.int64)
        out.lengths[k] = distinct_windows(out, window_hashes(h, k)[first], first, np.repeat(owner[mine], per), k)
    return out


def distinct_windows(part: Compiled, hashes: np.ndarray, first: np.ndarray, owners: np.ndarray, k: int) -> Windows:
    """Equal windows become one with all their items; windows of one hash are told apart by their words."""
    order = np.lexsort((owners, hashes))
    hashes, first, owners = hashes[order], first[order], owners[order]
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    edges = np.append(np.flatnonzero(new), len(hashes))
    for a, z in zip(edges[:-1][np.diff(edges) > 1], edges[1:][np.diff(edges) > 1], strict=True):  # hashes that occur more than once
        kinds: dict[tuple, list[int]] = {}
        for i in range(a, z):
            kinds.setdefault(tuple(part.window(int(first[i]), k)), []).append(i)
        if len(kinds) > 1:
            sorted_run = [i for run in kinds.values() for i in run]
            first[a:z], owners[a:z] = first[sorted_run], owners[sorted_run]
            new[a + np.cumsum([len(run) for run in kinds.values()])[:-1]] = True
    same = ~new & np.concatenate(([False], owners[1:] == owners[:-1]))  # one item that has the window twice
    hashes, first, owners, new = hashes[~same], first[~same], owners[~same], new[~same]
    at = np.flatnonzero(new)
    return Windows(hashes[at], first[at], np.append(at, len(hashes)), owners)


def in_order(items: set) -> list:
    """Ids as strings in order, the missing one last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words from the words' hashes."""
    m = len(hashes) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for k in range(n if m > 0 else 0):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + m]
    return out


def scan(doc: list[bytes], part: Compiled, hasher: WordHasher) -> tuple[np.ndarray, set]:
    """(mask of covered words, items with a window in the document)."""
    mask, found = np.zeros(len(doc), bool), set()
    if not part.lengths or not doc:
        return mask, found
    h = hasher(doc)
    known = np.concatenate(([0], np.cumsum(part.marks[(h & MARK).astype(np.int64)])))
    for n, windows in part.lengths.items():
        if len(doc) < n:
            continue
        starts = np.flatnonzero(known[n:] - known[:-n] == n)  # only words of the test set can make a window of it
        if not len(starts):
            continue
        w = np.zeros(len(starts), np.uint64)
        for k in range(n):
            w = w * np.uint64(0x9E3779B97F4A7C15) + h[starts + k]
        at = np.searchsorted(windows.hashes, w)
        for i in np.flatnonzero(windows.hashes[np.minimum(at, len(windows.hashes) - 1)] == w):
            s, k = int(starts[i]), int(at[i])
            while k < len(windows.hashes) and windows.hashes[k] == w[i]:
                if part.window(int(windows.first[k]), n) == doc[s : s + n]:
                    mask[s : s + n] = True
                    found.add((n, k))
                    break
                k += 1
    items = {i for n, k in found for i in part.lengths[n].owners[part.lengths[n].at[k] : part.lengths[n].at[k + 1]].tolist()}
    return mask, {part.items[i] for i in items}


def pieces(rows: list[tuple], n: int, most: int) -> Iterator[list[tuple]]:
    """A part as it is, or, if it is one item that is too long for a part, pieces of that item that share n - 1 words, so that each of its windows is in one piece."""
    if len(rows) != 1 or len(rows[0][1] or "") <= most:
        yield rows
        return
    (item, text), at, carry, first = rows[0], 0, [], True
    flat = text.encode("utf-8", "surrogatepass").translate(TABLE)
    while at < len(flat):
        end = flat.find(b" ", at + most)
        end = len(flat) if end < 0 else end
        piece = b" ".join([*carry, flat[at:end]])
        at = end
        if len(piece.split(None, n)) < n and at < len(flat):  # too few words for a window of the item
            carry = piece.split()
            continue
        if first or len(piece.split(None, n)) >= n:
            yield [(item, piece.decode("utf-8", "surrogatepass"))]
        first, carry = False, piece.rsplit(None, n - 1)[1:] if n > 1 else []


def parts(benchmark: DataFrame, most: int = PART_BYTES) -> Iterator[list[tuple]]:
    """The test set in parts of bounded bytes, at least one; it is read part by part through a local iterator."""
    out, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len((r.text or "").encode("utf-8", "surrogatepass"))
        if size + n > most and out:
            yield out
            out, size = [], 0
        out.append((r.item_id, r.text))
        size += n
    yield out


def spans_of(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"first": int(a), "last": int(z) - 1} for a, z in zip(edges[::2], edges[1::2], strict=True)]


def mask_of(spans: list[dict], n: int) -> np.ndarray:
    mask = np.zeros(n, bool)
    for s in spans:
        mask[s["first"] : s["last"] + 1] = True
    return mask


def scanned(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """docs with _n_words, _items and _spans: a pass for each part of the test set adds its hits to those of the parts before.

    All passes but the last are written before the next part is compiled; then their broadcast and what the pass before wrote are removed.
    """
    spark = prepare(docs.sparkSession)
    pair = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    out = docs.select("*", F.lit(0).cast("long").alias("_n_words"), F.array().cast("array<string>").alias("_items"), F.array().cast("array<struct<first:int,last:int>>").alias("_spans"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])

    def run_with(shared):
        def run(batches):
            hasher = WordHasher()
            for b in batches:
                of = b.schema.get_field_index
                n_words, items, spans = [], [], []
                for text, i, s in zip(*(b.column(of(c)).to_pylist() for c in ("text", "_items", "_spans")), strict=True):
                    w = words(text)
                    mask, found = scan(w, shared.value, hasher)
                    n_words.append(len(w))
                    items.append(in_order(found.union(i)))
                    spans.append(spans_of(mask | mask_of(s, len(w))))
                columns = dict(zip(b.schema.names, b.columns, strict=True)) | {"_n_words": pa.array(n_words, pa.int64()), "_items": pa.array(items, pa.list_(pa.string())), "_spans": pa.array(spans, pair)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        return run

    last, written = None, None
    for part in (piece for part in parts(benchmark) for piece in pieces(part, n, PART_BYTES)):
        if last is not None:
            kept = stored(out, "scanned")
            last.destroy()
            if written is not None:
                unstored(written)
            out = written = kept
        last = spark.sparkContext.broadcast(compile_items(part, n))
        out = out.mapInArrow(run_with(last), schema)
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row a document (doc_id, n_words, n_hit, items, spans, contaminated): counts, matched items and covered word spans."""
    out = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, n)
    covered = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), covered.alias("n_hit"), F.col("_items").alias("items"), F.col("_spans").alias("spans"), (F.size("_spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """docs without the contaminated documents, or (remove="spans") with the covered words cut out of their texts.

    Works in passes over the documents themselves, so nothing is shuffled; all columns are kept.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove}")
    return sheltered(docs, lambda inner: _decontaminate(inner, benchmark, n, remove))


def _decontaminate(docs: DataFrame, benchmark: DataFrame, n: int, remove: str) -> DataFrame:
    out = scanned(docs, benchmark, n)
    if remove == "documents":
        return out.filter(F.size("_spans") == 0).select(docs.columns)

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("text")
            texts = [cut(t, mask_of(s, m)) if s else t for t, s, m in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "_spans", "_n_words")), strict=True)]
            b = b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))
            yield b.select(b.schema.names[:-3])

    return out.mapInArrow(run, docs.schema)


def cut(text: str, mask: np.ndarray) -> str:
    """text without the characters of the words under the mask; what stands between words stays."""
    raw, out, last = text.encode("utf-8", "surrogatepass"), [], 0
    flat = raw.translate(TABLE)
    at = 0
    for i, w in enumerate(flat.split()):
        at = flat.index(w, at)
        if mask[i]:
            out.append(raw[last:at])
            last = at + len(w)
        at += len(w)
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")
