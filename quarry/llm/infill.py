r"""Fill-in-the-middle: a text is cut into prefix, middle and suffix between lines and written in another order, from which it can be rebuilt.

Texts are taken as the bytes of an Arrow batch, decomposed into chunks that overlap by one character: the predicate `a line starts here` looks at a
character and the one before it, so each chunk can be judged without the rest. All chunks of a batch are counted at once, lines and code points;
the prefix sums of the counts route both cut ranks of every text to the chunks that own them, and only these are scanned again, for the positions.
Bytes are never decoded: a line feed is one byte in UTF-8, and a code point is a byte that continues none. A batch holds at most 64 MB or one text.

The cuts and the order are drawn from the SHA-256 of seed and doc_id, so they do not depend on how the rows are dealt. A text that is empty or holds a mark
stays plain. A null text counts as empty, a null id as the empty text; repeated rows are cut alike, rows of one id by the same draws, each in its own text. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, prepare

MARKS = ("<P>", "<S>", "<M>")
SEED, FIM_PERCENT, SPM_PERCENT, CHUNK = 7, 100, 50, 1 << 14
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def line_starts(data: np.ndarray, first: int, end: int, whole: int) -> np.ndarray:
    """Which positions of data[first:end] start a line of the text that begins at `whole`; reads one character before them."""
    before = data[max(first - 1, whole) : end - 1] == 10
    return before if first > whole else np.concatenate(([True], before))[: end - first]


class Chunks:
    """The chunks of all texts of a batch, `offsets[k]` to `offsets[k + 1]` being the bytes of text k, and the prefix sums of their lines and code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        self.data, self.offsets = data, offsets
        per = -(-np.diff(offsets) // size)
        self.first_chunk = np.concatenate(([0], np.cumsum(per)))
        self.owner = np.repeat(np.arange(len(per)), per)
        self.at = offsets[self.owner] + (np.arange(len(self.owner)) - self.first_chunk[self.owner]) * size
        starts = np.empty(len(data), bool)
        starts[1:] = data[:-1] == 10
        starts[offsets[:-1][per > 0]] = True
        self.lines, self.points = self.summed(starts), self.summed((data & 0xC0) != 0x80)

    def summed(self, mask: np.ndarray) -> np.ndarray:
        counts = np.add.reduceat(mask, self.at, dtype=np.int64) if len(self.at) else np.empty(0, np.int64)
        return np.concatenate(([0], np.cumsum(counts)))

    def totals(self) -> np.ndarray:
        """Lines of each text."""
        return self.lines[self.first_chunk[1:]] - self.lines[self.first_chunk[:-1]]

    def cut(self, text: int, rank: int) -> tuple[int, int]:
        """(byte, code point) of a text at which `rank` lines end, from the one chunk that owns the line after them."""
        began, end, chunks = int(self.offsets[text]), int(self.offsets[text + 1]), self.first_chunk[text : text + 2]
        wanted = self.lines[chunks[0]] + rank
        if wanted >= self.lines[chunks[1]]:
            return end, int(self.points[chunks[1]] - self.points[chunks[0]])
        chunk = int(np.searchsorted(self.lines, wanted, side="right")) - 1
        first = int(self.at[chunk])
        last = int(self.at[chunk + 1]) if chunk + 1 < chunks[1] else end
        byte = first + int(np.flatnonzero(line_starts(self.data, first, last, began))[wanted - self.lines[chunk]])
        return byte, int(self.points[chunk] - self.points[chunks[0]] + np.count_nonzero((self.data[first:byte] & 0xC0) != 0x80))


def cut_batch(b: pa.RecordBatch, size: int) -> pa.RecordBatch:
    texts, (first, second), plain, spm = b.column(1), (b.column(k).to_numpy() for k in (2, 3)), b.column(4).to_pylist(), b.column(5).to_pylist()
    _, places, body = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(places, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    chunks = Chunks(data, offsets, size)
    n = chunks.totals()
    forms, prefix, middle, out = [], [], [], []
    for k in range(len(texts)):
        whole = data[offsets[k] : offsets[k + 1]]
        if plain[k]:
            forms.append("plain"), prefix.append(None), middle.append(None), out.append(whole.tobytes())
            continue
        (a, points), (z, points_too) = (chunks.cut(k, r) for r in sorted((int(first[k] % (n[k] + 1)), int(second[k] % (n[k] + 1)))))
        p, m, s = data[offsets[k] : a].tobytes(), data[a:z].tobytes(), data[z : offsets[k + 1]].tobytes()
        forms.append("spm" if spm[k] else "psm"), prefix.append(points), middle.append(points_too - points)
        out.append(b"".join((b"<S>", s, b"<P>", p, b"<M>", m) if spm[k] else (b"<P>", p, b"<S>", s, b"<M>", m)))
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], [c.split()[0] for c in CUT.split(", ")])


def cut(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """CUT: one row a document; n counts its lines, prefix_chars and middle_chars code points (null if plain)."""
    prepare(docs.sparkSession)
    text, digest = F.coalesce(F.col("text"), F.lit("")), F.sha2(F.concat(F.lit(f"{seed}:"), id_text()), 256)
    draw = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    plain = (text == "") | text.contains(MARKS[0]) | text.contains(MARKS[1]) | text.contains(MARKS[2]) | (draw[2] % 100 >= fim_percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), draw[0].alias("first"), draw[1].alias("second"), plain.alias("plain"), (draw[3] % 100 < spm_percent).alias("spm"))
    return rows.mapInArrow(lambda batches: (cut_batch(b, chunk) for b in batches), CUT)


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form alone: a text with marks is plain, so the marks of the others are their own."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
