"""Prose and spreadsheet chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import each, gathered
from ..functions.text import basename
from ..schemas import CHUNKS
from ..session import stored

# Sizes in tokens, letters of a token, markers, rows of a sheet chunk.
CHUNK, OVERLAP, MOST_TOKENS, LETTERS = 300, 50, 512, 4
REGION, PAGE = r"\[Region: [^\]]*\]\n?", r"\[Page (\d+)\]"
SHEET_ROWS, SHEET_PREVIEW = 20, 500


class Boundaries:
    """Where a text may be split, found once: places of sentence ends, blank lines and white space."""

    def __init__(self, text: str):
        marks = (m.start() for m in re.finditer(r"[!?](?=\s)|\.(?= *(?:\Z|[^ ]))", text, re.S))
        self.sentences = [i for i in marks if text[i] != "." or self._starts_sentence(text, i + 1)]
        self.blank_lines = [m.start() for m in re.finditer(r"\n(?=\n|\Z)", text)]
        self.spaces = [m.start() for m in re.finditer(r"\s", text)]

    @staticmethod
    def _starts_sentence(text: str, at: int) -> bool:
        rest = re.compile(" *").match(text, at).end()
        return rest == len(text) or text[rest].isupper()

    def split(self, start: int, end: int) -> int:
        """End of the chunk that starts at start and may reach end."""
        span = end - start
        for places, share in ((self.sentences, 10), (self.blank_lines, 5), (self.spaces, 20)):
            k = bisect_right(places, end - 1)
            if k and places[k - 1] > max(end - max(1, span // share), start):
                return places[k - 1] + 1
        return end


def pages(text: str) -> list[tuple[int, int]]:
    return [(m.start(), int(m[1])) for m in re.finditer(PAGE, text)]


def page_at(marks: list[tuple[int, int]], at: int) -> int | None:
    k = bisect_right(marks, (at, 1 << 62))
    return marks[k - 1][1] if k else None


#: Of a text, where each of its tokens ends, in letters and without special tokens.
Tokenizer = Callable[[str], Sequence[int]]


def trimmed(text: str, tokenizer: Tokenizer, most: int) -> str:
    """The beginning of text that has at most most tokens, in the text's own letters. A word that is cut may have other tokens than before, so what is left is counted again."""
    while len(ends := tokenizer(text)) > most:
        text = text[: min(ends[most - 1], len(text) - 1)].rstrip() if most > 0 else ""
    return text


def tokenizer_file(path: str) -> Callable[[], Tokenizer]:
    """Loader of a tokenizer file: the caller reads it once, and each task that chunks builds its own from what was read."""
    with open(path, encoding="utf-8") as f:
        content = f.read()

    def load() -> Tokenizer:
        import tokenizers

        t = tokenizers.Tokenizer.from_str(content)
        t.no_truncation()
        t.no_padding()
        return lambda text: [end for _, end in t.encode(text, add_special_tokens=False).offsets]

    return load


def prose(text: str | None, size: int = CHUNK * LETTERS, overlap: int = OVERLAP * LETTERS, tokenizer: Tokenizer | None = None, most: int = MOST_TOKENS) -> list[tuple]:
    """(chunk_id, text, start_pos, end_pos, page_number, total_chunks) of one text; null and blank texts have none.

    A chunk has at most most tokens, two of which are kept for special ones; without a tokenizer four letters count as one. What is cut off a chunk is lost to it, as in the
    application, unless the next chunk's overlap has it; a tokenizer's failure fails the task. end_pos is start_pos and the length of the chunk's text.
    """
    if overlap * 5 >= size * 4:
        raise ValueError("the overlap must stay under four fifths of the size")
    text = re.sub(REGION, "", text or "")
    marks, out, start = pages(text), [], 0
    places = Boundaries(text) if len(text) > size else None
    while start < len(text):
        end = len(text) if start + size >= len(text) else places.split(start, start + size)
        chunk = text[start:end].strip()
        if tokenizer:
            chunk = trimmed(chunk, tokenizer, most - 2)
        elif len(chunk) // LETTERS > most:
            chunk = chunk[: (most - 2) * LETTERS].rstrip()
        if chunk:
            out.append((len(out), chunk, start, start + len(chunk), page_at(marks, start)))
        if places is None or end - overlap >= len(text) - overlap:
            break
        start = end - overlap
    return [(*c, len(out)) for c in out]


def prose_chunks(docs: DataFrame, size: int = CHUNK * LETTERS, overlap: int = OVERLAP * LETTERS, tokenizer: Callable[[], Tokenizer] | None = None, most: int = MOST_TOKENS) -> DataFrame:
    """CHUNKS of (file_path, text); each text is sequential, texts are independent, so nothing is shuffled. tokenizer makes one, once a task."""

    def run(batches):
        names = ["file_path", "chunk_id", "text", "start_pos", "end_pos", "page_number", "total_chunks"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        tokens, schema = tokenizer() if tokenizer else None, pa.schema(list(zip(names, kinds, strict=True)))
        for b in batches:
            yield from gathered(((p, *c) for p, t in each(b) for c in prose(t, size, overlap, tokens, most)), schema, lambda r: len(r[2]))

    return docs.select("file_path", "text").mapInArrow(run, CHUNKS)


def register_prose_chunks(spark: SparkSession, name: str = "prose_chunks", tokenizer: Callable[[], Tokenizer] | None = None) -> None:
    """Makes the chunker a table function of SQL: `SELECT d.file_path, c.* FROM d, LATERAL prose_chunks(d.text) c`, or `prose_chunks(d.text, size, overlap)` in letters."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_id int, text string, start_pos int, end_pos int, page_number int, total_chunks int")
    class ProseChunks:
        def __init__(self):
            self.tokens = tokenizer() if tokenizer else None

        def eval(self, text, size=CHUNK * LETTERS, overlap=OVERLAP * LETTERS):
            yield from prose(text, size, overlap, self.tokens)

    spark.udtf.register(name, ProseChunks)


def with_keys(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_key", F.concat("file_path", F.lit(":"), F.col("chunk_id").cast("string")))


def page_marks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos from 0, page) of every page mark in the text of each key: a running sum over the lengths of what lies between marks, so the work grows with their number."""
    between = F.transform(F.split(text, r"\[Page \d+\]"), F.length)
    zipped = F.arrays_zip(between.alias("length"), F.regexp_extract_all(text, F.lit(PAGE), F.lit(1)).alias("number"))
    each = texts.select(key, F.posexplode(zipped).alias("i", "m")).select(key, "i", F.col("m.length").alias("length"), F.col("m.number").alias("number")).filter("number is not null")
    mark = F.length("number") + 7
    pos = F.sum(F.col("length") + mark).over(Window.partitionBy(key).orderBy("i")) - mark
    return each.select(key, pos.cast("int").alias("pos"), F.col("number").cast("int").alias("page"))


def pages_at(marks: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """places (key, pos, any other columns) with the page of each: that of the last mark of the key that is not behind it, null before the first.

    An as-of join as one sort: marks and places of a key are lined up by position, and every place takes the last page seen. Equal places stay apart.
    """
    others = [c for c in places.columns if c not in (key, "pos")]
    lined = places.select(key, "pos", F.struct(F.lit(1).alias("_"), *others).alias("place"), F.lit(None).cast("int").alias("page")).unionByName(marks.select(key, "pos", "page"), allowMissingColumns=True)
    seen = Window.partitionBy(key).orderBy("pos", F.col("place").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return lined.withColumn("page", F.last("page", ignorenulls=True).over(seen)).filter("place is not null").select(key, "pos", *(f"place.{c}" for c in others), "page")


def sheet_chunks(rows: DataFrame, rows_per_chunk: int = SHEET_ROWS) -> DataFrame:
    """CHUNKS of sheet rows (file_path, sheet, row_no, cells): groups of rows under the sheet's first non-blank row as header.

    A sheet may be larger than a task: rows are sorted by range over all tasks, and a row's number in its sheet is its place in its task's span of the sheet and the lengths of the spans
    before it. Windows see spans and sheets only. The sorted rows are stored in the shared folder, since their places must not change between jobs; rows is read twice.
    """
    trimmed = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    filled = rows.select("file_path", "sheet", "row_no", trimmed.alias("c")).filter(F.exists("c", lambda x: x != ""))
    last = F.size("c") - F.coalesce(F.array_position(F.reverse(F.transform("c", lambda x: x != "")), True), F.lit(1)).cast("int") + 1
    lines = filled.select("file_path", "sheet", "row_no", F.array_join(F.slice("c", F.lit(1), last), " | ").alias("line"))
    order = ("file_path", "sheet", "row_no")
    placed = stored(lines.repartitionByRange(*order).sortWithinPartitions(*order).select("file_path", "sheet", "line", F.monotonically_increasing_id().alias("at")), "sheet-rows")
    placed = placed.withColumn("part", F.shiftrightunsigned("at", 33))  # the task; rows of one have consecutive places

    of_sheet, of_file = Window.partitionBy("file_path", "sheet"), Window.partitionBy("file_path")
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = placed.groupBy("part", "file_path", "sheet").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    spans = stored(spans.withColumn("before", sum_before("n", of_sheet.orderBy("part"))).withColumn("rows", F.sum("n").over(of_sheet)).withColumn("head", F.min("start").over(of_sheet)), "sheet-spans")
    sheets = spans.filter("start = head").withColumn("chunks", F.floor((F.col("rows") - 2 + rows_per_chunk) / rows_per_chunk))
    sheets = sheets.withColumn("earlier", sum_before("chunks", of_file.orderBy("sheet"))).withColumn("total_chunks", F.sum("chunks").over(of_file)).select("file_path", "sheet", "head", "earlier", "total_chunks")
    sheets = stored(sheets.join(placed.select(F.col("at").alias("head"), F.col("line").alias("header")), "head"), "sheets")

    same = (placed["part"] == spans["part"]) & placed["file_path"].eqNullSafe(spans["file_path"]) & placed["sheet"].eqNullSafe(spans["sheet"])
    body = placed.join(spans, same).select("head", (F.col("at") - F.col("start") + F.col("before") - 1).alias("k"), "line").filter("k >= 0").withColumn("g", F.floor(F.col("k") / rows_per_chunk))
    groups = body.groupBy("head", "g").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("r"))  # at most rows_per_chunk rows
    first, final = F.col("g") * rows_per_chunk + 1, F.col("g") * rows_per_chunk + F.size("r")
    title = F.format_string("[File: %s | Sheet: %s | Rows: %d-%d]", basename(F.col("file_path")), F.col("sheet"), first, final)
    numbered = F.transform("r", lambda x: F.concat(F.lit("Row "), (x["k"] + 1).cast("string"), F.lit(": "), x["line"]))
    text = F.array_join(F.concat(F.array(title, F.concat(F.lit("Headers: "), "header")), numbered), "\n")
    out = groups.join(sheets, "head").select("file_path", (F.col("earlier") + F.col("g")).cast("int").alias("chunk_id"), text.alias("text"), F.col("total_chunks").cast("int").alias("total_chunks"))
    return out.select("file_path", "chunk_id", "text", F.lit(0).alias("start_pos"), F.length("text").alias("end_pos"), F.lit(None).cast("int").alias("page_number"), "total_chunks")
