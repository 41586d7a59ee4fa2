"""Scalar text functions as Spark columns."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokenizer pattern and stop words.
TOKEN = r"[a-z0-9]+(?:[.\-#]+[a-z0-9]*)*"
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "it", "as", "be", "was", "are",
    "this", "that", "its", "has", "not", "do", "if",
)
SEPARATORS = r"[.\-#]+"
# Labels of file types, sizes of cuts.
TYPE_LABELS = {"pdf": "PDF", "docx": "Word", "doc": "Word", "xlsx": "Excel", "xls": "Excel", "pptx": "PowerPoint", "ppt": "PowerPoint", "txt": "Text", "md": "Markdown", "csv": "CSV"}
TITLE_LENGTH, TITLE_SCAN, SNIPPET, PREVIEW = 48, 16_000, 300, 1_500


def tokens(text: Column) -> Column:
    """Keyword tokens in order: stop words go; tokens with separators also give their parts of over two characters."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS))
    parts = lambda t: F.when(t.rlike(r"[.#\-]"), F.filter(F.split(t, SEPARATORS), lambda p: F.length(p) > 2)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.flatten(F.transform(words, lambda t: F.concat(F.array(t), parts(t)))), F.array().cast("array<string>"))


_TOKENS, _SEPARATORS, _STOP = re.compile(TOKEN), re.compile(SEPARATORS), frozenset(STOP_WORDS)


def token_counts(text: str | None) -> Counter:
    """How often each of the `tokens` of a text is there; each distinct token is looked at once."""
    counts = Counter(_TOKENS.findall((text or "").lower()))
    for t in _STOP & counts.keys():
        del counts[t]
    for t, n in [(t, n) for t, n in counts.items() if not t.isalnum()]:
        for p in _SEPARATORS.split(t):
            if len(p) > 2:
                counts[p] += n
    return counts


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-case extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def cut(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def iso(ts: Column) -> Column:
    """UTC timestamp with a closing Z; a fraction only if there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("."), micros, F.lit("Z")))


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO text with or without Z, null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", ""))


def collapsed(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " "))


def document_title(text: Column, types: list[str]) -> Column:
    """First line near the top that is, white space and case aside, one of the known types; null without one."""
    if not types:
        return F.lit(None).cast("string")
    known = sorted({re.sub(r"\s+", " ", t.strip()).upper() for t in types if t.strip()})
    lines = F.transform(F.split(F.substring(text, 1, TITLE_SCAN), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), collapsed)
    return F.try_element_at(F.filter(lines, lambda x: x.isin(*known)), F.lit(1))


def chat_title(message: Column) -> Column:
    trimmed = F.regexp_replace(message, r"^\s+|\s+$", "")
    first = F.regexp_replace(F.split(trimmed, r"[.\n]", 2)[0], r"^\s+|\s+$", "")
    base = F.when(first == "", trimmed).otherwise(first)
    short = F.when(F.length(base) <= TITLE_LENGTH, base).otherwise(F.concat(F.regexp_replace(F.substring(base, 1, TITLE_LENGTH), r"\s+$", ""), F.lit("…")))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit("New chat")).otherwise(short)


def type_label(ext: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, F.lower(ext)), F.upper(ext))


def normal_type(file_type: Column) -> Column:
    """Lower-case type without a leading dot; unknown if blank."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(file_type)), r"^\.", ""), F.lit("")), F.lit("unknown"))


def listing_preview(status: Column, preview: Column, chunks: Column, name: Column, budget: int) -> Column:
    """Preview of a listing row: a placeholder while only metadata is known, else the text without its page prefix."""
    text = F.regexp_replace(F.coalesce(preview, F.lit("")), r"(?i)^Page \d+:\n?", "")
    shown = F.when((F.trim(text) == "") & (chunks > 0), F.format_string("[%d chunks indexed] %s", chunks, name)).otherwise(F.substring(text, 1, budget))
    return F.when(status == "metadata_only", F.concat(F.lit("[Indexing in progress...] "), name)).otherwise(shown)


def layout_preview(text: Column, n: int = 500) -> Column:
    """Preview that shows slices of the full, left and right regions of page 1 if the text marks them, else its beginning. Each step's value is bound, so that it is made once for a row."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    sizes = {"full": int(n * 0.40), "left": int(n * 0.28)}
    frame = sum(map(len, ("[Page 1]\n[Region: full]\n", "\n[Region: left]\n", "\n[Region: right]\n")))
    sizes["right"] = max(80, min(int(n * 0.32), n - frame - sizes["full"] - sizes["left"]))

    def shown(page: Column, name: str, most: int) -> Column:
        part = lambda rest: strip(F.substring_index(rest, "[Region:", 1))
        slice_ = lambda p: F.when(p != "", F.concat(F.lit(f"[Region: {name}]\n"), F.regexp_replace(F.substring(p, 1, most), r"\s+$", "")))
        return bound(_after(page, f"[Region: {name}]"), lambda rest: bound(part(rest), slice_))

    composed = lambda page: F.regexp_replace(F.substring(strip(F.concat_ws("\n", F.lit("[Page 1]"), *(shown(page, r, k) for r, k in sizes.items()))), 1, n), r"\s+$", "")
    first = lambda t: bound(_after(t, "[Page 1]"), lambda rest: bound(F.substring_index(rest, "\n\n[Page ", 1), composed))
    marked = lambda t: t.contains("[Region:") & t.contains("[Page 1]")
    return bound(text, lambda t: F.when(F.coalesce(t, F.lit("")) == "", F.lit("")).when(marked(t), first(t)).otherwise(strip(F.substring(t, 1, n))))


def bound(value: Column, of) -> Column:
    """of(value), the value being computed once for a row however often it is used."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _after(text: Column, token: str) -> Column:
    """What follows the first token; empty without it."""
    return bound(F.instr(text, token), lambda at: F.when(at > 0, F.substr(text, at + F.lit(len(token)))).otherwise(F.lit("")))


def clean_lines(text: Column, least: int, most: int) -> Column:
    """Question lines of a model's answer: no bullets or quotes, long enough, the first few."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:[-*•]|\d+[.)])\s*", ""), r"^[\"']+|[\"']+$", ""))
    return F.slice(F.filter(bare, lambda x: (F.length(x) > least) & x.contains("?")), 1, most)


def cell_value(value: Column) -> Column:
    """What a typed cell becomes: null, an integer, a number or the text, as (kind, value)."""
    t = F.trim(value)
    pair = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    whole = F.coalesce(t.try_cast("decimal(38,0)").cast("string"), t)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", pair("null", F.lit(None).cast("string"))).when(t.rlike(r"^[+-]?\d+$"), pair("int", whole))
        .when(t.try_cast("double").isNotNull(), pair("float", t.try_cast("double").cast("string"))).otherwise(pair("text", value))
    )


def calendar_date(ts: Column) -> Column:
    """Short English date; every month but May carries a dot."""
    month = F.date_format(ts, "MMM")
    return F.concat(F.when(month == "May", month).otherwise(F.concat(month, F.lit("."))), F.date_format(ts, " d, yyyy"))


def snippet_position(text: Column, snippet: Column) -> Column:
    """1-based place of a snippet: its first 80 characters, else 40, else 20; 0 if none is found."""
    low = F.lower(text)
    at = lambda n: F.nullif(F.position(F.lower(F.substring(snippet, 1, n)), low), F.lit(0))
    return F.coalesce(at(80), at(40), at(20), F.lit(0))


def shown_number(value: Column) -> Column:
    """A sheet's number as shown: whole, or two decimals without closing zeros."""
    return F.when(value == F.floor(value), F.format_string("%d", value.cast("long"))).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value.cast("double")), "0+$", ""), r"\.$", ""))


def tool_result(row: Column, folder_level: Column) -> Column:
    """JSON of a tool's result; results about the whole folder say that they need no citation."""
    hint = "[About the folder as a whole; cite no document.]\n"
    return F.concat(F.when(folder_level, F.lit(hint)).otherwise(F.lit("")), F.to_json(row))
