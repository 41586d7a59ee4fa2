r"""Chat formatting with a grammar round trip.

A conversation is its turns in order, a turn is `### role: text</turn>` and a line feed. In roles and texts a backslash before
a control string (`###`, `</turn>`, and `:` in a role) or before another backslash is dropped by the parser and what follows is ordinary text. A turn
is first rendered as it stands and reparsed; only if the parser does not return exactly its role and text, its conflicting
content is escaped, and the comparison repeats until both are identical. Turns are rendered side by side, whatever their conversation;
only the finished strings meet, and each whole conversation is parsed once more and compared with its source turns. The loss mask covers the (escaped) texts of assistant turns.

A null text or role counts as empty. Turns with equal numbers follow role and text; null turn numbers come first; a null
conversation id is a conversation of its own; repeated rows are turns of their own. Extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

CONTROLS = ("###", "</turn>")
LEARNED = "assistant"
FORMATTED = "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss_spans array<struct<first:long,last:long>>"
_ROLE = re.compile(r"\\(?=\\|###|</turn>|:)|###|</turn>|:")
_TEXT = re.compile(r"\\(?=\\|###|</turn>)|###|</turn>")
_UNIT = re.compile(r"\\|###|</turn>|:|[^\\]", re.S)


class Malformed(ValueError):
    """The text is not in the language of the template."""


def escaped(text: str, role: bool = False) -> str:
    return re.sub(r"(\\|###|</turn>|:)" if role else r"(\\|###|</turn>)", r"\\\1", text)


def read(s: str, at: int, role: bool) -> tuple[str, int, int]:
    """Reads to the first control string that is not escaped: (unescaped text, its end, end of the control string)."""
    out, last, pattern = [], at, _ROLE if role else _TEXT
    while m := pattern.search(s, at):
        if m[0] != "\\":
            if m[0] != (":" if role else "</turn>"):
                raise Malformed(f"unexpected {m[0]} at {m.start()}")
            return "".join([*out, s[last : m.start()]]), m.start(), m.end()
        out.append(s[last : m.start()])
        last = m.end()
        at = _UNIT.match(s, last).end()  # what was escaped is text
    raise Malformed("the text ends inside a turn")


def parse(s: str) -> list[tuple[str, str, int, int]]:
    """(role, text, first and end position of the escaped text) of every turn; deterministic, one symbol of look-ahead."""
    out, at = [], 0
    while at < len(s):
        if not s.startswith("### ", at):
            raise Malformed(f"no turn starts at {at}")
        role, _, at = read(s, at + 4, True)
        if s[at : at + 1] != " ":
            raise Malformed(f"no blank after a role at {at}")
        text, end, after = read(s, at + 1, False)
        if s[after : after + 1] != "\n":
            raise Malformed(f"no line feed at {after}")
        out.append((role, text, at + 1, end))
        at = after + 1
    return out


def render(role: str | None, text: str | None) -> str:
    role, text = role or "", text or ""
    for r in (role, escaped(role, True)):
        for t in (text, escaped(text)):
            s = f"### {r}: {t}</turn>\n"
            try:
                back = parse(s)
            except Malformed:
                continue
            if [x[:2] for x in back] == [(role, text)]:
                return s
    raise Malformed("no escaping of the turn reads back")


def format_conversations(rows: DataFrame) -> DataFrame:
    """FORMATTED: one row a conversation, its turns and loss spans read back from the formatted text."""
    prepare(rows.sparkSession)

    def show(batches):
        for b in batches:
            c = [b.column(i).to_pylist() for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(map(render, c[2], c[3]), pa.string())], ["conv_id", "turn", "role", "text", "shown"])

    def back(batches):
        span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        turn = pa.struct([("role", pa.string()), ("text", pa.string())])
        for b in batches:
            parsed = [parse(s) for s in b.column(1).to_pylist()]
            for c, p, said in zip(b.column(0).to_pylist(), parsed, b.column(2).to_pylist(), strict=True):
                if [x[:2] for x in p] != [(x["role"], x["text"]) for x in said]:
                    raise Malformed(f"conversation {c} does not read back")
            turns = [[{"role": r, "text": t} for r, t, _, _ in p] for p in parsed]
            spans = [[{"first": a, "last": z} for r, _, a, z in p if r == LEARNED] for p in parsed]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(turns, pa.list_(turn)), pa.array(spans, pa.list_(span))], ["conv_id", "formatted", "turns", "loss_spans"])

    cast = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    shown = cast.mapInArrow(show, "conv_id long, turn long, role string, text string, shown string")
    turns = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "shown"))).alias("t"))
    said = F.transform("t", lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["shown"]), "").alias("formatted"), said.alias("said")).mapInArrow(back, FORMATTED)


def loss_text(formatted, spans):
    """All text under the loss mask, unescaped: a backslash that the parser drops is dropped here too."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(s, p):
        import pandas as pd

        return pd.Series(["".join(read(x[int(y["first"]) : int(y["last"])] + "</turn>", 0, False)[0] for y in z) for x, z in zip(s, p, strict=True)], dtype=object)

    return text(formatted, spans)
