"""Rows that tasks make in Python, as Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

from ..session import BATCH_BYTES, BATCH_ROWS


def gathered(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """rows as batches; one ends with the row that fills BATCH_ROWS or most bytes as size counts them, so a task holds little more than its longest row, whatever a file expands to."""
    made: list[tuple] = []
    held = 0
    for r in rows:
        made.append(r)
        held += size(r)
        if len(made) >= BATCH_ROWS or held >= most:
            yield batch(made, schema)
            made, held = [], 0
    if made:
        yield batch(made, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def each(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, each copied into Python when its turn comes."""
    return (tuple(v.as_py() for v in r) for r in zip(*b.columns, strict=True))
