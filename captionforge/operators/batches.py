"""Arrow batches in pieces: what a Python worker holds is one batch in Arrow's form and one piece in Python's, whatever the table's size."""

from __future__ import annotations

import ctypes
from collections import namedtuple
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a piece. Batches of Spark's have 10,000, and as many pictures.
ROWS = 128

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, TypeError, OSError):  # other C libraries have none
    _trim = None


def give_back() -> None:
    """Returns memory to the system that nothing uses any more: Spark keeps Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)
        del b
        give_back()


def records(piece: pa.RecordBatch) -> Iterator:
    """The rows of a piece, with columns as attributes, and structs as dictionaries."""
    row = namedtuple("Row", piece.schema.names)
    columns = [c.to_pylist() for c in piece.columns]
    return map(row._make, zip(*columns, strict=True))


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
