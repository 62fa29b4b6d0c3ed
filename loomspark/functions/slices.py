"""Arrow functions that hold few rows as Python objects, however many a batch has."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

#: Characters of text after which what was made of it becomes an Arrow array.
SLICE_CHARS = 1 << 19
#: What a row counts for at least.
_ROW_CHARS = 64


def in_slices(make: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """An array of that type with make(values) for each row; the first column is the text that rows are measured by."""
    parts: list[pa.Array] = []
    held: list = []
    size = 0
    for row in zip(*columns):
        values = [x.as_py() for x in row]
        held.append(make(*values))
        size += len(values[0] or "") + _ROW_CHARS
        if size >= SLICE_CHARS:
            parts.append(pa.array(held, kind))
            held, size = [], 0
    return pa.concat_arrays([*parts, pa.array(held, kind)])
