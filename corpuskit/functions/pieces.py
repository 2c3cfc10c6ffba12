"""Arrow columns of texts in pieces of bounded size, for functions that work on Python strings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text and rows of a piece. Spark's batches hold up to 64 MB, of which every string would be an object at once.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 2_000


def in_pieces(fn: Callable[..., pa.Array], kind: pa.DataType, *columns: pa.Array, size: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> pa.Array:
    """``fn`` of Python lists, one per column, applied to runs of rows; a longer text is a run of its own."""
    ends = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns).cumsum()
    start, found = 0, [pa.array([], kind)]
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = int(np.searchsorted(ends, before + size, "right"))
        end = max(start + 1, min(end, start + rows))
        found.append(fn(*[c.slice(start, end - start).to_pylist() for c in columns]).cast(kind))
        start = end
    return pa.concat_arrays(found)
