"""Arrow batches in slices of bounded size: what a Python task holds follows the slice, not the batch, whose rows Spark counts without regard to their lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: bytes of text that a slice has at most; a longer text stands alone.
TEXT_BYTES = 1 << 20


def by_bytes(batch: pa.RecordBatch, column: int = -1, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in slices whose texts (a string or binary column) together have at most `most` bytes. An empty batch has none."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column % batch.num_columns)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def by_rows(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in slices of at most so many."""
    for lo in range(0, batch.num_rows, max(1, most)):
        yield batch.slice(lo, max(1, most))
