"""Parts of Arrow batches by the size of their texts, so that what Python holds does not grow with the batches Spark sends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are Python strings at once, but for a single longer text.
TEXT_BYTES = 2 << 20


def runs(sizes: np.ndarray, most: int, most_rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Places (a, b) of consecutive rows with sizes of at most ``most`` together and at most ``most_rows``; a larger row is alone."""
    behind, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(behind, (behind[a - 1] if a else 0) + most, side="right")))
        if most_rows is not None:
            b = min(b, a + most_rows)
        yield a, b
        a = b


def text_parts(batch: pa.RecordBatch, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``TEXT_BYTES`` in its text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in runs(sizes, TEXT_BYTES):
        yield batch.slice(a, b - a)
