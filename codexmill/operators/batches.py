"""Arrow batches cut so that texts of any length leave the memory of a task bounded."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_BYTES = 8 << 20


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches whose texts have at most ``most`` bytes together, or one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(size) or size[-1] <= most:
            yield batch
            continue
        at = 0
        while at < len(size):
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end
