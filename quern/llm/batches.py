"""Arrow batches of documents cut to bounded amounts of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], size: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text in each is about ``size`` bytes (or one row)."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()  # workers are reused; what they hold counts for the executor
