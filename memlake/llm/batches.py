"""Arrow batches in parts of bounded size, so that what a worker derives from a batch stays small."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def small(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows, at most `rows` of them at once."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
