"""Arrow batches cut by the bytes of a text column, so a task's temporary arrays stay small."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of about ``most`` bytes of ``column``; no row is cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        first, done = 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(first, last - first)
            first, done = last, int(ends[last - 1])


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, giving freed memory back to the system when its task ends.

    Python workers live on between tasks and stages; what their allocators keep adds up beside the executor's heap.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped
