"""What the operators share: tables in the shared folder, and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

from ..session import collecting, remove, shared_dir, shared_path, shuffle_width, written

__all__ = ["collecting", "remove", "row_hash_order", "shared_dir", "shared_path", "shuffle_width", "slices", "strings", "tidy", "utf8", "written"]


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Kernel) -> Kernel:
    """``run``, after which its worker gives back what it held: workers live on, and what they keep adds up over stages."""

    @wraps(run)
    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return to_the_end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    if column.type != wide:
        column = column.cast(pa.large_string()).cast(wide) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose ``column`` holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def strings(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column over UTF-8 bytes and n+1 offsets, without copying."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(body))


def row_hash_order(width: int) -> int:
    """Buckets to deal rows into, a few for each task so that hashing evens them out."""
    return max(1, 4 * width)
