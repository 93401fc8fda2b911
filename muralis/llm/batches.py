"""Pieces of Arrow batches, so that what a worker holds follows a few texts and not a whole batch of them."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Rows of a piece of texts.
PIECE = 128


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows; an empty one stays."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def tidy(read: Callable) -> Callable:
    """``read``, a function of batches, that gives memory back to the system when its task ends.

    Spark keeps workers for later tasks, and what freed Arrow buffers and strings leave in each of them adds up on an executor.
    """

    @functools.wraps(read)
    def tidied(batches):
        yield from read(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidied
