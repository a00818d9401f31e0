"""Memory of Python workers, which stay for other tasks of other queries."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa


def release() -> None:
    """Hand freed memory back to the system, as far as its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; a worker idle after it keeps nothing of what it took."""

    @functools.wraps(run)
    def over(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return over
