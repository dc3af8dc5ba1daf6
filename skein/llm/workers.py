"""Memory of the Python workers that Spark keeps between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    # another C library: its own rules stand
    _trim = None


def give_back() -> None:
    """Freed memory goes to the system. A worker outlives its task, and what it holds counts for the executor while the next
    stage, or another worker, needs the room."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back when a task is done."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
