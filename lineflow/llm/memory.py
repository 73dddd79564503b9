"""Memory of Python workers, which Spark keeps for later stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system. Allocators keep the most they ever held, and a worker
    that has had one large batch would otherwise keep it through all later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function from batches to batches, in a worker that holds no more than it needs
    before and after."""

    def wrapped(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
