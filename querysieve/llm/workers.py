"""Memory of Python workers, which Spark uses again for the tasks of other operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa


def _give_back() -> None:
    """Freed memory goes back to the system where its allocators can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(function: Callable, *forget: Callable[[], None]) -> Callable:
    """``function`` for ``mapInArrow``; when a task ends its caches go and freed memory is given back."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            for clear in forget:
                clear()
            _give_back()

    return run
