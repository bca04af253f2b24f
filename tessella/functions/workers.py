"""Python workers that give memory back.

A worker lives on between tasks, and what its allocators keep counts against its executor while other operators run. So large
arrays are mapped one by one, which returns them as they are freed, Arrow takes its buffers from the same allocator, and what
is left free is returned when a part is done.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: glibc's numbers of the options that set the size from which blocks are mapped, and up to which free memory is kept.
_MAP_FROM, _KEEP = -3, -1
#: Bytes for both. A mapped array costs a fault for each of its pages, so work on many arrays of some MB may ask for more.
LARGE = 1 << 18

Batches = Iterator[pa.RecordBatch]


def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library: its allocator's defaults stay
        return None


def frugal(large: int = LARGE) -> None:
    """Sets this process's allocators; a second call with the same size changes nothing."""
    libc = _libc()
    if libc is not None:
        libc.mallopt(_MAP_FROM, large)
        libc.mallopt(_KEEP, large)
    pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


def tidy(run: Callable[[Batches], Batches], large: int = LARGE) -> Callable[[Batches], Batches]:
    """``run`` for a frugal worker that returns its free memory once a part is done; see ``LARGE`` for ``large`` (up to 32 MB)."""

    def wrapped(batches: Batches) -> Batches:
        frugal(large)
        yield from run(batches)
        trim()

    return wrapped
