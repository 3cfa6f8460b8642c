"""What functions that run in tasks leave behind in their worker process.

Spark reuses Python workers from task to task and from stage to stage, so what one stage remembers
would still be held while the next ones run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Tables that only save work inside a task; each module that has one puts it here.
REMEMBERED: list[dict] = []

Batches = Iterator[pa.RecordBatch]

#: glibc keeps what was freed between other blocks unless it is asked for it; other C libraries have no such call.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    for table in REMEMBERED:
        table.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function on batches, which gives memory back when its task ends."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from function(batches)
        finally:
            release()

    return whole
