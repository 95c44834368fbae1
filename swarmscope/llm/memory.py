"""Memory that Python workers hold between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not the GNU C library

    def _trim(_: int) -> int:
        return 0


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and an allocator keeps what it once had."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that gives memory back after each of its results and as it ends."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        for made in task(batches):
            yield made
            del made
            give_back()
        give_back()

    return run


def lean_group(task: Callable) -> Callable:
    """The same of a function of one group's rows."""

    def run(rows):
        try:
            return task(rows)
        finally:
            give_back()

    return run


def lean_key(task: Callable) -> Callable:
    """The same of a function of a key and its group's rows."""

    def run(key, rows):
        try:
            return task(key, rows)
        finally:
            give_back()

    return run


def lean_pair(task: Callable) -> Callable:
    """The same of a function of a key and two groups' rows."""

    def run(key, left, right):
        try:
            return task(key, left, right)
        finally:
            give_back()

    return run
