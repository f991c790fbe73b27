"""Giving memory back between the tasks of a Python worker, which Spark reuses for all stages of a job."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa


def give_back() -> None:
    """Return what the allocators hold but no longer use to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def frugal(work):
    """A function over batches that gives its memory back when a task ends."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
