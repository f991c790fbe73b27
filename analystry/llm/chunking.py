"""Content-defined chunks: cuts where a gear rolling hash of the last 32 bytes has zero bits under a mask."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def gear_table() -> np.ndarray:
    return np.random.default_rng(1).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of gear[byte k back] << k over the last 32 bytes (the shift register is 32 bits wide)."""
    state = gear_table()[data]
    span = 1
    while span < 32:
        state[span:] = state[span:] + (state[:-span] << np.uint32(span))
        span *= 2
    return state


def chunk_bounds(data: bytes, least: int, bits: int, most: int) -> list[int]:
    """Ends of the chunks of `data`, in order; each is `least` to `most` bytes, but for a shorter last one.

    A chunk ends behind the first byte, `least` or more from its start, whose hash has `bits` zero top bits, and at `most`
    bytes if there is none. The cut depends on the bytes before it only, so an insertion moves the cuts next to it and no others.
    Empty data has no chunk.
    """
    size = len(data)
    if size == 0:
        return []
    values = rolling_hash(np.frombuffer(data, np.uint8))
    marks = (np.flatnonzero(values < np.uint32(1 << (32 - bits))) + 1).tolist()
    ends, start, at = [], 0, 0
    while size - start > least:
        while at < len(marks) and marks[at] < start + least:
            at += 1
        end = min(marks[at] if at < len(marks) else size, start + most, size)
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends
