"""Sorted sets of whole numbers as bytes: gaps in groups of seven bits, low ones first, the eighth bit set where more follow."""

from __future__ import annotations

import numpy as np


def encoded(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of int64 sets that lie one after the other, each ascending; ``starts`` has their first places."""
    gaps = np.diff(values.view(np.uint64), prepend=np.uint64(0))
    gaps[starts] = values[starts].view(np.uint64)
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        size += gaps >= np.uint64(1) << np.uint64(7 * k)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        longer = np.flatnonzero(size > k)
        part = (gaps[longer] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[longer] + k] = part.astype(np.uint8) | np.where(size[longer] > k + 1, np.uint8(128), np.uint8(0))
    return out, np.append(at[starts], len(out))


def decoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of sets that ``encoded`` made."""
    last = (data & 128) == 0
    ends = np.flatnonzero(last)
    begins = np.append(0, ends[:-1] + 1) if len(ends) else ends
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    gaps = np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begins) if len(ends) else np.empty(0, np.uint64)
    before = np.append(0, np.cumsum(last))[offsets]  # values before each set
    sizes = np.diff(before)
    total = np.cumsum(gaps)
    base = np.append(np.uint64(0), total)[before[:-1]]
    return (total - np.repeat(base, sizes)).view(np.int64), sizes
