"""Hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: About so many bytes of text are hashed in one step (a longer text is one step).
STEP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def odd(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd numbers of 64 bits."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = odd(21, 256)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = int(odd(22, 1)[0]) & ~7 | 3
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def hash_bytes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, offsets)`` of the words of the texts data[bounds[i]:bounds[i + 1]].

    Words end at the six ASCII white-space characters; A-Z count as a-z.  The hash of a
    word is a polynomial of its bytes modulo 2 ** 64, read off one running sum over all bytes.
    """
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[firsts] = ~space[firsts]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[firsts[1:] - 1] = ~space[firsts[1:] - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    powers, inverse = _powers(len(data))
    running = np.cumsum(_VALUE[data] * powers)
    before = np.where(a > 0, running[a - 1], np.uint64(0))
    return mix((running[b] - before) * inverse[a] + (b - a).astype(np.uint64)), np.searchsorted(a, bounds)


def hash_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, hashes, offsets)`` for consecutive rows of a binary column: the words of row from + i are hashes[offsets[i]:offsets[i + 1]].

    Null counts as empty.
    """
    n = len(column)
    if not n:
        return
    column = column.fill_null(b"") if column.null_count else column
    bounds = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + STEP_BYTES, "right")) - 1)
        yield lo, hi, *hash_bytes(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


def windows(values: np.ndarray, k: int, factors: np.ndarray) -> np.ndarray:
    """A hash of every run of ``k`` values (of the whole array, over the ends of texts too)."""
    if len(values) < k:
        return np.empty(0, np.uint64)
    out = values[: len(values) - k + 1] * factors[0]
    for i in range(1, k):
        out += values[i : len(values) - k + 1 + i] * factors[i]
    return mix(out)
