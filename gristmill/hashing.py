"""Hashes of 64 bits over arrays: a finalizer, and polynomial hashes of spans."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd multiplier of the polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit values (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; the longest table of a base is kept."""
    if n > len(_POWERS.get(base, ())):
        out = np.full(1 << max(16, (n - 1).bit_length()), base, U64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each [start, end) the polynomial hash of ``values`` there, the same wherever the span lies."""
    n = len(values)
    total = np.zeros(n + 1, U64)
    np.cumsum(values.astype(U64, copy=False) * powers(BASE_INVERSE, n), out=total[1:])
    return (total[end] - total[start]) * powers(BASE, n + 1)[start]
