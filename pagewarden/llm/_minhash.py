"""MinHash band keys with a permutation of its own for every minimum.

Minima are independent of each other however few values a set has, so two sets of Jaccard similarity s
share none of b bands of r rows with a chance of (1 - s^r)^b at every size.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def band_keys(hashes: np.ndarray, begins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) keys of sets of mixed 64-bit hashes; each set has one at least and begins at ``begins``."""
    if not len(begins):
        return np.zeros((0, bands), np.int64)
    rng = np.random.default_rng(11)
    times, plus = rng.integers(0, 2**32, (2, bands * rows), dtype=np.uint64).astype(np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    permuted, low = np.empty_like(h), np.empty(len(begins), np.uint32)
    keys = np.zeros((bands, len(begins)), np.uint64)
    for i in range(bands * rows):
        np.multiply(h, times[i] | np.uint32(1), out=permuted)
        np.add(permuted, plus[i], out=permuted)
        np.minimum.reduceat(permuted, begins, out=low)
        keys[i // rows] = mix(keys[i // rows] * _MIX + low)
    return (keys.T + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)
