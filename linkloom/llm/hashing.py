"""Hashes of runs of bytes, for many runs of one buffer at once."""

from __future__ import annotations

import numpy as np

_HELD = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... below n, modulo 2^64."""
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]))


_LETTERS = np.random.default_rng(41).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = _powers(_BASE, _HELD), _powers(pow(_BASE, -1, 1 << 64), _HELD)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[start:end] of bytes, equal for equal runs wherever they stand.

    Sums of letter times power of place, modulo 2^64, brought back to place 0 and mixed; so a run costs the same
    however long it is.
    """
    n = len(data)
    up, down = (_UP, _DOWN) if n < _HELD else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up[:n])])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(_BASE)
    return h ^ (h >> np.uint64(29))
