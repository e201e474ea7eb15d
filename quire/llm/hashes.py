"""Hashes of all stretches of a byte string at once, the same in every process.

With random 64-bit values for bytes and an odd base, the hash of a stretch is a difference of
prefix sums divided by a power of the base (all modulo 2 ** 64), then mixed.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS[base]) < n:
        steps = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:end]`` for bytes as uint8."""
    sums = prefix_sums(data)
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts])


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` bytes, by where they start."""
    sums, n = prefix_sums(data), max(0, len(data) - size + 1)
    return mix((sums[size:] - sums[:n]) * _powers(_INVERSE, n)) if n else np.zeros(0, np.uint64)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    return sums


def word_shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of every ``size`` words; of all words where there are fewer; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    each = stretches(data, starts, ends)
    size = min(size, len(each))
    out = np.zeros(len(each) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + each[k : k + len(out)]
    return np.unique(mix(out))
