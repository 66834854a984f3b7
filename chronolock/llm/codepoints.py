"""Vectorised hashing of spans of text, on arrays of code points.

Spans hash by prefix sums: with an odd base ``B`` a prefix sum ``P[i] = sum(c[j] * B**j, j < i)``
modulo 2**64 gives every span as ``(P[e] - P[s]) * B**-s``, and a mixer spreads the bits.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` for ``i <= n``."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        grown = []
        for b in (BASE, INVERSE):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            grown.append(np.multiply.accumulate(steps))
        _powers[:] = grown
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place where it can."""
    h = h.copy()
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and where each text starts (one more place at the end)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=at[1:])
    return cp, at


def prefix(cp: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cp) + 1, np.uint64)
    up, _ = powers(len(cp))
    c = cp.astype(np.uint64)
    c += np.uint64(0x1F)
    c *= np.uint64(0xBF58476D1CE4E5B9)
    c ^= c >> np.uint64(31)
    c *= up[: len(cp)]
    np.cumsum(c, out=out[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal content and length."""
    _, down = powers(len(p))
    h = p[end] - p[start]
    h *= down[start]
    h += (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return mixed(h)
