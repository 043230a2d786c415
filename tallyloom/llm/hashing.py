"""Words and runs of words as 64-bit numbers, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Words:
    """64-bit hashes of byte words; a worker remembers the words it has met, up to a bound."""

    def __init__(self, most: int = 1 << 16):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, k: int, axis: int = 0) -> np.ndarray:
    """Hashes of all runs of k neighbours along an axis: Horner's rule with mixed inputs, then mixed."""
    h = np.moveaxis(h, axis, 0)
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full((n, *h.shape[1:]), k, np.uint64)
    base = np.uint64(_M[0])
    for j in range(k):
        out = out * base + h[j : j + n]
    return np.moveaxis(mix(out), 0, axis)
