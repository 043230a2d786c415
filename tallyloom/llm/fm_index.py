"""A compressed full-text index over integer symbols: a wavelet matrix of the Burrows-Wheeler transform, searched backwards.

Suffixes are sorted by their first `depth` symbols (ties by position), which is all that patterns up to that length need.
All searches run in step over many streams at once, in numpy.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit planes from the highest down, packed into 64-bit words with a running count for each word."""

    def __init__(self, x: np.ndarray):
        self.levels = max(1, int(x.max(initial=0)).bit_length())
        self.planes, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1
            packed = np.zeros(len(x) // 64 * 8 + 16, np.uint8)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            plane = packed.view(np.uint64)
            self.planes.append(plane)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(plane))]).astype(np.uint32))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c occurs among the first i symbols."""
        first = np.zeros_like(i)
        both = np.concatenate([i, first])
        cc = np.concatenate([c, c])
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = both >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.planes[k][word] & ((np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)))
            both = np.where((cc >> level) & 1, self.zeros[k] + ones, both - ones).astype(np.int64)
        return both[: len(i)] - both[len(i) :]


class FMIndex:
    """Index of a text of symbols >= 1, with 0 after each of its parts; `order` ranks the positions of the text."""

    def __init__(self, text: np.ndarray, order: np.ndarray, depth: int):
        n, self.depth, self.n = len(text), depth, len(text)
        ranks, width = {1: text.astype(np.int64)}, 1
        while width * 2 <= depth:
            ranks[width * 2] = self._pair(ranks[width], width, n)
            width *= 2
        self._ranks, self._width = ranks, width
        self._suffixes = np.argsort(self._pair(ranks[width], depth - width, n), kind="stable")
        self.bwt = WaveletMatrix(text[self._suffixes - 1])
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self._bounds: dict[int, np.ndarray] = {}
        deepest = self.bounds(depth)
        self.earliest = np.minimum.reduceat(order[self._suffixes], deepest[:-1])
        for d in range(1, depth):
            self.bounds(d)
        del self._ranks, self._suffixes  # what stays is the transform, the interval bounds and one number for each deepest interval

    @staticmethod
    def _pair(rank: np.ndarray, shift: int, n: int) -> np.ndarray:
        """Dense ranks of (rank at i, rank at i + shift); past the end counts as -1."""
        later = np.full(n, -1, np.int64)
        later[: n - shift] = rank[shift:] if shift else rank
        return np.unique(rank * (int(rank.max(initial=0)) + 2) + later + 1, return_inverse=True)[1]

    def bounds(self, d: int) -> np.ndarray:
        """Where, in suffix order, the prefix of length d changes; ends with n."""
        if d not in self._bounds:
            width = max(w for w in self._ranks if w <= d)
            r = self._pair(self._ranks[width], d - width, self.n)[self._suffixes]
            self._bounds[d] = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1, [self.n]])
        return self._bounds[d]

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics one symbol further to the left: the longest match (at most self.depth) that starts there.

        A match of full depth first gives up its last symbol; one that can't be extended gives up more, one by one.
        """
        depth = depth.copy()
        lo, hi = lo.copy(), hi.copy()
        todo = np.arange(len(c))
        full = depth >= self.depth
        known = c < len(self.starts) - 1
        while len(todo):
            self._shorten(todo[full[todo]], self.depth - 1, lo, hi, depth)
            full = np.zeros(len(c), bool)
            ok = known[todo]
            t = todo[ok]
            both = self.bwt.rank(np.concatenate([c[t], c[t]]), np.concatenate([lo[t], hi[t]])) + np.concatenate([self.starts[c[t]]] * 2)
            a, b = both[: len(t)], both[len(t) :]
            hit = b > a
            lo[t[hit]], hi[t[hit]] = a[hit], b[hit]
            depth[t[hit]] += 1
            missed = np.concatenate([t[~hit], todo[~ok]])
            over = missed[(depth[missed] == 0) | ~known[missed]]
            lo[over], hi[over], depth[over] = 0, self.n, 0
            todo = np.setdiff1d(missed, over)
            for d in np.unique(depth[todo]):
                self._shorten(todo[depth[todo] == d], int(d) - 1, lo, hi, depth)
        return lo, hi, depth

    def _shorten(self, which: np.ndarray, d: int, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> None:
        if not len(which):
            return
        if d == 0:
            lo[which], hi[which] = 0, self.n
        else:
            b = self.bounds(d)
            at = np.searchsorted(b, lo[which], "right") - 1
            lo[which], hi[which] = b[at], b[at + 1]
        depth[which] = d

    def first(self, lo: np.ndarray) -> np.ndarray:
        """The lowest order of the occurrences in the deepest interval that starts at lo."""
        return self.earliest[np.searchsorted(self.bounds(self.depth), lo, "right") - 1]

    def stream(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """For each part, at each position: the lowest order of a match of full depth that starts there, or -1."""
        lengths = np.array([len(p) for p in parts])
        offset = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        out = np.full(len(flat), -1, np.int64)
        lo, hi, depth = np.zeros(len(parts), np.int64), np.full(len(parts), self.n), np.zeros(len(parts), np.int64)
        for s in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > s)
            at = offset[on + 1] - 1 - s
            lo[on], hi[on], depth[on] = self.step(flat[at], lo[on], hi[on], depth[on])
            deep = on[depth[on] == self.depth]
            out[offset[deep + 1] - 1 - s] = self.first(lo[deep])
        return [out[a:b] for a, b in zip(offset, offset[1:], strict=False)]
