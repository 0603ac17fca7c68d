"""Word shingles of whole texts as 64-bit hashes, computed by numpy without a Python step for each word."""

from __future__ import annotations

import numpy as np

from .common import kept_by_worker

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """Sets of distinct shingles of k words. A-Z are lowered; words are runs of bytes outside 0x20 and 0x09-0x0D.

    A text of fewer than k words, but one at least, has its whole sequence as its only shingle.
    """

    def __init__(self, k: int = 5):
        self.k = k
        rng = np.random.default_rng(20240229)
        self.table = rng.integers(0, 2**64, 256, dtype=U64)
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.power = np.ones(1, U64)
        self.inverse = np.ones(1, U64)
        self.place = mix(np.arange(1, 2 * k + 1, dtype=U64)) | U64(1)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            n = max(n, 1 << 16)
            self.power = np.cumprod(np.concatenate((np.ones(1, U64), np.full(n, _BASE, U64))), dtype=U64)
            self.inverse = np.cumprod(np.concatenate((np.ones(1, U64), np.full(n, pow(_BASE, -1, 2**64), U64))), dtype=U64)

    def words(self, text: str) -> np.ndarray:
        """A hash of each word: a polynomial in the word's bytes, from differences of running sums."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
        if not raw.size:
            return np.zeros(0, U64)
        if raw.size >= self.power.size:
            self._grow(2 * raw.size)
        gap = self.space[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        total = np.concatenate((np.zeros(1, U64), np.cumsum(self.table[raw] * self.power[: raw.size], dtype=U64)))
        return mix((total[end] - total[begin]) * self.inverse[begin] + (end - begin).astype(U64))

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingles."""
        w = self.words(text or "")
        if not w.size:
            return w
        if w.size < self.k:
            return mix((w * self.place[self.k : self.k + w.size]).sum(dtype=U64, keepdims=True) + U64(w.size))
        n = w.size - self.k + 1
        h = w[:n] * self.place[0]
        for j in range(1, self.k):
            h = h + w[j : j + n] * self.place[j]
        return np.unique(mix(h))


def signature(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a whole set."""
    x = mix(shingles + U64(0x632BE59BD9B4E019)).sum(dtype=U64, keepdims=True) ^ mix(np.array([shingles.size], U64))
    return int(mix(x).view(np.int64)[0])


def of_worker(k: int) -> Shingler:
    return kept_by_worker(f"shingles {k}", lambda: Shingler(k))
