"""Shingle sets and SetSketch registers, as arrays."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash

#: Words of a shingle.
WORDS = 5
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes by word; emptied when full."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: ``WORDS`` lower-cased words in a row.

    A text with fewer words has its whole sequence as its one shingle, a text
    without words has none.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, WORDS)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out = out * _P + h[i : n - k + 1 + i]
    return np.unique(_mixed(out + np.uint64(k)))


class SetSketch:
    """Registers of ``m`` exponentially spaced, truncated minima.

    Register i of a set is ``floor(1 - log_b x)`` of the least x, where x are the
    elements' exponential variates of rate ``a``, limited to 0..255. The register
    of a union is the larger of the two, so sketches merge.
    """

    def __init__(self, m: int, b: float = 1.2, a: float = 20.0, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.m, self.b, self.a = m, b, a
        self.xors = rng.integers(0, 2**63, m, dtype=np.uint64)
        self.factors = rng.integers(0, 2**63, m, dtype=np.uint64) | np.uint64(1)

    def registers(self, items: np.ndarray) -> bytes:
        least = np.full(self.m, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(items), 1024):
            block = (items[at : at + 1024, None] ^ self.xors) * self.factors
            np.minimum(least, block.min(0), out=least)
        u = (least.astype(float) + 1) / 2.0**64
        x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / self.a
        k = np.floor(1 - np.log(x) / math.log(self.b))
        return np.clip(k, 0, 255).astype(np.uint8).tobytes()

    def similarity(self, greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Most likely Jaccard similarities, from the numbers of registers that
        are greater or less in the first set, and both sets' sizes."""
        grid = np.linspace(0, 1, 201)[None, :]
        u = (n_a / (n_a + n_b))[:, None]
        v = 1 - u
        j = grid * np.minimum(u / v, v / u)
        scale = (self.b - 1) / self.b

        def p(x):
            return -np.log1p(-np.clip(x, 0, 1) * scale) / math.log(self.b)

        up, down = p(u - v * j), p(v - u * j)
        same = np.maximum(1 - up - down, 1e-12)
        up, down = np.maximum(up, 1e-12), np.maximum(down, 1e-12)
        equal = self.m - greater - less
        like = greater[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(same)
        return j[np.arange(len(j)), like.argmax(1)]


def set_digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()
