"""Vectorised 64-bit hashing that the operators share."""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def table(n: int, base: int = BASE) -> np.ndarray:
    """Hashes of the symbols 0 to n - 1."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _U(base))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes; h is sorted in place. (np.unique makes a hash table, which takes several times as long.)"""
    h.sort()
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


class Powers:
    """Powers of a base and of its inverse modulo 2 ** 64, grown as needed."""

    def __init__(self, base: int = BASE):
        self.base, self.held = base, [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.held[0]) < n:
            for k, b in enumerate((self.base, pow(self.base, -1, 1 << 64))):
                x = np.full(1 << (n - 1).bit_length(), b, np.uint64)
                x[0] = 1
                self.held[k] = np.cumprod(x)
        return self.held


class Sums:
    """Prefix sums of a sequence of symbols, from which the hash of any part is taken."""

    def __init__(self, symbols: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(symbols) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * up[: len(symbols)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` symbols: doubled while that fits, then one more at a time."""
    first, m, b = h, 1, BASE
    while 2 * m <= size:
        h, m, b = h[:-m] * _U(b) + h[m:], 2 * m, b * b % (1 << 64)
    for k in range(m, size):
        h = h[:-1] * _U(BASE) + first[k:]
    return mixed(h)


def rolled_short(points: np.ndarray, size: int) -> np.ndarray:
    """32-bit hashes of all runs of `size` symbols, given as small numbers; for MinHash, not for names."""
    first = h = points.astype(np.uint32)
    m, b = 1, 0x9E3779B1
    while 2 * m <= size:
        h, m, b = h[:-m] * np.uint32(b) + h[m:], 2 * m, b * b % (1 << 32)
    for k in range(m, size):
        h = h[:-1] * np.uint32(0x9E3779B1) + first[k:]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))
