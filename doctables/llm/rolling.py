"""Hashes of any span of a byte string from one pass over it."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mixed(value: np.ndarray) -> np.ndarray:
    """The 64 bits stirred, so that any of them may be used alone."""
    value = value ^ (value >> np.uint64(32))
    value = value * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))


def _grown(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()

        def table(base: int) -> np.ndarray:
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            return np.multiply.accumulate(factors)

        _powers, _inverse = table(BASE), table(pow(BASE, -1, 1 << 64))


class Prefixes:
    """Polynomial hashes modulo 2**64 of all prefixes of `codes`, from which spans follow."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        _grown(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes [start, stop), wherever they stand."""
        return mixed((self.sums[stop] - self.sums[start]) * _inverse[start])

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of `width` bytes."""
        n = max(len(self.sums) - width, 0)
        return mixed((self.sums[width:] - self.sums[:n]) * _inverse[:n])
