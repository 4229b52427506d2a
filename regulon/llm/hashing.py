"""Vectorised 64-bit hashes of all substrings of an array of bytes."""

from __future__ import annotations

import numpy as np

KEEP = (1 << 20) + (1 << 18)  # powers that are kept between calls

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_STEP = (_rng.integers(0, 1 << 61, 2, dtype=np.uint64) << np.uint64(3)) | np.uint64(5)
_MIX = np.uint64(0x9FB21C651E98DF25)


class Prefix:
    """Polynomial hashes of all substrings of an array of bytes, modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0):
        n, self.which = len(data), which
        if which not in self._powers:
            self._powers[which] = powers(int(_STEP[which]), KEEP)
        up, down = self._powers[which] if n < KEEP else powers(int(_STEP[which]), n + 1)
        self.down = down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[which][data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, width: int) -> np.ndarray:
        x = self.sums[width:] - self.sums[:-width]
        x *= self.down[: len(x)]
        return mixed(x)


def powers(step: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``step`` and of its inverse modulo 2**64."""
    up, down = (np.full(size, x, np.uint64) for x in (step, pow(step, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x
