"""Vectorised 64-bit hashing shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash

_C1, _C2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S11 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(11)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise; wraps on overflow."""
    x = x + _GOLD
    x = (x ^ (x >> _S30)) * _C1
    x = (x ^ (x >> _S27)) * _C2
    return x ^ (x >> _S31)


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x ^ mix(np.uint64([salt & 0xFFFFFFFFFFFFFFFF]))[0])


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles in (0, 1]."""
    return ((x >> _S11).astype(np.float64) + 1.0) * (1.0 / 9007199254740992.0)


class WordHashes(dict):
    """Word to its 64-bit hash, remembered; emptied when it has grown to ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value
