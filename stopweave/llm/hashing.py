"""Word hashes for tasks that compare word sequences: 64-bit, deterministic, the same on every executor."""

from __future__ import annotations

import numpy as np

#: Distinct words that a worker remembers before it starts anew; bounds memory, never results.
CACHE_SIZE = 300_000


class WordHashes(dict):
    """Word (UTF-8 bytes) to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_SIZE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on."""
    n = len(h) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out
