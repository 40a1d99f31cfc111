"""Words, shingles and their 64-bit hashes inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for at most ``limit`` words."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), dtype=np.uint64)


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; only A-Z are lower-cased."""
    if not text:
        return []
    raw = text.encode()
    return (raw.lower() if lower else raw).split()


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * _ODD[0] + hashes[k:k + n])
    return out


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words are none."""
    if not len(hashes):
        return hashes
    return np.unique(rolling(hashes, min(size, len(hashes))))
