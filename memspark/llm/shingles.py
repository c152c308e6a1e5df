"""Words of whole texts as hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Multipliers of the hashes (odd, 64 bits).
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Words (bytes) to 64-bit hashes; emptied when ``most`` have been met."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D: what bytes.split() cuts at."""
    return text.split() if text else []


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of ``n`` words; none if there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:m].copy()
    for i in range(1, n):
        h *= _BASE
        h += hashes[i : i + m]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of runs of ``n`` words, ascending; of the whole sequence if it is shorter; empty without words."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(grams(hashes, min(n, len(hashes))) + np.uint64(max(0, n - len(hashes))))
