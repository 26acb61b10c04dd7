"""Words, word shingles and MinHash values of whole texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: Words whose hash a task remembers; the memory is emptied when full, results do not change.
REMEMBERED = 400_000

_FACTORS = np.random.default_rng(5).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hash of each word, computed once per word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def scramble(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def shingle_row(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Hash of each run of five words, in text order; fewer words are one shingle, none are none."""
    n = len(words)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)][:n], dtype=np.uint64)
    single = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    total = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
    for i, factor in enumerate(_FACTORS):
        total += single[i : n - SHINGLE + 1 + i] * factor
    return scramble(total)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Distinct shingles, sorted."""
    return np.unique(shingle_row(words_of(text), hashes))


class MinHash:
    """``k`` independent hash orders over shingles."""

    def __init__(self, k: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, k, dtype=np.uint64)

    def of_rows(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Least value of each order in each piece of ``shingles``; no piece may be empty."""
        out = np.empty((len(starts), len(self.a)), dtype=np.uint64)
        for j, (a, b) in enumerate(zip(self.a, self.b)):
            out[:, j] = np.minimum.reduceat(shingles * a + b, starts)
        return out
