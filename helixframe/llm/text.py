"""Words, lines and 64-bit hashes of whole texts, shared by the operators."""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACES = b" \t\n\v\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"  # the same words in SQL
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """word -> 64-bit hash, remembered while it stays below ``limit`` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHash()


def raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word; words are runs of bytes other than ASCII white space."""
    words = text.split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each hash over the word (a fixed bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` words, in order (empty when there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * _STEP + words[j:n + j]
    return mix(h)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles: windows of ``k`` words, or all words as one when fewer."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
