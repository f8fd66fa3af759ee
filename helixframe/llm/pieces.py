"""Token ids of whole texts through the tokenizers library, each distinct piece encoded once.

The byte-level pre-tokenizer never joins a visible character with the white space that
follows it, nor a letter with a stop, so a text may be cut there: a piece is a run of
white space and the letters after it, or what follows from a stop on. Texts with white
space beyond ASCII are one piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np

from helixframe.llm.text import mix

ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
BATCH_CHARS = 2_000_000
END = 0  # id that ends each document
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\v\f\r")] = True
LETTER = np.zeros(256, bool)
LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
STOP = np.zeros(256, bool)
STOP[list(b".,;:!?")] = True
BASE = 0x9E3779B97F4A7C15


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, kind: str):
        self.data, self.n = np.zeros(1024, kind), 0

    def append(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n:self.n + len(values)] = values
        self.n += len(values)

    @property
    def used(self) -> np.ndarray:
        return self.data[:self.n]


class Pieces:
    """Piece number -> ids; the Python worker remembers the first ``limit`` pieces it meets, by 64-bit hash."""

    limit, slot_bits = 1_500_000, 22

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.encoder = Tokenizer.from_file(path)
        self.size = self.encoder.get_vocab_size()
        self.slots = np.zeros(1 << self.slot_bits, np.int32)  # piece number, 0: free
        self.hashes, self.flat, self.starts, self.lengths = _Grown("u8"), _Grown("u4"), _Grown("i8"), _Grown("i8")
        self._add(np.zeros(1, np.uint64), [[END]])  # piece 0 is the end mark
        self.kept = 1
        self.powers = np.ones(1, np.uint64)

    def _add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts.append(self.flat.n + np.cumsum(lengths) - lengths)
        self.lengths.append(lengths)
        self.hashes.append(hashes)
        self.flat.append(np.fromiter((i for e in ids for i in e), np.uint32, int(lengths.sum())))

    def _forget(self) -> None:
        """Pieces beyond the limit last for one call."""
        if self.hashes.n > self.kept:
            self.flat.n = int(self.starts.data[self.kept])
            self.hashes.n = self.starts.n = self.lengths.n = self.kept

    def _hash(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(len(data), BASE, np.uint64)))
            self.inverse = np.cumprod(np.append(np.uint64(1), np.full(len(data), pow(BASE, -1, 1 << 64), np.uint64)))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)], out=sums[1:])
        return mix((sums[end] - sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, 0 where unknown."""
        slot, out, todo = (h >> np.uint64(64 - self.slot_bits)).astype(np.int64), np.zeros(len(h), np.int64), None
        while True:
            at = slot if todo is None else slot[todo]
            number = self.slots[at].astype(np.int64)
            hit = self.hashes.data[number] == (h if todo is None else h[todo])
            hit &= number > 0
            if todo is None:
                out[hit] = number[hit]
                todo = np.flatnonzero(~hit & (number > 0))
            else:
                out[todo[hit]] = number[hit]
                todo = todo[~hit & (number > 0)]
            if not len(todo):
                return out
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)

    def _insert(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        while len(slot):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = number[free]
            left = self.slots[slot] != number
            slot, number = (slot[left] + 1) & (len(self.slots) - 1), number[left]

    def numbers(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts, each closed by the end mark, and how many each text has; good until the next call."""
        self._forget()
        encoded = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join(encoded), np.uint8)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        first = np.cumsum(sizes) - sizes
        space = SPACE[data]
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[1:] |= STOP[data[1:]] & LETTER[data[:-1]]
        for i, t in enumerate(texts):
            if t and ODD.search(t):
                start[first[i]:first[i] + sizes[i]] = False
        start[first[sizes > 0]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))[:len(begin)]
        h = self._hash(data, begin, end)
        number = self._find(h)
        missing = np.flatnonzero(number == 0)
        if len(missing):
            new, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            one = missing[one]
            view = memoryview(data)
            pieces_ = [str(view[a:b], "utf-8") for a, b in zip(begin[one].tolist(), end[one].tolist())]
            base = self.hashes.n
            self._add(new, [e.ids for e in self.encoder.encode_batch_fast(pieces_, add_special_tokens=False)])
            number[missing] = base + back
            stay = max(0, min(len(new), self.limit - base))
            self._insert(new[:stay], np.arange(base, base + stay, dtype=np.int32))
            self.kept = base + stay
        per_text = np.diff(np.searchsorted(begin, np.append(first, len(data))))
        counts = per_text + 1
        out = np.zeros(int(counts.sum()), np.int64)
        marks = np.cumsum(counts) - 1
        inside = np.ones(len(out), bool)
        inside[marks] = False
        out[inside] = number
        return out, counts

    def expand(self, numbers: np.ndarray) -> np.ndarray:
        n = self.lengths.used[numbers]
        shift = self.starts.used[numbers] - (np.cumsum(n) - n)
        return self.flat.used[np.repeat(shift, n) + np.arange(int(n.sum()))]

    def lengths_by_text(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.lengths.used[numbers], np.cumsum(counts) - counts) if len(counts) else counts


_loaded: dict[str, Pieces] = {}


def pieces(path: str | None) -> Pieces:
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def small_batches(texts: list) -> Iterator[slice]:
    """Slices of a batch with about BATCH_CHARS characters each."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BATCH_CHARS:
            yield slice(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
