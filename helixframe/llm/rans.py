"""Range asymmetric numeral system with a static table: interleaved blocks of token ids.

A block holds up to BLOCK ids. Id i of a block belongs to lane i mod LANES; the lanes
share one stream of 32-bit words, ordered by step and lane. Lane states are kept at
every CHECKPOINT-th step, so decoding may start inside a block; each block carries the
CRC-32 of its ids. Blocks are independent; many are coded side by side as vectors.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BITS = 18  # the frequencies of a table sum to 2 ** BITS
LOWEST = 1 << 20  # states stay at or above this, and below 2 ** 52, where doubles divide them exactly
LANES, BLOCK, CHECKPOINT = 64, 65_536, 256
AT_ONCE = 48  # blocks coded side by side
HEAD = struct.Struct("<IIIII")  # ids, words, checkpoints, crc of ids, bytes of the body


@dataclass
class Table:
    freq: np.ndarray  # by id
    start: np.ndarray

    @staticmethod
    def fit(counts: np.ndarray) -> "Table":
        """Frequencies in proportion to counts, at least 1 for each id that occurs."""
        counts = np.asarray(counts, np.float64)
        total, seen = counts.sum(), counts > 0
        if not seen.any():
            seen[0], counts[0], total = True, 1.0, 1.0
        room = (1 << BITS) - int(seen.sum())
        freq = np.where(seen, 1 + np.floor(counts / total * room), 0).astype(np.int64)
        freq[int(np.argmax(counts))] += (1 << BITS) - int(freq.sum())
        return Table(freq, np.cumsum(freq) - freq)

    def slots(self) -> np.ndarray:
        """By slot: the id, its frequency less 1 and the slot's place in it, in 24, 20 and 20 bits."""
        ids = np.repeat(np.arange(len(self.freq), dtype=np.int64), self.freq)
        return (ids << 40) | ((self.freq[ids] - 1) << 20) | (np.arange(1 << BITS) - self.start[ids])

    def pack(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes())

    @staticmethod
    def unpack(data: bytes) -> "Table":
        freq = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        return Table(freq, np.cumsum(freq) - freq)


def _encode_side_by_side(table: Table, ids: np.ndarray, blocks: int, steps: int, pad: int) -> list[bytes]:
    """``ids``: blocks * steps * LANES values, padded in the last block by ``pad``."""
    grid = ids.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, blocks * LANES)
    state = np.full(blocks * LANES, LOWEST, np.int64)
    words = np.zeros(grid.shape, np.uint32)
    sent = np.zeros(grid.shape, bool)
    kept = {}
    both = (table.freq << 32) | table.start
    for t in range(steps - 1, -1, -1):
        b = both[grid[t]]
        f = b >> 32
        full = state >= (f << (52 - BITS))
        words[t] = state  # the low 32 bits
        sent[t] = full
        np.right_shift(state, 32, out=state, where=full)
        q = (state / f).astype(np.int64)
        state = (q << BITS) + (state - q * f) + (b & 0xFFFFFFFF)
        if t % CHECKPOINT == 0:
            kept[t] = state.copy()
    out = []
    for b in range(blocks):
        lanes = slice(b * LANES, (b + 1) * LANES)
        own = sent[:, lanes]
        stream = words[:, lanes][own]
        before = np.concatenate([[0], np.cumsum(own.sum(axis=1))])
        points = sorted(kept)
        marks = b"".join(struct.pack("<I", int(before[t])) + kept[t][lanes].astype("<i8").tobytes() for t in points)
        n = steps * LANES - (pad if b == blocks - 1 else 0)
        block = ids[b * steps * LANES:b * steps * LANES + n]
        body = marks + stream.astype("<u4").tobytes()
        out.append(HEAD.pack(n, len(stream), len(points), zlib.crc32(block.astype("<u4").tobytes()), len(body)) + body)
    return out


def encode(table: Table, ids: np.ndarray) -> list[bytes]:
    """Blocks of the ids in order."""
    out, at, whole = [], 0, len(ids) // BLOCK
    while whole:
        n = min(whole, AT_ONCE)
        out += _encode_side_by_side(table, ids[at:at + n * BLOCK], n, BLOCK // LANES, 0)
        at, whole = at + n * BLOCK, whole - n
    if at < len(ids):
        last = ids[at:]
        steps = -(-len(last) // LANES)
        pad = steps * LANES - len(last)
        out += _encode_side_by_side(table, np.concatenate([last, np.full(pad, last[0], last.dtype)]), 1, steps, pad)
    return out


def _decode_side_by_side(slots: np.ndarray, bodies: list[memoryview], heads: list[tuple], first: int, last: int) -> np.ndarray:
    """Steps first..last of blocks of equal shape, from the checkpoint at step ``first``."""
    blocks, mark = len(bodies), 4 + 8 * LANES
    k = first // CHECKPOINT
    state = np.concatenate([np.frombuffer(b, "<i8", LANES, k * mark + 4) for b in bodies]).astype(np.int64)
    at = np.array([struct.unpack_from("<I", b, k * mark)[0] for b in bodies], np.int64)
    streams = [np.frombuffer(b, "<u4", h[1], h[2] * mark) for b, h in zip(bodies, heads)]
    base = np.cumsum([0] + [len(s) for s in streams[:-1]])
    stream = np.concatenate(streams + [np.zeros(1, np.uint32)]).astype(np.int64)
    at = at + base
    out = np.zeros((last - first, blocks * LANES), np.uint32)
    for t in range(last - first):
        s = slots[state & ((1 << BITS) - 1)]
        out[t] = s >> 40
        state = (((s >> 20) & 0xFFFFF) + 1) * (state >> BITS) + (s & 0xFFFFF)
        need = np.flatnonzero(state < LOWEST)
        if len(need):
            # Words lie in the order of lanes, so those of a block follow one another.
            counts = np.bincount(need // LANES, minlength=blocks)
            place = np.arange(len(need)) + np.repeat(at - (np.cumsum(counts) - counts), counts)
            state[need] = (state[need] << 32) | stream[place]
            at += counts
    return out.reshape(last - first, blocks, LANES).transpose(1, 0, 2).reshape(blocks, -1)


def split_blocks(data: bytes) -> tuple[list[tuple], list[memoryview]]:
    heads, bodies, at, view = [], [], 0, memoryview(data)
    while at < len(view):
        h = HEAD.unpack_from(view, at)
        heads.append(h)
        bodies.append(view[at + HEAD.size:at + HEAD.size + h[4]])
        at += HEAD.size + h[4]
    return heads, bodies


def decode(table: Table, data: bytes) -> np.ndarray:
    """All ids of consecutive blocks; raises when a checksum differs."""
    heads, bodies = split_blocks(data)
    out, i, slots = [], 0, table.slots()
    while i < len(heads):
        j = i + 1
        while j < len(heads) and j - i < AT_ONCE and heads[j][0] == heads[i][0]:
            j += 1
        n = heads[i][0]
        grid = _decode_side_by_side(slots, bodies[i:j], heads[i:j], 0, -(-n // LANES))
        for h, row in zip(heads[i:j], grid):
            if zlib.crc32(row[:n].astype("<u4").tobytes()) != h[3]:
                raise ValueError("a block's checksum differs")
            out.append(row[:n])
        i = j
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def decode_part(table: Table, block: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of one block, from the nearest checkpoint."""
    heads, bodies = split_blocks(block)
    stop = min(stop, heads[0][0])
    if stop <= start:
        return np.empty(0, np.uint32)
    first = start // LANES // CHECKPOINT * CHECKPOINT
    row = _decode_side_by_side(table.slots(), bodies, heads, first, -(-stop // LANES))[0]
    return row[start - first * LANES:stop - first * LANES]
