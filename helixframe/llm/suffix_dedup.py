"""Removal of long repeated byte strings through run-length indexes.

Every window of LENGTH bytes belongs to the smallest hash of its K-byte strings (leftmost
of equal ones), so equal windows belong to equal strings at equal offsets. Consecutive
windows of one such anchor make a snippet; snippets go to the bucket of their anchor's
hash. Anchors that occur once cannot repeat and are not sent; equal snippets are sent
once per chunk and indexed once. Per bucket, the snippets that share an anchor with a
different one get a run-length index: suffixes are sorted up to the end of their own
snippet (equal ones by snippet), their Burrows-Wheeler transform is cut into runs and at
every snippet's start, and the longest common prefix with the neighbour in suffix
order is computed at run ends only; between them it falls by one per byte. Streaming
over the text these matching statistics mark the windows that occur elsewhere.

An anchor that stands in more than HOT chunks (a passage that much of the corpus shares)
would fill one bucket. Its windows go to the buckets of their own hashes instead, as
hashes without bytes, counted once per chunk; a hash with two or more is repeated.

Windows do not cross documents. A null text is empty; texts below LENGTH bytes stay whole;
repeated rows are repeated texts and lose all they share; null ids are kept as they are; an
empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from helixframe.llm import chunks
from helixframe.llm.text import mix
from helixframe.session import materialise

LENGTH, K = 200, 32
HOT = 256  # chunks that hold an anchor
BLOCK = 1 << 20  # window starts looked at together
SYMBOLS = 7  # symbols of 9 bits in a first rank
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
MARKS = ("<u8", "<u8", "<u4", "<u4", "u1")  # anchor, name, first window, window after the last, whether one window
_LOW = np.uint64((1 << 24) - 1)


def string_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position on."""
    n = len(data) - K + 1
    h = np.zeros(n, np.uint64)
    for j, m in enumerate(_MULTIPLIERS):
        h += np.ndarray((n,), "<u8", np.ascontiguousarray(data), 8 * j, (1,)) * m
    return mix(h)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    n = len(values)
    rows = -(-n // w)
    grid = np.full(rows * w, np.uint64(2 ** 64 - 1))
    grid[:n] = values
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def snippets(data: np.ndarray, valid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hash, first window and number of windows of each snippet; ``valid``: starts of whole windows."""
    for lo in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        part = data[lo:lo + BLOCK + LENGTH - 1]
        ok = valid[lo:lo + len(part) - LENGTH + 1]
        if not ok.any():
            continue
        h = string_hashes(part)
        ranked = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        at = (window_minima(ranked, LENGTH - K + 1) & _LOW).astype(np.int64)
        starts = np.flatnonzero(ok)
        own = at[starts]
        new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        yield h[own[new]], starts[new] + lo, np.diff(np.append(new, len(starts)))


def windows_of(texts: list[bytes]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts of some megabytes: joined bytes, first byte of each text, valid window starts."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= 2 * BLOCK or i == len(texts) - 1:
            part = texts[lo:i + 1]
            lengths = np.array([len(t) for t in part], np.int64)
            ends = np.cumsum(lengths)
            data = np.frombuffer(b"".join(part), np.uint8)
            step = np.zeros(len(data) + 1, np.int32)
            whole = lengths >= LENGTH
            np.add.at(step, (ends - lengths)[whole], 1)
            np.add.at(step, (ends - LENGTH + 1)[whole], -1)
            yield slice(lo, i + 1), data, ends - lengths, np.cumsum(step[:-1]) > 0
            lo, size = i + 1, 0


def _keys(buckets: int):
    def keys_of(texts: list[bytes], given: list):
        found = [h for _, data, _, valid in windows_of(texts) for h, _, _ in snippets(data, valid)]
        anchors, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        to, prints = chunks.place(anchors, buckets)
        twice = (counts > 1).astype(np.uint8)
        return [(b, chunks.dump(prints[at], twice[at])) for b, at in chunks.by_bucket(to, buckets)], given, None
    return keys_of


def _shared(hot_chunks: int):
    def run(table: pa.Table) -> pa.Table:
        """Per chunk, its anchors that occur more than once anywhere, and whether they are hot."""
        parts = [chunks.load(b, "<u4", "u1") for b in table["body"].to_pylist()]
        prints = np.concatenate([p[0] for p in parts])
        values, back = np.unique(prints, return_inverse=True)
        often = np.bincount(back, 1 + np.concatenate([p[1] for p in parts]), len(values)) > 1
        values, hot = values[often], np.bincount(back)[often] > hot_chunks
        bodies = []
        for p in parts:
            own = np.isin(values, p[0])
            bodies.append(chunks.dump(values[own], hot[own].astype(np.uint8)))
        return pa.table([table["chunk"], table["bucket"], pa.array(bodies, pa.binary())], names=["chunk", "bucket", "body"])
    return run


def _send(buckets: int):
    """Distinct snippets of a chunk at shared anchors, by bucket."""
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known, flags = [np.empty(0, np.uint64)], [np.empty(0, np.uint8)]
        for b, body in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist()):
            prints, hot = chunks.load(body, "<u4", "u1")
            known.append(chunks.join_key(np.uint64(b), prints))
            flags.append(hot)
        known, flags = np.concatenate(known), np.concatenate(flags)
        order = np.argsort(known)
        known, flags = known[order], flags[order]
        seen: dict[int, list] = {}  # name -> route, bytes, times, anchor, whether one window

        def add(name: int, route: int, piece: bytes, anchor: int, single: bool) -> None:
            if name in seen:
                seen[name][2] = 2
            else:
                seen[name] = [route, piece, 1, anchor, single]

        for body in texts["body"].to_pylist():
            for _, data, _, valid in windows_of(chunks.unpack_texts(body)):
                view = memoryview(data)
                for h, first, n in snippets(data, valid):
                    wanted = chunks.join_key(*chunks.place(h, buckets))
                    at = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
                    for i in np.flatnonzero(known[at] == wanted).tolist() if len(known) else []:
                        if flags[at[i]]:
                            for j in range(first[i], first[i] + n[i]):
                                name = window_name(view[j:j + LENGTH])
                                add(name, name, b"", int(h[i]), True)
                        else:
                            piece = view[first[i]:first[i] + n[i] + LENGTH - 1]
                            add(xxhash.xxh3_64_intdigest(piece), int(h[i]), bytes(piece), int(h[i]), False)
        names = np.fromiter(seen, np.uint64, len(seen))
        routes, anchors = (np.array([v[i] for v in seen.values()], np.uint64) for i in (0, 3))
        counts, single = (np.array([v[i] for v in seen.values()], np.uint8) for i in (2, 4))
        pieces = [v[1] for v in seen.values()]
        lengths = np.array([len(p) for p in pieces], np.uint32)
        out = []
        for b, at in chunks.by_bucket(chunks.place(routes, buckets)[0], buckets):
            packed = zstandard.ZstdCompressor(level=1).compress(b"".join(pieces[i] for i in at))
            out.append((b, chunks.dump(routes[at], names[at], lengths[at], counts[at], anchors[at], single[at]), packed))
        chunk = texts["chunk"][:1].to_pylist()
        return pa.table([pa.array(chunk * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()),
                         pa.array([o[2] for o in out], pa.binary())], names=["chunk", "bucket", "body", "bytes"])
    return run


class RunLengthIndex:
    """Runs of the transform of some strings, with neighbours' common prefixes at the run ends.

    Common prefixes shorter than ``at_least`` may be left at 0.
    """

    def __init__(self, strings: list[bytes], at_least: int = 0):
        # Bytes are 1..256 and each string is closed by 0. These ends stand for distinct symbols in the
        # order of the strings: no suffix is compared beyond its own, so the order is whole and a
        # suffix without its first symbol keeps its place among those that lost the same one.
        data = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, 0) for s in strings])
        n = len(data)
        ends = np.flatnonzero(data == 0)
        string = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
        left = ends[string] - np.arange(n)  # symbols before the suffix's own end
        first = np.zeros(n, np.uint64)
        padded = np.append(data, np.zeros(SYMBOLS, np.uint16)).astype(np.uint64)
        for j in range(SYMBOLS):
            first = (first << np.uint64(9)) | np.where(left > j, padded[j:n + j], np.uint64(0))
        ranks, width, key = [], SYMBOLS, first
        while True:
            order = np.argsort(key)
            new = np.diff(key[order], prepend=key[order[:1]]) != 0
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new)
            ranks.append((width, rank))
            if rank[order[-1]] == n - 1:
                break
            after = string.astype(np.uint64)
            longer = np.flatnonzero(left >= width)
            after[longer] = rank[longer + width]
            key = (rank.astype(np.uint64) << np.uint64(32)) | after
            width *= 2
        self.n, self._ranks, self._data = n, ranks, data
        last = data[order - 1]  # the transform
        # Before a string's start stands another string's end or nothing: each start is a run of its own.
        cut = np.flatnonzero((last[1:] != last[:-1]) | (last[1:] == 0)) + 1
        self.runs = len(cut) + 1
        # The prefix at a cut belongs to the tail before it and to the head after it.
        prefix = np.zeros(len(cut), np.int64)
        a, b = order[cut - 1], order[cut]
        near = np.arange(len(cut))
        for width, rank in ranks:
            if width <= at_least:
                near = near[rank[a[near]] == rank[b[near]]]
        prefix[near] = self._common(a[near], b[near])
        self.head_at, self.head_prefix = self._by_position(np.append(order[:1], b), np.append(0, prefix))
        self.tail_at, self.tail_prefix = self._by_position(np.append(a, order[-1:]), np.append(prefix, 0))
        del self._ranks, self._data

    @staticmethod
    def _by_position(at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(at)
        return at[by], prefix[by]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        length = np.zeros(len(a), np.int64)
        singles = [(1, self._data)] * (SYMBOLS - 1)
        for width, rank in [*reversed(self._ranks), *singles]:
            inside = (a + length < self.n) & (b + length < self.n)
            same = np.zeros(len(a), bool)
            same[inside] = rank[(a + length)[inside]] == rank[(b + length)[inside]]
            length += width * same
        return length

    def matching_statistics(self) -> np.ndarray:
        """Longest prefix of each position's suffix that also starts elsewhere (exact up to the end of its string)."""
        at = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for where, prefix in ((self.head_at, self.head_prefix), (self.tail_at, self.tail_prefix)):
            sampled = np.zeros(self.n, np.int64)
            sampled[where] = 1
            k = np.cumsum(sampled) - 1
            out = np.maximum(out, np.where(k >= 0, prefix[k] - (at - where[k]), 0))
        return out


def window_name(window: memoryview) -> int:
    """Hash of one window, with a seed of its own so that it is no snippet's name."""
    return xxhash.xxh3_64_intdigest(window, seed=1)


def ranges_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _mark(table: pa.Table) -> pa.Table:
    """Ranges of repeated windows of each chunk's snippets in one bucket."""
    heads = [chunks.load(b, "<u8", "<u8", "<u4", "u1", "<u8", "u1") for b in table["body"].to_pylist()]
    routes, names, lengths, counts = [np.concatenate([h[i] for h in heads]) for i in range(4)]
    _, first, back = np.unique(names, return_index=True, return_inverse=True)
    times = np.bincount(back, counts.astype(np.int64))
    group, size = np.unique(routes[first], return_inverse=True, return_counts=True)[1:]
    mixed = size[group] > 1  # snippets that share their anchor with another
    windows = np.maximum(lengths[first].astype(np.int64) - LENGTH + 1, 1)
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {int(i): (np.array([0]), windows[i:i + 1]) for i in np.flatnonzero(times > 1)}
    wanted = np.flatnonzero(mixed)
    if len(wanted):
        texts: list[bytes] = []
        which = set(first[wanted].tolist())
        base = 0
        where: dict[int, bytes] = {}
        for h, packed in zip(heads, table["bytes"].to_pylist()):
            n = len(h[0])
            own = [i for i in range(n) if base + i in which]
            if own:
                data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(h[2].astype(np.int64).sum()) + 1)
                ends = np.cumsum(h[2].astype(np.int64))
                for i in own:
                    where[base + i] = data[ends[i] - h[2][i]:ends[i]]
            base += n
        texts = [where[i] for i in first[wanted].tolist()]
        repeated = RunLengthIndex(texts, LENGTH).matching_statistics() >= LENGTH
        at = 0
        for i, t in zip(wanted.tolist(), texts):
            if times[i] < 2:
                lo, hi = ranges_of(repeated[at:at + windows[i]])
                if len(lo):
                    found[i] = (lo, hi)
            at += len(t) + 1
    bodies, at = [], 0
    for h in heads:
        own = back[at:at + len(h[0])]
        rows = [(a, m, lo, hi, one) for a, m, one, i in zip(h[4].tolist(), h[1].tolist(), h[5].tolist(), own.tolist()) if i in found for lo, hi in zip(*found[i])]
        columns = list(zip(*rows)) if rows else [()] * 5
        bodies.append(chunks.dump(*[np.array(c, t) for c, t in zip(columns, MARKS)]))
        at += len(h[0])
    return pa.table([table["chunk"], pa.array(bodies, pa.binary())], names=["chunk", "body"])


def _remove(keep_text: bool):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [chunks.load(b, *MARKS) for b in answers["body"].to_pylist()]
        anchors = np.unique(np.concatenate([np.empty(0, np.uint64)] + [p[0] for p in parts]))
        hot = set(np.concatenate([np.empty(0, np.uint64)] + [p[0][p[4] > 0] for p in parts]).tolist())
        marks: dict[int, list[tuple[int, int]]] = {}
        for p in parts:
            for name, lo, hi in zip(p[1].tolist(), p[2].tolist(), p[3].tolist()):
                marks.setdefault(name, []).append((lo, hi))
        out = [[] for _ in range(6)]
        for ids, body in zip(texts["ids"].to_pylist(), texts["body"].to_pylist()):
            all_texts = chunks.unpack_texts(body)
            for s, data, begin, valid in windows_of(all_texts):
                step, view = np.zeros(len(data) + 1, np.int32), memoryview(data)
                for h, first, n in snippets(data, valid):
                    for i in np.flatnonzero(np.isin(h, anchors)).tolist():
                        if int(h[i]) in hot:
                            for j in range(first[i], first[i] + n[i]):
                                if window_name(view[j:j + LENGTH]) in marks:
                                    step[j] += 1
                                    step[j + LENGTH] -= 1
                            continue
                        for lo, hi in marks.get(xxhash.xxh3_64_intdigest(view[first[i]:first[i] + n[i] + LENGTH - 1]), ()):
                            step[first[i] + lo] += 1
                            step[first[i] + hi - 1 + LENGTH] -= 1
                gone = np.cumsum(step[:-1]) > 0
                for t, b in zip(all_texts[s], begin.tolist()):
                    mask = gone[b:b + len(t)]
                    kept = data[b:b + len(t)][~mask].tobytes() if mask.any() else t
                    out[1].append(len(t))
                    out[2].append(len(t) - len(kept))
                    out[3].append(len(ranges_of(mask)[0]))
                    out[4].append(hashlib.sha256(kept).hexdigest())
                    out[5].append(kept if keep_text else None)
            out[0] += ids
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string()),
                         pa.array(out[5], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, hot_chunks: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null unless ``keep_text``)."""
    buckets = chunks.bucket_count(docs.sparkSession)
    packs = chunks.pack(docs, _keys(buckets), id_col, text_col, "repeat-packs")
    shared = chunks.answer(chunks.keys_in(packs), ["bucket"], _shared(hot_chunks), "chunk long, bucket int, body binary")
    sent = chunks.rejoin(packs, shared, _send(buckets), "chunk long, bucket int, body binary, bytes binary")
    marked = materialise(chunks.answer(sent, ["bucket"], _mark, "chunk long, body binary"), "repeat-marks")
    return chunks.rejoin(packs, marked, _remove(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
