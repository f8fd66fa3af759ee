"""Language-model scoring by prediction by partial matching.

The model is the trie of all byte contexts up to ORDER bytes in the training texts. The
probability of a byte starts at the longest context that was seen; with n counts of
d symbols, method C gives a symbol count / (n + d) and the escape d / (n + d); after an
escape the symbols of the longer context are excluded from the shorter one, and after
the empty context the rest of the 256 bytes are equally likely. Counts are full, so a
context's symbols are a subset of its suffix's, and exclusion is subtraction.

Contexts live in buckets of their last two bytes, words in buckets of their hash. Each
chunk of texts sends its distinct grams and words with training counts; counts merge in
a tree of fixed fan-in; the merged model of a bucket answers the chunks in slices of
bounded size. Only counts of byte pairs (65,536 at most) and totals reach the driver.

A text is lower-cased (A-Z), starts after ORDER line ends and is closed by byte 0, the end. A
null text is empty and still has its end; a null id counts as the empty string when
documents are divided; repeated rows count and score each; an empty table gives an empty
result; without training documents all bytes are equally likely; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from helixframe.llm import chunks
from helixframe.llm.text import LOWER, mix, word_hashes
from helixframe.session import materialise

ORDER = 5
FAN_IN = 64
PIECE = 1 << 21  # bytes looked at together
LN10 = np.log(10.0)


def squeeze(values: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, and columns beside them, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    body = planes.tobytes() + b"".join(np.ascontiguousarray(m.view(np.uint8).reshape(len(values), m.itemsize).T).tobytes() for m in more)
    return np.array([len(values)], "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def expand(data: bytes, *types: str) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), np.uint8)
    out, at = [], 0
    for i, t in enumerate(("<u8", *types)):
        w = np.dtype(t).itemsize
        column = np.ascontiguousarray(body[at:at + n * w].reshape(w, n).T).view(t).reshape(-1)
        out.append(np.cumsum(column, dtype=np.uint64) if i == 0 else column)
        at += n * w
    return out


def total_by_value(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.diff(values, prepend=values[:1] ^ np.uint64(1))) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ORDER line ends and before its end; first coded position of each."""
    data = np.frombuffer(b"".join([b"\n" * ORDER + t + b"\0" for t in texts]), np.uint8)
    sizes = np.array([len(t) + ORDER + 1 for t in texts], np.int64)
    return data, np.cumsum(sizes) - sizes + ORDER


def grams_at(data: np.ndarray) -> np.ndarray:
    """The ORDER bytes before and at each position from ORDER on, as one number."""
    g = data[:len(data) - ORDER].astype(np.uint64)
    for k in range(1, ORDER + 1):
        g <<= np.uint64(8)
        g |= data[k:len(data) - ORDER + k]
    return g


def gram_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return chunks.place((grams >> np.uint64(8)) & np.uint64(0xFFFF), buckets)[0]


def word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return buckets + chunks.place(words, buckets)[0]


def _pieces(texts: list[bytes]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def distinct_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = [], []
    for s in _pieces(texts):
        data, first = padded(texts[s])
        g = grams_at(data)
        coded = np.ones(len(g), bool)  # positions inside a text, not in the padding of the next
        for f in first[1:]:
            coded[f - 2 * ORDER:f - ORDER] = False
        v, c = np.unique(g[coded], return_counts=True)
        values.append(v)
        counts.append(c)
    return total_by_value(np.concatenate(values), np.concatenate(counts)) if values else (np.empty(0, np.uint64), np.empty(0, np.int64))


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = zip(*[np.unique(np.concatenate([word_hashes(t) for t in texts[s]]), return_counts=True) for s in _pieces(texts)]) if texts else ((), ())
    return total_by_value(np.concatenate(values), np.concatenate(counts)) if values else (np.empty(0, np.uint64), np.empty(0, np.int64))


def all_values(texts: list[bytes], train: list[bool], distinct) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of all texts, with their counts in the training ones."""
    known, rest = distinct([t for t, x in zip(texts, train) if x]), distinct([t for t, x in zip(texts, train) if not x])
    return total_by_value(np.concatenate([known[0], rest[0]]), np.concatenate([known[1], np.zeros(len(rest[0]), np.int64)]))


def _keys(buckets: int):
    def keys_of(texts: list[bytes], given: list[int]):
        texts = [t.translate(LOWER) for t in texts]
        train = [bool(x) for x in given]
        keys = []
        for distinct, bucket in ((distinct_grams, gram_bucket), (distinct_words, word_bucket)):
            values, counts = all_values(texts, train, distinct)
            keys += [(b, squeeze(values[at], counts[at].astype("<u8"))) for b, at in chunks.by_bucket(bucket(values, buckets), 2 * buckets)]
        return keys, given, None
    return keys_of


def _merge(table: pa.Table) -> pa.Table:
    parts = [expand(b, "<u8") for b in table["body"].to_pylist()]
    values, counts = total_by_value(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    known = counts > 0
    body = squeeze(values[known], counts[known].astype("<u8"))
    return pa.table([table["bucket"][:1], table["slice"][:1], pa.array([body], pa.binary())], names=["bucket", "slice", "body"])


def merged(keys: DataFrame) -> DataFrame:
    """One model (bucket, body) per bucket; never more than about FAN_IN tables meet in a task."""
    slices = max(1, keys.agg(F.countDistinct("chunk")).first()[0])
    state = keys.withColumn("slice", F.xxhash64("chunk"))
    while True:
        slices = -(-slices // FAN_IN)
        state = state.withColumn("slice", F.pmod(F.col("slice"), F.lit(slices)).cast("long")).select("bucket", "slice", "body")
        state = materialise(state.groupBy("bucket", "slice").applyInArrow(_merge, "bucket int, slice long, body binary"), "model")
        if slices == 1:
            return state.select("bucket", "body")


class Level:
    """Counts of one context length: contexts with total, number of symbols and exclusion sum."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        contexts = grams >> np.uint64(8)
        first = np.flatnonzero(np.diff(contexts, prepend=contexts[:1] ^ np.uint64(1))) if len(contexts) else np.empty(0, np.int64)
        self.contexts = contexts[first]
        self.n = np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)
        self.d = np.diff(np.append(first, len(grams)))
        self.first = first

    def count(self, grams: np.ndarray) -> np.ndarray:
        return _look_up(self.grams, self.counts, grams)

    def exclude(self, parent: "Level", symbols: int) -> None:
        """Counts that the parent context gives to each context's symbols."""
        in_parent = parent.count(self.grams & np.uint64((1 << 8 * symbols) - 1))
        self.excluded = np.add.reduceat(in_parent, self.first) if len(self.first) else np.empty(0, np.int64)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.int64)


def build_levels(grams: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> list[Level]:
    """Levels 0..ORDER; levels 0 and 1 come from the counts of byte pairs of all buckets."""
    levels = [Level(*total_by_value(pairs[0] & np.uint64(0xFF), pairs[1])), Level(*pairs)]
    for k in range(2, ORDER + 1):
        levels.append(Level(*total_by_value(grams & np.uint64((1 << 8 * (k + 1)) - 1), counts)))
    for k in range(1, ORDER + 1):
        levels[k].exclude(levels[k - 1], k)
    levels[0].excluded = np.zeros(len(levels[0].n), np.int64)
    return levels


def log_probabilities(levels: list[Level], grams: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each gram's last byte after the others."""
    out = np.zeros(len(grams))
    todo = np.arange(len(grams))
    less_n, less_d = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for k in range(ORDER, -1, -1):
        level, g = levels[k], grams[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
        c = g >> np.uint64(8)
        n, d = _look_up(level.contexts, level.n, c), _look_up(level.contexts, level.d, c)
        seen = n > 0
        free_n, free_d = n - less_n[todo], d - less_d[todo]
        total = np.maximum(free_n + free_d, 1)
        own = level.count(g)
        hit = seen & (own > 0)
        out[todo[hit]] += np.log(own[hit] / total[hit])
        miss = seen & ~hit & (free_d > 0)
        out[todo[miss]] += np.log(free_d[miss] / total[miss])
        less_n[todo[seen]] = _look_up(level.contexts, level.excluded, c)[seen]
        less_d[todo[seen]] = d[seen]
        todo = todo[~hit]
    out[todo] -= np.log(np.maximum(256 - less_d[todo], 1))
    return out


def _answer(buckets: int, pairs: tuple[np.ndarray, np.ndarray]):
    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["chunk", "bucket", "body"])
        bucket = asked["bucket"][0].as_py()
        values, counts = expand(model["body"][0].as_py(), "<u8") if model.num_rows else (np.empty(0, np.uint64), np.empty(0, np.int64))
        counts = counts.astype(np.int64)
        levels = build_levels(values, counts, pairs) if bucket < buckets else None
        bodies = []
        for body in asked["body"].to_pylist():
            wanted = expand(body, "<u8")[0]
            found = log_probabilities(levels, wanted) if levels else _look_up(values, counts, wanted)
            bodies.append(found.astype("<f4" if levels else "<i8").tobytes())
        return pa.table([asked["chunk"], asked["bucket"], pa.array(bodies, pa.binary())], names=["chunk", "bucket", "body"])
    return run


class Finder:
    """Position of 64-bit values in a sorted array, through a table of 2 ** 22 slots."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.slots = np.zeros(1 << 22, np.int32)
        self.slots[self._slot(values)] = np.arange(len(values), dtype=np.int32)

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(wanted)].astype(np.int64)
        other = np.flatnonzero(self.values[at] != wanted)
        at[other] = np.searchsorted(self.values, wanted[other])
        return at


def _in_order(values: np.ndarray, to: np.ndarray, answers: dict[int, bytes], buckets: int, kind: str) -> np.ndarray:
    out = np.zeros(len(values), kind)
    for b, at in chunks.by_bucket(to, 2 * buckets):
        out[at] = np.frombuffer(answers[b], kind)
    return out


def _score(buckets: int, tokens: int, distinct: int, ends: int):
    log_all = np.log10(tokens + distinct + 1)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        replies = dict(zip(answers["bucket"].to_pylist(), answers["body"].to_pylist()))
        out = [[] for _ in range(6)]
        for ids, given, body in zip(texts["ids"].to_pylist(), texts["sizes"].to_pylist(), texts["body"].to_pylist()):
            lowered = [t.translate(LOWER) for t in chunks.unpack_texts(body)]
            train = [bool(x) for x in given]
            grams, words = all_values(lowered, train, distinct_grams)[0], all_values(lowered, train, distinct_words)[0]
            log_p = _in_order(grams, gram_bucket(grams, buckets), replies, buckets, "<f4").astype(float)
            counts = _in_order(words, word_bucket(words, buckets), replies, buckets, "<i8")
            find_gram, find_word, log_c = Finder(grams), Finder(words), np.log10(counts + 1)
            for s in _pieces(lowered):
                part = lowered[s]
                data, first = padded(part)
                stops = first + np.array([len(t) + 1 for t in part])
                g = grams_at(data)
                inside = np.zeros(len(g) + 1, np.int8)
                inside[first - ORDER] += 1
                inside[stops - ORDER] -= 1
                coded = np.cumsum(inside[:-1]).astype(bool)
                sums = np.concatenate([[0.0], np.cumsum(log_p[find_gram(g[coded])])])
                ends_at = np.cumsum([len(t) + 1 for t in part])
                starts_at = ends_at - np.array([len(t) + 1 for t in part])
                for i, t in enumerate(part):
                    w = find_word(word_hashes(t)) if t else np.empty(0, np.int64)
                    n = len(w) + 1
                    out[0].append(n)
                    out[1].append(int((counts[w] > 0).sum()) + (ends > 0))
                    out[2].append(float(log_c[w].sum() + np.log10(ends + 1) - n * log_all))
                    out[3].append(float(sums[ends_at[i]] - sums[starts_at[i]]) / LN10)
            out[4] += ids
            out[5] += [not x for x in train]
        return pa.table([pa.array(out[4], pa.int64()), pa.array(out[5], pa.bool_()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                         pa.array([tokens] * len(out[0]), pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    buckets = chunks.bucket_count(docs.sparkSession)
    train = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 != 2).cast("long")
    packs = chunks.pack(docs, _keys(buckets), id_col, text_col, "model-packs", train)
    keys = chunks.keys_in(packs)
    models = merged(keys)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, body in zip(batch["bucket"].to_pylist(), batch["body"].to_pylist()):
                values, counts = expand(body, "<u8")
                if bucket < buckets:
                    values, counts = total_by_value(values & np.uint64(0xFFFF), counts)
                else:
                    values, counts = np.array([1 << 20, 1 << 21], np.uint64), np.array([counts.sum(), len(counts)])
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], ["value", "n"])
    rows = models.mapInArrow(totals, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()  # byte pairs and two totals
    total = {r["value"]: r["n"] for r in rows}
    words, distinct = total.pop(1 << 20, 0), total.pop(1 << 21, 0)
    ends = chunks.texts_of(packs).select(F.explode("sizes").alias("t")).agg(F.sum("t").alias("n")).first()["n"] or 0
    order = sorted(total)
    pairs = np.array(order, np.uint64), np.array([total[v] for v in order], np.int64)

    slices = -(-max(1, keys.agg(F.countDistinct("chunk")).first()[0]) // FAN_IN)
    asked = keys.withColumn("slice", F.pmod(F.xxhash64("chunk"), F.lit(slices)))
    copies = models.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    answers = asked.groupBy("bucket", "slice").cogroup(copies.groupBy("bucket", "slice")).applyInArrow(_answer(buckets, pairs), "chunk long, bucket int, body binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.rejoin(packs, answers, _score(buckets, words + ends, distinct + (ends > 0), ends), schema)
