"""Quality classifier: ridge regression on random Fourier features of text statistics.

Statistics of whole texts are standardised and mapped by fixed random cosines that
approximate a Gaussian kernel. Every task sums its labelled rows into normal equations,
the sums meet in a tree, and one small system is solved. Ridge scores are turned into
probabilities by isotonic regression over fixed score bins of all training rows.

Null or empty texts get the statistics of an empty text and a score like any other;
a null id belongs to the training side but has no label; labels other than 0 and 1 are
ignored and several labels of one id averaged; without labels of both kinds every score
is the mean label (0.5 without any); repeated rows get equal scores; an empty table gives
an empty result; only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.llm.text import raw
from helixframe.session import materialise

FEATURES, RIDGE, BINS, SPAN = 256, 1e-3, 4096, (-1.0, 2.0)
_CLASS = np.zeros(256, np.int64)  # byte -> kind
for _kind, _bytes in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!?", b".", b",;:", b"\n", b" \t\v\f\r",
                                b"()[]{}'\"-_/\\@+=~^`", bytes(range(128, 256))], start=1):
    _CLASS[list(_bytes)] = _kind
KINDS = 12
NAMES = ["log_bytes", "log_words", "mean_length", "sd_length", "distinct_words", "top_word", "distinct_pairs", "capital_words", "marked_words",
         "single_letters", "line_length", "distinct_lines", "long_words"] + [f"kind_{i}" for i in range(1, KINDS)]


def statistics(text: str | None) -> list[float]:
    b = raw(text)
    n = max(1, len(b))
    kinds = np.bincount(_CLASS[np.frombuffer(b, np.uint8)], minlength=KINDS) if b else np.zeros(KINDS)
    words = b.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    uses: dict[bytes, int] = {}
    for w in words:
        uses[w] = uses.get(w, 0) + 1
    distinct = list(uses)
    marked = sum(uses[w] for w in distinct if w[-1:] in b"#*$%&!|")
    capital = sum(uses[w] for w in distinct if len(w) > 1 and w.isupper())
    lines = b.split(b"\n")
    return [math.log1p(len(b)), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), len(uses) / k, max(uses.values(), default=0) / k,
            len(set(zip(words, words[1:]))) / k, capital / k, marked / k, float((lengths == 1).sum()) / k, math.log1p(n / len(lines)),
            len(set(lines)) / len(lines), float((lengths > 15).sum()) / k, *(kinds[1:] / n).tolist()]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "held_out", "x"])


def fold(id_col: str, modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def _sum_blobs(keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v) for v in table["v"].to_pylist()], axis=0)
        return pa.table([table[k][:1] for k in keys] + [pa.array([total.tobytes()], pa.binary())], names=[*keys, "v"])
    return run


def summed(df: DataFrame) -> dict[int, np.ndarray]:
    """Vectors (part, i, v) of all tasks, added by i in two levels; the driver gets one per i."""
    first = df.withColumn("part", F.col("part") % 64).groupBy("i", "part").applyInArrow(_sum_blobs(["i", "part"]), "i int, part long, v binary")
    last = first.groupBy("i").applyInArrow(_sum_blobs(["i"]), "i int, v binary")
    return {r["i"]: np.frombuffer(r["v"]) for r in last.collect()}


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    seed: int = 0
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    base: float = 0.5

    def cosines(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        d = x.shape[1]
        w = rng.standard_normal((d, FEATURES)) / math.sqrt(d)
        z = np.clip((x - self.mean) / self.scale, -4, 4) @ w + rng.uniform(0, 2 * math.pi, FEATURES)
        return np.hstack([math.sqrt(2 / FEATURES) * np.cos(z), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        r = self.ridge(x)
        # A thousandth of the order inside a step is kept, so that equal steps still rank.
        return np.clip(0.999 * np.interp(r, *self.knots) + 0.001 / (1 + np.exp(-4 * (r - 0.5))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pooling of adjacent violators; knots at the blocks' weighted means."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _arrays(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch["x"].flatten()).reshape(len(batch), -1)


def fit(train: DataFrame, seed: int = 0) -> Model:
    """``train``: x array<double>, y double, all labelled rows of the training side."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros(2 * len(NAMES) + 3)
        for b in batches:
            x, y = _arrays(b), np.asarray(b["y"])
            if len(x):
                total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x), y.sum(), ((y > 0) & (y < 1)).sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "i", "v"])

    ddl = "part long, i int, v binary"
    total = summed(train.mapInArrow(moments, ddl)).get(0)
    d = len(NAMES)
    if total is None or total[2 * d] == 0:
        return Model(np.zeros(d), np.ones(d))
    n, positive = total[2 * d], total[2 * d + 1]
    mean = total[:d] / n
    sd = np.sqrt(np.maximum(total[d:2 * d] / n - mean * mean, 0))
    model = Model(mean, np.where(sd > 1e-9, sd, 1.0), seed, base=float(positive / n))
    if positive == 0 or positive == n:
        return model

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        a = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            if len(b):
                z = model.cosines(_arrays(b))
                a += z.T @ np.hstack([z, np.asarray(b["y"])[:, None]])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(a), pa.int64()), pa.array(range(len(a)), pa.int32()), pa.array([r.tobytes() for r in a], pa.binary())], ["part", "i", "v"])

    rows = summed(train.mapInArrow(equations, ddl))
    a = np.stack([rows[i] for i in range(FEATURES + 1)])
    penalty = RIDGE * n / FEATURES * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(a[:, :-1] + penalty, a[:, -1])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros((BINS, 2))
        for b in batches:
            if len(b):
                at = np.clip((model.ridge(_arrays(b)) - SPAN[0]) / (SPAN[1] - SPAN[0]) * BINS, 0, BINS - 1).astype(int)
                total[:, 0] += np.bincount(at, minlength=BINS)
                total[:, 1] += np.bincount(at, np.asarray(b["y"]), BINS)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "i", "v"])

    total = summed(train.mapInArrow(bins, ddl))[0].reshape(BINS, 2)
    used = np.flatnonzero(total[:, 0])
    centre = SPAN[0] + (used + 0.5) / BINS * (SPAN[1] - SPAN[0])
    model.knots = isotonic(centre, total[used, 1] / total[used, 0], total[used, 0])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    x = materialise(rows.mapInArrow(_statistics, "doc_id long, held_out boolean, x array<double>"), "quality-statistics")
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(label_col).alias("y"))
    model = fit(x.filter("not held_out").join(known, "doc_id").select("x", "y"), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_arrays(b)) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return x.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
