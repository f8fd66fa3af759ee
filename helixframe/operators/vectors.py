"""Embedding vectors: shift measures and principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.session import materialise

FAN_IN = 16
PART_DDL = "node long, width int, data array<double>"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def difference(wt: Column, mut: Column) -> Column:
    return F.zip_with(mut, wt, lambda m, w: m.cast("double") - w.cast("double"))


def cosine_and_shift(wt: Column, mut: Column) -> tuple[Column, Column]:
    """Cosine similarity (guarded norm product) and L2 norm of the difference."""
    d = difference(wt, mut)
    return _dot(wt, mut) / (F.sqrt(_dot(wt, wt)) * F.sqrt(_dot(mut, mut)) + 1e-8), F.sqrt(_dot(d, d))


def _summed(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _reduced(parts: DataFrame, combine: Callable[[np.ndarray], np.ndarray], name: str) -> np.ndarray:
    """Combine small matrices (node, data, flattened row by row ``width`` to a row) in a tree; only the root comes to the driver."""
    def merge(group: pa.Table) -> pa.Table:
        stacked = np.concatenate([np.array(d).reshape(-1, w) for d, w in zip(group["data"].to_pylist(), group["width"].to_pylist())])
        out = combine(stacked)
        return pa.table({"node": [group["up"][0].as_py()], "width": [out.shape[1]], "data": pa.array([out.ravel()], pa.list_(pa.float64()))},
                        schema=pa.schema([("node", pa.int64()), ("width", pa.int32()), ("data", pa.list_(pa.float64()))]))

    while True:
        parts = materialise(parts, name)
        last = (parts.agg(F.max("node")).first()[0] or 0) < FAN_IN
        up = parts.withColumn("up", F.floor(F.col("node") / FAN_IN).cast("long"))
        parts = up.groupBy("up").applyInArrow(merge, PART_DDL)
        if last:
            row = parts.first()
            return np.array(row["data"]).reshape(-1, row["width"]) if row else np.empty((0, 0))


def principal_axes(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the first ``k`` principal axes (rows) of a table of vectors, by tall-skinny QR.

    Every task reduces its centred rows to one triangular factor of the vectors' width;
    factors are stacked and factored again in a tree. The root's singular vectors are the
    axes. Nothing is squared, as a covariance would be, and the driver sees one small
    triangle. An axis points to where its largest component (the first on ties) is positive.
    """
    x = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            m = _summed(pa.Table.from_batches([batch]), "x")
            if len(m):
                part = np.append(m.sum(axis=0), len(m))
                total = part if total is None else total + part
        yield from _part(None if total is None else total[None])

    n = _reduced(x.mapInArrow(sums, PART_DDL), lambda m: m.sum(axis=0)[None], "vector-sums")
    if not n.size:
        return np.empty(0), np.empty((0, 0))
    mean = n[0, :-1] / n[0, -1]

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            m = _summed(pa.Table.from_batches([batch]), "x")
            if len(m):
                r = np.linalg.qr(m - mean if r is None else np.vstack([r, m - mean]), mode="r")
        yield from _part(r)

    r = _reduced(x.mapInArrow(factors, PART_DDL), lambda m: np.linalg.qr(m, mode="r"), "vector-factors")
    axes = np.linalg.svd(r, full_matrices=True)[2][:k]
    largest = np.argmax(np.round(np.abs(axes), 9), axis=1)
    return mean, axes * np.sign(axes[np.arange(len(axes)), largest])[:, None]


def _part(data: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if data is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([data.shape[1]], pa.int32()),
                                          pa.array([data.ravel()], pa.list_(pa.float64()))], ["node", "width", "data"])


def principal_components(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Centred vectors on at most ``k`` principal axes (never more than the width), as ``pca_components``; NULL vectors stay NULL."""
    mean, axes = principal_axes(df, vector, k)
    terms = F.array(*[F.array(*map(F.lit, a.tolist())) for a in axes]) if len(axes) else F.array().cast("array<array<double>>")
    centre = F.zip_with(F.col(vector), F.array(*map(F.lit, mean.tolist())) if len(mean) else F.array().cast("array<double>"), lambda x, m: x.cast("double") - m)
    out = df.withColumn("_c", centre)
    parts = F.transform(terms, lambda a: _dot(a, F.col("_c")))
    return out.withColumn("pca_components", F.when(F.col(vector).isNotNull(), parts)).drop("_c", vector)
