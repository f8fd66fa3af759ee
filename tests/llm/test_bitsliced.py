"""Top-k search over the bit-sliced index against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import bitsliced

SCHEMA = "vec_id long, embedding array<float>, block long, part string, rank int, score string, asked int"


def brute(rows, k=5, scale=256.0):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(kept):
        if i is not None and i % 50 == 0:
            scored = [(-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w)))), j is None, j or 0, j) for other, (j, w) in enumerate(kept) if other != at]
            out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r[:2], 1, "x", 2, "y", 3) for r in rows], SCHEMA)
    return sorted(map(tuple, bitsliced.top_k(df, F.col("vec_id") % 50 == 0, **more).collect()), key=str)


def vectors(n, dims, seed, spread=0.2):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dims)]) for i in range(n)]


def test_whole_table_in_blocks(spark):
    rows = vectors(300, 16, 1)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, block_rows=100, max_group=3) == brute(rows)


def test_awkward_vectors(spark):
    rng = random.Random(2)
    rows = vectors(120, 6, 3)
    rows += [(200, None), (250, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (300, [float("nan")] * 6), (301, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (350, [])]
    rows += [(400, [0.5, -0.5]), (None, [1.0] * 6), (None, [1.0] * 6), (50, [0.3] * 6), (50, [0.3] * 6)]
    rows += [(500 + i, [0.25] * 6) for i in range(90)]  # many ties, some of them queries
    rows += [(1000, [3e30, -1.0, 0.0, 0.0, 0.0, 0.0]), (1001, [-2e30, 2.0, 1.0, 1.0, 1.0, 1.0]), (1002, [1e9, 1e9, 1e9, 0.0, 0.0, 0.0])]  # too wide for slices
    rng.shuffle(rows)
    for more in ({}, {"block_rows": 16, "max_group": 2}, {"k": 300}):
        assert found(spark, rows, **more) == brute(rows, more.get("k", 5))


@pytest.mark.parametrize("spread", [0.001, 3.0, 4e5])
def test_ranges(spark, spread):
    rows = vectors(150, 5, 4, spread)
    assert found(spark, rows, block_rows=50) == brute(rows)


def test_few_rows_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0])]) == []
    assert found(spark, [(50, [1.0]), (51, [2.0])]) == [(50, 1, 51, 131072)]
    assert found(spark, [(51, [1.0]), (52, None)]) == []


def test_boundary_is_small():
    values = np.random.default_rng(5).normal(0, 32, (20_000, 64)).astype(np.int64)
    low, widths, slices = bitsliced.slice_columns(values)
    block = bitsliced.Block(list(range(len(values))), low, widths, slices, np.empty(0, np.int64), np.empty((0, 64)))
    assert (block.values == values).all()
    assert max(len(block.boundary(values[q], 5, q)) for q in range(0, 1000, 50)) < 2_000
