"""Exact top-k inner products over a bit-sliced index.

The index holds blocks of rows. In a block every attribute (vector component, quantised
to an integer) is kept as bit slices: bitmap b of attribute i has one bit per row, bit b
of the value above the attribute's least one. A query's score is then a weighted sum of
bitmaps: each signed binary digit of its component i adds the attribute's slices, or for
a negative digit their complements, at the digit's weight. Bitmaps of one weight are
added three to two, carries go to the next weight, and the sum is again one slice per
weight. The least weights are left out as long as what they could add stays below the
spread of the scores; walking the sum's slices from the most significant down finds the
k-th largest partial sum, and every row whose partial sum could still reach it is a
boundary row, resolved by its exact integer product. No row is lost by the shortcut.

Queries meet the index in blocks: groups of queries times blocks of rows, each pair one
task's work of bounded size. A block answers with its best k rows, and only those meet.

Vectors that are null, or hold null or non-finite components, take no part. Shorter ones
count as padded with zeros, an empty one is all zeros. Rows are told apart by their place
in the index: of rows with equal ids each is searched and found for itself. Ties go to
the smaller id, null ids last. Vectors with a quantised component so large that products
might leave a long's range are not sliced but multiplied as whole numbers, and scores are
clipped to that range.
An empty table gives an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixframe.session import materialise

BLOCK_ROWS = 32_768
MAX_GROUP = 8_192  # queries that one task holds at most
INDEX = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("asked", pa.list_(pa.int32())), ("lows", pa.list_(pa.int64())),
                   ("widths", pa.list_(pa.int32())), ("slices", pa.binary()), ("wide_rows", pa.list_(pa.int32())), ("wide", pa.binary())])
INDEX_DDL = ("block long, ids array<long>, asked array<int>, lows array<long>, widths array<int>, slices binary, "
             "wide_rows array<int>, wide binary")
QUERY = pa.schema([("home", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vector", pa.list_(pa.float64()))])
QUERY_DDL = "home long, place int, query_id long, vector array<double>"
FOUND_DDL = "home long, place int, query_id long, vec_id long, score long"


def slice_columns(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and number of slices of each column, and all slices as rows of 64-bit words."""
    n, dims = values.shape
    words = -(-n // 64)
    lows = values.min(axis=0) if n else np.zeros(dims, np.int64)
    above = values - lows
    widths = np.array([int(x).bit_length() for x in above.max(axis=0)], np.int64) if n else np.zeros(dims, np.int64)
    out = np.zeros((int(widths.sum()), words * 8), np.uint8)
    at = 0
    for i, width in enumerate(widths.tolist()):
        bits = (above[:, i][None, :] >> np.arange(width)[:, None]) & 1
        out[at:at + width, :-(-n // 8)] = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
        at += width
    return lows, widths, out.view(np.uint64)


def signed_digits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the digits +1 and -1 of non-negative numbers, no two of them adjacent."""
    half = x >> 1
    three = x + half
    change = half ^ three
    return three & change, half & change


def limit(dims: int) -> float:
    """Components below it in size give products that fit a long."""
    return 2.0 ** ((61 - dims.bit_length()) // 2)


class Block:
    """One block of the index, ready to be searched."""

    def __init__(self, ids: list, lows: np.ndarray, widths: np.ndarray, slices: np.ndarray, wide_rows: np.ndarray, wide: np.ndarray):
        self.n, self.dims, self.slices, self.words = len(ids), len(lows), slices, slices.shape[1]
        self.order = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        self.missing = np.array([i is None for i in ids], bool)
        self.attribute = np.repeat(np.arange(self.dims), widths)
        self.bit = np.arange(len(slices)) - np.repeat(np.cumsum(widths) - widths, widths)
        self.wide_rows, self.wide = wide_rows, wide
        self.values = np.tile(lows, (self.n, 1))
        for row, i, bit in zip(slices, self.attribute.tolist(), self.bit.tolist()):
            self.values[:, i] += np.unpackbits(row.view(np.uint8), count=self.n, bitorder="little").astype(np.int64) << bit
        self.variance = self.values.var(axis=0) if self.n else np.zeros(self.dims)
        valid = np.zeros(self.words * 64, np.uint8)
        valid[:self.n] = 1
        valid[wide_rows] = 0
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Quantised vectors of some rows."""
        out = self.values.astype(np.float64)
        out[self.wide_rows] = self.wide
        return out[rows]

    def sum_slices(self, query: np.ndarray, least: float) -> tuple[list[np.ndarray], int, int]:
        """Slices of the partial sums, the weight of the first, and what the weights left out add at most."""
        size, sign = np.abs(query), query < 0
        plus, minus = signed_digits(size)
        rows, weights, turned = [], [], []
        for j in range(int(size.max(initial=0)).bit_length() + 1):
            up, down = (plus >> j & 1).astype(bool), (minus >> j & 1).astype(bool)
            picked = np.flatnonzero((up | down)[self.attribute])
            rows.append(picked)
            weights.append(self.bit[picked] + j)
            turned.append((down ^ sign)[self.attribute[picked]])
        rows, weights, turned = np.concatenate(rows), np.concatenate(weights), np.concatenate(turned)
        counts = np.bincount(weights, minlength=1)
        first, rest = 0, 0
        while first < len(counts) - 1 and rest + (int(counts[first]) << first) <= least:
            rest += int(counts[first]) << first
            first += 1
        order = np.argsort(weights, kind="stable")
        cuts = np.searchsorted(weights[order], np.arange(len(counts) + 1))
        flip = np.where(turned, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        out, carried, w = [], [], first
        while w < len(counts) or carried:
            parts = carried
            carried = []
            if w < len(counts) and cuts[w + 1] > cuts[w]:
                own = order[cuts[w]:cuts[w + 1]]
                parts = [*parts, self.slices[rows[own]] ^ flip[own][:, None]]
            x = np.concatenate(parts) if parts else np.zeros((1, self.words), np.uint64)
            while len(x) > 2:
                t = len(x) // 3
                a, b, c = x[:t], x[t:2 * t], x[2 * t:3 * t]
                u = a ^ b
                carried.append((a & b) | (u & c))
                x = np.concatenate([u ^ c, x[3 * t:]])
            if len(x) == 2:
                carried.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
            out.append(x[0])
            w += 1
        return out, first, rest

    def boundary(self, query: np.ndarray, k: int, own: int | None) -> np.ndarray:
        """Rows outside the wide ones that may be among the best k."""
        open_rows = self.valid
        if own is not None:
            open_rows = open_rows.copy()
            open_rows[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        spread = float(np.sqrt((query.astype(np.float64) ** 2 * self.variance).sum()))
        sums, first, rest = self.sum_slices(query, spread)
        if int(np.bitwise_count(open_rows).sum()) > k:
            level, left, equal = 0, k, open_rows
            for w in range(len(sums) - 1, -1, -1):
                high = equal & sums[w]
                n = int(np.bitwise_count(high).sum())
                if n >= left:
                    level, equal = level | 1 << w, high
                else:
                    left, equal = left - n, equal & ~sums[w]
            level = max(0, level - (-(-rest >> first)))
            above, equal = np.zeros_like(open_rows), open_rows
            for w in range(len(sums) - 1, -1, -1):
                if level >> w & 1:
                    equal = equal & sums[w]
                else:
                    above |= equal & sums[w]
                    equal = equal & ~sums[w]
            open_rows = above | equal
        return np.flatnonzero(np.unpackbits(open_rows.view(np.uint8), bitorder="little"))

    def best(self, query: np.ndarray, k: int, own: int | None = None) -> list[tuple[int, int]]:
        """(row, score) of the best k rows, the query's own row left out."""
        query = np.concatenate([query[:self.dims], np.zeros(max(0, self.dims - len(query)))])
        wide = bool((np.abs(query) >= limit(self.dims)).any())
        rows = np.setdiff1d(np.arange(self.n), self.wide_rows) if wide else self.boundary(query.astype(np.int64), k, own)
        scores = whole_products(self.values[rows], query) if wide else (self.values[rows] @ query.astype(np.int64)).tolist()
        scored = chain(zip(rows.tolist(), scores), zip(self.wide_rows.tolist(), whole_products(self.wide, query)))
        missing, order = self.missing, self.order
        return [(r, -s) for s, _, _, r in heapq.nsmallest(k, ((-s, missing[r], order[r], r) for r, s in scored if r != own))]


def whole_products(values: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of numbers of any size, clipped to the range of a long."""
    whole = [int(x) for x in query]
    return [max(-2 ** 63, min(2 ** 63 - 1, sum(int(a) * b for a, b in zip(row, whole)))) for row in values.tolist()]


def quantise(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Quantised vectors, zero-padded to one length, and which rows take part."""
    flat = vectors.flatten()
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    good = ~np.asarray(vectors.is_null())
    good[row[~np.isfinite(values)]] = False
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    keep = good[row]
    with np.errstate(over="ignore"):
        out[row[keep], column[keep]] = np.floor(scale * values[keep])
    return out, good


def build_index(vectors: DataFrame, asked: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                scale: float = 256.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Written table with one row per block: ids, slices and exact values of its rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    blocks = max(1, -(-rows.count() // block_rows))
    rows = rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))

    def pack(group: pa.Table) -> pa.Table:
        values, good = quantise(group["vector"].combine_chunks(), scale)
        values = values[good]
        wide_rows = np.flatnonzero((np.abs(values) >= limit(values.shape[1])).any(axis=1))
        small = values.copy()
        small[wide_rows] = 0
        lows, widths, slices = slice_columns(small.astype(np.int64))
        kept = pa.array(good)
        row = {"block": group["block"][0].as_py(), "ids": group["id"].filter(kept).to_pylist(),
               "asked": np.flatnonzero(group["asked"].filter(kept).to_numpy()).tolist(), "lows": lows.tolist(), "widths": widths.tolist(),
               "slices": slices.tobytes(), "wide_rows": wide_rows.tolist(), "wide": values[wide_rows].tobytes()}
        return pa.table({k: [v] for k, v in row.items()}, schema=INDEX)

    return materialise(rows.groupBy("block").applyInArrow(pack, INDEX_DDL), "bit-slices")


def load_block(row: dict) -> Block:
    words, widths, wide_rows = -(-len(row["ids"]) // 64), np.array(row["widths"], np.int64), np.array(row["wide_rows"], np.int64)
    return Block(row["ids"], np.array(row["lows"], np.int64), widths, np.frombuffer(row["slices"], np.uint64).reshape(int(widths.sum()), words),
                 wide_rows, np.frombuffer(row["wide"]).reshape(len(wide_rows), len(widths)))


def queries_in(index: DataFrame) -> DataFrame:
    """Written table of the rows to search for: their block, place in it, id and quantised vector."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["asked"], np.int64)
                columns = [[row["block"]] * len(at), at.tolist(), [row["ids"][i] for i in at], load_block(row).vectors(at).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, QUERY)], schema=QUERY)

    return materialise(index.mapInArrow(take, QUERY_DDL), "bit-queries")


def top_k(vectors: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, block_rows: int = BLOCK_ROWS, max_group: int = MAX_GROUP) -> DataFrame:
    """query_id, rank, vec_id and score of the best k other rows for every row for which ``asked`` holds."""
    spark = vectors.sparkSession
    index = build_index(vectors, asked, id_col, vector_col, scale, block_rows)
    queries = queries_in(index)
    blocks, wanted = (index.agg(F.max("block")).first()[0] or 0) + 1, queries.count()
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-wanted // min(max_group, max(64, wanted * blocks // tasks))))
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sent = (queries.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))

    def search(questions: pa.Table, block: pa.Table) -> pa.Table:
        found = {"home": [], "place": [], "query_id": [], "vec_id": [], "score": []}
        if len(block) and len(questions):
            row = block.to_pylist()[0]
            held, ids = load_block(row), row["ids"]
            for home, place, query_id, vector in zip(*[questions[c].to_pylist() for c in ("home", "place", "query_id", "vector")]):
                for at, score in held.best(np.array(vector, np.float64), k, place if home == row["block"] else None):
                    for name, v in zip(found, (home, place, query_id, ids[at], score)):
                        found[name].append(v)
        return pa.table({name: pa.array(v, pa.int32() if name == "place" else pa.int64()) for name, v in found.items()})

    pairs = sent.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(search, FOUND_DDL)
    best = W.partitionBy("home", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
