"""Line dedup by pairwise alignment.

Documents that share lines are found through hashes of lines (``min_line_chars`` or more)
and of runs of lines: the shortest from each line on and up to each line that have
``min_block_chars``. Each line of a long enough block lies in such a run of the block.
A hash pairs every later holder with the earliest one, so pairs grow with the lines, no
holder is left out, and what a document loses to an earlier one does not depend on how
many others hold the same lines. A pair is aligned by patience diff (lines unique on both
sides, longest increasing subsequence, recursion between them); runs of aligned lines
with ``min_block_chars`` characters or more are deleted from the later document. An
alignment keeps one order, so blocks that changed places are not all found at once:
shared runs that still hold a line not deleted are aligned again by themselves, with the
other lines masked, until nothing more is deleted. The earliest document keeps its lines.

Lines are compared without outer white space; blank lines find no partner but may be
part of a block. Documents order by id, then text hash, null ids first; rows equal in
both are one document and all keep what it keeps; null texts have no lines and stay null;
an empty table gives an empty result; other columns, whatever their names, are neither
read nor changed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.llm.rows import boxed, unboxed, without_lines
from helixframe.llm.text import mix, signed
from helixframe.session import materialise

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal lines, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, start, end = todo.pop()
        while lo < hi and start < end and a[lo] == b[start]:
            out.append((lo, start))
            lo, start = lo + 1, start + 1
        while lo < hi and start < end and a[hi - 1] == b[end - 1]:
            hi, end = hi - 1, end - 1
            out.append((hi, end))
        if lo == hi or start == end:
            continue
        left, right = Counter(a[lo:hi]), Counter(b[start:end])
        at = {b[j]: j for j in range(start, end) if right[b[j]] == 1}
        unique = [(i, at[a[i]]) for i in range(lo, hi) if left[a[i]] == 1 and a[i] in at]
        anchors = _longest_rising(unique)
        if not anchors:
            continue
        edges = [(lo - 1, start - 1), *anchors, (hi, end)]
        out += anchors
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    tops, piles, back = [], [], {}
    for n, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[n] = piles[p - 1] if p else None
        if p == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[p], piles[p] = j, n
    out, n = [], piles[-1] if piles else None
    while n is not None:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def common_blocks(a: list[int], sizes: list[int], b: list[int], min_chars: int) -> list[int]:
    """Lines of ``a`` in aligned blocks that are long enough."""
    out, run = [], []
    for i, j in [*patience(a, b), (-2, -2)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(sizes[x] for x, _ in run) >= min_chars:
                out += [x for x, _ in run]
            run = []
        run.append((i, j))
    return out


def run_hashes(hashes: np.ndarray, sizes: np.ndarray, min_line: int, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and line after of each seed: lines of ``min_line`` characters or more, and the shortest runs from each line
    on and up to each line that have ``min_chars``."""
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    full = np.flatnonzero(sizes > 0)
    need = max(1, min_chars)
    alone = np.flatnonzero(sizes >= max(1, min_line))
    first = np.concatenate([full, np.searchsorted(ends, ends[full + 1] - need, "right") - 1])
    last = np.concatenate([np.searchsorted(ends, ends[full] + need, "left"), full + 1])  # line after the run
    ok = (first >= 0) & (last < len(ends))
    first, last = np.concatenate([alone, first[ok]]), np.concatenate([alone + 1, last[ok]])
    if not len(first):
        return np.empty(0, np.int64), first, last
    first, last = np.unique(np.stack([first, last]), axis=1)
    powers, back = (np.cumprod(np.append(np.uint64(1), np.full(len(hashes), x, np.uint64)), dtype=np.uint64) for x in (_STEP, _BACK))
    total = np.append(np.uint64(0), np.cumsum(mix(hashes.view(np.uint64)) * powers[:-1], dtype=np.uint64))
    return signed(mix((total[last] - total[first]) * back[first] + np.uint64(_STEP))), first, last


def _seeds(min_line: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, n in zip(batch["h"], batch["n"]):
                found.append(run_hashes(h.values.to_numpy(zero_copy_only=False).astype(np.int64), n.values.to_numpy(zero_copy_only=False).astype(np.int64), min_line, min_chars))
            counts = [len(f[0]) for f in found]
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            columns = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch["id"].take(owner), batch["k"].take(owner), pa.array(columns[0], pa.int64()), pa.array(columns[1].astype(np.int32)),
                                              pa.array(columns[2].astype(np.int32))], ["id", "k", "seed", "first", "last"])
    return run


def text_key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line_chars: int = 20, min_block_chars: int = 40) -> DataFrame:
    """key (id, text hash), lines (sorted positions to delete) of documents that lose some."""
    # 0 stands for a blank line.
    line = F.transform(F.split(text_col, "\n", -1), lambda x: F.struct(
        F.when(F.length(F.trim(x)) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.trim(x))).alias("h"), F.length(F.trim(x)).alias("n")))
    lined = docs.filter(F.col(text_col).isNotNull()).select(text_key(id_col, text_col).alias("key"), line.alias("l"))
    lined = materialise(lined.select("key", F.col("l.h").alias("h"), F.col("l.n").alias("n")), "lines")
    lined = materialise(lined.dropDuplicates(["key"]), "lines-once")
    seeds = lined.select(F.col("key.id").alias("id"), F.col("key.h").alias("k"), "h", "n").mapInArrow(
        _seeds(min_line_chars, min_block_chars), "id long, k long, seed long, first int, last int")
    seeds = materialise(seeds.select(F.struct("id", F.col("k").alias("h")).alias("key"), "seed", "first", "last"), "line-seeds")
    held = seeds.groupBy("seed").agg(F.min("key").alias("earlier"), F.max("key").alias("latest")).filter("earlier != latest").drop("latest")
    held = materialise(held, "shared-seeds")  # written first, so that the join sees two plain sides and can split a hot seed
    shared = materialise(seeds.join(held, "seed").filter("key != earlier").select(F.col("key").alias("later"), "earlier", "first", "last").distinct(), "line-pairs")

    gone, asked = None, shared.groupBy("later", "earlier").agg(F.lit(None).cast("array<struct<first:int,last:int>>").alias("only"))
    while True:
        found = materialise(_deleted(asked, lined, min_block_chars), "line-removals")
        if gone is not None:
            found = materialise(found.join(gone, ["key", "line"], "left_anti"), "line-removals-new")
            if not found.limit(1).count():
                break
        gone = found if gone is None else materialise(gone.unionByName(found), "lines-gone")
        # seeds of several lines or of a whole block's size that still have a line
        lost = gone.groupBy("key").agg(F.collect_set("line").alias("lost"))
        rest = shared.join(lost, F.col("later") == F.col("key"), "left").filter(
            F.col("lost").isNull() | (F.size(F.array_except(F.sequence("first", F.col("last") - 1), "lost")) > 0))
        rest = rest.join(lined.select(F.col("key").alias("k"), "n"), F.col("later") == F.col("k")).filter(
            F.aggregate(F.slice("n", F.col("first") + 1, F.col("last") - F.col("first")), F.lit(0), lambda a, x: a + x) >= min_block_chars)
        asked = materialise(rest.groupBy("later", "earlier").agg(F.collect_set(F.struct("first", "last")).alias("only")), "line-pairs-left")
        if not asked.limit(1).count():
            break
    return gone.groupBy("key").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def _deleted(asked: DataFrame, lined: DataFrame, min_block_chars: int) -> DataFrame:
    """key, line of every line deleted by aligning the pairs; ``only`` names the runs that are not masked (null: all lines)."""
    both = (asked.join(lined.select(F.col("key").alias("later"), F.col("h").alias("a"), F.col("n").alias("sizes")), "later")
            .join(lined.select(F.col("key").alias("earlier"), F.col("h").alias("b")), "earlier"))
    both = both.select(F.col("later.id").alias("id"), F.col("later.h").alias("h"), "a", "sizes", "b", F.col("only.first").alias("first"), F.col("only.last").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, n, b, first, last in zip(*[batch[c].to_pylist() for c in ("a", "sizes", "b", "first", "last")]):
                if first is not None:
                    open_lines = {i for x, y in zip(first, last) for i in range(x, y)}
                    a = [x if i in open_lines else ("masked", i) for i, x in enumerate(a)]
                found.append(common_blocks(a, n, b, min_block_chars))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["h"], pa.array(found, pa.list_(pa.int32()))], ["id", "h", "lines"])
    gone = both.mapInArrow(run, "id long, h long, lines array<int>").select(F.struct("id", "h").alias("key"), F.explode("lines").alias("line"))
    return gone.distinct()


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The input's columns without the deleted lines, plus n_lines and n_removed (which replace columns of those names)."""
    gone = removed_lines(docs, id_col, text_col, **params).select("key", "lines")
    key = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("unnamed"), F.xxhash64(text_col).alias("h"))
    gone = gone.select(F.struct(F.coalesce("key.id", F.lit(0)).alias("id"), F.col("key.id").isNull().alias("unnamed"), F.col("key.h").alias("h")).alias("gone_key"), "lines")
    rows = boxed(docs, key=key).join(gone, F.col("key") == F.col("gone_key"), "left")
    text = F.col("row").getField(text_col)
    out = without_lines(rows, text, "lines", "left_text")
    counts = {"n_lines": F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("lines"), F.lit(0)).cast("long")}
    columns = [c for c in docs.columns if c not in counts]
    return unboxed(out.withColumns({f"made_{n}": F.greatest(c, F.lit(0)) for n, c in counts.items()}), [*columns, *counts],
                   **{text_col: F.col("left_text"), **{n: F.col(f"made_{n}") for n in counts}})
