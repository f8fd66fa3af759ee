"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target over
source size. Its fraction is rounded in pairs: one of the two takes mass from the
other, at random but in expectation fairly, until one of them is integral; the
one that is left meets the next. This happens within small groups of documents
of similar size, then among the one residue of each group, in a tree of fixed
fan-in. The largest come first throughout, so that what is left to the last draw is
small. Copies are 0, 1 or 2; sums of copies are exact up to one per source.

A null text has size 0; a null source is a source of its own and comes last; a
source without words has target 0; equal rows share one draw (and travel as one row
with their number); an empty table gives an empty result; other columns, whatever their
names, are neither read nor changed. Draws come from hashes of the row, so that reruns
agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixframe.llm.rows import boxed, unboxed
from helixframe.llm.text import WORD, mix
from helixframe.operators.ranking import number_rows
from helixframe.session import materialise

GROUP = 4096  # documents in a first group, on average
FAN_IN = 64  # residues that meet in one node of the tree
STATE = "row_key long, doc_id long, source string, times long, node long, size long, whole long, rest double"


def row_key(*columns: str) -> Column:
    return F.xxhash64(*columns)


def water_level(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """``sources`` (size, weight) with column target: weights share the total, full sources pass on their excess."""
    limit = cap * F.col("size")
    total = sources.agg(F.sum("size").alias("t")).first()["t"] or 0
    level, full = None, -1
    while True:
        free = F.lit(True) if level is None else F.col("weight") * level < limit
        a = sources.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(free, 0.0).otherwise(limit)).alias("taken"),
                        F.count_if(~free).alias("full")).first()
        if not a["w"] or a["full"] == full:
            break
        full, level = a["full"], (share * total - a["taken"]) / a["w"]
    target = limit if level is None else F.least(F.col("weight") * level, limit)
    return sources.withColumn("target", target.cast("double"))


def draw(a: np.uint64, b: np.uint64, seed: int) -> float:
    h = mix(np.array([a], np.uint64) * np.uint64(3) + np.array([b], np.uint64) + np.uint64(seed))
    return float(h[0] >> np.uint64(11)) / (1 << 53)


def pivot(p: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    """Round probabilities in order; at most one stays between 0 and 1."""
    p = np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p))
    open_at = -1
    for i in np.flatnonzero((p > 0) & (p < 1)):
        if open_at < 0:
            open_at = i
            continue
        a, b = p[open_at], p[i]
        u, s = draw(keys[open_at], keys[i], seed), a + b
        if s < 1:
            winner, loser = (open_at, i) if u * s < a else (i, open_at)
            p[winner], p[loser], rest = s, 0.0, winner
        else:
            winner, loser = (open_at, i) if u * (2 - s) < 1 - b else (i, open_at)
            p[winner], p[loser], rest = 1.0, s - 1, loser
        if 1e-9 < p[rest] < 1 - 1e-9:
            open_at = rest
        else:
            p[rest], open_at = round(p[rest]), -1
    return p


def _round(seed: int, last: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "row_key"], ascending=[False, True], ignore_index=True)
        keys = part["row_key"].to_numpy(np.int64).view(np.uint64)
        rest = pivot(part["rest"].to_numpy(float), keys, seed)
        if last:
            rest = np.array([float(draw(k, k, seed) < x) if 0 < x < 1 else x for k, x in zip(keys, rest)])
        done = (rest == 0) | (rest == 1)
        return part.assign(whole=part["whole"] + np.where(done, rest, 0).astype(np.int64), rest=np.where(done, 0.0, rest))
    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """One row per document: row_key, doc_id, source, size, source_size, target, copies, taken."""
    key = row_key(id_col, source_col, text_col)
    each = docs.select(key.alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # equal rows have one key, and with it one id, source and size
    same = each.groupBy("row_key").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size")], F.count(F.lit(1)).alias("times"))
    sized = materialise(same, "mix-sizes")
    # Code points order as their UTF-8 bytes do; the first two characters split the numbering.
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("size"))
    slot = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.substring("source", 1, 2)))
    numbered = number_rows(sources, [], slot, [F.col("source").asc_nulls_last()])
    place = (F.col("row_number") - 1) % len(weights)
    numbered = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    sources = water_level(materialise(numbered, "mix-sources"), share, cap)
    sources = sources.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target")

    bucket = F.floor(F.log2(F.col("size") + 1) * 4).cast("long")
    rows = sized.withColumn("bucket", bucket)
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    slots = F.ceil(F.col("n") / GROUP).cast("long")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # at most some 200 buckets
    plan = counts.select(F.col("source").alias("cs"), F.col("bucket").alias("cb"), slots.alias("slots"),
                         F.coalesce(F.sum(slots).over(before), F.lit(0)).alias("offset"))
    plan = plan.join(sources, F.col("cs").eqNullSafe(F.col("s")))
    placed = rows.join(plan, rows["source"].eqNullSafe(F.col("cs")) & (rows["bucket"] == F.col("cb")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = placed.select("row_key", "doc_id", "source", "times", (F.col("offset") + F.pmod(F.xxhash64("row_key"), F.col("slots"))).alias("node"), "size",
                          F.floor(expected).cast("long").alias("whole"), (expected - F.floor(expected)).alias("rest"))
    level = 0
    done = []
    while True:
        nodes = state.agg(F.max("node")).first()[0] if level else (plan.agg(F.max(F.col("offset") + F.col("slots"))).first()[0])
        last = not nodes
        state = materialise(state.groupBy("source", "node").applyInPandas(_round(seed + level, last), STATE), f"mix-level-{level}")
        done.append(state.filter("rest = 0"))
        if last:
            break
        state = state.filter("rest > 0").withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.withColumn("one", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    return (out.join(sources, out["source"].eqNullSafe(F.col("s")))
            .select("row_key", "doc_id", "source", "size", "source_size", "target", F.col("whole").alias("copies"),
                    (F.col("whole") * F.col("size")).alias("taken")))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mixture in the input's columns: each document as often as it is taken."""
    taken = mix_sources(docs, id_col, text_col, source_col, **params).filter("copies > 0")
    taken = taken.groupBy(F.col("row_key").alias("taken_key")).agg(F.max("copies").cast("int").alias("copies"))
    rows = boxed(docs, key=row_key(id_col, source_col, text_col)).join(taken, F.col("key") == F.col("taken_key"))
    return unboxed(rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))), docs.columns)
