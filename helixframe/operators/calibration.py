"""Blending, isotonic calibration, conformal thresholds and intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from helixframe import constants as K
from helixframe.operators import metrics as M
from helixframe.session import materialise

WEIGHT_STEPS = 20
NODE_ROWS = 4096  # distinct scores that are pooled in one go
ARRAY_BLOCKS = 4096  # isotonic blocks of a group that travel as one array
FAN_IN = 16  # nodes that become one in the tree of isotonic blocks


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std) with the population deviation; one pass for all columns."""
    aggs = [a for i, c in enumerate(columns) for a in (F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_s{i}"))]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std")) for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.feature", "r.mean", "r.std")


def scale(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standard-scaled columns, fitted on ``train`` only; constant features stay unscaled."""
    one = train.agg(*[a for c in columns for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]).withColumn("_k", F.lit(1))
    out = df.withColumn("_k", F.lit(1)).join(one, "_k")
    std = {c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return (out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / std[c] for c in columns})
            .drop("_k", *[f"_{p}_{c}" for p in "ms" for c in columns]))


def blend(p1: Column, p2: Column, w1: Column | None = None, w2: Column | None = None) -> tuple[Column, Column]:
    """Weighted blend (default 0.6 / 0.4) and the disagreement of the two scores."""
    w1 = F.lit(0.6) if w1 is None else F.coalesce(w1, F.lit(0.6))
    w2 = F.lit(0.4) if w2 is None else F.coalesce(w2, F.lit(0.4))
    return w1 * p1 + w2 * p2, F.abs(p1 - p2)


def logistic(weights: Mapping[str, float], bias: float) -> Column:
    """Score of a linear model over feature columns."""
    z = sum((F.lit(w) * F.col(f"`{c}`") for c, w in weights.items()), F.lit(bias))
    return 1 / (1 + F.exp(-z))


def optimise_weights(df: DataFrame, group: str, p1: str, p2: str, label: str, min_rows: int = 10, min_class: int = 2) -> DataFrame:
    """Best blend weight per group on a 0..1 grid of step 0.05 by AUC, the lowest on ties.

    Rows are pooled to distinct (p1, p2) before the grid is exploded.
    """
    pooled = df.groupBy(group, p1, p2).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    grid = pooled.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(WEIGHT_STEPS))))
    w = F.col("step") / WEIGHT_STEPS
    # rounding joins blends that are equal but for the last bits of their sum
    counts = (grid.withColumn("score", F.round(w * F.col(p1) + (1 - w) * F.col(p2), 9)).groupBy(group, "step", "score")
              .agg(F.sum("_p").alias("pos"), F.sum("_n").alias("neg")))
    auc = M.auc_from_counts(counts, [group, "step"])
    best = auc.groupBy(group).agg(F.max(F.struct(F.round("roc_auc", 9).alias("auc"), (-F.col("step")).alias("neg"))).alias("b"),
                                  F.max("n").alias("n"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    ok = (F.col("n") >= min_rows) & (F.col("n_pos") >= min_class) & (F.col("n_neg") >= min_class)
    weight = F.round(-F.col("b.neg") / WEIGHT_STEPS, 2)
    return best.select(group, F.when(ok, weight).otherwise(0.6).alias("w1"), F.when(ok, F.round(1 - weight, 2)).otherwise(0.4).alias("w2"),
                       F.when(ok, "optimized").otherwise("default_fallback").alias("method"), F.when(ok, F.col("b.auc")).alias("cal_auc"))


def weight_report(calibration: DataFrame, test: DataFrame, group: str, p1: str, p2: str, label: str, default: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """The best weights per group with the AUC they and the default weights reach on the test rows, and the gain."""
    best = materialise(optimise_weights(calibration, group, p1, p2, label), "best-weights")
    pooled = test.groupBy(group, p1, p2).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n")).join(best.select(group, "w1", "w2"), group)
    runs = F.array(*[F.struct(F.lit(name).alias("run"), F.round(a * F.col(p1) + b * F.col(p2), 9).alias("score")) for name, a, b in (
        ("best", F.col("w1"), F.col("w2")), ("default", F.lit(default[0]), F.lit(default[1])))])
    counts = pooled.withColumn("r", F.explode(runs)).groupBy(group, "r.run", "r.score").agg(F.sum("_p").alias("pos"), F.sum("_n").alias("neg"))
    auc = M.auc_from_counts(counts, [group, "run"]).groupBy(group).agg(*[F.max(F.when(F.col("run") == n, F.col("roc_auc"))).alias(f"{n}_test_auc") for n in ("best", "default")],
                                                                        F.max("n").alias("n_test"))
    return best.join(auc, group, "left").withColumn("gain", F.col("best_test_auc") - F.col("default_test_auc"))


def _pool_adjacent(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge neighbouring blocks until the means rise (lo, hi, weight, mean)."""
    pdf = pdf.sort_values("lo")
    out: list[list[float]] = []
    for lo, hi, w, m in pdf[["lo", "hi", "weight", "mean"]].itertuples(index=False):
        out.append([lo, hi, w, m])
        while len(out) > 1 and out[-2][3] >= out[-1][3]:
            _, hi2, w2, m2 = out.pop()
            a = out[-1]
            a[3] = (a[3] * a[2] + m2 * w2) / (a[2] + w2)
            a[1], a[2] = hi2, a[2] + w2
    return pd.DataFrame(out, columns=["lo", "hi", "weight", "mean"])


def isotonic_fit(df: DataFrame, group: str, score: str, label: str, min_rows: int = 50, min_class: int = 2,
                 fallback: str = "_universal", node_rows: int = NODE_ROWS) -> DataFrame:
    """Isotonic blocks (lo, hi, weight, mean) per group, and a universal fit over all rows.

    Rows pool to distinct scores; adjacent violators merge inside slices of the group's
    scores, then between slices in a tree (``merge_neighbours``). Merging is associative,
    so the result is the exact fit while no task reads all blocks of a group.
    Groups with too few rows or labels have no own fit.
    """
    pooled = (df.groupBy(group, F.col(score).alias("lo")).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sum(F.col(label).cast("double")).alias("_s"),
                                                               F.count_if(F.col(label) == 1).alias("_p")))
    pooled = materialise(pooled, "isotonic-points")
    enough = pooled.groupBy(group).agg(F.sum("weight").alias("_w"), F.sum("_p").alias("_np")).filter(
        (F.col("_w") >= min_rows) & (F.col("_np") >= min_class) & (F.col("_w") - F.col("_np") >= min_class)).select(group)
    every = pooled.groupBy("lo").agg(F.sum("weight").alias("weight"), F.sum("_s").alias("_s")).withColumn(group, F.lit(fallback))
    points = (pooled.join(enough, group, "left_semi").select(group, "lo", "weight", "_s").unionByName(every.select(group, "lo", "weight", "_s"))
              .select(group, "lo", F.col("lo").alias("hi"), "weight", (F.col("_s") / F.col("weight")).alias("mean")))
    # a node for about ``node_rows`` points, made of whole slices
    slices = M.COARSE * M.COARSE
    sizes = materialise(points.groupBy(group).agg(F.least(F.lit(slices), F.ceil(F.count(F.lit(1)) / node_rows)).cast("long").alias("_nodes")), "isotonic-sizes")
    nodes = sizes.agg(F.max("_nodes")).first()[0] or 1
    node = F.lit(0).cast("long")
    if nodes > 1:
        points, node = M.with_slices(points, [group], "lo"), F.floor(F.col("_slice") * F.col("_nodes") / slices).cast("long")
    points = points.join(sizes, group).select(group, node.alias("node"), "lo", "hi", "weight", "mean")
    blocks = materialise(_pooled(points, group), "isotonic-slices")
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        blocks = materialise(merge_neighbours(blocks, group), "isotonic")
    return blocks.drop("node")


def _pooled(blocks: DataFrame, group: str) -> DataFrame:
    """Blocks of every (group, node) with adjacent violators merged."""
    def merge(key, pdf):
        out = _pool_adjacent(pdf)
        out.insert(0, "node", key[1])
        out.insert(0, group, key[0])
        return out
    return blocks.groupBy(group, "node").applyInPandas(merge, f"`{group}` string, node long, lo double, hi double, weight double, mean double")


def merge_neighbours(blocks: DataFrame, group: str) -> DataFrame:
    """One level of the tree: FAN_IN neighbouring nodes, each rising within itself, become one.

    Only blocks that neighbours can still pull in meet in a task: those with a mean at or
    above the least one to their right, or at or below the greatest one to their left.
    Pooling them gives means within those bounds, so the others stay as they are.
    """
    b = blocks.withColumn("_up", F.floor(F.col("node") / FAN_IN).cast("long"))
    ends = b.groupBy(group, "_up", "node").agg(F.min("mean").alias("_lo"), F.max("mean").alias("_hi"))
    w = W.partitionBy(group, "_up").orderBy("node")  # FAN_IN rows
    ends = ends.select(group, "node", F.min("_lo").over(w.rowsBetween(1, W.unboundedFollowing)).alias("_right"), F.max("_hi").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_left"))
    b = b.join(ends, [group, "node"])
    open_block = F.coalesce(F.col("mean") >= F.col("_right"), F.lit(False)) | F.coalesce(F.col("mean") <= F.col("_left"), F.lit(False))
    columns = [group, F.col("_up").alias("node"), "lo", "hi", "weight", "mean"]
    return _pooled(b.filter(open_block).select(*columns), group).unionByName(b.filter(~open_block).select(*columns))


def isotonic_segments(blocks: DataFrame, group: str) -> DataFrame:
    """Line segments through the block edges: (x0, y0) to (x1, y1). A block of several
    scores is flat between its edges and joined to the next block by a straight line."""
    edges = blocks.select(group, F.explode(F.array_distinct(F.array(
        F.struct(F.col("lo").alias("x"), F.col("mean").alias("y")), F.struct(F.col("hi").alias("x"), F.col("mean").alias("y"))))).alias("e"))
    w = W.partitionBy(group).orderBy("x0")
    return (edges.select(group, F.col("e.x").alias("x0"), F.col("e.y").alias("y0"))
            .withColumn("x1", F.lead("x0").over(w)).withColumn("y1", F.lead("y0").over(w))
            .withColumn("is_first", F.lag("x0").over(w).isNull()))


def isotonic_apply(df: DataFrame, blocks: DataFrame, group: str, score: str, out: str = "calibrated", fallback: str = "_universal",
                   array_blocks: int = ARRAY_BLOCKS) -> DataFrame:
    """Calibrated score by linear interpolation, clipped outside the fitted range.

    Pooling leaves few blocks: where no group has more than ``array_blocks`` a group's edges
    travel as one sorted array and every row bisects them. Larger fits are joined by slices:
    distinct scores and segments are one table; each score takes the last segment that
    starts at or below it, within its slice or carried over from the slices below.
    Groups without a fit use the universal one.
    """
    most = blocks.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= array_blocks:
        return _by_bisection(df, blocks, group, score, out, fallback, most)
    own = blocks.select(group).distinct().withColumn("_fit", F.col(group))
    s = df.select(group, F.col(score).alias("_x")).distinct().join(own, group, "left").withColumn("_fit", F.coalesce("_fit", F.lit(fallback)))
    seg = isotonic_segments(blocks, group).select(F.col(group).alias("_fit"), F.struct("x0", "y0", "x1", "y1").alias("_seg"))
    asked = s.filter(M.known("_x")).select("_fit", "_x").distinct().withColumn("_seg", F.lit(None).cast(seg.schema["_seg"].dataType))
    points = M.with_slices(asked.unionByName(seg.select("_fit", F.col("_seg.x0").alias("_x"), "_seg")), ["_fit"], "_x")
    lasts = points.groupBy("_fit", "_slice").agg(F.max_by("_seg", F.when(F.col("_seg").isNotNull(), F.col("_x"))).alias("_last"),
                                                 F.min_by("_seg", F.when(F.col("_seg").isNotNull(), F.col("_x"))).alias("_first"))
    below = W.partitionBy("_fit").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy("_fit").orderBy("_slice").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = lasts.select("_fit", "_slice", F.last("_last", True).over(below).alias("_carried"), F.first("_first", True).over(above).alias("_lowest"))
    inner = W.partitionBy("_fit", "_slice").orderBy("_x", F.col("_seg").isNull()).rowsBetween(W.unboundedPreceding, 0)
    found = (points.withColumn("_in", F.last("_seg", True).over(inner)).filter(F.col("_seg").isNull()).join(carried, ["_fit", "_slice"])
             .select("_fit", "_x", F.coalesce("_in", "_carried").alias("g"), "_lowest"))
    x, g = F.col("_x"), F.col("g")
    line = g["y0"] + (x - g["x0"]) * (g["y1"] - g["y0"]) / (g["x1"] - g["x0"])
    y = F.when(g.isNull(), F.col("_lowest")["y0"]).when(g["x1"].isNull() | (x == g["x0"]), g["y0"]).otherwise(line)
    values = s.join(found.select("_fit", "_x", y.alias(out)), ["_fit", "_x"]).select(group, F.col("_x").alias(score), out)
    return df.join(values, [group, score], "left")


def _by_bisection(df: DataFrame, blocks: DataFrame, group: str, score: str, out: str, fallback: str, most: int) -> DataFrame:
    edge = F.array_distinct(F.array(*[F.struct(F.col(c).alias("x"), F.col("mean").alias("y")) for c in ("lo", "hi")]))
    lines = blocks.select(group, F.explode(edge).alias("e")).groupBy(group).agg(F.sort_array(F.collect_list("e")).alias("_e"))  # two edges a block
    lines = lines.select(F.col(group).alias("_fit"), F.col("_e.x").alias("_xs"), F.col("_e.y").alias("_ys"))
    fitted = lines.select(F.col("_fit").alias(group), F.col("_fit").alias("_own"))
    rows = df.join(fitted, group, "left").withColumn("_fit", F.coalesce("_own", F.lit(fallback))).join(lines, "_fit", "left")
    x = F.col(score)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((2 * most + 1).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get("_xs", i + s - 1) <= x, i + s).otherwise(i))  # edges at or below x
    rows = rows.withColumn("_at", at)
    i, n = F.col("_at"), F.size("_xs")
    x0, x1, y0, y1 = F.get("_xs", i - 1), F.get("_xs", i), F.get("_ys", i - 1), F.get("_ys", i)
    y = F.when(i == 0, F.get("_ys", F.lit(0))).when((i == n) | (x == x0), y0).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))
    return rows.withColumn(out, F.when(M.known(score), y)).drop("_fit", "_own", "_xs", "_ys", "_at")


def conformal_fit(df: DataFrame, group: str, score: str, label: str, alpha: float = K.CONFORMAL_ALPHA, min_rows: int = K.CONFORMAL_MIN,
                  fallback: str = "_global") -> DataFrame:
    """Quantile of 1 - p(true class) per group with the finite-sample level.

    Order statistics come from cumulative counts over distinct values, so any group
    size works; groups below ``min_rows`` take the global quantile.
    """
    # rounding joins values that differ only in the last bits of 1 - p
    s = F.round(F.when(F.col(label) == 1, 1 - F.col(score)).otherwise(F.col(score)), 12)
    counts = df.groupBy(group, s.alias("score")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.groupBy("score").agg(F.sum("n").alias("n")).withColumn(group, F.lit(fallback))
    c = M.cumulative(counts.unionByName(every.select(group, "score", "n")), [group], ("n",), descending=False)
    total = F.col("n_total")
    level = F.least(F.ceil((total + 1) * (1.0 - alpha)) / total, F.lit(1.0))
    h = (total - 1) * level
    at = F.col("n_cum")
    q = (c.withColumn("_h", h).groupBy(group).agg(
        F.max("n_total").alias("n_calibration"), F.max("_h").alias("_h"),
        F.min(F.when(at > F.floor("_h"), F.col("score"))).alias("_a"), F.min(F.when(at > F.ceil("_h"), F.col("score"))).alias("_b")))
    b = F.coalesce(F.col("_b"), F.col("_a"))
    q = q.select(group, "n_calibration", (F.col("_a") + (b - F.col("_a")) * (F.col("_h") - F.floor("_h"))).alias("_q"))
    q = materialise(q, "conformal")  # a row per group, read for the groups, the global threshold and every set
    glob = q.filter(F.col(group) == fallback).select(F.col("_q").alias("_g"), F.lit(1).alias("_k"))
    out = q.withColumn("_k", F.lit(1)).join(glob, "_k")
    small = F.col("n_calibration") < min_rows
    return out.select(group, "n_calibration", F.when(small, F.col("_g")).otherwise(F.col("_q")).alias("quantile"), small.alias("is_fallback"))


def conformal_set(p: Column, q: Column) -> Column:
    """Labels within the quantile, never empty."""
    chosen = F.array_compact(F.array(F.when(p >= 1 - q, "Pathogenic"), F.when(1 - p >= 1 - q, "Benign")))
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.when(p >= 0.5, "Pathogenic").otherwise("Benign")))


def with_conformal_set(df: DataFrame, thresholds: DataFrame, group: str, score: str, fallback: str = "_global") -> DataFrame:
    t = thresholds.select(group, F.col("quantile").alias("_q"))
    g = thresholds.filter(F.col(group) == fallback).select(F.col("quantile").alias("_g"), F.lit(1).alias("_k"))
    out = df.withColumn("_k", F.lit(1)).join(t, group, "left").join(g, "_k", "left")
    return out.withColumn("conformal_set", conformal_set(F.col(score), F.coalesce("_q", "_g"))).drop("_q", "_g", "_k")


def conformal_coverage(df: DataFrame, group: str, label: str) -> DataFrame:
    truth = F.when(F.col(label) == 1, "Pathogenic").otherwise("Benign")
    size = F.size("conformal_set")
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.array_contains(F.col("conformal_set"), truth), 1.0).otherwise(0.0)).alias("coverage"),
        F.avg(size).alias("avg_set_size"), F.avg(F.when(size == 1, 1.0).otherwise(0.0)).alias("singleton_rate"))


def array_percentile(values: Column, q: float) -> Column:
    """Linear-interpolated percentile of an array column (within the row)."""
    s = F.sort_array(values)
    h = (F.size(values) - 1) * F.lit(q)
    a, b = F.try_element_at(s, (F.floor(h) + 1).cast("int")), F.try_element_at(s, (F.ceil(h) + 1).cast("int"))
    return a + (b - a) * (h - F.floor(h))


def ensemble_interval(values: Column, lo: float = 0.05, hi: float = 0.95) -> dict[str, Column]:
    """Percentile interval of one row's ensemble scores; no shuffle."""
    a, b = array_percentile(values, lo), array_percentile(values, hi)
    return {"ci_lower": a, "ci_upper": b, "ci_width": b - a}


def class_weight(df: DataFrame, groups: Sequence[str], label: str) -> DataFrame:
    """n_neg / max(n_pos, 1) per group."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.groupBy(*groups).agg(neg.alias("n_neg"), pos.alias("n_pos"), (neg / F.greatest(pos, F.lit(1))).alias("weight"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def beta_interval(p: pd.Series, n: pd.Series) -> pd.Series:
    """95% interval of Beta(p n + 1, (1 - p) n + 1), by bisection of its distribution
    function on the log scale of a continued fraction."""
    from math import lgamma
    a, b = (p * n + 1).to_numpy(float), ((1 - p) * n + 1).to_numpy(float)
    front = np.array([lgamma(x + y) - lgamma(x) - lgamma(y) for x, y in zip(a, b)])

    def cdf(x):
        flip = x > (a + 1) / (a + b + 2)
        s, t, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
        c, d = np.ones_like(z), 1 / (1 - (s + t) * z / (s + 1))
        h = d.copy()
        for m in range(1, 400):
            for k in (m * (t - m) * z / ((s + 2 * m - 1) * (s + 2 * m)), -(s + m) * (s + t + m) * z / ((s + 2 * m) * (s + 2 * m + 1))):
                d = 1 / (1 + k * d)
                c = 1 + k / c
                h = h * c * d
        part = np.exp(front + s * np.log(z) + t * np.log1p(-z)) * h / s
        return np.where(flip, 1 - part, part)

    ends = []
    for target in (0.025, 0.975):
        lo, hi = np.full_like(a, 1e-12), np.full_like(a, 1 - 1e-12)
        for _ in range(60):
            mid = (lo + hi) / 2
            low = cdf(mid) < target
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        ends.append((lo + hi) / 2)
    return pd.Series(list(np.column_stack(ends)))


def draws(keys: np.ndarray, means: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson draws of every pooled row for all replicates: one generator per row, seeded by its key, so a repeated task draws the same."""
    out = np.zeros((len(keys), replicates), np.int64)
    for i in np.flatnonzero(means):
        out[i] = np.random.Generator(np.random.Philox(key=int(keys[i]) & (2**64 - 1))).poisson(means[i], replicates)
    return out


def bootstrap_replicates(df: DataFrame, score: str, label: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """rep, roc_auc and pr_auc (trapezoid) of every Poisson resample that holds both classes.

    Rows pool to distinct scores, in slices of the score range; a pooled row of n copies
    draws Poisson(n), the sum of n Poisson(1) draws. A slice holds vectors of all replicates
    and is read twice: for its totals, whose sums over the slices above are where its
    curves begin, and for its parts of both areas. What is shuffled is pooled rows and one
    vector per slice, whatever the number of replicates a row takes part in.
    """
    counts = M.score_counts(df, [], score, label)
    keys = [F.xxhash64(F.lit(seed), F.lit(c), "score").alias(f"key_{c}") for c in ("pos", "neg")]
    sliced = M.with_slices(counts, [], "score").select("_slice", "score", F.col("pos").cast("double").alias("pos"), F.col("neg").cast("double").alias("neg"), *keys)
    sliced = materialise(sliced, "bootstrap-slices")
    vectors = ", ".join(f"{c} array<double>" for c in ("tp", "fp", "wins", "area"))

    def drawn(pdf: pd.DataFrame):
        """Draws (pos, neg) of the rows from the highest score down, a block of rows at a time."""
        pdf = pdf.sort_values("score", ascending=False)
        for i in range(0, len(pdf), 1000):
            part = pdf.iloc[i:i + 1000]
            yield tuple(draws(part[f"key_{c}"].to_numpy(), part[c].to_numpy(), replicates) for c in ("pos", "neg"))

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        tp, fp = np.zeros(replicates), np.zeros(replicates)
        for pos, neg in drawn(pdf):
            tp, fp = tp + pos.sum(axis=0), fp + neg.sum(axis=0)
        return pd.DataFrame({"_slice": [pdf["_slice"].iloc[0]], "tp": [tp], "fp": [fp]})

    sums = materialise(sliced.groupBy("_slice").applyInPandas(totals, "_slice int, tp array<double>, fp array<double>"), "bootstrap-totals")
    # slices x replicates values at most, of a bounded number of slices
    each = sums.select("_slice", F.posexplode(F.arrays_zip("tp", "fp")).alias("rep", "t")).select("_slice", "rep", "t.tp", "t.fp")
    above = W.partitionBy("rep").orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    starts = each.select("_slice", "rep", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(c) for c in ("tp", "fp")])
    starts = starts.groupBy("_slice").agg(F.sort_array(F.collect_list(F.struct("rep", "tp", "fp"))).alias("s"))
    starts = starts.select(F.col("_slice").alias("_of"), F.col("s.tp").alias("tp0"), F.col("s.fp").alias("fp0"))

    def areas(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("tp", "fp", "wins", "area")})
        tp, fp = (np.array(right[c].iloc[0], float) for c in ("tp0", "fp0"))
        wins, area = np.zeros(replicates), np.zeros(replicates)
        first = tp, fp
        for pos, neg in drawn(left):
            tps, fps = np.vstack([tp, tp + np.cumsum(pos, axis=0)]), np.vstack([fp, fp + np.cumsum(neg, axis=0)])
            wins += (neg * (tps[:-1] + pos / 2)).sum(axis=0)
            # precision where the curve begins is 1; rows without a draw add nothing
            precision = np.where(tps + fps > 0, tps / np.maximum(tps + fps, 1), 1.0)
            area += (pos * (precision[1:] + precision[:-1]) / 2).sum(axis=0)
            tp, fp = tps[-1], fps[-1]
        return pd.DataFrame({"tp": [tp - first[0]], "fp": [fp - first[1]], "wins": [wins], "area": [area]})

    parts = sliced.groupBy("_slice").cogroup(starts.groupBy("_of")).applyInPandas(areas, vectors)
    each = parts.select(F.posexplode(F.arrays_zip("tp", "fp", "wins", "area")).alias("rep", "v")).groupBy("rep").agg(*[
        F.sum(f"v.{c}").alias(c) for c in ("tp", "fp", "wins", "area")]).filter("tp > 0 AND fp > 0")
    return each.select("rep", (F.col("wins") / (F.col("tp") * F.col("fp"))).alias("roc_auc"), (F.col("area") / F.col("tp")).alias("pr_auc"))


def bootstrap_metric_ci(df: DataFrame, score: str, label: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """95 % percentile interval of ROC and PR area over the resamples."""
    m = bootstrap_replicates(df, score, label, replicates, seed)  # a row per replicate
    return m.agg(*[F.percentile(c, q).alias(f"{c}_{n}") for c in ("roc_auc", "pr_auc") for n, q in (("lo", 0.025), ("hi", 0.975))],
                 F.count(F.lit(1)).alias("replicates"))
