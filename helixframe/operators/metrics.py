"""Grouped, tie-aware evaluation statistics.

Raw rows shrink to one row per (group, score) by a map-side combined aggregate;
all curves are then cumulative sums over that table.  The sums run in two
levels (within a slice of the group's scores, plus the totals of the slices above)
so a group with very many distinct scores still spreads over many tasks. Slices
are cut at a sample of the distinct scores, so they are even wherever the scores lie.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from helixframe.functions import rules
from helixframe.operators.ranking import top_n
from helixframe.session import materialise

COARSE = 16  # slices per group: COARSE squared


def with_slices(df: DataFrame, groups: Sequence[str], value: str, out: str = "_slice") -> DataFrame:
    """Slice number of ``value`` within its group; rises with the value.

    The bounds are the group's values with the smallest hashes: a uniform sample that
    does not depend on the order of rows, so every use of the plan cuts alike. They are
    an array per group, searched in two steps of COARSE comparisons.
    """
    n = COARSE * COARSE - 1
    picked = top_n(df.select(*groups, value).distinct(), groups, [F.xxhash64(F.col(value)), F.col(value)], n, "_rank")
    bounds = picked.groupBy(*groups).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_bounds"))  # n at most
    x = F.col(value).cast("double")

    def above(places: Sequence[Column]) -> Column:
        total = F.lit(0)
        for i in places:
            total = total + F.coalesce((x >= F.get("_bounds", i)).cast("int"), F.lit(0))
        return total

    joined = df.join(bounds, list(groups)) if groups else df.crossJoin(bounds)  # one row without groups
    joined = joined.withColumn("_coarse", above([F.lit(COARSE * j - 1) for j in range(1, COARSE)]))
    fine = above([COARSE * F.col("_coarse") + (j - 1) for j in range(1, COARSE)])
    return joined.withColumn(out, COARSE * F.col("_coarse") + fine).drop("_bounds", "_coarse")


def known(value: str) -> Column:
    """Neither NULL nor NaN."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def score_counts(df: DataFrame, groups: Sequence[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """(groups, score) -> pos, neg; rows without a score (NULL or NaN) are left out."""
    w = F.lit(1) if weight is None else weight
    return (df.filter(known(score)).groupBy(*groups, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg")))


def cumulative(counts: DataFrame, groups: Sequence[str], sums: Sequence[str] = ("pos", "neg"),
               descending: bool = True, value: str = "score") -> DataFrame:
    """Add ``<sum>_cum`` (inclusive running total by ``value``) and ``<sum>_total`` per group.

    The pooled counts are written first: slices, their totals and the rows all read them.
    """
    b = materialise(with_slices(materialise(counts, "counts"), groups, value), "counts-in-slices")
    key = F.col("_slice").desc() if descending else F.col("_slice").asc()
    per = b.groupBy(*groups, "_slice").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    before = W.partitionBy(*groups).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    offsets = per.select(*groups, "_slice",
                         *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
                         *[F.sum(f"_{s}").over(whole).alias(f"{s}_total") for s in sums])
    order = F.col(value).desc() if descending else F.col(value).asc()
    inner = W.partitionBy(*groups, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = b.withColumns({f"_in_{s}": F.sum(s).over(inner) for s in sums})
    if groups:
        out = out.join(offsets, [*groups, "_slice"])
    else:
        out = out.join(offsets, "_slice")
    return (out.withColumns({f"{s}_cum": F.col(f"_off_{s}") + F.col(f"_in_{s}") for s in sums})
            .drop("_slice", *[f"_off_{s}" for s in sums], *[f"_in_{s}" for s in sums]))


def _guard(value: Column, ok: Column) -> Column:
    return F.when(ok, value)


def roc_auc(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """groups, n, n_pos, n_neg, roc_auc (NULL for a single class)."""
    return auc_from_counts(score_counts(df, groups, score, label), groups)


def auc_from_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    c = cumulative(counts, groups)
    # pairs won = pos * (2 * negatives below + ties); negatives below = total - cumulative
    wins = F.sum(F.col("pos").cast("double") * (2 * (F.col("neg_total") - F.col("neg_cum")) + F.col("neg")))
    p, n = F.sum("pos"), F.sum("neg")
    return c.groupBy(*groups).agg(
        (p + n).alias("n"), p.alias("n_pos"), n.alias("n_neg"),
        _guard(wins / (2 * p.cast("double") * n.cast("double")), (p > 0) & (n > 0)).alias("roc_auc"))


def pr_metrics(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Trapezoid area under the precision-recall points and average precision."""
    return pr_from_counts(score_counts(df, groups, score, label), groups)


def pr_from_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    c = cumulative(counts.filter(F.col("pos") + F.col("neg") > 0), groups)
    tp, fp = F.col("pos_cum"), F.col("neg_cum")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    prec = tp / (tp + fp)
    prev = F.when(tp0 + fp0 == 0, 1.0).otherwise(tp0 / (tp0 + fp0))
    p = F.sum("pos")
    return c.groupBy(*groups).agg(
        _guard(F.sum(F.col("pos") * (prec + prev) / 2) / p, p > 0).alias("pr_auc"),
        _guard(F.sum(F.col("pos") * prec) / p, p > 0).alias("average_precision"))


def areas(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """groups, n, n_pos, n_neg, roc_auc, pr_auc and average_precision from one pass over the curve."""
    return areas_from_counts(score_counts(df, groups, score, label), groups)


def areas_from_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    c = cumulative(counts, groups)
    tp, fp = F.col("pos_cum"), F.col("neg_cum")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    precision = tp / (tp + fp)
    last = F.when(tp0 + fp0 == 0, 1.0).otherwise(tp0 / (tp0 + fp0))
    wins = F.sum(F.col("pos").cast("double") * (2 * (F.col("neg_total") - fp) + F.col("neg")))
    p, n = F.sum("pos"), F.sum("neg")
    return c.groupBy(*groups).agg(
        (p + n).alias("n"), p.alias("n_pos"), n.alias("n_neg"), _guard(wins / (2 * p.cast("double") * n.cast("double")), (p > 0) & (n > 0)).alias("roc_auc"),
        _guard(F.sum(F.col("pos") * (precision + last) / 2) / p, p > 0).alias("pr_auc"), _guard(F.sum(F.col("pos") * precision) / p, p > 0).alias("average_precision"))


def roc_points(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """One row per distinct threshold: tpr, fpr and Youden's J."""
    c = cumulative(score_counts(df, groups, score, label), groups)
    tpr = F.try_divide(F.col("pos_cum"), F.col("pos_total"))
    fpr = F.try_divide(F.col("neg_cum"), F.col("neg_total"))
    return c.select(*groups, F.col("score").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("j"))


def youden(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Threshold of the greatest tpr - fpr; the highest threshold on ties."""
    best = F.max(F.struct(F.round("j", 12).alias("j"), "threshold", "tpr", "fpr")).alias("b")
    return roc_points(df, groups, score, label).groupBy(*groups).agg(best).select(
        *groups, *[F.col(f"b.{c}").alias(c) for c in ("j", "threshold", "tpr", "fpr")])


def best_f1(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Threshold of the greatest F1; the lowest threshold on ties."""
    c = cumulative(score_counts(df, groups, score, label), groups)
    prec = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    rec = F.try_divide(F.col("pos_cum"), F.col("pos_total"))
    f1 = 2 * prec * rec / (prec + rec + 1e-8)
    best = F.max(F.struct(F.round(f1, 12).alias("f1"), (-F.col("score")).alias("neg"))).alias("b")
    return c.groupBy(*groups).agg(best).select(*groups, (-F.col("b.neg")).alias("threshold"), F.col("b.f1").alias("f1"))


def confusion(df: DataFrame, groups: Sequence[str], predicted: Column, label: str) -> DataFrame:
    """tp, fp, fn, tn and the metrics derived from them."""
    pos = F.col(label) == 1
    neg = F.col(label) == 0
    base = df.groupBy(*groups).agg(
        F.count_if(pos & predicted).alias("tp"), F.count_if(neg & predicted).alias("fp"),
        F.count_if(pos & ~predicted).alias("fn"), F.count_if(neg & ~predicted).alias("tn"))
    return base.withColumns(derived_metrics())


def derived_metrics(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in (tp, fp, fn, tn))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    sens, spec, prec = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    denom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "sensitivity": sens, "specificity": spec, "precision": prec,
        "recall": sens, "f1": ratio(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (sens + spec) / 2,
        "mcc": ratio(tp * tn - fp * fn, denom),
    }


def macro_auc(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """Equal-weight mean of the per-group AUC next to the pooled AUC."""
    per = roc_auc(df, [group], score, label).agg(F.avg("roc_auc").alias("macro_auc"), F.count("roc_auc").alias("n_groups"))
    pooled = roc_auc(df, [], score, label).select(F.col("roc_auc").alias("pooled_auc"))
    return per.withColumn("_k", F.lit(1)).join(pooled.withColumn("_k", F.lit(1)), "_k").drop("_k")


def average_ranks(counts: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """(groups, value, n) -> mid-rank of every distinct value, centred on the mean rank."""
    c = cumulative(counts, groups, ("n",), descending=False, value=value)
    mid = F.col("n_cum") - F.col("n") + (F.col("n") + 1) / 2
    return c.select(*groups, value, (mid - (F.col("n_total") + 1) / 2).alias(out))


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str, min_rows: int = 2) -> DataFrame:
    """Rank correlation per group; NULL below ``min_rows``. Rows are first pooled to
    distinct (x, y), so a value held by many rows is one row in the rank join."""
    pairs = (df.filter(known(x) & known(y))
             .groupBy(*groups, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("c")))
    rx = average_ranks(pairs.groupBy(*groups, "_x").agg(F.sum("c").alias("n")), groups, "_x", "rx")
    ry = average_ranks(pairs.groupBy(*groups, "_y").agg(F.sum("c").alias("n")), groups, "_y", "ry")
    j = pairs.join(rx, [*groups, "_x"]).join(ry, [*groups, "_y"])
    sxy, sxx, syy = (F.sum(F.col("c") * F.col(a) * F.col(b)) for a, b in (("rx", "ry"), ("rx", "rx"), ("ry", "ry")))
    n = F.sum("c")
    return j.groupBy(*groups).agg(n.alias("n"), _guard(sxy / F.sqrt(sxx * syy), (n >= min_rows) & (sxx > 0) & (syy > 0))
                                  .alias("spearman_r"))


def brier(df: DataFrame, groups: Sequence[str], scores: dict[str, Column], label: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"),
                                   *[F.avg(F.pow(s - F.col(label), 2)).alias(n) for n, s in scores.items()])


def _components(counts: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Per distinct score: share of negatives beaten (v10) and of positives above (v01)."""
    c = cumulative(counts.withColumnRenamed(value, "score"), groups)
    below = F.col("neg_total") - F.col("neg_cum")
    above = F.col("pos_cum") - F.col("pos")
    return c.select(*groups, F.col("score").alias(value),
                    F.try_divide(below + F.col("neg") / 2, F.col("neg_total")).alias(f"{out}10"),
                    F.try_divide(above + F.col("pos") / 2, F.col("pos_total")).alias(f"{out}01"))


def delong(df: DataFrame, groups: Sequence[str], a: str, b: str, label: str) -> DataFrame:
    """Paired AUC difference, its z and two-sided p value on the rows both tools score."""
    both = (df.filter(known(a) & known(b))
            .groupBy(*groups, F.col(a).alias("_a"), F.col(b).alias("_b"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))

    def one(col: str, name: str) -> DataFrame:
        return _components(both.groupBy(*groups, col).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), groups, col, name)

    j = both.join(one("_a", "a"), [*groups, "_a"]).join(one("_b", "b"), [*groups, "_b"])
    m, n = F.sum("pos"), F.sum("neg")
    d10, d01 = F.col("a10") - F.col("b10"), F.col("a01") - F.col("b01")
    out = j.groupBy(*groups).agg(
        m.alias("n_pos"), n.alias("n_neg"),
        (F.sum(F.col("pos") * F.col("a10")) / m).alias("auc_a"), (F.sum(F.col("pos") * F.col("b10")) / m).alias("auc_b"),
        F.sum(F.col("pos") * d10 * d10).alias("_s10"), F.sum(F.col("neg") * d01 * d01).alias("_s01"))
    diff = F.col("auc_a") - F.col("auc_b")
    var = ((F.col("_s10") - F.col("n_pos") * diff * diff) / (F.col("n_pos") - 1) / F.col("n_pos")
           + (F.col("_s01") - F.col("n_neg") * diff * diff) / (F.col("n_neg") - 1) / F.col("n_neg"))
    out = out.withColumn("delta", diff).withColumn("z", F.when(var > 0, diff / F.sqrt(var))).drop("_s10", "_s01")
    return out.withColumn("p_value", two_sided_p(F.col("z")))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail probability of a z value."""
    from math import erfc, sqrt
    return z.map(lambda v: erfc(abs(v) / sqrt(2.0)), na_action="ignore")


def expand_groups(counts: DataFrame, sets: dict[str, list[str]], all_value: str = "ALL") -> DataFrame:
    """Replace each dimension of ``sets`` by itself and ``all_value``: the rows of all
    grouping sets, built from pre-aggregated counts rather than raw rows."""
    out = counts
    for c in sets:
        out = out.withColumn(c, F.explode(F.array(F.col(c), F.lit(all_value))))
    return out


def median_by_counts(counts: DataFrame, groups: Sequence[str], value: str = "score", weight: str = "n") -> DataFrame:
    """Exact median per group from (value, weight) rows, without collecting a group."""
    c = cumulative(counts, groups, (weight,), descending=False, value=value)
    lo = F.floor((F.col(f"{weight}_total") - 1) / 2)
    hi = F.floor(F.col(f"{weight}_total") / 2)
    cum = F.col(f"{weight}_cum")
    return c.groupBy(*groups).agg(
        ((F.min(F.when(cum > lo, F.col(value))) + F.min(F.when(cum > hi, F.col(value)))) / 2).alias("median"))


def run_delta(new: DataFrame, old: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """New minus old metric per key present in both runs."""
    o = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values])
    return new.join(o, list(keys)).select(
        *keys, *values, *[f"old_{v}" for v in values], *[(F.col(v) - F.col(f"old_{v}")).alias(f"delta_{v}") for v in values])


def impact(df: DataFrame, groups: Sequence[str], full: str, ablated: str, label: str, threshold: float = 0.5) -> DataFrame:
    """AUC and MCC with and without a feature group, the deltas and an impact band."""
    def side(score: str, tag: str) -> DataFrame:
        auc = roc_auc(df, groups, score, label).select(*groups, "n", F.col("roc_auc").alias(f"auc_{tag}"))
        mcc = confusion(df, groups, F.col(score) >= threshold, label).select(*groups, F.col("mcc").alias(f"mcc_{tag}"))
        return auc.join(mcc, list(groups))
    both = side(full, "with").join(side(ablated, "without").drop("n"), list(groups))
    shift = df.groupBy(*groups).agg(
        F.count_if((F.col(full) >= threshold) != (F.col(ablated) >= threshold)).alias("class_changes"),
        F.avg(F.abs(F.col(full) - F.col(ablated))).alias("mean_shift"))
    out = both.join(shift, list(groups))
    return (out.withColumn("delta_auc", F.col("auc_without") - F.col("auc_with"))
            .withColumn("delta_mcc", F.col("mcc_without") - F.col("mcc_with"))
            .withColumn("assessment", rules.impact_band(F.col("delta_auc"))))
