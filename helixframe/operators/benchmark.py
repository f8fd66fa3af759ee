"""Benchmark comparison: predictors, subsets and label conventions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.functions import rules
from helixframe.operators import metrics as M
from helixframe.session import materialise


def oriented(long: DataFrame, lower_is_pathogenic: Sequence[str]) -> DataFrame:
    """Negate the scores of predictors where low means pathogenic; NaN counts as missing."""
    s = F.nanvl(F.col("score"), F.lit(None).cast("double"))
    return long.withColumn("score", F.when(F.col("predictor").isin(list(lower_is_pathogenic)), -s).otherwise(s))


def compare_predictors(long: DataFrame, lower_is_pathogenic: Sequence[str] = (), min_scored: int = 50) -> DataFrame:
    """Per predictor: coverage, ROC, PR and the metrics of a cut at its median."""
    o = oriented(long, lower_is_pathogenic)
    key = ["predictor"]
    cover = o.groupBy(*key).agg(F.count(F.lit(1)).alias("_total"), F.count("score").alias("n_scored"))
    counts = materialise(M.score_counts(o, key, "score", "label"), "predictor-counts")  # pooled once, read three times
    median = M.median_by_counts(counts.withColumn("n", F.col("pos") + F.col("neg")), key)
    # the median cut splits the pooled counts, so no raw row is touched again
    cut = (counts.join(median, key).withColumn("_up", F.col("score") >= F.col("median")).groupBy(*key).agg(
        *[F.sum(F.when(F.col("_up") == up, F.col(c)).otherwise(0)).alias(n)
          for n, c, up in (("tp", "pos", True), ("fp", "neg", True), ("fn", "pos", False), ("tn", "neg", False))])
        .withColumns(M.derived_metrics()).select(*key, "mcc", "balanced_accuracy"))
    # a predictor with few scores keeps its row, without metrics and with a note
    few = F.col("n_scored") < min_scored
    names = ("roc_auc", "pr_auc", "mcc", "balanced_accuracy")
    out = cover.join(M.areas_from_counts(counts, key).select(*key, "roc_auc", "pr_auc"), key, "left").join(cut, key, "left")
    note = F.when(few, "too few scores").when(F.col("roc_auc").isNull(), "single class").otherwise("ok")
    return (out.withColumn("note", note).withColumn("coverage", 100.0 * F.col("n_scored") / F.col("_total"))
            .select(*key, "n_scored", "coverage", *[F.when(F.col("note") == "ok", F.col(n)).alias(n) for n in names], "note"))


def predictors_by_group(long: DataFrame, group: str, lower_is_pathogenic: Sequence[str] = (), min_class: int = 5) -> DataFrame:
    """AUC per group and predictor with a note where it cannot be given."""
    o = oriented(long, lower_is_pathogenic)
    key = [group, "predictor"]
    has = F.col("score").isNotNull()
    base = o.groupBy(*key).agg(F.count("score").alias("n_scored"), F.count_if(has & (F.col("label") == 1)).alias("n_pos"),
                               F.count_if(has & (F.col("label") == 0)).alias("n_neg"))
    auc = M.roc_auc(o, key, "score", "label").select(*key, "roc_auc")
    p, n = F.col("n_pos"), F.col("n_neg")
    note = (F.when(F.col("n_scored") == 0, "no scores").when((p == 0) | (n == 0), "single class")
            .when((p < min_class) | (n < min_class), "too few samples").otherwise("ok"))
    return (base.join(auc, key, "left").withColumn("note", note)
            .withColumn("roc_auc", F.when(F.col("note") == "ok", F.col("roc_auc"))))


def subset_names(in_training: Column, in_test: Column) -> Column:
    """All subsets a benchmark row belongs to, as one array."""
    return F.array_compact(F.array(
        F.lit("all"), F.when(~in_training, "no_training_overlap"), F.when(in_test, "test_only"),
        F.when(~in_training & ~in_test, "novel_only")))


def _subset_counts(bench: DataFrame, score: str, label: str) -> DataFrame:
    """Pooled counts per (subset, source, gene, score), expanded to all grouping sets."""
    names = subset_names(F.col("in_training"), F.col("in_test"))
    counts = M.score_counts(bench.withColumn("_names", names), ["_names", "source", "gene"], score, label)
    counts = counts.withColumn("subset", F.explode("_names")).drop("_names")
    wide = M.expand_groups(counts, {"source": ["ALL"], "gene": ["ALL"]})
    return wide.groupBy("subset", "source", "gene", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def subset_auc(bench: DataFrame, score: str, label: str) -> DataFrame:
    return M.auc_from_counts(_subset_counts(bench, score, label), ["subset", "source", "gene"])


def subset_metrics(bench: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """AUC, MCC and balanced accuracy for every subset x source x gene and their totals."""
    counts = _subset_counts(bench, score, label)
    key = ["subset", "source", "gene"]
    up = F.col("score") >= threshold
    cut = counts.groupBy(*key).agg(
        *[F.sum(F.when(up == u, F.col(c)).otherwise(0)).alias(n)
          for n, c, u in (("tp", "pos", True), ("fp", "neg", True), ("fn", "pos", False), ("tn", "neg", False))])
    cut = cut.withColumns(M.derived_metrics()).select(*key, "mcc", "balanced_accuracy")
    return M.auc_from_counts(counts, key).join(cut, key)


def flip_assay_label(bench: DataFrame, bin_col: str = "dms_score_bin", out: str = "assay_label") -> DataFrame:
    """Assay bin 0 means loss of function, i.e. label 1."""
    return bench.withColumn(out, 1 - F.col(bin_col))


def width_summary(df: DataFrame, groups: Sequence[str], width: str) -> DataFrame:
    """Median, mean and population deviation of interval widths with a band."""
    counts = df.groupBy(*groups, F.col(width).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    med = M.median_by_counts(counts, groups).withColumnRenamed("median", "median_width")
    rest = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(width).alias("mean_width"),
                                   F.stddev_pop(width).alias("std_width"))
    return med.join(rest, list(groups)).withColumn("band", rules.width_band(F.col("median_width")))


def side_by_side(df: DataFrame, keys: Sequence[str], slot: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of slot 0 and of slot 1 per key as left_* and right_* columns."""
    def pick(i: int) -> Column:
        return F.min_by(F.when(F.col(slot) == i, F.struct(*values)), F.when(F.col(slot) == i, F.struct(*order)))
    both = df.groupBy(*keys).agg(pick(0).alias("_l"), pick(1).alias("_r")).filter("_l IS NOT NULL AND _r IS NOT NULL")
    return both.select(*keys, *[F.col(f"{p}.{v}").alias(f"{n}_{v}") for p, n in (("_l", "left"), ("_r", "right")) for v in values])


def merge_sets(sources: Sequence[DataFrame], old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the sources against an old list: added, removed or same per element.
    One tagged aggregate, no full join."""
    tagged = [s.select(*keys, F.lit(True).alias("_new")) for s in sources] + [old.select(*keys, F.lit(False).alias("_new"))]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    seen = out.groupBy(*keys).agg(F.bool_or("_new").alias("_n"), F.bool_or(~F.col("_new")).alias("_o"))
    status = F.when(F.col("_n") & F.col("_o"), "same").when(F.col("_n"), "added").otherwise("removed")
    return seen.select(*keys, status.alias("status"))


def set_difference(a: Column, b: Column) -> tuple[Column, Column]:
    """Elements of ``b`` not in ``a`` (gained) and of ``a`` not in ``b`` (lost), sorted."""
    return F.sort_array(F.array_except(b, a)), F.sort_array(F.array_except(a, b))
