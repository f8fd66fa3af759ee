"""Evaluation statistics over the score views."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import benchmark as B, metrics as M
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query


def sql_auc(src: str, groups: str, score: str = "score", label: str = "label") -> str:
    """SQL relation: groups, n, n_pos, n_neg, roc_auc from rows with a score."""
    return f"""(SELECT {groups}, CAST(sum(p + n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
      CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(CAST(p AS DOUBLE) * (2 * (cn - n) + n)) / (2 * CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) END AS roc_auc
      FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY {groups} ORDER BY s) AS BIGINT) AS cn
        FROM (SELECT {groups}, {score} AS s, count(*) FILTER ({label} = 1) AS p, count(*) FILTER ({label} = 0) AS n
          FROM {src} WHERE {score} IS NOT NULL GROUP BY {groups}, {score}) d) c GROUP BY {groups})"""


def sql_curve(src: str, groups: str, score: str = "score", label: str = "label") -> str:
    """SQL relation: one row per distinct score with running tp/fp from the top and totals."""
    return f"""(SELECT {groups}, s, p, n, CAST(sum(p) OVER (PARTITION BY {groups} ORDER BY s DESC) AS DOUBLE) AS tp,
      CAST(sum(n) OVER (PARTITION BY {groups} ORDER BY s DESC) AS DOUBLE) AS fp,
      CAST(sum(p) OVER (PARTITION BY {groups}) AS DOUBLE) AS pt, CAST(sum(n) OVER (PARTITION BY {groups}) AS DOUBLE) AS nt
      FROM (SELECT {groups}, {score} AS s, count(*) FILTER ({label} = 1) AS p, count(*) FILTER ({label} = 0) AS n
        FROM {src} WHERE {score} IS NOT NULL GROUP BY {groups}, {score}) d)"""


def sql_pr(src: str, groups: str, score: str = "score", label: str = "label") -> str:
    return f"""(SELECT {groups}, sum(p * (tp / (tp + fp) + CASE WHEN tp - p + fp - n = 0 THEN 1 ELSE (tp - p) / (tp - p + fp - n) END) / 2) / sum(p) AS pr_auc,
      sum(p * tp / (tp + fp)) / sum(p) AS average_precision FROM {sql_curve(src, groups, score, label)} k GROUP BY {groups})"""


def sql_confusion(src: str, groups: str, pred: str, label: str = "label") -> str:
    return f"""(SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS sens, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS spec,
      CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec,
      CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (tp*tn - fp*fn) / sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END AS mcc
      FROM (SELECT {groups}, CAST(count(*) FILTER ({label} = 1 AND {pred}) AS DOUBLE) AS tp, CAST(count(*) FILTER ({label} = 0 AND {pred}) AS DOUBLE) AS fp,
        CAST(count(*) FILTER ({label} = 1 AND NOT ({pred})) AS DOUBLE) AS fn, CAST(count(*) FILTER ({label} = 0 AND NOT ({pred})) AS DOUBLE) AS tn
        FROM {src} GROUP BY {groups}) cf)"""


@query("roc_auc_grouped", f"""
SELECT gene, predictor, n, n_pos, n_neg, round(roc_auc, 9) AS roc_auc FROM {sql_auc('predictors_long', 'gene, predictor')} a""")
def roc_auc_grouped(spark, sf):
    out = M.roc_auc(view(spark, sf, "predictors_long"), ["gene", "predictor"], "score", "label")
    return out.withColumn("roc_auc", F.round("roc_auc", 9))


@query("pr_auc_trapezoid", f"""
SELECT gene, predictor, round(pr_auc, 9) AS pr_auc FROM {sql_pr('predictors_long', 'gene, predictor')} a""")
def pr_auc_trapezoid(spark, sf):
    out = M.pr_metrics(view(spark, sf, "predictors_long"), ["gene", "predictor"], "score", "label")
    return out.select("gene", "predictor", F.round("pr_auc", 9).alias("pr_auc"))


@query("average_precision", f"""
SELECT gene, predictor, round(average_precision, 9) AS average_precision FROM {sql_pr('predictors_long', 'gene, predictor')} a""")
def average_precision(spark, sf):
    out = M.pr_metrics(view(spark, sf, "predictors_long"), ["gene", "predictor"], "score", "label")
    return out.select("gene", "predictor", F.round("average_precision", 9).alias("average_precision"))


@query("roc_curve_points", f"""
SELECT gene, s AS threshold, round(tp / pt, 9) AS tpr, round(fp / nt, 9) AS fpr, round(tp / pt - fp / nt, 9) AS j
FROM {sql_curve('variants', 'gene', 'p_tree')} k""")
def roc_curve_points(spark, sf):
    out = M.roc_points(view(spark, sf, "variants"), ["gene"], "p_tree", "label")
    return out.select("gene", "threshold", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "j")])


@query("youden_threshold", f"""
SELECT gene, threshold, j FROM (SELECT gene, s AS threshold, round(tp / pt - fp / nt, 12) AS j,
  row_number() OVER (PARTITION BY gene ORDER BY round(tp / pt - fp / nt, 12) DESC, s DESC) AS rn
  FROM {sql_curve('variants', 'gene', 'p_tree')} k) x WHERE rn = 1""")
def youden_threshold(spark, sf):
    return M.youden(view(spark, sf, "variants"), ["gene"], "p_tree", "label").select("gene", "threshold", "j")


@query("confusion_metrics", f"""
SELECT gene, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(sens, 9) AS sensitivity, round(spec, 9) AS specificity,
  round(prec, 9) AS precision, round(sens, 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
  round((sens + spec) / 2, 9) AS balanced_accuracy, round(mcc, 9) AS mcc
FROM {sql_confusion('variants', 'gene', 'p_tree >= 0.5::DOUBLE')} c""")
def confusion_metrics(spark, sf):
    out = M.confusion(view(spark, sf, "variants"), ["gene"], F.col("p_tree") >= 0.5, "label")
    return out.select("gene", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in M.derived_metrics()])


@query("macro_auc", f"""
SELECT round(avg(a.roc_auc), 9) AS macro_auc, count(a.roc_auc) AS n_groups, round(max(p.roc_auc), 9) AS pooled_auc
FROM {sql_auc('variants', 'gene', 'p_tree')} a,
 {sql_auc("(SELECT 1 AS one, * FROM variants) v", 'one', 'p_tree')} p""")
def macro_auc(spark, sf):
    out = M.macro_auc(view(spark, sf, "variants"), "gene", "p_tree", "label")
    return out.select(F.round("macro_auc", 9).alias("macro_auc"), "n_groups", F.round("pooled_auc", 9).alias("pooled_auc"))


@query("brier_score", """
SELECT gene, n, round(a, 9) AS brier_gene, round(b, 9) AS brier_universal, round(b - a, 9) AS improvement FROM (
SELECT gene, count(*) AS n, avg((p_tree - label) * (p_tree - label)) AS a, avg((p_mlp - label) * (p_mlp - label)) AS b
FROM variants GROUP BY gene) x""")
def brier_score(spark, sf):
    out = M.brier(view(spark, sf, "variants"), ["gene"], {"a": F.col("p_tree"), "b": F.col("p_mlp")}, "label")
    return out.select("gene", "n", F.round("a", 9).alias("brier_gene"), F.round("b", 9).alias("brier_universal"),
                      F.round(F.col("b") - F.col("a"), 9).alias("improvement"))


def sql_rank(src, groups, v):
    return (f"(SELECT {groups}, {v} AS v, lt + (c + 1) / 2.0::DOUBLE - (tot + 1) / 2.0::DOUBLE AS r FROM (SELECT *, "
            f"CAST(sum(c) OVER (PARTITION BY {groups} ORDER BY {v}) - c AS DOUBLE) AS lt, CAST(sum(c) OVER (PARTITION BY {groups}) AS DOUBLE) AS tot "
            f"FROM (SELECT {groups}, {v}, count(*) AS c FROM {src} GROUP BY {groups}, {v}) a) b)")


ASSAYED = "(SELECT * FROM bench WHERE dms_score IS NOT NULL)"


@query("spearman_grouped", f"""
SELECT b.gene, count(*) AS n, round(sum(x.r * y.r) / sqrt(sum(x.r * x.r) * sum(y.r * y.r)), 9) AS spearman_r
FROM {ASSAYED} b JOIN {sql_rank(ASSAYED + ' q', 'gene', 'p_tree')} x ON x.gene = b.gene AND x.v = b.p_tree
JOIN {sql_rank(ASSAYED + ' q', 'gene', 'dms_score')} y ON y.gene = b.gene AND y.v = b.dms_score GROUP BY b.gene""")
def spearman_grouped(spark, sf):
    out = M.spearman(view(spark, sf, "bench"), ["gene"], "p_tree", "dms_score", min_rows=10)
    return out.withColumn("spearman_r", F.round("spearman_r", 9))


ORIENTED = ("(SELECT *, CASE WHEN predictor = 'p_inverse' THEN -score ELSE score END AS s FROM predictors_long) q")


@query("predictor_comparison", f"""
WITH o AS (SELECT * FROM {ORIENTED}),
med AS (SELECT predictor, median(s) AS med FROM o WHERE s IS NOT NULL GROUP BY predictor),
cov AS (SELECT predictor, count(*) AS total, count(s) AS n_scored FROM o GROUP BY predictor),
m AS (SELECT cov.predictor, cov.n_scored, round(100.0::DOUBLE * cov.n_scored / total, 6) AS coverage, round(a.roc_auc, 9) AS roc_auc,
  round(p.pr_auc, 9) AS pr_auc, round(c.mcc, 9) AS mcc, round((c.sens + c.spec) / 2, 9) AS balanced_accuracy,
  CASE WHEN cov.n_scored < 50 THEN 'too few scores' WHEN a.roc_auc IS NULL THEN 'single class' ELSE 'ok' END AS note
FROM cov LEFT JOIN {sql_auc('o', 'predictor', 's')} a ON a.predictor = cov.predictor
LEFT JOIN {sql_pr('o', 'predictor', 's')} p ON p.predictor = cov.predictor
LEFT JOIN {sql_confusion("(SELECT o.*, med.med FROM o JOIN med ON med.predictor = o.predictor WHERE s IS NOT NULL) z", 'predictor', 's >= med')} c
  ON c.predictor = cov.predictor)
SELECT predictor, n_scored, coverage, note, CASE WHEN note = 'ok' THEN roc_auc END AS roc_auc, CASE WHEN note = 'ok' THEN pr_auc END AS pr_auc,
  CASE WHEN note = 'ok' THEN mcc END AS mcc, CASE WHEN note = 'ok' THEN balanced_accuracy END AS balanced_accuracy FROM m""")
def predictor_comparison(spark, sf):
    out = B.compare_predictors(view(spark, sf, "predictors_long"), lower_is_pathogenic=["p_inverse"])
    return out.select("predictor", "n_scored", F.round("coverage", 6).alias("coverage"),
                      *[F.round(c, 9).alias(c) for c in ("roc_auc", "pr_auc", "mcc", "balanced_accuracy")], "note")


@query("predictor_per_gene", f"""
WITH o AS (SELECT * FROM {ORIENTED}),
base AS (SELECT gene, predictor, count(s) AS n_scored, count(*) FILTER (s IS NOT NULL AND label = 1) AS n_pos,
  count(*) FILTER (s IS NOT NULL AND label = 0) AS n_neg FROM o GROUP BY gene, predictor)
SELECT b.gene, b.predictor, b.n_scored, b.n_pos, b.n_neg,
  CASE WHEN b.n_scored = 0 THEN 'no scores' WHEN b.n_pos = 0 OR b.n_neg = 0 THEN 'single class'
   WHEN b.n_pos < 5 OR b.n_neg < 5 THEN 'too few samples' ELSE 'ok' END AS note,
  CASE WHEN b.n_pos >= 5 AND b.n_neg >= 5 THEN round(a.roc_auc, 9) END AS roc_auc
FROM base b LEFT JOIN {sql_auc('o', 'gene, predictor', 's')} a ON a.gene = b.gene AND a.predictor = b.predictor""")
def predictor_per_gene(spark, sf):
    out = B.predictors_by_group(view(spark, sf, "predictors_long"), "gene", lower_is_pathogenic=["p_inverse"])
    return out.withColumn("roc_auc", F.round("roc_auc", 9))


SUBSETS = """(SELECT 'all' AS subset, * FROM bench UNION ALL SELECT 'no_training_overlap', * FROM bench WHERE NOT in_training
 UNION ALL SELECT 'test_only', * FROM bench WHERE in_test UNION ALL SELECT 'novel_only', * FROM bench WHERE NOT in_training AND NOT in_test)"""
CUBED = f"""(SELECT subset, src AS source, g AS gene, p_tree, label FROM {SUBSETS} s0, unnest([s0.source, 'ALL']) AS u1(src), unnest([s0.gene, 'ALL']) AS u2(g))"""


@query("benchmark_subsets", f"""
WITH e AS {CUBED}
SELECT a.subset, a.source, a.gene, a.n, round(a.roc_auc, 9) AS roc_auc, round(c.mcc, 9) AS mcc,
  round((c.sens + c.spec) / 2, 9) AS balanced_accuracy
FROM {sql_auc('e', 'subset, source, gene', 'p_tree')} a
JOIN {sql_confusion('e', 'subset, source, gene', 'p_tree >= 0.5::DOUBLE')} c
 ON c.subset = a.subset AND c.source = a.source AND c.gene = a.gene""")
def benchmark_subsets(spark, sf):
    out = B.subset_metrics(view(spark, sf, "bench"), "p_tree", "label")
    return out.select("subset", "source", "gene", "n", *[F.round(c, 9).alias(c) for c in ("roc_auc", "mcc", "balanced_accuracy")])


@query("run_delta", f"""
WITH e AS {CUBED.replace('p_tree, label', 'p_tree, p_mlp, label')}
SELECT a.subset, a.source, a.gene, round(a.roc_auc, 9) AS roc_auc, round(b.roc_auc, 9) AS old_roc_auc,
  round(a.roc_auc - b.roc_auc, 9) AS delta_roc_auc
FROM {sql_auc('e', 'subset, source, gene', 'p_tree')} a JOIN {sql_auc('e', 'subset, source, gene', 'p_mlp')} b
 ON b.subset = a.subset AND b.source = a.source AND b.gene = a.gene""")
def run_delta(spark, sf):
    b = view(spark, sf, "bench")
    keys = ["subset", "source", "gene"]
    out = M.run_delta(B.subset_auc(b, "p_tree", "label"), B.subset_auc(b, "p_mlp", "label"), keys, ["roc_auc"])
    return out.select(*keys, *[F.round(c, 9).alias(c) for c in ("roc_auc", "old_roc_auc", "delta_roc_auc")])


@query("dms_label_flip", """
SELECT gene, 1 - dms_score_bin AS label, count(*) AS n, CAST(sum(dms_score_bin) AS BIGINT) AS bins
FROM bench WHERE dms_score_bin IS NOT NULL GROUP BY gene, 1 - dms_score_bin""")
def dms_label_flip(spark, sf):
    b = B.flip_assay_label(view(spark, sf, "bench")).filter("dms_score_bin IS NOT NULL")
    return b.groupBy("gene", F.col("assay_label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("dms_score_bin").cast("bigint").alias("bins"))


@query("delong_test", """
WITH r AS (SELECT gene, label, p_tree AS a, p_mlp AS b FROM variants),
va AS (SELECT gene, v, CAST(sum(n) OVER w - n AS DOUBLE) AS nlt, n, CAST(sum(p) OVER w AS DOUBLE) AS ple, p,
   CAST(sum(n) OVER (PARTITION BY gene) AS DOUBLE) AS nn, CAST(sum(p) OVER (PARTITION BY gene) AS DOUBLE) AS pp
  FROM (SELECT gene, a AS v, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r GROUP BY gene, a) x
  WINDOW w AS (PARTITION BY gene ORDER BY v)),
vb AS (SELECT gene, v, CAST(sum(n) OVER w - n AS DOUBLE) AS nlt, n, CAST(sum(p) OVER w AS DOUBLE) AS ple, p,
   CAST(sum(n) OVER (PARTITION BY gene) AS DOUBLE) AS nn, CAST(sum(p) OVER (PARTITION BY gene) AS DOUBLE) AS pp
  FROM (SELECT gene, b AS v, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r GROUP BY gene, b) x
  WINDOW w AS (PARTITION BY gene ORDER BY v)),
s AS (SELECT r.gene, r.label,
   CASE WHEN label = 1 THEN (x.nlt + x.n / 2) / x.nn ELSE (x.pp - x.ple + x.p / 2) / x.pp END AS ca,
   CASE WHEN label = 1 THEN (y.nlt + y.n / 2) / y.nn ELSE (y.pp - y.ple + y.p / 2) / y.pp END AS cb
  FROM r JOIN va x ON x.gene = r.gene AND x.v = r.a JOIN vb y ON y.gene = r.gene AND y.v = r.b)
SELECT *, round(CASE WHEN abs(z) >= 5 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(80), lambda i:
    (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * pow(abs(z) / sqrt(2), 2 * i + 1) / (gamma(i + 1.0::DOUBLE) * (2 * i + 1)))) END, 5) AS p_value FROM (
SELECT gene, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
  round(avg(ca) FILTER (label = 1), 9) AS auc_a, round(avg(cb) FILTER (label = 1), 9) AS auc_b,
  round(avg(ca - cb) FILTER (label = 1), 9) AS delta,
  round(avg(ca - cb) FILTER (label = 1) / sqrt(var_samp(ca - cb) FILTER (label = 1) / count(*) FILTER (label = 1)
    + var_samp(ca - cb) FILTER (label = 0) / count(*) FILTER (label = 0)), 6) AS z
FROM s GROUP BY gene) t""")
def delong_test(spark, sf):
    out = M.delong(view(spark, sf, "variants"), ["gene"], "p_tree", "p_mlp", "label")
    return out.select("gene", "n_pos", "n_neg", *[F.round(c, 9).alias(c) for c in ("auc_a", "auc_b", "delta")],
                      F.round("z", 6).alias("z"), F.round("p_value", 5).alias("p_value"))


@query("bootstrap_width_by_gene", """
WITH w AS (SELECT gene, abs(p_tree - p_mlp) / 4 AS width FROM variants)
SELECT gene, n, round(m, 9) AS median_width, round(a, 9) AS mean_width, round(s, 9) AS std_width,
 CASE WHEN m < 0.1::DOUBLE THEN 'NARROW' WHEN m < 0.2::DOUBLE THEN 'MODERATE' ELSE 'WIDE' END AS band
FROM (SELECT gene, count(*) AS n, median(width) AS m, avg(width) AS a, stddev_pop(width) AS s FROM w GROUP BY gene) x""")
def bootstrap_width_by_gene(spark, sf):
    v = view(spark, sf, "variants").withColumn("width", F.abs(F.col("p_tree") - F.col("p_mlp")) / 4)
    out = B.width_summary(v, ["gene"], "width")
    return out.select("gene", "n", *[F.round(c, 9).alias(c) for c in ("median_width", "mean_width", "std_width")], "band")
