"""Scoring, calibration and uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import rules as R
from helixframe.operators import aggregates as AG, calibration as C, features as FE, metrics as M, sampling as SA, training as TR
from helixframe.plans.evaluation import sql_auc, sql_confusion, sql_curve
from helixframe.plans.evidence import K4, KEY
from helixframe.plans.features import FULL, full_vector, vec_sql
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query


def variants(spark, sf):
    return view(spark, sf, "variants")


SCALED = [c for c in FE.FEATURE_ORDER if not AG.is_leak(c)]


@query("standard_scale", f"""
WITH f AS (SELECT gene, split, label, {', '.join(f'CAST({vec_sql(c)} AS DOUBLE) AS "{c}"' for c in SCALED)} FROM {FULL} v),
m AS (SELECT {', '.join(f'avg("{c}") AS "m_{c}", CASE WHEN stddev_pop("{c}") = 0 THEN 1 ELSE stddev_pop("{c}") END AS "s_{c}"' for c in SCALED)} FROM f WHERE split = 'train')
SELECT gene, label, count(*) AS n, {', '.join(f'round(sum(("{c}" - "m_{c}") / "s_{c}" * (("{c}" - "m_{c}") / "s_{c}" + 1)), 4) AS "{c}"' for c in SCALED)} FROM f, m GROUP BY gene, label""")
def standard_scale(spark, sf):
    """All columns of the feature vector scaled by their training moments; compared as sums of z (z + 1)."""
    table, _ = modelling(spark, sf)
    out = TR.scaled(table, table.filter("split = 'train'"), len(SCALED)).withColumn("label", F.col("label").cast("int"))
    x = F.col("x")
    return out.groupBy("gene", "label").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(x[i] * (x[i] + 1)), 4).alias(c) for i, c in enumerate(SCALED)])


@query("blend_scores", f"""
SELECT {K4}, round(coalesce(g.xgb_weight, 0.6::DOUBLE) * p_tree + coalesce(g.mlp_weight, 0.4::DOUBLE) * p_mlp, 9) AS blended, round(abs(p_tree - p_mlp), 9) AS disagreement
FROM variants v LEFT JOIN (SELECT gene, xgb_weight + gid * 0.05::DOUBLE AS xgb_weight, mlp_weight - gid * 0.05::DOUBLE AS mlp_weight FROM genes WHERE gid < 4) g ON g.gene = v.gene""")
def blend_scores(spark, sf):
    w = view(spark, sf, "genes").filter("gid < 4").select("gene", (F.col("xgb_weight") + F.col("gid") * 0.05).alias("w1"), (F.col("mlp_weight") - F.col("gid") * 0.05).alias("w2"))
    b, d = C.blend(F.col("p_tree"), F.col("p_mlp"), F.col("w1"), F.col("w2"))
    return variants(spark, sf).join(w, "gene", "left").select(*KEY, F.round(b, 9).alias("blended"), F.round(d, 9).alias("disagreement"))


GRID = "(SELECT v.gene, v.label, s AS step, round((s / 20.0::DOUBLE) * p_tree + (1 - s / 20.0::DOUBLE) * p_mlp, 9) AS b FROM variants v, unnest(range(21)) u(s) WHERE split = 'cal')"


@query("optimise_weights", f"""
SELECT gene, round(step / 20.0::DOUBLE, 2) AS w1, round(1 - step / 20.0::DOUBLE, 2) AS w2, 'optimized' AS method, auc AS cal_auc FROM (
SELECT gene, step, round(roc_auc, 9) AS auc, row_number() OVER (PARTITION BY gene ORDER BY round(roc_auc, 9) DESC, step) AS rn FROM {sql_auc(GRID + ' g', 'gene, step', 'b')} a) x WHERE rn = 1""")
def optimise_weights(spark, sf):
    return C.optimise_weights(variants(spark, sf).filter("split = 'cal'"), "gene", "p_tree", "p_mlp", "label")


TESTED = """(SELECT v.gene, v.label, b.w1, b.w2, round(b.w1 * p_tree + b.w2 * p_mlp, 9) AS best, round(0.6::DOUBLE * p_tree + 0.4::DOUBLE * p_mlp, 9) AS base
  FROM variants v JOIN best b ON b.gene = v.gene WHERE split = 'test')"""


@query("weight_report", f"""
WITH best AS (SELECT gene, round(step / 20.0::DOUBLE, 2) AS w1, round(1 - step / 20.0::DOUBLE, 2) AS w2, auc AS cal_auc FROM (
  SELECT gene, step, round(roc_auc, 9) AS auc, row_number() OVER (PARTITION BY gene ORDER BY round(roc_auc, 9) DESC, step) AS rn FROM {sql_auc(GRID + ' g', 'gene, step', 'b')} a) x WHERE rn = 1)
SELECT gene, w1, w2, cal_auc, n AS n_test, round(a.roc_auc, 9) AS best_test_auc, round(d.roc_auc, 9) AS default_test_auc, round(a.roc_auc - d.roc_auc, 9) AS gain
FROM best JOIN {sql_auc(TESTED + ' t', 'gene', 'best')} a USING (gene) JOIN (SELECT gene, roc_auc FROM {sql_auc(TESTED + ' t', 'gene', 'base')} u) d USING (gene)""")
def weight_report(spark, sf):
    v = variants(spark, sf)
    out = C.weight_report(v.filter("split = 'cal'"), v.filter("split = 'test'"), "gene", "p_tree", "p_mlp", "label")
    return out.select("gene", "w1", "w2", "cal_auc", "n_test", *[F.round(c, 9).alias(c) for c in ("best_test_auc", "default_test_auc", "gain")])


# Exact isotonic value of every distinct score by the max-min formula.
ISO = """pts AS (SELECT gene, p_tree AS x, count(*) AS w, sum(label) AS s FROM variants WHERE split = 'cal' GROUP BY gene, p_tree),
cum AS (SELECT gene, x, row_number() OVER o AS i, CAST(sum(w) OVER o AS DOUBLE) AS cw, CAST(sum(s) OVER o AS DOUBLE) AS cs, CAST(sum(w) OVER o - w AS DOUBLE) AS pw, CAST(sum(s) OVER o - s AS DOUBLE) AS ps
  FROM pts WINDOW o AS (PARTITION BY gene ORDER BY x)),
pr AS (SELECT a.gene, a.i AS j, b.i AS k, (b.cs - a.ps) / (b.cw - a.pw) AS m FROM cum a JOIN cum b ON b.gene = a.gene AND b.i >= a.i),
mn AS (SELECT gene, j, k, min(m) OVER (PARTITION BY gene, j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lo FROM pr),
fit AS (SELECT c.gene, c.x, f.y FROM cum c JOIN (SELECT gene, k AS i, max(lo) AS y FROM mn GROUP BY gene, k) f ON f.gene = c.gene AND f.i = c.i)"""


@query("isotonic_fit", f"WITH {ISO} SELECT gene, round(min(x), 9) AS lo, round(max(x), 9) AS hi, round(y, 9) AS mean FROM (SELECT gene, x, round(y, 11) AS y FROM fit) q GROUP BY gene, y")
def isotonic_fit(spark, sf):
    blocks = C.isotonic_fit(variants(spark, sf).filter("split = 'cal'"), "gene", "p_tree", "label").filter("gene <> '_universal'")
    return blocks.select("gene", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), F.round("mean", 9).alias("mean"))


@query("isotonic_apply", f"""
WITH {ISO}, q AS (SELECT DISTINCT gene, p_tree AS x FROM variants WHERE split = 'test'),
lo AS (SELECT q.gene, q.x, max(f.x) AS x0 FROM q LEFT JOIN fit f ON f.gene = q.gene AND f.x <= q.x GROUP BY q.gene, q.x),
hi AS (SELECT q.gene, q.x, min(f.x) AS x1 FROM q LEFT JOIN fit f ON f.gene = q.gene AND f.x > q.x GROUP BY q.gene, q.x)
SELECT v.l_orderkey, v.l_linenumber, v.l_partkey, v.l_suppkey, round(CASE WHEN a.y IS NULL THEN b.y WHEN b.y IS NULL OR v.p_tree = lo.x0 THEN a.y ELSE a.y + (v.p_tree - lo.x0) * (b.y - a.y) / (hi.x1 - lo.x0) END, 9) AS calibrated
FROM variants v JOIN lo ON lo.gene = v.gene AND lo.x = v.p_tree JOIN hi ON hi.gene = v.gene AND hi.x = v.p_tree
LEFT JOIN fit a ON a.gene = lo.gene AND a.x = lo.x0 LEFT JOIN fit b ON b.gene = hi.gene AND b.x = hi.x1 WHERE v.split = 'test'""")
def isotonic_apply(spark, sf):
    v = variants(spark, sf)
    blocks = C.isotonic_fit(v.filter("split = 'cal'"), "gene", "p_tree", "label")
    out = C.isotonic_apply(v.filter("split = 'test'"), blocks, "gene", "p_tree")
    return out.select(*KEY, F.round("calibrated", 9).alias("calibrated"))


@query("clip_probability", f"""
SELECT {K4}, least(greatest(p_tree, 0.005::DOUBLE), 0.995::DOUBLE) AS batch, least(greatest(p_tree, 0.01::DOUBLE), 0.99::DOUBLE) AS single FROM variants""")
def clip_probability(spark, sf):
    from helixframe import constants as K
    p = F.col("p_tree")
    return variants(spark, sf).select(*KEY, R.clip(p, K.CLIP_BATCH).alias("batch"), R.clip(p, K.CLIP_SINGLE).alias("single"))


@query("best_f1_threshold", f"""
SELECT gene, s AS threshold, f1 FROM (SELECT gene, s, round(2 * (tp / (tp + fp)) * (tp / pt) / (tp / (tp + fp) + tp / pt + 1e-8::DOUBLE), 12) AS f1,
  row_number() OVER (PARTITION BY gene ORDER BY round(2 * (tp / (tp + fp)) * (tp / pt) / (tp / (tp + fp) + tp / pt + 1e-8::DOUBLE), 12) DESC, s) AS rn FROM {sql_curve('variants', 'gene', 'p_tree')} k) x WHERE rn = 1""")
def best_f1_threshold(spark, sf):
    return M.best_f1(variants(spark, sf), ["gene"], "p_tree", "label").select("gene", "threshold", "f1")


CONF = """sc AS (SELECT gene, round(CASE WHEN label = 1 THEN 1 - p_tree ELSE p_tree END, 12) AS s FROM variants WHERE split = 'cal'),
al AS (SELECT gene, s FROM sc UNION ALL SELECT '_global', s FROM sc),
ls AS (SELECT gene, count(*) AS n, list(s ORDER BY s) AS l FROM al GROUP BY gene),
hs AS (SELECT *, (n - 1) * least(ceil((n + 1) * 0.9::DOUBLE) / n, 1) AS h FROM ls),
th AS (SELECT gene, n, l[CAST(floor(h) AS BIGINT) + 1] + (l[CAST(ceil(h) AS BIGINT) + 1] - l[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h)) AS q FROM hs)"""


def thresholds(spark, sf):
    return C.conformal_fit(variants(spark, sf).filter("split = 'cal'"), "gene", "p_tree", "label")


@query("conformal_fit", f"WITH {CONF} SELECT gene, n AS n_calibration, round(q, 9) AS quantile, FALSE AS is_fallback FROM th")
def conformal_fit(spark, sf):
    return thresholds(spark, sf).withColumn("quantile", F.round("quantile", 9))


SETS = f"""{CONF}, st AS (SELECT v.*, p_tree >= 1 - q AS hp, 1 - p_tree >= 1 - q AS hb FROM variants v JOIN (SELECT gene, round(q, 9) AS q FROM th) t ON t.gene = v.gene WHERE split = 'test'),
fs AS (SELECT *, CASE WHEN hp OR (NOT hb AND p_tree >= 0.5::DOUBLE) THEN 1 ELSE 0 END AS inp, CASE WHEN hb OR (NOT hp AND p_tree < 0.5::DOUBLE) THEN 1 ELSE 0 END AS inb FROM st)"""


def sets(spark, sf):
    t = thresholds(spark, sf).withColumn("quantile", F.round("quantile", 9))
    return C.with_conformal_set(variants(spark, sf).filter("split = 'test'"), t, "gene", "p_tree")


@query("conformal_apply", f"WITH {SETS} SELECT {K4}, concat_ws(',', CASE WHEN inp = 1 THEN 'Pathogenic' END, CASE WHEN inb = 1 THEN 'Benign' END) AS labels FROM fs")
def conformal_apply(spark, sf):
    return sets(spark, sf).select(*KEY, F.array_join("conformal_set", ",").alias("labels"))


@query("conformal_coverage", f"""WITH {SETS} SELECT gene, count(*) AS n, round(avg(CASE WHEN label = 1 THEN inp ELSE inb END), 9) AS coverage, round(avg(inp + inb), 9) AS avg_set_size,
  round(avg(CASE WHEN inp + inb = 1 THEN 1 ELSE 0 END), 9) AS singleton_rate FROM fs GROUP BY gene""")
def conformal_coverage(spark, sf):
    out = C.conformal_coverage(sets(spark, sf), "gene", "label")
    return out.select("gene", "n", *[F.round(c, 9).alias(c) for c in ("coverage", "avg_set_size", "singleton_rate")])


@query("bootstrap_ci_models", f"""
WITH e AS (SELECT {K4}, unnest(list_transform(range(1, 21), lambda k: least(greatest(p_tree + ((l_partkey * k) % 21 - 10) / 200.0::DOUBLE, 0), 1))) AS s FROM variants)
SELECT {K4}, round(quantile_cont(s, 0.05), 9) AS ci_lower, round(quantile_cont(s, 0.95), 9) AS ci_upper FROM e GROUP BY {K4}""")
def bootstrap_ci_models(spark, sf):
    arr = F.expr("transform(sequence(1, 20), k -> least(greatest(p_tree + ((l_partkey * k) % 21 - 10) / 200D, 0D), 1D))")
    v = variants(spark, sf).withColumn("e", arr)
    ci = C.ensemble_interval(F.col("e"))
    return v.select(*KEY, F.round(ci["ci_lower"], 9).alias("ci_lower"), F.round(ci["ci_upper"], 9).alias("ci_upper"))


@query("bootstrap_metric_ci")
def bootstrap_metric_ci(spark, sf):
    """1,000 resamples of the pooled test rows; random draws, so rows only."""
    return C.bootstrap_metric_ci(variants(spark, sf).filter("split = 'test'"), "p_tree", "label")


@query("beta_interval")
def beta_interval(spark, sf):
    """95% Beta interval of every distinct probability; SQL has no inverse Beta."""
    p = variants(spark, sf).select("p_tree").distinct()
    ci = p.withColumn("ci", C.beta_interval(F.col("p_tree"), F.lit(100.0)))
    return ci.select("p_tree", F.round(F.col("ci")[0], 6).alias("ci_lower"), F.round(F.col("ci")[1], 6).alias("ci_upper"))


H = "(l_orderkey * 104729 + l_partkey * 7919 + l_linenumber * 13) % 1000003"


@query("stratified_split", f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY gene, label ORDER BY {H}, {K4}) - 1 AS i, count(*) OVER (PARTITION BY gene, label) AS size FROM variants)
SELECT {K4}, CASE WHEN i < floor(size * 0.6::DOUBLE + 0.5::DOUBLE) THEN 'train' WHEN i < floor(size * 0.8::DOUBLE + 0.5::DOUBLE) THEN 'cal' ELSE 'test' END AS split FROM o""")
def stratified_split(spark, sf):
    v = variants(spark, sf).drop("split")
    return SA.stratified_split(v, ["gene", "label"], F.expr(H), 1000003, KEY).select(*KEY, "split")


@query("kfold_assign", f"""
SELECT {K4}, CAST((row_number() OVER (PARTITION BY gene, label ORDER BY {H}, {K4}) - 1) % 10 + 1 AS INT) AS fold FROM variants""")
def kfold_assign(spark, sf):
    return SA.kfold(variants(spark, sf), ["gene", "label"], F.expr(H), 1000003, KEY).select(*KEY, "fold")


@query("temporal_split", f"SELECT {K4}, CASE WHEN y >= 2024 THEN 'test' ELSE 'train' END AS part FROM (SELECT *, CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE eval_year END AS y FROM variants) v")
def temporal_split(spark, sf):
    y = F.expr("CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE eval_year END")
    return variants(spark, sf).select(*KEY, SA.temporal_split(y, 2024).alias("part"))


@query("class_weight", """
SELECT gene, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1) AS n_pos, round(count(*) FILTER (label = 0) / CAST(greatest(count(*) FILTER (label = 1), 1) AS DOUBLE), 9) AS weight
FROM variants WHERE split = 'train' GROUP BY gene""")
def class_weight(spark, sf):
    return C.class_weight(variants(spark, sf).filter("split = 'train'"), ["gene"], "label").withColumn("weight", F.round("weight", 9))


SMALL_GENES = ("BRCA1", "PALB2", "RAD51C", "RAD51D")
# Trees of the registered jobs. The operators' defaults are the production sizes; README has measured times of both.
SIZE = {"iterations": 20, "depth": 5, "step": 0.1}
MANY = {"iterations": 10, "depth": 5, "step": 0.2}  # where one query fits dozens of models
RESAMPLES = 10


def modelling(spark, sf):
    """The full feature vector of every variant, without what tells the gene or the row's place."""
    return TR.feature_table(full_vector(spark, sf, [*KEY, "gene", "split", "label"]), SCALED, "label", [*KEY, "gene", "split"]), SCALED


def feature_groups(columns):
    """Places of the features of each ablation group."""
    groups = {"frequency": ("gnomad_", "is_rare", "is_popmax_rare", "af_x"), "assay": ("mave_", "has_mave"), "conservation": ("phylop", "high_cons", "ultra_cons", "conserv_"),
              "embedding": ("esm2_",), "structure": ("rsa", "is_buried", "bfactor", "dist_dna", "dist_palb2", "is_dna", "ss_", "buried_", "dna_contact")}
    return {g: [i for i, c in enumerate(columns) if c.startswith(names)] for g, names in groups.items()}


@query("minority_oversample")
def minority_oversample(spark, sf):
    """Synthetic minority rows that balance the training set, on the full scaled vector; drawn by hash, so rows only."""
    table, columns = modelling(spark, sf)
    train = table.filter("split = 'train'")
    out = TR.oversample(TR.scaled(train, train, len(columns)), "label", "x", "row")
    return out.select("label", *[F.round(F.col("x")[i], 6).alias(c) for i, c in enumerate(columns)])


@query("train_ensemble")
def train_ensemble(spark, sf):
    table, columns = modelling(spark, sf)
    out = TR.train_ensemble(table, "label", "split", "gene", len(columns), net_iterations=50, **SIZE)
    return out.select(*KEY, *[F.round(c, 6).alias(c) for c in ("score_tree", "score_mlp", "score_blend", "calibrated")])


@query("cross_validate")
def cross_validate(spark, sf):
    table, _ = modelling(spark, sf)
    return TR.cross_validate(table, "label", ["gene", "label"], KEY, **SIZE)


@query("temporal_validation")
def temporal_validation(spark, sf):
    """Trees fitted on variants evaluated before 2024, judged on later ones."""
    keep = [*KEY, "gene", "split", F.expr("CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE eval_year END").alias("year"), "label"]
    table = TR.feature_table(full_vector(spark, sf, keep), SCALED, "label", [*KEY, "gene", "year"])
    return TR.temporal_validation(table, "label", "year", 2024, ["gene", "label"], KEY, **SIZE)


@query("resampled_fits")
def resampled_fits(spark, sf):
    """Score interval of every test variant over fits on resamples of the training variants."""
    table, _ = modelling(spark, sf)
    out = TR.resampled_fits(table.filter("split = 'train'"), table.filter("split = 'test'"), "label", KEY, fits=RESAMPLES, **MANY)
    return out.select(*KEY, *[F.round(c, 6).alias(c) for c in ("mean_score", "ci_lower", "ci_upper", "ci_width")])


@query("transfer_experiment")
def transfer_experiment(spark, sf):
    table, _ = modelling(spark, sf)
    return TR.transfer(table, "label", "split", "gene", "BRCA2", SMALL_GENES, **MANY)


@query("feature_group_ablation")
def feature_group_ablation(spark, sf):
    table, columns = modelling(spark, sf)
    return TR.group_ablation(table, "label", "split", feature_groups(columns), len(columns), ["gene", "label"], KEY, k=3, **MANY)


@query("ablation_delta", f"""
WITH g AS (SELECT gene, label, p_tree, p_mlp FROM variants UNION ALL SELECT 'ALL', label, p_tree, p_mlp FROM variants),
m AS (SELECT a.gene, a.n, a.roc_auc AS aw, b.roc_auc AS ao, c.mcc AS mw, d.mcc AS mo FROM {sql_auc('g', 'gene', 'p_tree')} a JOIN {sql_auc('g', 'gene', 'p_mlp')} b USING (gene)
  JOIN {sql_confusion('g', 'gene', 'p_tree >= 0.5::DOUBLE')} c USING (gene) JOIN {sql_confusion('g', 'gene', 'p_mlp >= 0.5::DOUBLE')} d USING (gene)),
s AS (SELECT gene, count(*) FILTER ((p_tree >= 0.5::DOUBLE) <> (p_mlp >= 0.5::DOUBLE)) AS class_changes, avg(abs(p_tree - p_mlp)) AS mean_shift FROM g GROUP BY gene)
SELECT gene, n, round(aw, 9) AS auc_with, round(ao, 9) AS auc_without, round(ao - aw, 9) AS delta_auc, round(mo - mw, 9) AS delta_mcc, class_changes, round(mean_shift, 9) AS mean_shift,
  CASE WHEN abs(ao - aw) < 0.005::DOUBLE THEN 'minimal_impact' WHEN abs(ao - aw) < 0.02::DOUBLE THEN 'moderate_impact' ELSE 'significant_impact' END AS assessment FROM m JOIN s USING (gene)""")
def ablation_delta(spark, sf):
    v = variants(spark, sf).select("gene", "label", "p_tree", "p_mlp").withColumn("gene", F.explode(F.array("gene", F.lit("ALL"))))
    out = M.impact(v, ["gene"], "p_tree", "p_mlp", "label")
    return out.select("gene", "n", *[F.round(c, 9).alias(c) for c in ("auc_with", "auc_without", "delta_auc", "delta_mcc")], "class_changes",
                      F.round("mean_shift", 9).alias("mean_shift"), "assessment")
