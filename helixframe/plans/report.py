"""One wide result per variant: every look-up, score, bound and rule in one row."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.functions import evidence as EV, rules as R
from helixframe.operators import calibration as C, quality as Q, support as S
from helixframe.plans.evidence import ASSAY, FULL_CODES, HIST, K4, KEY, PHYLO, POP, full_rules, inputs, sql_class
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query
from helixframe.plans.scoring import ISO, SETS

PLAIN_SETS = SETS.replace("sc AS", "scr AS").replace("FROM sc", "FROM scr").replace("al AS", "alr AS").replace("FROM al ", "FROM alr ")


@query("variant_report", f"""
WITH {ISO}, {PLAIN_SETS}, {HIST}, same AS (SELECT gene, aa_ref, aa_alt, count(*) AS n FROM tr GROUP BY ALL),
q AS (SELECT DISTINCT gene, p_tree AS x FROM variants WHERE split = 'test'),
lo AS (SELECT q.gene, q.x, max(f.x) AS x0 FROM q LEFT JOIN fit f ON f.gene = q.gene AND f.x <= q.x GROUP BY q.gene, q.x),
hi AS (SELECT q.gene, q.x, min(f.x) AS x1 FROM q LEFT JOIN fit f ON f.gene = q.gene AND f.x > q.x GROUP BY q.gene, q.x),
cal AS (SELECT lo.gene, lo.x, CASE WHEN a.y IS NULL THEN b.y WHEN b.y IS NULL OR lo.x = lo.x0 THEN a.y ELSE a.y + (lo.x - lo.x0) * (b.y - a.y) / (hi.x1 - lo.x0) END AS y
  FROM lo JOIN hi ON hi.gene = lo.gene AND hi.x = lo.x LEFT JOIN fit a ON a.gene = lo.gene AND a.x = lo.x0 LEFT JOIN fit b ON b.gene = hi.gene AND b.x = hi.x1),
ev AS (SELECT {K4}, codes, acmg_class, pop FROM {sql_class(FULL_CODES)} c),
p AS (SELECT v.*, least(greatest(cal.y, 0.01::DOUBLE), 0.99::DOUBLE) AS prob, least(v.p_tree, v.p_mlp) AS a, greatest(v.p_tree, v.p_mlp) AS b, ev.codes, ev.acmg_class, ev.pop IS NOT NULL AND ev.pop = 'kazakh' AS w
  FROM variants v JOIN cal ON cal.gene = v.gene AND cal.x = v.p_tree JOIN ev USING ({K4}) WHERE v.split = 'test'),
ci AS (SELECT *, CASE WHEN w THEN least(greatest((a + b) / 2 - (b - a) / 2 * 1.5::DOUBLE, 0), 1) ELSE a END AS clo, CASE WHEN w THEN least(greatest((a + b) / 2 + (b - a) / 2 * 1.5::DOUBLE, 0), 1) ELSE b END AS chi FROM p)
SELECT ci.l_orderkey, ci.l_linenumber, ci.l_partkey, ci.l_suppkey, g.transcript || ':c.' || ci.cdna_pos || ci.mutation AS hgvs_c, 'p.' || ci.aa_ref || ci.aa_pos || ci.aa_alt AS hgvs_p, round(prob, 6) AS probability,
  CASE WHEN prob > 0.9::DOUBLE THEN 'pathogenic' WHEN prob > 0.7::DOUBLE THEN 'likely_pathogenic' WHEN prob < 0.1::DOUBLE THEN 'benign' WHEN prob < 0.3::DOUBLE THEN 'likely_benign' ELSE 'uncertain' END AS risk_tier,
  round(clo, 6) AS ci_lower, round(chi, 6) AS ci_upper, CASE WHEN chi - clo < 0.10::DOUBLE THEN 'High Confidence' WHEN chi - clo < 0.25::DOUBLE THEN 'Moderate Confidence' ELSE 'Low Confidence' END AS confidence,
  concat_ws(',', CASE WHEN inp = 1 THEN 'Pathogenic' END, CASE WHEN inb = 1 THEN 'Benign' END) AS conformal, nearby, coalesce(same.n, 0) AS same_substitution,
  CASE WHEN nearby > 100 THEN 'HIGH' WHEN nearby >= 10 THEN 'MODERATE' ELSE 'LOW' END AS data_support, ci.codes, ci.acmg_class,
  CASE WHEN ph > 7 THEN 'Ultra-conserved' WHEN ph > 4 THEN 'Conserved' ELSE 'Variable' END AS phylop_label,
  CASE WHEN ma IS NULL THEN 'No data' WHEN ma < 1.49::DOUBLE THEN 'Abnormal' WHEN ma > 2.5::DOUBLE THEN 'Normal' ELSE 'Intermediate' END AS assay_label
FROM (SELECT *, {PHYLO} AS ph, {ASSAY} AS ma FROM ci) ci JOIN fs USING ({K4}) JOIN near n ON n.gene = ci.gene AND n.aa_pos = ci.aa_pos
JOIN genes g ON g.gene = ci.gene LEFT JOIN same ON same.gene = ci.gene AND same.aa_ref = ci.aa_ref AND same.aa_alt = ci.aa_alt""")
def variant_report(spark, sf):
    """All results of each requested variant (the test split) in one pass over the request table."""
    v = view(spark, sf, "variants")
    cal, train = v.filter("split = 'cal'"), v.filter("split = 'train'")
    e = inputs(spark, sf).filter("split = 'test'").withColumn("codes", EV.code_list(full_rules()))
    e = EV.classify(e)
    e = C.isotonic_apply(e, C.isotonic_fit(cal, "gene", "p_tree", "label"), "gene", "p_tree")
    thresholds = C.conformal_fit(cal, "gene", "p_tree", "label").withColumn("quantile", F.round("quantile", 9))
    e = C.with_conformal_set(e, thresholds, "gene", "p_tree")
    e = S.data_support(e, train, F.col("critical"))
    p = R.clip(F.col("calibrated"), K.CLIP_SINGLE)
    ci = R.widen_interval(F.least("p_tree", "p_mlp"), F.greatest("p_tree", "p_mlp"), EV.is_underrepresented(F.expr(POP)))
    e = e.withColumn("p", p).withColumns(ci)
    e = Q.add_identifiers(e.join(view(spark, sf, "genes").select("gene", "transcript"), "gene"))
    labels = R.source_labels(F.expr(PHYLO), F.expr(ASSAY), F.col("p_tree"), F.lit(None).cast("double"))
    return e.select(*KEY, "hgvs_c", "hgvs_p", F.round("p", 6).alias("probability"), R.risk_tier(F.col("p")).alias("risk_tier"), F.round("ci_lower", 6).alias("ci_lower"),
                    F.round("ci_upper", 6).alias("ci_upper"), R.uncertainty_label(F.col("ci_upper") - F.col("ci_lower")).alias("confidence"),
                    F.array_join("conformal_set", ",").alias("conformal"), "nearby", "same_substitution", F.col("level").alias("data_support"),
                    F.array_join("codes", ",").alias("codes"), "acmg_class", *[labels[c].alias(c) for c in ("phylop_label", "assay_label")])
