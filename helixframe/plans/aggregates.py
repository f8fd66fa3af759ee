"""Aggregations over the variant, frequency and log views."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import evidence as EV, rules as R
from helixframe.operators import aggregates as AG, annotate as A, features as FE, lookups as L, quality as Q, ranking as RK, vcf as V
from helixframe.plans.coordinates import classified
from helixframe.plans.evaluation import sql_auc
from helixframe.plans.evidence import EV_CODES, K4, KEY, sql_class, with_codes
from helixframe.plans.features import FULL, full_vector, vec_sql
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query
from helixframe.session import materialise

VK = "gene, aa_pos, aa_ref, aa_alt"
POPS = {"AFR": "af_afr", "AMR": "af_amr", "EAS": "af_eas", "NFE": "af_nfe"}
LONG = "(" + " UNION ALL ".join(f"SELECT v.*, '{n}' AS population, {c} AS pop_af FROM variants v" for n, c in POPS.items()) + ")"


def variants(spark, sf):
    return view(spark, sf, "variants")


def with_thresholds(spark, sf):
    return variants(spark, sf).join(view(spark, sf, "genes").select("gene", "ba1", "bs1"), "gene")


@query("agg_position_mean", "SELECT gene, aa_pos, round(avg(p_mlp), 9) AS score FROM variants GROUP BY gene, aa_pos")
def agg_position_mean(spark, sf):
    return AG.position_mean(variants(spark, sf).withColumnRenamed("p_mlp", "score"), ["gene", "aa_pos"], ["score"]).withColumn("score", F.round("score", 9))


@query("agg_position_mean_nan", f"""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {VK} ORDER BY {K4}) AS rn FROM (SELECT *, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE p_tree END AS a,
  CASE WHEN l_partkey % 6 < 3 THEN NULL ELSE p_mlp END AS b FROM variants) x WHERE a IS NOT NULL OR b IS NOT NULL) y WHERE rn = 1)
SELECT gene, aa_pos, round(avg(a), 9) AS a, round(avg(b), 9) AS b FROM f GROUP BY gene, aa_pos""")
def agg_position_mean_nan(spark, sf):
    v = variants(spark, sf).selectExpr(*KEY, *L.VARIANT_KEY, "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE p_tree END AS a",
                                       "CASE WHEN l_partkey % 6 < 3 THEN NULL ELSE p_mlp END AS b")
    out = AG.position_mean_first(v, L.VARIANT_KEY, ["gene", "aa_pos"], KEY, ["a", "b"])
    return out.select("gene", "aa_pos", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


@query("agg_position_max", f"""
SELECT gene, aa_pos, max(p_mlp) AS max_score, arg_max(p_mlp, ({K4})) AS last_score FROM variants GROUP BY gene, aa_pos""")
def agg_position_max(spark, sf):
    v = variants(spark, sf).withColumnRenamed("p_mlp", "s")
    mx = AG.position_max(v, ["gene", "aa_pos"], "s").withColumnRenamed("s", "max_score")
    return mx.join(AG.last_score(v, ["gene", "aa_pos"], "s", KEY).withColumnRenamed("s", "last_score"), ["gene", "aa_pos"])


@query("agg_frequency_max", """
SELECT gene, cdna_pos, max(af) AS af, max(af_afr) AS af_afr, max(af_amr) AS af_amr, max(af_eas) AS af_eas, max(af_nfe) AS af_nfe FROM variants GROUP BY gene, cdna_pos""")
def agg_frequency_max(spark, sf):
    return AG.frequency_max(variants(spark, sf), ["gene", "cdna_pos"], ["af", *POPS.values()])


@query("freq_source_pick", f"""
SELECT {K4}, CASE WHEN ea >= ga THEN ea ELSE ga END AS af, round(CASE WHEN ea >= ga THEN CASE WHEN ea > 0 THEN greatest(af_afr, af_amr, af_eas, af_nfe, af_sas) ELSE 0 END
  ELSE greatest(af_afr / 2, 0) END, 12) AS popmax FROM (SELECT *, exome_af AS ea, coalesce(genome_af, 0) AS ga FROM freq_records) x""")
def freq_source_pick(spark, sf):
    d = lambda e: F.expr(e).cast("double")
    exome = F.struct(d("exome_af").alias("af"), d("af_afr").alias("afr"), d("af_amr").alias("amr"), d("af_eas").alias("eas"), d("af_nfe").alias("nfe"), d("af_sas").alias("sas"))
    genome = F.struct(d("genome_af").alias("af"), d("af_afr / 2").alias("afr"), *[F.lit(0.0).alias(n) for n in ("amr", "eas", "nfe", "sas")])
    f = view(spark, sf, "freq_records").withColumn("best", AG.pick_source([exome, genome]))
    return f.select(*KEY, F.col("best.af").alias("af"), F.round(AG.popmax(F.col("best")), 12).alias("popmax"))


@query("freq_combine_counts", f"""
SELECT {K4}, ac, an, round(ac / CAST(an AS DOUBLE), 12) AS af FROM (SELECT *, coalesce(exome_ac, 0) + coalesce(genome_ac, 0) AS ac, coalesce(exome_an, 0) + coalesce(genome_an, 0) AS an
FROM freq_records) x WHERE an > 0 AND ac >= 2 AND ac / CAST(an AS DOUBLE) >= 0.001::DOUBLE""")
def freq_combine_counts(spark, sf):
    out = AG.combine_counts([("exome_ac", "exome_an"), ("genome_ac", "genome_an")], 2, 0.001)(view(spark, sf, "freq_records").drop("af"))
    return out.select(*KEY, "ac", "an", F.round("af", 12).alias("af"))


@query("splice_max_delta", f"""
SELECT {K4}, CASE WHEN l_partkey % 3 = 0 THEN greatest(p_tree / 2, af, p_mlp) ELSE greatest(p_tree, p_mlp / 2) END AS max_ds FROM variants WHERE l_partkey % 5 <> 0""")
def splice_max_delta(spark, sf):
    """Two transcripts per variant; the first whose gene matches counts."""
    tx = F.expr("""array(
      named_struct('gene', CASE WHEN l_partkey % 5 = 0 THEN 'none' WHEN l_partkey % 3 = 0 THEN 'other' ELSE gene END, 'ds_ag', p_tree, 'ds_al', p_mlp / 2, 'ds_dg', 0D, 'ds_dl', 0D),
      named_struct('gene', CASE WHEN l_partkey % 5 = 0 THEN 'none' ELSE gene END, 'ds_ag', p_tree / 2, 'ds_al', af, 'ds_dg', p_mlp, 'ds_dl', CAST(NULL AS DOUBLE)))""")
    v = variants(spark, sf).withColumn("tx", tx)
    hit = lambda t: t["gene"] == F.col("gene")
    return v.filter(F.exists("tx", hit)).select(*KEY, AG.splice_max(F.col("tx"), hit).alias("max_ds"))


@query("score_bands", """
SELECT gene, count(*) FILTER (p_tree < 0.34::DOUBLE) AS below, count(*) FILTER (p_tree BETWEEN 0.34::DOUBLE AND 0.564::DOUBLE) AS between, count(*) FILTER (p_tree > 0.564::DOUBLE) AS above
FROM variants GROUP BY gene""")
def score_bands(spark, sf):
    return AG.score_bands(variants(spark, sf), ["gene"], "p_tree", 0.340, 0.564)


@query("pathogenic_positions", """
SELECT gene, count(DISTINCT aa_pos) AS n, array_to_string(list_sort(list(DISTINCT aa_pos)), ',') AS positions FROM variants WHERE label = 1 AND aa_alt <> 'Ter' AND aa_ref <> aa_alt GROUP BY gene""")
def pathogenic_positions(spark, sf):
    v = variants(spark, sf).filter("label = 1 AND aa_alt <> 'Ter' AND aa_ref <> aa_alt")
    out = AG.sorted_positions(AG.pathogenic_positions(v))
    return out.select("gene", F.size("positions").cast("bigint").alias("n"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def sums(columns):
    return ", ".join(f'round(sum(CAST({vec_sql(c)} AS DOUBLE)), 4) AS "{c}"' for c in columns)


# The master table's rows: training variants, and frequent ones as benign proxies of unknown base change.
MASTER = """mrows AS (SELECT *, FALSE AS proxy FROM variants WHERE split = 'train'
  UNION ALL SELECT * REPLACE (greatest(aa_pos * 3, 1) AS cdna_pos, 'N>N' AS mutation, 0 AS label), TRUE FROM variants WHERE split = 'cal' AND af >= 0.001::DOUBLE)"""
MASTER_FULL = FULL.replace("FROM variants v JOIN blosum62", "FROM mrows v JOIN blosum62")


@query("master_dataset", f"""WITH {MASTER}
SELECT gene, label, proxy, count(*) AS n, round(sum(score), 4) AS score, {sums(FE.FEATURE_ORDER)}
FROM (SELECT v.*, coalesce(e.score, p.mean_score, 0) AS score FROM {MASTER_FULL} v LEFT JOIN annot_variant e ON e.gene = v.gene AND e.aa_pos = v.aa_pos AND e.aa_ref = v.aa_ref AND e.aa_alt = v.aa_alt
  LEFT JOIN annot_position p ON p.gene = v.gene AND p.aa_pos = v.aa_pos) m GROUP BY gene, label, proxy""")
def master_dataset(spark, sf):
    """Gene and proxy rows with the whole annotation chain, compared as sums of every column."""
    v = variants(spark, sf)
    main = v.filter("split = 'train'").withColumn("proxy", F.lit(False))
    proxy = v.filter("split = 'cal' AND af >= 0.001D").withColumns({
        "cdna_pos": Q.proxy_cdna(F.col("aa_pos")), "mutation": F.lit("N>N"), "label": F.lit(0), "proxy": F.lit(True)})

    def annotate(df):
        out = L.exact_then_position(df, view(spark, sf, "annot_variant"), view(spark, sf, "annot_position"), "score", "score", position_value="mean_score")
        return full_vector(spark, sf, ["gene", "label", "proxy", "score"], out)

    m = AG.master_dataset([main, proxy], annotate)
    return m.groupBy("gene", "label", "proxy").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"), *[
        F.round(F.sum(F.col(f"`{c}`").cast("double")), 4).alias(c) for c in FE.FEATURE_ORDER])


KEPT = [c for c in FE.FEATURE_ORDER if not AG.is_leak(c)]


@query("leak_drop", f"SELECT gene, label, count(*) AS n, {sums(KEPT)} FROM {FULL} v GROUP BY gene, label")
def leak_drop(spark, sf):
    """The wide feature table without its leaking columns, compared as sums of every column that is left."""
    kept = AG.drop_leaks(full_vector(spark, sf, ["gene", "label"]))
    return kept.groupBy("gene", "label").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.col(f"`{c}`").cast("double")), 4).alias(c) for c in kept.columns[2:]])


PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count("{c}") AS n, round(min("{c}"), 9) AS lo, round(max("{c}"), 9) AS hi, round(avg("{c}"), 6) AS mean, round(stddev_pop("{c}"), 6) AS std,
  min("{c}") = max("{c}") AS constant FROM f""" for c in FE.FEATURE_ORDER)


@query("zero_variance_drop", f"""
WITH f AS (SELECT {', '.join(f'CAST({vec_sql(c)} AS DOUBLE) AS "{c}"' for c in FE.FEATURE_ORDER)} FROM {FULL} v), p AS ({PROFILE_SQL})
SELECT *, NOT constant AS kept FROM p""")
def zero_variance_drop(spark, sf):
    """Profile of all columns of the feature table and whether each is in the reduced one."""
    wide = materialise(full_vector(spark, sf), "wide-features")
    out = materialise(AG.column_profile(wide, FE.FEATURE_ORDER), "column-profile")
    kept = AG.drop_constant(wide, FE.FEATURE_ORDER, out).columns
    return out.select("feature", "n", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "constant", F.col("feature").isin(kept).alias("kept"))


@query("class_balance", """
SELECT coalesce(gene, 'ALL') AS gene, count(*) AS n, count(*) FILTER (label = 1) AS pathogenic, count(*) FILTER (label = 0) AS benign,
  round(100.0::DOUBLE * count(*) FILTER (label = 1) / count(*), 9) AS pct_pathogenic FROM variants GROUP BY ROLLUP (gene)""")
def class_balance(spark, sf):
    return AG.class_balance(variants(spark, sf)).withColumn("pct_pathogenic", F.round("pct_pathogenic", 9))


@query("class_balance_minus", """
SELECT gene, n_before, benign_before, n_after, benign_after, round(100.0::DOUBLE * (n_after - benign_after) / n_after, 9) AS pct_pathogenic_after FROM (
SELECT gene, count(*) AS n_before, count(*) FILTER (label = 0) AS benign_before, count(*) FILTER (NOT (label = 0 AND af > 0)) AS n_after,
  count(*) FILTER (label = 0 AND NOT (label = 0 AND af > 0)) AS benign_after FROM variants GROUP BY gene) x""")
def class_balance_minus(spark, sf):
    out = AG.class_balance_without(variants(spark, sf), F.expr("label = 0 AND af > 0"))
    return out.withColumn("pct_pathogenic_after", F.round("pct_pathogenic_after", 9))


@query("pop_coverage", f"""
SELECT gene, population, count(*) AS total, count(*) FILTER (pop_af > 0) AS nonzero FROM ({LONG[1:-1]} UNION ALL SELECT v.*, 'GLOBAL', af FROM variants v) l GROUP BY gene, population""")
def pop_coverage(spark, sf):
    return AG.population_counts(variants(spark, sf), {**POPS, "GLOBAL": "af"}).select("gene", "population", "total", "nonzero")


@query("pop_frequency_stats", f"""
SELECT l.gene, population, count(*) FILTER (pop_af > 0) AS nonzero, round(coalesce(avg(pop_af) FILTER (pop_af > 0), 0), 12) AS mean_nonzero_af, max(a.n) AS nonzero_any_pop
FROM {LONG} l JOIN (SELECT gene, count(*) AS n FROM variants WHERE greatest(af_afr, af_amr, af_eas, af_nfe) > 0 GROUP BY gene) a ON a.gene = l.gene GROUP BY l.gene, population""")
def pop_frequency_stats(spark, sf):
    v = variants(spark, sf)
    out = AG.population_counts(v, POPS).join(AG.any_population(v, list(POPS.values())).drop("total"), "gene")
    return out.select("gene", "population", "nonzero", F.round("mean_nonzero_af", 12).alias("mean_nonzero_af"), "nonzero_any_pop")


CODE = "CASE WHEN {a} > g.ba1 THEN 'BA1' WHEN {a} > g.bs1 THEN 'BS1' WHEN {a} = 0 THEN 'PM2' ELSE '-' END"


@query("evidence_disparity", f"""
SELECT gene, population, count(*) AS n, count(*) FILTER (c = 'PM2') AS "PM2", count(*) FILTER (c = 'BS1') AS "BS1", count(*) FILTER (c = 'BA1') AS "BA1",
  round(100.0::DOUBLE * count(*) FILTER (c = 'PM2') / count(*), 9) AS "pct_PM2", round(100.0::DOUBLE * count(*) FILTER (c = 'BS1') / count(*), 9) AS "pct_BS1",
  round(100.0::DOUBLE * count(*) FILTER (c = 'BA1') / count(*), 9) AS "pct_BA1"
FROM (SELECT l.gene, population, {CODE.format(a='pop_af')} AS c FROM {LONG} l JOIN genes g ON g.gene = l.gene) x GROUP BY gene, population""")
def evidence_disparity(spark, sf):
    out = AG.evidence_disparity(with_thresholds(spark, sf), POPS)
    return out.withColumns({f"pct_{c}": F.round(f"pct_{c}", 9) for c in ("PM2", "BS1", "BA1")})


@query("af_recalibration", f"""
WITH c AS (SELECT l.gene, population, {CODE.format(a='af')} AS o, {CODE.format(a='pop_af')} AS n FROM {LONG} l JOIN genes g ON g.gene = l.gene)
SELECT coalesce(gene, 'ALL') AS gene, population, count(*) AS total, count(*) FILTER (o <> n) AS total_changed,
  count(*) FILTER (n = 'PM2' AND o <> 'PM2') AS "PM2_gained", count(*) FILTER (o = 'PM2' AND n <> 'PM2') AS "PM2_lost",
  count(*) FILTER (n = 'BS1' AND o <> 'BS1') AS "BS1_gained", count(*) FILTER (o = 'BS1' AND n <> 'BS1') AS "BS1_lost",
  count(*) FILTER (n = 'BA1' AND o <> 'BA1') AS "BA1_gained", count(*) FILTER (o = 'BA1' AND n <> 'BA1') AS "BA1_lost"
FROM c GROUP BY GROUPING SETS ((gene, population), (population))""")
def af_recalibration(spark, sf):
    return AG.af_recalibration(with_thresholds(spark, sf), POPS)


ANC = """CASE WHEN greatest(af_afr, af_amr, af_eas, af_nfe) <= 0 THEN 'NO_DATA' WHEN af_afr >= greatest(af_amr, af_eas, af_nfe) THEN 'AFR'
  WHEN af_amr >= greatest(af_eas, af_nfe) THEN 'AMR' WHEN af_eas >= af_nfe THEN 'EAS' ELSE 'NFE' END"""


@query("ancestry_assign", f"SELECT {K4}, {ANC} AS population FROM variants")
def ancestry_assign(spark, sf):
    return variants(spark, sf).select(*KEY, R.ancestry({n: F.col(c) for n, c in POPS.items()}).alias("population"))


@query("ancestry_bias", f"""
SELECT population, n, n_pos AS n_pathogenic, n_neg AS n_benign, CASE WHEN n >= 5 THEN round(roc_auc, 9) END AS auc FROM {sql_auc(f"(SELECT *, {ANC} AS population FROM variants) v", 'population', 'p_tree')} a""")
def ancestry_bias(spark, sf):
    return AG.ancestry_bias(variants(spark, sf), POPS, "p_tree", "label").withColumn("auc", F.round("auc", 9))


@query("vcf_type_counts", "SELECT l_suppkey, variant_type, count(*) AS n FROM vcf_classified WHERE variant_type IS NOT NULL GROUP BY l_suppkey, variant_type")
def vcf_type_counts(spark, sf):
    return classified(spark, sf).filter("variant_type IS NOT NULL").groupBy("l_suppkey", "variant_type").agg(F.count(F.lit(1)).alias("n"))


@query("compound_het", """
WITH c AS (SELECT *, genotype IS NULL OR genotype IN ('0/1', '0|1', '1|0', '1/0') AS het FROM vcf_classified WHERE variant_type IS NOT NULL),
d AS (SELECT l_suppkey, gene, count(*) AS n_variants, count(*) FILTER (het) AS n_het, bool_or(genotype IS NOT NULL) AS has_gt_data FROM c GROUP BY l_suppkey, gene),
f AS (SELECT l_suppkey, gene, string_agg(variant_type || '@' || pos, '; ' ORDER BY rn) AS descriptions FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, gene ORDER BY l_orderkey, l_linenumber, l_partkey, allele) AS rn FROM c WHERE het) x WHERE rn <= 5 GROUP BY l_suppkey, gene)
SELECT d.l_suppkey, d.gene, n_variants, n_het, has_gt_data, descriptions FROM d JOIN f ON f.l_suppkey = d.l_suppkey AND f.gene = d.gene WHERE n_variants >= 2 AND n_het >= 2""")
def compound_het(spark, sf):
    c = classified(spark, sf).filter("variant_type IS NOT NULL")
    out = V.compound_het(c, ["l_suppkey", "gene"], ["l_orderkey", "l_linenumber", "l_partkey", "allele"],
                         F.concat("variant_type", F.lit("@"), F.col("pos").cast("string")))
    return out.withColumn("descriptions", F.array_join("descriptions", "; "))


@query("cohort_stats", """
SELECT 'total' AS kind, '' AS key, count(*) AS observations, count(DISTINCT gene || '-' || variant) AS unique_variants FROM cohort_obs UNION ALL
SELECT 'gene', gene, count(*), count(DISTINCT gene || '-' || variant) FROM cohort_obs GROUP BY gene UNION ALL
SELECT 'prediction', prediction, count(*), count(DISTINCT gene || '-' || variant) FROM cohort_obs GROUP BY prediction""")
def cohort_stats(spark, sf):
    return AG.cohort_counts(view(spark, sf, "cohort_obs"))


@query("analysis_stats", """
SELECT gene, prediction, count(*) AS n, round(avg(value), 6) AS avg_latency FROM cohort_obs GROUP BY GROUPING SETS ((gene), (prediction), ())""")
def analysis_stats(spark, sf):
    per = view(spark, sf, "cohort_obs")
    return per.groupingSets([["gene"], ["prediction"], []], "gene", "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_latency"))


@query("benchmark_metadata", """
WITH k AS (SELECT 'source' AS kind, source AS key, * FROM bench UNION ALL SELECT 'gene', gene, * FROM bench)
SELECT kind, key, count(*) AS n_variants, count(*) FILTER (lab = 1) AS pathogenic, count(*) FILTER (lab = 0) AS benign, count(*) FILTER (lab IS NULL) AS unlabeled,
  count(*) FILTER (in_training) AS in_training, count(*) FILTER (in_test) AS in_test, count(*) FILTER (NOT in_training AND NOT in_test) AS novel,
  array_to_string(list_sort(list(DISTINCT gene)), ',') AS genes, array_to_string(list_sort(list(DISTINCT citation)), ',') AS citations
FROM (SELECT *, CASE WHEN source = 'assay' THEN 1 - dms_score_bin WHEN l_orderkey % 10 = 0 THEN NULL ELSE label END AS lab FROM k) z GROUP BY kind, key""")
def benchmark_metadata(spark, sf):
    b = view(spark, sf, "bench").withColumn("label", F.expr("CASE WHEN source = 'assay' THEN 1 - dms_score_bin WHEN l_orderkey % 10 = 0 THEN NULL ELSE label END"))
    out = AG.benchmark_metadata(b)
    return out.withColumn("genes", F.array_join("genes", ",")).withColumn("citations", F.array_join("citations", ","))


@query("feature_importance_norm", """
WITH l AS (SELECT 'p_tree' AS feature, p_tree - 0.5::DOUBLE AS value FROM variants UNION ALL SELECT 'p_mlp', p_mlp - 0.5::DOUBLE FROM variants UNION ALL SELECT 'af', af FROM variants
  UNION ALL SELECT 'af_eas', -af_eas FROM variants UNION ALL SELECT 'label', label - 0.3::DOUBLE FROM variants),
a AS (SELECT feature, avg(abs(value)) AS importance FROM l GROUP BY feature), n AS (SELECT *, importance / (max(importance) OVER () + 1e-10::DOUBLE) AS normalised FROM a)
SELECT feature, round(importance, 9) AS importance, round(normalised, 9) AS normalised, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank,
  normalised >= median(normalised) OVER () AS selected FROM n""")
def feature_importance_norm(spark, sf):
    cols = {"p_tree": "p_tree - 0.5D", "p_mlp": "p_mlp - 0.5D", "af": "af", "af_eas": "-af_eas", "label": "label - 0.3D"}
    long = variants(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.expr(e).alias("value")) for n, e in cols.items()])).alias("r"))
    out = AG.importance(long.select(F.col("r.feature").alias("feature"), F.col("r.value").alias("value")))
    return out.withColumn("importance", F.round("importance", 9)).withColumn("normalised", F.round("normalised", 9))


AGREE = f"(SELECT *, CASE WHEN acmg_class IN ('Pathogenic', 'Likely Pathogenic') THEN 1 WHEN acmg_class IN ('Benign', 'Likely Benign') THEN 0 ELSE -1 END AS bin FROM {sql_class(EV_CODES)} c)"


@query("evidence_agreement", f"""
WITH b AS (SELECT gene, bin, label FROM {AGREE} x), g AS (SELECT gene, bin, label FROM b UNION ALL SELECT 'ALL', bin, label FROM b),
t AS (SELECT gene, count(*) AS total, CAST(count(*) FILTER (bin = 1 AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (bin = 1 AND label = 0) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (bin = 0 AND label = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (bin = 0 AND label = 0) AS DOUBLE) AS tn FROM g GROUP BY gene)
SELECT gene, total, CAST(n AS BIGINT) AS resolved, CAST(total - n AS BIGINT) AS vus, round((total - n) / total, 9) AS vus_rate, round((tp + tn) / n, 9) AS agreement,
  round(((tp + tn) / n - e) / (1 - e), 9) AS kappa FROM (SELECT *, tp + fp + fn + tn AS n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS e FROM t) z""")
def evidence_agreement(spark, sf):
    c = EV.classify(with_codes(spark, sf)).withColumn("acmg_binary", EV.class_to_binary(F.col("acmg_class")))
    out = AG.agreement(c)
    return out.select("gene", "total", "resolved", "vus", *[F.round(c, 9).alias(c) for c in ("vus_rate", "agreement", "kappa")])


@query("evidence_code_frequency", f"SELECT code, count(*) AS n FROM (SELECT unnest(string_split(codes, ',')) AS code FROM {EV_CODES}) x WHERE code <> '' GROUP BY code")
def evidence_code_frequency(spark, sf):
    return AG.code_frequency(with_codes(spark, sf))


@query("vus_summary", f"""
WITH k AS (SELECT DISTINCT {VK} FROM variants WHERE split = 'train')
SELECT v.gene, count(*) AS n, count(*) FILTER (p_tree >= 0.8::DOUBLE) AS n_lp, count(*) FILTER (p_tree >= 0.6::DOUBLE AND p_tree < 0.8::DOUBLE) AS n_pp,
 count(*) FILTER (p_tree >= 0.2::DOUBLE AND p_tree < 0.6::DOUBLE) AS n_vus, count(*) FILTER (p_tree >= 0.1::DOUBLE AND p_tree < 0.2::DOUBLE) AS n_pb, count(*) FILTER (p_tree < 0.1::DOUBLE) AS n_lb,
 count(*) FILTER (k.gene IS NULL) AS n_novel, count(*) FILTER (p_tree < 0.2::DOUBLE OR p_tree >= 0.6::DOUBLE) AS n_reclassified, round(median(p_tree), 9) AS median
FROM variants v LEFT JOIN k ON k.gene = v.gene AND k.aa_pos = v.aa_pos AND k.aa_ref = v.aa_ref AND k.aa_alt = v.aa_alt WHERE split <> 'train' GROUP BY v.gene""")
def vus_summary(spark, sf):
    v = variants(spark, sf)
    vus = L.membership(v.filter("split <> 'train'"), v.filter("split = 'train'"), L.VARIANT_KEY, "known")
    vus = vus.withColumn("novel", ~F.col("known")).withColumn("classification", R.reclassify(F.col("p_tree"))).withColumn("probability", F.col("p_tree"))
    return AG.vus_summary(vus).withColumn("median", F.round("median", 9))


@query("histogram_bins", "SELECT least(CAST(floor(p_tree * 40) AS INT) + 1, 40) AS bin, count(*) AS n FROM variants GROUP BY 1")
def histogram_bins(spark, sf):
    return AG.histogram(variants(spark, sf), "p_tree", 40)
