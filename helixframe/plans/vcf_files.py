"""VCF files to scored variants, end to end: read, parse, de-duplicate, classify, features, blend, calibrate, clip, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K, dims
from helixframe.functions import rules as R
from helixframe.operators import calibration as C, features as FE, vcf as V
from helixframe.plans.coordinates import KEY, coding_dims
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query
from helixframe.plans.scoring import ISO
from helixframe.session import materialise, shared_dir
from helixframe.sources import vcf_source as S

FILE_PARTS, FILE_LINES = 3, 500_000  # part files of the fixture at least, whatever the number of genes, and lines of one at most, about
RANGE_BYTES = 1 << 18
# Two linear models over features stand for the trained ones, which are not published.
MODELS = (({"blosum62_score": -0.31, "volume_diff": 0.004, "hydro_diff": 0.12, "charge_change": 0.7, "relative_aa_pos": -0.4, "n_domains_hit": 0.8}, -0.6),
          ({"blosum62_score": -0.22, "volume_diff": 0.002, "hydro_diff": 0.2, "charge_change": 0.4, "relative_aa_pos": 0.3, "n_domains_hit": 0.5}, -0.9))


def file_parts(rows):
    """Number of part files: one task writes each, so it follows the number of lines."""
    return max(FILE_PARTS, -(-rows.count() // FILE_LINES))


def lines(spark, sf):
    """The fixture's lines written as block-gzip files, one upload per gene, and read back with their numbers."""
    path = shared_dir(spark, "uploads")
    rows = view(spark, sf, "vcf_lines").select("gene", "value", *KEY)
    written = S.write_block_gzip(rows, path, "gene", [*KEY, "value"], file_parts(rows))
    materialise(written, "uploads-written")
    return S.numbered_vcf(spark, path, RANGE_BYTES)


def score(alleles, spark, calibrators):
    """Missense alleles with the blended, calibrated and clipped probability."""
    tables = {n: dims.dim(spark, n) for n in ("genes", "blosum62", "residues", "domains", "domain_candidates")}
    vector = FE.feature_vector(alleles, tables, {}, ["gene", "line", "allele"])
    weights = dims.dim(spark, "genes").select("gene", "xgb_weight", "mlp_weight")
    one, two = (C.logistic(*m) for m in MODELS)
    blended, disagreement = C.blend(one, two, F.col("xgb_weight"), F.col("mlp_weight"))
    rows = vector.join(weights, "gene", "left").select("gene", "line", "allele", F.round(blended, 6).alias("blended"), F.round(disagreement, 4).alias("disagreement"))
    out = C.isotonic_apply(materialise(rows, "blended"), calibrators, "gene", "blended")
    return out.withColumn("p", R.clip(F.col("calibrated"), K.CLIP_BATCH)).drop("blended", "calibrated")


def sql_logistic(weights, bias):
    return f"1 / (1 + exp(-({bias}::DOUBLE{''.join(f' + {w}::DOUBLE * {c}' for c, w in weights.items())})))"


SCORED = f"""{ISO}, ms AS (SELECT c.gene, c.line, c.allele, CAST(b.blosum62_score AS DOUBLE) AS blosum62_score, abs(r.volume - a.volume) AS volume_diff, abs(r.hydro - a.hydro) AS hydro_diff,
  CASE WHEN r.charge <> a.charge THEN 1 ELSE 0 END AS charge_change, c.aap / CAST(g.aa_length AS DOUBLE) AS relative_aa_pos, g.xgb_weight AS w1, g.mlp_weight AS w2,
  (SELECT count(*) FROM domains d WHERE d.gene = c.gene AND c.aap BETWEEN d.start_aa AND d.end_aa) AS n_domains_hit
  FROM gene_classified c JOIN blosum62 b ON b.aa_ref = c.raa AND b.aa_alt = c.aaa JOIN residues r ON r.aa = c.raa JOIN residues a ON a.aa = c.aaa JOIN genes g ON g.gene = c.gene
  WHERE c.variant_type = 'missense'),
pp AS (SELECT *, {sql_logistic(*MODELS[0])} AS p1, {sql_logistic(*MODELS[1])} AS p2 FROM ms),
bl AS (SELECT gene, line, allele, round(w1 * p1 + w2 * p2, 6) AS x, round(abs(p1 - p2), 4) AS disagreement FROM pp),
q AS (SELECT DISTINCT gene, x FROM bl),
lo AS (SELECT q.gene, q.x, max(f.x) AS x0 FROM q LEFT JOIN fit f ON f.gene = q.gene AND f.x <= q.x GROUP BY q.gene, q.x),
hi AS (SELECT q.gene, q.x, min(f.x) AS x1 FROM q LEFT JOIN fit f ON f.gene = q.gene AND f.x > q.x GROUP BY q.gene, q.x),
cal AS (SELECT lo.gene, lo.x, CASE WHEN a.y IS NULL THEN b.y WHEN b.y IS NULL OR lo.x = lo.x0 THEN a.y ELSE a.y + (lo.x - lo.x0) * (b.y - a.y) / (hi.x1 - lo.x0) END AS y
  FROM lo JOIN hi ON hi.gene = lo.gene AND hi.x = lo.x LEFT JOIN fit a ON a.gene = lo.gene AND a.x = lo.x0 LEFT JOIN fit b ON b.gene = hi.gene AND b.x = hi.x1),
sc AS (SELECT bl.gene, bl.line, bl.allele, bl.disagreement, least(greatest(cal.y, 0.005::DOUBLE), 0.995::DOUBLE) AS p FROM bl JOIN cal ON cal.gene = bl.gene AND cal.x = bl.x),
al AS (SELECT c.gene, c.line, c.allele, c.chrom, c.pos, c.ref, c.alt, c.variant_type, coalesce(s.p, c.probability) AS p, c.reason, s.disagreement FROM gene_classified c
  LEFT JOIN sc s ON s.gene = c.gene AND s.line = c.line AND s.allele = c.allele AND c.variant_type = 'missense')"""


def scored(spark, sf):
    """Every allele of every upload with its outcome or the reason why it was skipped."""
    calibrators = C.isotonic_fit(view(spark, sf, "variants").filter("split = 'cal'"), "gene", "p_tree", "label")
    coding, zones = coding_dims(spark)
    parsed = materialise(V.parse_lines(lines(spark, sf).withColumnRenamed("upload", "gene").drop("file")), "parsed-lines")
    alleles = V.dedup_alleles(V.explode_alleles(parsed.filter("parsed")), ["gene"], ["gene", "line", "allele"])
    out = V.consequences(alleles, dims.dim(spark, "genes"), dims.dim(spark, "domains"), coding, zones, dims.dim(spark, "codons"))
    out = materialise(out.drop("value", "warnings", "multi_sample"), "judged-alleles")
    missense = out.filter("reason IS NULL AND rule IS NULL")
    p = score(missense.select("gene", "line", "allele", "cdna_pos", "aa_pos", "aa_ref", "aa_alt", "mutation"), spark, calibrators)
    out = V.apply_outcomes(out.join(p, ["gene", "line", "allele"], "left"), F.col("p"))
    bad = parsed.filter("NOT parsed").select("gene", "line", F.lit(0).alias("allele"), F.lit("Parse error").alias("reason"))
    return out, bad


@query("vcf_scored", f"""WITH {SCORED}
SELECT gene, line, allele, chrom, pos, ref, alt, variant_type, round(p, 4) AS probability, CASE WHEN variant_type = 'missense' THEN CASE WHEN p >= 0.5::DOUBLE THEN 'Pathogenic' ELSE 'Benign' END END AS missense_call,
  CAST(NULL AS VARCHAR) AS skipped, disagreement FROM al WHERE variant_type IS NOT NULL
UNION ALL SELECT gene, line, allele, chrom, pos, ref, alt, NULL, NULL, NULL, reason, NULL FROM al WHERE reason IS NOT NULL
UNION ALL SELECT gene, line, allele, chrom, pos, ref, alt, NULL, NULL, NULL, skip, NULL FROM gene_marked WHERE skip IS NOT NULL
UNION ALL SELECT gene, line, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Parse error', NULL FROM gene_parsed WHERE chrom IS NULL OR pos IS NULL""")
def vcf_scored(spark, sf):
    """Files to scored variants: duplicates and line numbers follow the order of the files' lines."""
    out, bad = scored(spark, sf)
    rows = out.select("gene", "line", "allele", "chrom", "pos", "ref", "alt", "variant_type", F.round("probability", 4).alias("probability"),
                      F.when(F.col("variant_type") == "missense", F.col("prediction")).alias("missense_call"), F.col("reason").alias("skipped"),
                      F.when(F.col("variant_type") == "missense", F.col("disagreement")).alias("disagreement"))
    return rows.unionByName(bad.withColumnRenamed("reason", "skipped"), allowMissingColumns=True)
