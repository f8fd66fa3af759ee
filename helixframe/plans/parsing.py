"""Parsing projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.functions import parsing as P, rules as R
from helixframe.operators import features as FE, quality as Q, ranking as RK, vcf as V
from helixframe.plans.coordinates import ROW_ID, alleles, classified, usable
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K4 = ", ".join(KEY)


def parsed(spark, sf):
    return V.parse_lines(view(spark, sf, "vcf_lines"))


@query("vcf_parse", f"""SELECT {K4}, CASE WHEN chrom IS NOT NULL AND pos IS NOT NULL THEN chrom END AS chrom, pos, ref, alts AS alt,
 chrom IS NOT NULL AND pos IS NOT NULL AS parsed FROM vcf_parsed""")
def vcf_parse(spark, sf):
    return parsed(spark, sf).select(*KEY, "chrom", "pos", "ref", "alt", "parsed")


@query("vcf_genotype", f"SELECT {K4}, genotype, gq, multi_sample FROM vcf_parsed")
def vcf_genotype(spark, sf):
    return parsed(spark, sf).select(*KEY, "genotype", "gq", "multi_sample")


@query("vcf_quality_flags", f"""SELECT {K4}, concat_ws('; ', CASE WHEN filt NOT IN ('PASS', '.', '') THEN 'VCF FILTER: ' || filt END,
 CASE WHEN gq < 20 THEN 'Low genotype quality (GQ=' || gq || ')' END) AS warnings FROM vcf_parsed""")
def vcf_quality_flags(spark, sf):
    return parsed(spark, sf).select(*KEY, F.array_join("warnings", "; ").alias("warnings"))


@query("vcf_explode_alleles", f"SELECT {K4}, allele, chrom, pos, ref, alt, bad AS skip FROM vcf_alleles")
def vcf_explode_alleles(spark, sf):
    return alleles(spark, sf).select(*KEY, "allele", "chrom", "pos", "ref", "alt", "skip")


@query("vcf_dedup", f"SELECT {K4}, allele, skip FROM vcf_marked")
def vcf_dedup(spark, sf):
    return usable(spark, sf).select(*KEY, "allele", "skip")


SKIPS = """skips AS (
  SELECT l_suppkey, line, CAST(NULL AS BIGINT) AS pos, 0 AS allele, 'Parse error' AS reason FROM vcf_parsed WHERE chrom IS NULL OR pos IS NULL
  UNION ALL SELECT l_suppkey, line, pos, allele, skip FROM vcf_marked WHERE skip IS NOT NULL
  UNION ALL SELECT l_suppkey, line, pos, allele, reason FROM vcf_classified WHERE reason IS NOT NULL)"""


def skipped(spark, sf):
    """All skip rows with their line number within the file; lines are numbered, parsed and classified once."""
    lines = RK.number_rows(view(spark, sf, "vcf_lines"), ["l_suppkey"], F.floor(F.col("l_orderkey") / 5000),
                           ["l_orderkey", "l_linenumber", "l_partkey", "value"], "line").withColumn("line", F.col("line").cast("bigint"))
    return classified(spark, sf, lines, malformed=True).filter("reason IS NOT NULL").select("l_suppkey", "line", "pos", "allele", "reason")


@query("vcf_skip_report", f"""WITH {SKIPS}
SELECT l_suppkey, line, allele, reason, pos FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY line, allele) AS rn FROM skips) s WHERE rn <= 50""")
def vcf_skip_report(spark, sf):
    """First 50 skips per file, in line order: the report's own top-k."""
    first = RK.top_n(skipped(spark, sf), ["l_suppkey"], [F.col("line"), F.col("allele")], 50, "rn")
    return first.select("l_suppkey", "line", "allele", "reason", "pos")


@query("vcf_skip_counts", f"""WITH {SKIPS}
SELECT string_split(reason, ':')[1] AS reason, count(*) AS n FROM skips GROUP BY 1""")
def vcf_skip_counts(spark, sf):
    return V.skip_counts(skipped(spark, sf).withColumn("reason", F.split("reason", ":")[0]))


HGVS = ("(CASE WHEN l_partkey % 5 = 0 THEN 'NP_1:' ELSE '' END) || CASE WHEN l_partkey % 17 = 0 THEN 'c.' || CAST(cdna_pos AS STRING) "
        "WHEN l_partkey % 19 = 0 THEN 'p.' || aa_ref || CAST(aa_pos AS STRING) || '*' WHEN l_partkey % 23 = 0 THEN 'p.Xaa' || CAST(aa_pos AS STRING) || aa_alt "
        "WHEN l_partkey % 29 = 0 THEN 'p.' || aa_ref || CAST(aa_pos AS STRING) || aa_ref "
        "ELSE 'c.' || CAST(cdna_pos AS STRING) || mutation || ' (p.' || aa_ref || CAST(aa_pos AS STRING) || aa_alt || ')' END")


@query("hgvs_parse", f"""
SELECT {K4}, CASE WHEN hit THEN r END AS aa_ref, CASE WHEN hit THEN CAST(p AS BIGINT) END AS aa_pos, CASE WHEN hit THEN a END AS aa_alt,
  TRY_CAST(regexp_extract(h, 'c\\.(\\d+)', 1) AS BIGINT) AS cdna_pos,
  coalesce(hit AND r <> a AND a <> 'Ter' AND r <> 'Xaa', FALSE) AS missense
FROM (SELECT *, r <> '' AS hit, CASE WHEN a0 = '*' THEN 'Ter' ELSE a0 END AS a FROM (
  SELECT *, regexp_extract(h, 'p\\.([A-Z][a-z]{{2}})(\\d+)([A-Z][a-z]{{2}}|\\*)', 1) AS r,
   regexp_extract(h, 'p\\.([A-Z][a-z]{{2}})(\\d+)([A-Z][a-z]{{2}}|\\*)', 2) AS p,
   regexp_extract(h, 'p\\.([A-Z][a-z]{{2}})(\\d+)([A-Z][a-z]{{2}}|\\*)', 3) AS a0 FROM (SELECT *, {HGVS} AS h FROM variants) x) y) z""")
def hgvs_parse(spark, sf):
    v = view(spark, sf, "variants").select(*KEY, F.expr(HGVS).alias("h")).withColumn("c", P.amino_change(F.col("h")))
    c = F.col("c")
    return v.select(*KEY, c["ref"].alias("aa_ref"), c["pos"].alias("aa_pos"), c["alt"].alias("aa_alt"),
                    P.cdna_position(F.col("h")).alias("cdna_pos"), P.is_missense(c).alias("missense"))


TOKEN = ("CASE WHEN l_partkey % 13 = 0 THEN 'A1V:G2S' WHEN l_partkey % 13 = 1 THEN 'A' WHEN l_partkey % 13 = 2 THEN 'MxxL' "
         "WHEN l_partkey % 13 = 3 THEN 'K' || CAST(aa_pos AS STRING) || 'K' WHEN l_partkey % 13 = 4 THEN 'R' || CAST(aa_pos AS STRING) || '*' "
         "ELSE substring('ARNDCQEGHILKMFPSTWYV', CAST(aa_pos % 20 + 1 AS INT), 1) || CAST(aa_pos AS STRING) || "
         "substring('ARNDCQEGHILKMFPSTWYV', CAST((aa_pos + 1 + l_orderkey % 19) % 20 + 1 AS INT), 1) END")


@query("mutant_token_parse", f"""
SELECT {K4}, CASE WHEN ok THEN substr(t, 1, 1) END AS ref, CASE WHEN ok THEN CAST(substr(t, 2, length(t) - 2) AS BIGINT) END AS pos,
  CASE WHEN ok THEN substr(t, length(t), 1) END AS alt
FROM (SELECT *, t NOT LIKE '%:%' AND length(t) >= 3 AND TRY_CAST(substr(t, 2, length(t) - 2) AS BIGINT) IS NOT NULL AND substr(t, 1, 1) <> substr(t, length(t), 1) AS ok
  FROM (SELECT *, {TOKEN} AS t FROM variants) x) y""")
def mutant_token_parse(spark, sf):
    v = view(spark, sf, "variants").select(*KEY, P.mutant_token(F.expr(TOKEN)).alias("m"))
    return v.select(*KEY, F.col("m.ref").alias("ref"), F.col("m.pos").alias("pos"), F.col("m.alt").alias("alt"))


@query("multi_value_score", f"""
SELECT {K4}, list_filter(list_transform(string_split(raw_score, ';'), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x IS NOT NULL)[1] AS score FROM score_dump""")
def multi_value_score(spark, sf):
    return view(spark, sf, "score_dump").select(*KEY, P.first_score(F.col("raw_score")).alias("score"))


@query("multi_value_position", f"""
SELECT {K4}, list_filter(list_transform(string_split(raw_pos, ';'), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x > 0)[1] AS pos FROM score_dump""")
def multi_value_position(spark, sf):
    return view(spark, sf, "score_dump").select(*KEY, P.first_position(F.col("raw_pos")).alias("pos"))


SIG = ("CASE l_partkey % 6 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely benign' WHEN 2 THEN 'Conflicting: Pathogenic/Benign' "
       "WHEN 3 THEN 'Uncertain significance' WHEN 4 THEN 'LIKELY PATHOGENIC' ELSE 'Benign' END")


@query("significance_label", f"""
SELECT {K4}, CASE l_partkey % 6 WHEN 0 THEN 1 WHEN 4 THEN 1 WHEN 1 THEN 0 WHEN 5 THEN 0 END AS label
FROM variants WHERE l_partkey % 6 NOT IN (2, 3)""")
def significance_label(spark, sf):
    v = view(spark, sf, "variants").select(*KEY, R.significance_label(F.expr(SIG)).alias("label"))
    return v.filter("label IS NOT NULL")


@query("id_set_label", """
WITH ids AS (SELECT *, l_partkey AS uid FROM variants WHERE aa_alt <> 'Ter' AND aa_ref <> aa_alt),
path AS (SELECT DISTINCT l_partkey AS uid FROM variants WHERE label = 1 AND split = 'train'),
ben AS (SELECT DISTINCT l_partkey AS uid FROM variants WHERE label = 0 AND split = 'cal'),
lab AS (SELECT i.*, CASE WHEN p.uid IS NOT NULL THEN 1 WHEN b.uid IS NOT NULL THEN 0 END AS lab FROM ids i LEFT JOIN path p ON p.uid = i.uid LEFT JOIN ben b ON b.uid = i.uid)
SELECT gene, aa_pos, aa_ref, aa_alt, lab AS label, uid FROM (SELECT *, row_number() OVER (PARTITION BY gene, aa_pos, aa_ref, aa_alt
  ORDER BY uid, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lab WHERE lab IS NOT NULL) x WHERE rn = 1""")
def id_set_label(spark, sf):
    v = view(spark, sf, "variants")
    path = v.filter("label = 1 AND split = 'train'").select(F.col("l_partkey").alias("uid"))
    ben = v.filter("label = 0 AND split = 'cal'").select(F.col("l_partkey").alias("uid"))
    rec = v.filter("aa_alt <> 'Ter' AND aa_ref <> aa_alt").withColumn("uid", F.col("l_partkey")).drop("label")
    out = Q.label_by_id_sets(rec, "uid", path, ben)
    first = RK.keep_first(out, ["gene", "aa_pos", "aa_ref", "aa_alt"], ["uid", "l_orderkey", "l_linenumber", "l_suppkey"])
    return first.select("gene", "aa_pos", "aa_ref", "aa_alt", "label", "uid")


@query("cdna_estimate", f"""
SELECT {K4}, coalesce(CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE cdna_pos END, aa_pos * 3 - 1) AS cdna_pos, greatest(aa_pos * 3, 1) AS proxy_cdna FROM variants""")
def cdna_estimate(spark, sf):
    v = view(spark, sf, "variants").withColumn("c", F.expr("CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE cdna_pos END"))
    return v.select(*KEY, Q.estimated_cdna(F.col("c"), F.col("aa_pos")).alias("cdna_pos"),
                    Q.proxy_cdna(F.col("aa_pos")).alias("proxy_cdna"))


REQ = """SELECT *, CASE WHEN l_partkey % 31 = 0 THEN 'TP53' ELSE gene END AS g, CASE WHEN l_partkey % 29 = 0 THEN 0 WHEN l_partkey % 29 = 1 THEN cdna_pos + 20000 ELSE cdna_pos END AS c,
  CASE WHEN l_partkey % 23 = 0 THEN upper(aa_ref) WHEN l_partkey % 23 = 1 THEN 'Xyz' ELSE aa_ref END AS r,
  CASE WHEN l_partkey % 19 = 0 THEN 'fs' WHEN l_partkey % 19 = 1 THEN 'AA>T' WHEN l_partkey % 19 = 2 THEN 'Unknown' WHEN l_partkey % 19 = 3 THEN lower(mutation) ELSE mutation END AS m"""


@query("input_validate", f"""
SELECT {K4}, concat_ws('; ', CASE WHEN g.gene IS NULL THEN 'Unsupported gene' END, CASE WHEN c < 1 THEN 'cDNA_pos must be positive' END,
  CASE WHEN c > g.cds_length THEN 'cDNA position exceeds gene length' END, CASE WHEN r = 'Xyz' THEN 'Invalid reference amino acid' END,
  CASE WHEN m = 'AA>T' THEN 'Invalid mutation' END) AS errors,
  CASE WHEN r = 'Xyz' THEN 'Xyz' ELSE upper(substr(r, 1, 1)) || lower(substr(r, 2)) END AS aa_ref, CASE WHEN m = 'Unknown' THEN m ELSE upper(m) END AS mutation
FROM ({REQ} FROM variants) v LEFT JOIN genes g ON g.gene = v.g""")
def input_validate(spark, sf):
    req = view(spark, sf, "variants").selectExpr("*", *[x for x in REQ_COLS])
    out = Q.validate_requests(req.select(*KEY, F.col("g").alias("gene"), F.col("c").alias("cdna_pos"), F.col("r").alias("aa_ref"),
                                         "aa_alt", F.col("m").alias("mutation")), view(spark, sf, "genes"))
    return out.select(*KEY, F.array_join("errors", "; ").alias("errors"), "aa_ref", "mutation")


REQ_COLS = [c.strip() + " END AS " + n for c, n in (
    ("CASE WHEN l_partkey % 31 = 0 THEN 'TP53' ELSE gene", "g"),
    ("CASE WHEN l_partkey % 29 = 0 THEN 0 WHEN l_partkey % 29 = 1 THEN cdna_pos + 20000 ELSE cdna_pos", "c"),
    ("CASE WHEN l_partkey % 23 = 0 THEN upper(aa_ref) WHEN l_partkey % 23 = 1 THEN 'Xyz' ELSE aa_ref", "r"),
    ("CASE WHEN l_partkey % 19 = 0 THEN 'fs' WHEN l_partkey % 19 = 1 THEN 'AA>T' WHEN l_partkey % 19 = 2 THEN 'Unknown' "
     "WHEN l_partkey % 19 = 3 THEN lower(mutation) ELSE mutation", "m"))]


@query("onehot_decode", f"SELECT {K4}, aa_ref, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE aa_alt END AS aa_alt FROM variants")
def onehot_decode(spark, sf):
    v = view(spark, sf, "variants").withColumn("aa_alt", F.expr("CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE aa_alt END"))
    wide = FE.add_onehot(v).drop("aa_ref", "aa_alt")
    return wide.select(*KEY, FE.decode_onehot("AA_ref").alias("aa_ref"), FE.decode_onehot("AA_alt").alias("aa_alt"))


@query("position_restore", f"SELECT {K4}, aa_pos AS restored, CAST(round_even(aa_pos * 2.5::DOUBLE, 0) AS BIGINT) AS half_even FROM variants")
def position_restore(spark, sf):
    v = view(spark, sf, "variants").withColumn("rel", F.col("aa_pos") / F.col("aa_len"))
    return v.select(*KEY, FE.restore_position(F.col("rel"), F.col("aa_len")).alias("restored"),
                    FE.restore_position(F.lit(2.5), F.col("aa_pos")).alias("half_even"))


GID = ("CASE WHEN l_partkey % 12 = 0 THEN '13-100-A' WHEN l_partkey % 12 = 1 THEN '99-100-A-G' WHEN l_partkey % 12 = 2 THEN '13-x1-A-G' "
       "WHEN l_partkey % 12 = 3 THEN 'X-5-N-G' WHEN l_partkey % 12 = 4 THEN 'MT-5-A-<DEL>' ELSE CAST(1 + l_partkey % 22 AS STRING) || '-' || CAST(cdna_pos AS STRING) || '-' || replace(mutation, '>', '-') END")


@query("genomic_id_parse", f"""
SELECT {K4}, CASE l_partkey % 12 WHEN 0 THEN 'Expected format: chr-pos-ref-alt' WHEN 1 THEN 'Invalid chromosome in variant' WHEN 2 THEN 'Invalid position in variant'
  WHEN 3 THEN 'Invalid ref allele in variant' WHEN 4 THEN 'Invalid alt allele in variant' END AS error,
  CASE WHEN l_partkey % 12 >= 5 THEN cdna_pos END AS pos FROM variants""")
def genomic_id_parse(spark, sf):
    v = view(spark, sf, "variants").select(*KEY, P.genomic_id(F.expr(GID)).alias("g"))
    return v.select(*KEY, F.col("g.error").alias("error"), F.when(F.col("g.error").isNull(), F.col("g.pos")).alias("pos"))


@query("config_validate", """
SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 5 = 0 THEN 'aa_length' END, CASE WHEN p_size % 7 = 0 THEN 'domains' END, CASE WHEN p_size % 11 = 0 THEN 'strand' END) AS missing,
  p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 11 <> 0 AS available FROM part""")
def config_validate(spark, sf):
    """One JSON gene configuration per part; some lack required keys."""
    part = view(spark, sf, "part")
    doc = F.to_json(F.struct(
        F.lit("17").alias("chromosome"), F.col("p_size").alias("cds_length"),
        F.expr("CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END").alias("aa_length"),
        F.expr("CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'd' END").alias("domains"),
        F.expr("CASE WHEN p_size % 11 = 0 THEN NULL ELSE '+' END").alias("strand")))
    out = Q.validate_configs(part.select("p_partkey", doc.alias("config")), "config")
    return out.select("p_partkey", F.array_join("missing", ",").alias("missing"), "available")


@query("rebuild_ids", f"""
SELECT {K4}, g.transcript || ':c.' || cdna_pos || mutation AS hgvs_c, 'p.' || aa_ref || aa_pos || aa_alt AS hgvs_p,
  v.gene || ':p.' || aa_ref || aa_pos || aa_alt AS variant FROM variants v JOIN genes g ON g.gene = v.gene""")
def rebuild_ids(spark, sf):
    v = view(spark, sf, "variants").join(view(spark, sf, "genes").select("gene", "transcript"), "gene")
    return Q.add_identifiers(v).select(*KEY, "hgvs_c", "hgvs_p", "variant")
