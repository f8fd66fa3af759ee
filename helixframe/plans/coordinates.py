"""Coordinate and sequence operators, over synthetic transcripts and VCF lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import dims
from helixframe.functions import parsing as P, rules as R
from helixframe.operators import coords as C, vcf as V
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K4 = ", ".join(KEY)
G = ["tx"]

CLIP = """(SELECT *, greatest(exon_start, cds_start) AS cs, least(exon_end, cds_end) AS ce FROM tx_exons)"""
TXMAP = f"""txm AS (SELECT tx, strand, before + i + 1 AS cdna_pos, CASE WHEN strand = '+' THEN cs + i ELSE ce - i END AS genomic_pos
  FROM (SELECT *, unnest(range(CAST(ce - cs + 1 AS BIGINT))) AS i FROM (
    SELECT *, CAST(coalesce(sum(ce - cs + 1) OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '+' THEN cs ELSE -cs END
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM {CLIP} c WHERE cs <= ce) d) e)"""
TXB = """txb AS (SELECT tx, strand, cdna_pos, genomic_pos AS exon_end, nxt AS next_start FROM (
  SELECT *, lead(genomic_pos) OVER (PARTITION BY tx ORDER BY cdna_pos) AS nxt FROM txm) q
  WHERE CASE WHEN strand = '+' THEN nxt - genomic_pos ELSE genomic_pos - nxt END > 1)"""


@query("exon_coding_clip", f"""
SELECT tx, k, strand, CAST(cs AS BIGINT) AS coding_start, CAST(ce AS BIGINT) AS coding_end,
  row_number() OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '+' THEN cs ELSE -cs END) AS coding_order
FROM {CLIP} c WHERE cs <= ce""")
def exon_coding_clip(spark, sf):
    e = C.exon_offsets(view(spark, sf, "tx_exons"), G)
    rank = F.expr("row_number() OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '+' THEN coding_start ELSE -coding_start END)")
    return e.select("tx", "k", "strand", F.col("coding_start").cast("bigint").alias("coding_start"),
                    F.col("coding_end").cast("bigint").alias("coding_end"), rank.alias("coding_order"))


@query("cdna_genomic_map", f"WITH {TXMAP} SELECT tx, strand, CAST(cdna_pos AS BIGINT) AS cdna_pos, CAST(genomic_pos AS BIGINT) AS genomic_pos FROM txm")
def cdna_genomic_map(spark, sf):
    return C.cdna_map(view(spark, sf, "tx_exons"), G)


@query("exon_boundaries", f"""WITH {TXMAP}, {TXB}
SELECT tx, strand, CAST(exon_end AS BIGINT) AS exon_end, CAST(next_start AS BIGINT) AS next_start FROM txb""")
def exon_boundaries(spark, sf):
    return C.boundaries_from_map(C.cdna_map(view(spark, sf, "tx_exons"), G, ["cdna_before"]), G).drop("cdna_pos")


@query("splice_zones", f"""WITH {TXMAP}, {TXB}, w AS (
  SELECT tx, a + o AS pos, abs(o) AS d, CASE WHEN abs(o) <= 2 THEN 1000000000 ELSE 0 END + cdna_pos * 1000 + s * 100 + o AS turn FROM (
    SELECT tx, cdna_pos, 0 AS s, exon_end AS a FROM txb UNION ALL SELECT tx, cdna_pos, 1, next_start FROM txb) x,
   (SELECT unnest(range(-8, 9)) AS o) y WHERE o <> 0)
SELECT tx, CAST(pos AS BIGINT) AS genomic_pos, CAST(arg_max(d, turn) AS BIGINT) AS distance,
  CASE WHEN min(d) <= 2 THEN 'canonical' ELSE 'near' END AS zone FROM w z
WHERE NOT EXISTS (SELECT 1 FROM txm m WHERE m.tx = z.tx AND m.genomic_pos = z.pos) GROUP BY tx, pos""")
def splice_zones(spark, sf):
    m = C.cdna_map(view(spark, sf, "tx_exons"), G, ["cdna_before"])
    return (C.splice_zones(C.boundaries_from_map(m, G), m, G)
            .withColumn("distance", F.col("distance").cast("bigint")))


@query("synonymous_near_boundary", f"""WITH {TXMAP}
SELECT m.tx, CAST(m.cdna_pos AS BIGINT) AS cdna_pos, coalesce(bool_or(abs(n.genomic_pos - m.genomic_pos) > abs(n.cdna_pos - m.cdna_pos) + 1), FALSE) AS near_boundary
FROM txm m LEFT JOIN txm n ON n.tx = m.tx AND n.cdna_pos BETWEEN m.cdna_pos - 3 AND m.cdna_pos + 3 AND n.cdna_pos <> m.cdna_pos
GROUP BY m.tx, m.cdna_pos""")
def synonymous_near_boundary(spark, sf):
    return C.near_boundary(C.cdna_map(view(spark, sf, "tx_exons"), G), G).select("tx", "cdna_pos", "near_boundary")


def gene_exons(spark):
    """Exons of the dimension with the coding range of the whole layout."""
    g = dims.dim(spark, "genes").select("gene", "strand")
    return dims.dim(spark, "exons").join(g, "gene").selectExpr(
        "gene", "strand", "exon_start", "exon_end", "exon_start AS cds_start", "exon_end AS cds_end")


def coding_dims(spark):
    m = C.cdna_map(gene_exons(spark), ["gene"], ["cdna_before"])
    bases = view(spark, None, "cds_bases")
    zones = C.splice_zones(C.boundaries_from_map(m, ["gene"]), m, ["gene"])
    return C.coding_table(m.drop("cdna_before"), bases, ["gene"]), zones


def alleles(spark, sf, lines=None, malformed=False):
    parsed = V.parse_lines(view(spark, sf, "vcf_lines") if lines is None else lines)
    return V.explode_alleles(parsed if malformed else parsed.filter("parsed"), malformed)


def usable(spark, sf, lines=None, malformed=False):
    """Alleles after de-duplication; one file per supplier, rows in key order."""
    return V.dedup_alleles(alleles(spark, sf, lines, malformed), ["l_suppkey"], ROW_ID)


MISSENSE_SQL = "CAST((cdna_pos * 31 + l_partkey * 7) % 1000 AS DOUBLE) / 1000"
ROW_ID = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "allele"]


def classified(spark, sf, lines=None, malformed=False):
    coding, zones = coding_dims(spark)
    out = V.consequences(usable(spark, sf, lines, malformed), dims.dim(spark, "genes"), dims.dim(spark, "domains"), coding, zones,
                         dims.dim(spark, "codons"))
    return V.apply_outcomes(out, F.expr(MISSENSE_SQL))




@query("strand_complement", f"""
SELECT {K4}, allele, strand, comp AS complemented, cr AS cds_ref FROM vcf_translated WHERE cp IS NOT NULL AND length(ref) = 1 AND length(alt) = 1""")
def strand_complement(spark, sf):
    coding, _ = coding_dims(spark)
    live = usable(spark, sf).filter("skip IS NULL AND length(ref) = 1 AND length(alt) = 1")
    c = coding.withColumnRenamed("genomic_pos", "pos")
    out = C.translate_snv(live.join(c, ["gene", "pos"]), dims.dim(spark, "codons"))
    return out.select(*KEY, "allele", "strand", C.complement(F.col("ref"), F.col("strand")).alias("complemented"), "cds_ref")


@query("codon_translate", f"""
SELECT {K4}, allele, cp AS cdna_pos, aap AS aa_pos, codon, raa AS aa_ref, aaa AS aa_alt,
  CASE WHEN cr IS NULL THEN 'Ref mismatch: CDS has ' || have || ' at cDNA ' || cp || ', VCF says ' || ref
   WHEN raa IS NULL OR aaa IS NULL THEN 'Unknown codon' END AS reject
FROM vcf_translated WHERE cp IS NOT NULL AND length(ref) = 1 AND length(alt) = 1""")
def codon_translate(spark, sf):
    coding, _ = coding_dims(spark)
    live = usable(spark, sf).filter("skip IS NULL AND length(ref) = 1 AND length(alt) = 1")
    out = C.translate_snv(live.join(coding.withColumnRenamed("genomic_pos", "pos"), ["gene", "pos"]), dims.dim(spark, "codons"))
    return out.select(*KEY, "allele", "cdna_pos", "aa_pos", "codon", "aa_ref", "aa_alt", "reject")


@query("consequence_tiers", f"""
SELECT {K4}, allele, variant_type, probability, reason, cp AS cdna_pos, aap AS aa_pos,
  CASE WHEN variant_type = 'missense' THEN CASE WHEN probability > 0.9::DOUBLE THEN 'pathogenic' WHEN probability > 0.7::DOUBLE THEN 'likely_pathogenic'
    WHEN probability < 0.1::DOUBLE THEN 'benign' WHEN probability < 0.3::DOUBLE THEN 'likely_benign' ELSE 'uncertain' END
   WHEN variant_type IN ('frameshift', 'nonsense') THEN 'pathogenic' WHEN variant_type = 'splice_canonical' THEN 'likely_pathogenic'
   WHEN variant_type = 'splice_near' THEN 'uncertain' WHEN variant_type = 'inframe_indel' THEN CASE WHEN in_dom THEN 'likely_pathogenic' ELSE 'uncertain' END
   WHEN variant_type = 'synonymous' THEN CASE WHEN near THEN 'uncertain' ELSE 'likely_benign' END END AS tier,
  CASE variant_type WHEN 'frameshift' THEN 'PVS1' WHEN 'nonsense' THEN 'PVS1' WHEN 'splice_canonical' THEN 'PVS1' WHEN 'splice_near' THEN 'PP3_splice'
   WHEN 'inframe_indel' THEN 'PM4' WHEN 'synonymous' THEN CASE WHEN near THEN NULL ELSE 'BP7' END END AS evidence
FROM vcf_classified""")
def consequence_tiers(spark, sf):
    return classified(spark, sf).filter("skip IS NULL").select(*KEY, "allele", "variant_type", "probability", "reason", "cdna_pos", "aa_pos",
                                        "tier", "evidence")


TR = """CASE WHEN l_partkey % 50 = 0 THEN 'FS' WHEN l_partkey % 50 = 1 THEN 'del' WHEN l_partkey % 50 = 2 THEN 'c.12_13ins' ELSE mutation END"""
TA = "CASE WHEN l_partkey % 70 = 3 THEN 'Fs' WHEN l_partkey % 70 = 4 THEN '*' ELSE aa_alt END"
TREF = "CASE WHEN aa_pos = 1 THEN 'Met' ELSE aa_ref END"


@query("truncating_startloss", f"""
SELECT {K4}, (a IN ('Ter', '*', 'Fs') OR regexp_matches(lower(m), 'fs|del|ins|dup')) AS truncating,
  (aa_pos = 1 AND r IN ('Met', 'M') AND a NOT IN ('Met', 'M')) AS start_loss
FROM (SELECT *, {TR} AS m, {TA} AS a, {TREF} AS r FROM variants) v""")
def truncating_startloss(spark, sf):
    v = view(spark, sf, "variants").selectExpr(*KEY, "aa_pos", f"{TR} AS m", f"{TA} AS a", f"{TREF} AS r")
    return v.select(*KEY, R.is_truncating(F.col("a"), F.col("m")).alias("truncating"),
                    R.is_start_loss(F.col("aa_pos"), F.col("r"), F.col("a")).alias("start_loss"))


ALLELES = "CASE WHEN l_partkey % 6 = 0 THEN 'AT/A' WHEN l_partkey % 6 = 1 THEN 'A/G/T' ELSE replace(mutation, '>', '/') END"
AFTEXT = "CASE WHEN l_partkey % 10 = 7 THEN 'n/a' ELSE CAST(p_tree AS STRING) END"


@query("genomic_snv_filter", f"""
SELECT {K4}, string_split(al, '/')[1] AS ref, string_split(al, '/')[2] AS alt, coalesce(TRY_CAST(t AS DOUBLE), 0) AS af
FROM (SELECT *, {ALLELES} AS al, {AFTEXT} AS t FROM variants) v WHERE regexp_full_match(al, './.')""")
def genomic_snv_filter(spark, sf):
    v = view(spark, sf, "variants").selectExpr(*KEY, f"{ALLELES} AS al", f"{AFTEXT} AS t")
    v = v.withColumn("snv", P.single_base_alleles(F.col("al"))).filter("snv IS NOT NULL")
    return v.select(*KEY, F.col("snv.ref").alias("ref"), F.col("snv.alt").alias("alt"),
                    F.coalesce(P.to_double(F.col("t")), F.lit(0.0)).alias("af"))
