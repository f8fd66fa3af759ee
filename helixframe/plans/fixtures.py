"""Variant-shaped views over the supplied tables, once for Spark and once as SQL.

Each view is defined by integer arithmetic, ``CASE`` and ``FLOOR`` only, so both
engines produce identical rows.  ``SQL_VIEWS`` holds the text of the DuckDB twin
of every view; ``with_views`` prepends those a query body mentions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe import dims

AA_LIST = "Ala,Arg,Asn,Asp,Cys,Gln,Glu,Gly,His,Ile,Leu,Lys,Met,Phe,Pro,Ser,Thr,Trp,Tyr,Val,Ter"
MUT_LIST = "A>C,A>G,A>T,C>A,C>G,C>T,G>A,G>C,G>T,T>A,T>C,T>G"

_LEN = ("CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 1863 WHEN 1 THEN 3418 WHEN 2 THEN 1186 "
        "WHEN 3 THEN 376 ELSE 328 END")
_GENE = ("CASE CAST({k} % 5 AS INT) WHEN 0 THEN 'BRCA1' WHEN 1 THEN 'BRCA2' WHEN 2 THEN 'PALB2' "
         "WHEN 3 THEN 'RAD51C' ELSE 'RAD51D' END")

VARIANTS = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gene, aa_len, aa_pos, cdna_pos,
  AA[[ri]] aa_ref, CASE WHEN (l_orderkey + l_partkey) % 41 = 0 THEN 'Ter' ELSE AA[[ai]] END aa_alt,
  MUT[[l_partkey % 12]] mutation, af,
  CASE WHEN t < 3 THEN CAST(0 AS DOUBLE) ELSE af * t / 4 END af_eas,
  CASE WHEN t > 5 THEN CAST(0 AS DOUBLE) ELSE af * (8 - t) / 6 END af_nfe,
  CASE WHEN t % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE af / 2 END af_afr,
  CASE WHEN t % 3 = 0 THEN af / 3 ELSE CAST(0 AS DOUBLE) END af_amr,
  label, LEAST(999, FLOOR(h1 * 7 / 10) + 250 * label) / CAST(1000 AS DOUBLE) p_tree,
  LEAST(999, FLOOR(h2 * 8 / 10) + 150 * label) / CAST(1000 AS DOUBLE) p_mlp,
  CASE WHEN h2 % 10 < 6 THEN 'train' WHEN h2 % 10 < 8 THEN 'cal' ELSE 'test' END split,
  2015 + (l_partkey + l_linenumber) % 11 AS eval_year
FROM (SELECT *, (aa_pos-1)*3+1+l_linenumber%3 cdna_pos, (aa_pos*7+gid)%20 ri,
    ((aa_pos*7+gid)%20+1+(l_orderkey+l_suppkey)%19)%20 ai
  FROM (SELECT *, l_suppkey%5 gid, {_GENE.format(k='l_suppkey')} gene, {_LEN} aa_len,
     1 + (l_partkey*37+l_orderkey*11+l_linenumber*101) % {_LEN} aa_pos,
     CASE CAST(ROUND(l_discount*100) AS INT) WHEN 3 THEN CAST(0.000001 AS DOUBLE)
       WHEN 4 THEN CAST(0.00005 AS DOUBLE) WHEN 5 THEN CAST(0.0001 AS DOUBLE)
       WHEN 6 THEN CAST(0.0002 AS DOUBLE) WHEN 7 THEN CAST(0.0005 AS DOUBLE)
       WHEN 8 THEN CAST(0.001 AS DOUBLE) WHEN 9 THEN CAST(0.002 AS DOUBLE)
       WHEN 10 THEN CAST(0.006 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END af,
     CAST(ROUND(l_tax*100) AS INT) t, CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END label,
     (l_partkey*7919+l_orderkey*104729+l_linenumber*13)%1000 h1,
     (l_partkey*6007+l_orderkey*3571+l_linenumber*29)%1000 h2 FROM lineitem) a) b
"""

_SIGN = "CASE gid WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE -1 END"
_ANCHOR = ("CASE gid WHEN 0 THEN 43170245 WHEN 1 THEN 32315086 WHEN 2 THEN 23641321 "
           "WHEN 3 THEN 58692573 ELSE 35121522 END")
_CHROM = "CASE gid WHEN 1 THEN '13' WHEN 2 THEN '16' ELSE '17' END"
_BASE = ("substring('ACGT', CAST(1 + (cdna*cdna + 3*cdna*(cdna%11) + (cdna%97)*(cdna%89) + gid) % 4 "
         "AS INT), 1)")
_CR = f"CASE WHEN {_SIGN} < 0 THEN translate(b,'ACGT','TGCA') ELSE b END"

VCF_LINES = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_GENE.format(k='gid')} gene,
 (CASE WHEN l_orderkey % 101 = 0 THEN 'ZZ' WHEN l_orderkey % 37 = 0 THEN '1'
   WHEN l_linenumber % 2 = 0 THEN 'chr' || {_CHROM} ELSE {_CHROM} END)
 || chr(9) || CAST(CASE WHEN l_partkey % 5 = 0 THEN {_ANCHOR} + {_SIGN} * (exon_off + 149 + 1 + l_partkey % 12)
   ELSE {_ANCHOR} + {_SIGN} * (exon_off + (cdna-1) % 150) END AS STRING)
 || chr(9) || '.' || chr(9) || r
 || chr(9) || (CASE WHEN l_quantity >= 49 THEN r || 'TT' WHEN l_quantity >= 47 THEN r || 'TTT'
   WHEN l_quantity >= 46 THEN '<DEL>' WHEN l_quantity >= 45 THEN '*'
   WHEN l_linenumber = 6 THEN a1 || ',' || a2 ELSE a1 END)
 || chr(9) || '99' || chr(9)
 || (CASE WHEN l_linestatus = 'F' AND l_linenumber = 3 THEN 'LowQual' ELSE 'PASS' END) || chr(9) || '.'
 || (CASE WHEN l_linenumber = 5 THEN '' ELSE chr(9) || 'GT:GQ' || chr(9)
   || (CASE WHEN l_partkey % 3 = 0 THEN '1/1' ELSE '0/1' END) || ':' || CAST(10 + l_partkey % 60 AS STRING) END) AS value
FROM (SELECT *, CASE WHEN l_suppkey % 23 = 0 THEN a2 ELSE cr END r FROM (
 SELECT *, {_CR} cr, translate({_CR},'ACGT','CGTA') a1, translate({_CR},'ACGT','GTAC') a2
 FROM (SELECT *, {_BASE} b, CAST(FLOOR((cdna-1)/150) AS BIGINT)*1000 exon_off FROM (
  SELECT *, 1 + (l_partkey*37 + l_orderkey*11 + l_linenumber*101) %
    (CASE gid WHEN 0 THEN 1863 WHEN 1 THEN 3418 WHEN 2 THEN 1186 WHEN 3 THEN 376 ELSE 328 END*3) cdna
  FROM (SELECT *, CAST(l_suppkey % 5 AS BIGINT) gid FROM lineitem) x0) x1) x2) x3) x4
"""

# One synthetic transcript per part: 2-5 exons of 20-59 bases, 200 bases apart.
# The coding range starts inside the first exon (every tenth: the second) and
# ends inside the last one.
TX_EXONS = """
SELECT tx, strand, k, exon_start, exon_start + exon_len - 1 AS exon_end,
  CASE WHEN tx % 10 = 0 THEN anchor + 200 + 3 ELSE anchor + 5 + tx % 7 END AS cds_start,
  anchor + (n_exon - 1) * 200 + 12 + tx % 31 AS cds_end
FROM (SELECT tx, strand, n_exon, anchor, k, anchor + k * 200 AS exon_start,
    20 + (tx * 7 + k * 13) % 40 AS exon_len
  FROM (SELECT p_partkey AS tx, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
      2 + p_size % 4 AS n_exon, 100000 + (p_partkey % 97) * 5000 AS anchor, EXPLODE[[2 + p_size % 4]] AS k
    FROM part) a) b
"""

RESIDUE_XYZ = """
SELECT CAST(FLOOR(p_partkey / 400) AS BIGINT) AS structure, p_partkey % 400 + 1 AS resnum,
  CAST((p_partkey * 37) % 100 AS DOUBLE) AS x, CAST((p_partkey * 53) % 100 AS DOUBLE) AS y,
  CAST(p_size AS DOUBLE) AS z, CAST((p_partkey * 29) % 101 AS DOUBLE) AS plddt, p_partkey
FROM part
"""

COHORT_OBS = f"""
SELECT event_id, ts, {_GENE.format(k='user_id')} AS gene, 'v' || CAST(event_id % 50 AS STRING) AS variant,
  event_type AS prediction, LEAST(value, 300) / 300 AS probability, user_id, value, props
FROM events
"""

ANNOT_VARIANT = """
SELECT DISTINCT gene, aa_pos, aa_ref, aa_alt, ((aa_pos * 31) % 500) / CAST(100 AS DOUBLE) AS score
FROM variants WHERE aa_pos % 3 = 0
"""

ANNOT_POSITION = """
SELECT gene, aa_pos, AVG(score) AS mean_score, MAX(score) AS max_score FROM (
  SELECT gene, aa_pos, score FROM annot_variant
  UNION ALL SELECT DISTINCT gene, aa_pos, ((aa_pos * 17) % 500) / CAST(100 AS DOUBLE) AS score
  FROM variants WHERE aa_pos % 5 = 0 AND aa_pos % 3 <> 0) u
GROUP BY gene, aa_pos
"""

PREDICTORS_LONG = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gene, label, predictor, score FROM (
  SELECT *, 'p_tree' AS predictor, p_tree AS score FROM variants
  UNION ALL SELECT *, 'p_mlp' AS predictor, p_mlp AS score FROM variants
  UNION ALL SELECT *, 'p_inverse' AS predictor,
    CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 1 - p_mlp END AS score FROM variants) u
"""

# Functional-assay style benchmark over the variants: bin 0 means loss of function.
BENCH = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gene, aa_pos, aa_ref, aa_alt, p_tree, p_mlp, label,
  CASE WHEN l_partkey % 3 = 0 THEN 'expert' ELSE 'assay' END AS source,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 1 - label END AS dms_score_bin,
  CASE WHEN l_partkey % 3 = 0 THEN NULL
    ELSE ((l_orderkey * 13 + l_partkey * 7) % 400 - 200) / CAST(100 AS DOUBLE) - label END AS dms_score,
  split = 'train' AS in_training, split = 'test' AS in_test,
  'cite' || CAST(l_suppkey % 7 AS STRING) AS citation
FROM variants
"""

# Observed annotation records per protein variant, several per key, with missing values.
SCORE_DUMP = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gene, aa_pos, aa_ref, aa_alt, cdna_pos,
  CASE WHEN l_partkey % 11 = 0 THEN '.' WHEN l_partkey % 11 = 1 THEN '.;NA;' || CAST(p_mlp AS STRING)
    WHEN l_partkey % 11 = 2 THEN '' WHEN l_partkey % 11 = 3 THEN 'NA'
    WHEN l_partkey % 11 = 4 THEN CAST(p_mlp AS STRING) || ';0.5' ELSE CAST(p_mlp AS STRING) END AS raw_score,
  CASE WHEN l_partkey % 13 = 0 THEN '-1;' || CAST(aa_pos AS STRING) WHEN l_partkey % 13 = 1 THEN '.'
    WHEN l_partkey % 13 = 2 THEN '-1' ELSE CAST(aa_pos AS STRING) END AS raw_pos,
  p_mlp, af, af_eas, af_nfe, af_afr, af_amr
FROM variants
"""

# Allele counts per protein variant for two sequencing sources.
FREQ_RECORDS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gene, aa_pos, aa_ref, aa_alt, cdna_pos,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_orderkey % 9 END AS exome_ac,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 1000 + l_partkey % 5000 END AS exome_an,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_suppkey % 7 END AS genome_ac,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 500 + l_orderkey % 3000 END AS genome_an,
  af AS exome_af, af_afr, af_amr, af_eas, af_nfe, af / 4 AS af_sas,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE af_eas END AS genome_af
FROM variants
"""

VIEWS = {
    "variants": VARIANTS, "vcf_lines": VCF_LINES, "tx_exons": TX_EXONS, "residue_xyz": RESIDUE_XYZ,
    "cohort_obs": COHORT_OBS, "annot_variant": ANNOT_VARIANT, "annot_position": ANNOT_POSITION,
    "predictors_long": PREDICTORS_LONG, "bench": BENCH, "score_dump": SCORE_DUMP, "freq_records": FREQ_RECORDS,
}
_BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _render(sql: str, engine: str) -> str:
    if engine == "spark":
        pick, split, explode = "element_at", "split", r"explode(sequence(0, CAST(\1 AS INT) - 1))"
    else:
        pick, split, explode = "list_element", "string_split", r"unnest(range(CAST(\1 AS INT)))"
    sql = re.sub(r"AA\[\[(.*?)\]\]", rf"{pick}({split}('{AA_LIST}', ','), CAST(\1 AS INT)+1)", sql)
    sql = re.sub(r"MUT\[\[(.*?)\]\]", rf"{pick}({split}('{MUT_LIST}', ','), CAST(\1 AS INT)+1)", sql)
    return re.sub(r"EXPLODE\[\[(.*?)\]\]", explode, sql)


# Row keys of the tables whose derived views do heavy work per row.
_ROW_KEYS = {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "part": ("p_partkey",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table. The test tables are one file of one row group, which Spark reads in one task; where
    there are fewer files than cores the rows are spread by key before the views' formulas."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _ROW_KEYS and len(df.inputFiles()) < cores:
        df = df.repartition(cores, *_ROW_KEYS[name])
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Spark DataFrame of a base table, a derived view or a dimension."""
    if name in _BASE_TABLES:
        return table(spark, sf_dir, name)
    if name in dims.TABLES:
        return dims.dim(spark, name)
    if name == "cds_bases":
        return cds_bases(spark)
    text = _render(VIEWS[name], "spark")
    sources = {n: view(spark, sf_dir, n) for n in _mentions(text)}
    for n in sources:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **sources)


def cds_bases(spark: SparkSession) -> DataFrame:
    """gene, cdna, base: the coding sequence of the fixtures, one row per base."""
    genes = dims.dim(spark, "genes")
    return (genes.select("gene", "gid", F.explode(F.expr("sequence(1L, cds_length)")).alias("cdna"))
            .selectExpr("gene", "cdna", f"{_BASE} AS base"))


SQL_VIEWS = {n: _render(t, "duckdb") for n, t in VIEWS.items()}
SQL_VIEWS["vcf_lines"] = ("SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, value) AS line FROM ("
                          + SQL_VIEWS["vcf_lines"] + ") numbered_lines")
SQL_VIEWS.update({n: dims.sql_values(n) for n in dims.TABLES})
SQL_VIEWS["cds_bases"] = (
    f"SELECT gene, cdna, {_BASE} AS base FROM "
    "(SELECT gene, gid, unnest(range(1, cds_length + 1)) AS cdna FROM genes) g"
)
# Helper views only the SQL twins use; the Spark side builds them with the operators.
_FLAGS = ("in_critical_repeat_region", "in_DNA_binding", "in_OB_folds", "in_NLS", "in_primary_interaction")
SQL_HELPERS = {
    "domain_flags": (
        "SELECT gene, flag, start_aa, end_aa FROM (SELECT d.gene, c.flag, d.start_aa, d.end_aa, "
        "row_number() OVER (PARTITION BY d.gene, c.flag ORDER BY c.rank) rn "
        "FROM domains d JOIN domain_candidates c ON d.name = c.name) x WHERE rn = 1"),
    "flag_wide": "SELECT gene, " + ", ".join(
        f"max(CASE WHEN flag='{f}' THEN start_aa END) s_{f}, max(CASE WHEN flag='{f}' THEN end_aa END) e_{f}"
        for f in _FLAGS) + " FROM domain_flags GROUP BY gene",
    "known_path": (
        "SELECT DISTINCT gene, aa_pos, aa_ref, aa_alt FROM variants "
        "WHERE split = 'train' AND label = 1 AND aa_alt <> 'Ter'"),
    "ev_in": (
        "SELECT e.*, (in_critical_repeat_region + in_DNA_binding) > 0 AS critical, aa_alt = 'Ter' AS is_nonsense "
        "FROM (SELECT v.*, g.ba1, g.bs1, g.aa_length, " + ", ".join(
            f"CASE WHEN v.aa_pos BETWEEN w.s_{f} AND w.e_{f} THEN 1 ELSE 0 END AS {f}" for f in _FLAGS) +
        ", EXISTS (SELECT 1 FROM known_path k WHERE k.gene = v.gene AND k.aa_pos = v.aa_pos) AS same_position, "
        "EXISTS (SELECT 1 FROM known_path k WHERE k.gene = v.gene AND k.aa_pos = v.aa_pos AND k.aa_ref = v.aa_ref "
        "AND k.aa_alt = v.aa_alt) AS same_change "
        "FROM variants v JOIN genes g ON v.gene = g.gene LEFT JOIN flag_wide w ON v.gene = w.gene) e"),
}
SQL_HELPERS |= {
    "vcf_parsed": (
        "SELECT *, CASE WHEN regexp_full_match(c, '([1-9]|1[0-9]|2[0-2]|x|y|mt?)') THEN c END AS chrom, "
        "TRY_CAST(p[2] AS BIGINT) AS pos, upper(p[4]) AS ref, upper(p[5]) AS alts, coalesce(p[7], '.') AS filt, "
        "CASE WHEN len(p) >= 10 THEN string_split(p[10], ':')[list_position(string_split(p[9], ':'), 'GT')] END AS genotype, "
        "CASE WHEN len(p) >= 10 THEN TRY_CAST(string_split(p[10], ':')[list_position(string_split(p[9], ':'), 'GQ')] AS BIGINT) END AS gq, "
        "len(p) > 10 AS multi_sample "
        "FROM (SELECT *, replace(lower(p[1]), 'chr', '') AS c FROM (SELECT *, string_split(trim(value), chr(9)) AS p FROM vcf_lines) x0) x1"),
    "vcf_alleles": (
        "SELECT *, CASE WHEN alt = '*' OR starts_with(alt, '<') THEN 'Unsupported allele type: ' || alt END AS bad FROM ("
        "SELECT *, trim(string_split(alts, ',')[allele + 1]) AS alt FROM (SELECT *, CAST(unnest(range(len(string_split(alts, ',')))) AS INT) AS allele "
        "FROM vcf_parsed WHERE chrom IS NOT NULL AND pos IS NOT NULL) y0) y1"),
    "vcf_marked": (
        "SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN row_number() OVER (PARTITION BY l_suppkey, chrom, pos, ref, alt, bad IS NULL "
        "ORDER BY l_orderkey, l_linenumber, l_partkey, allele) > 1 THEN 'Duplicate variant' END AS skip FROM vcf_alleles"),
    "gmap": (
        "SELECT e.gene, g.strand, e.first_cdna + i AS cdna_pos, CASE WHEN g.strand = '+' THEN e.exon_start + i ELSE e.exon_end - i END AS genomic_pos "
        "FROM (SELECT *, unnest(range(CAST(exon_end - exon_start + 1 AS BIGINT))) AS i FROM exons) e JOIN genes g ON g.gene = e.gene"),
    "gzones": (
        "SELECT z.gene, z.pos, arg_max(z.d, z.o) AS distance, CASE WHEN min(z.d) <= 2 THEN 'canonical' ELSE 'near' END AS zone FROM ("
        "SELECT b.gene, b.a + o.o AS pos, abs(o.o) AS d, CASE WHEN abs(o.o) <= 2 THEN 1000000000 ELSE 0 END + b.c * 1000 + b.s * 100 + o.o AS o FROM "
        "(SELECT gene, cdna_pos AS c, 0 AS s, genomic_pos AS a FROM gbound UNION ALL SELECT gene, cdna_pos, 1, nxt FROM gbound) b, "
        "(SELECT unnest(range(-8, 9)) AS o) o WHERE o.o <> 0) z "
        "WHERE NOT EXISTS (SELECT 1 FROM gmap m WHERE m.gene = z.gene AND m.genomic_pos = z.pos) GROUP BY z.gene, z.pos"),
    "gbound": (
        "SELECT * FROM (SELECT *, lead(genomic_pos) OVER (PARTITION BY gene ORDER BY cdna_pos) AS nxt FROM gmap) w "
        "WHERE CASE WHEN strand = '+' THEN nxt - genomic_pos ELSE genomic_pos - nxt END > 1"),
    "gcoding": (
        "SELECT m.gene, m.strand, m.cdna_pos, m.genomic_pos, c.codon, CAST((m.cdna_pos - 1) % 3 AS INT) AS off, CAST((m.cdna_pos - 1) // 3 + 1 AS BIGINT) AS aap, "
        "n.near FROM gmap m JOIN (SELECT gene, (cdna - 1) // 3 AS ci, string_agg(base, '' ORDER BY cdna) AS codon FROM cds_bases GROUP BY gene, ci) c "
        "ON c.gene = m.gene AND c.ci = (m.cdna_pos - 1) // 3 JOIN (SELECT a.gene, a.cdna_pos, bool_or(abs(b.genomic_pos - a.genomic_pos) > abs(b.cdna_pos - a.cdna_pos) + 1) AS near "
        "FROM gmap a JOIN gmap b ON b.gene = a.gene AND b.cdna_pos BETWEEN a.cdna_pos - 3 AND a.cdna_pos + 3 AND b.cdna_pos <> a.cdna_pos GROUP BY a.gene, a.cdna_pos) n "
        "ON n.gene = m.gene AND n.cdna_pos = m.cdna_pos"),
    "vcf_translated": (
        "SELECT t.*, r.aa AS raa, x.aa AS aaa FROM (SELECT *, overlay_codon AS acodon FROM (SELECT *, CASE WHEN cr IS NOT NULL THEN "
        "substr(codon, 1, off) || ca || substr(codon, off + 2) END AS overlay_codon FROM (SELECT *, CASE WHEN have = comp THEN comp WHEN have = ref THEN ref END AS cr, "
        "CASE WHEN have = comp THEN compa WHEN have = ref THEN alt END AS ca FROM (SELECT v.*, g.strand, g.chromosome, c.cdna_pos AS cp, c.aap, c.codon, c.off, c.near, "
        "z.zone, z.distance, substr(c.codon, c.off + 1, 1) AS have, CASE WHEN g.strand = '-' THEN translate(v.ref, 'ACGT', 'TGCA') ELSE v.ref END AS comp, "
        "CASE WHEN g.strand = '-' THEN translate(v.alt, 'ACGT', 'TGCA') ELSE v.alt END AS compa "
        "FROM (SELECT * FROM vcf_marked WHERE skip IS NULL) v JOIN genes g ON g.gene = v.gene LEFT JOIN gcoding c ON c.gene = v.gene AND c.genomic_pos = v.pos "
        "LEFT JOIN gzones z ON z.gene = v.gene AND z.pos = v.pos) t0) t1) t2) t LEFT JOIN codons r ON r.codon = t.codon LEFT JOIN codons x ON x.codon = t.acodon"),
    "vcf_classified": (
        "SELECT *, CASE WHEN reason IS NOT NULL THEN NULL WHEN indel AND shift THEN 'frameshift' WHEN indel THEN 'inframe_indel' "
        "WHEN cp IS NULL THEN CASE zone WHEN 'canonical' THEN 'splice_canonical' ELSE 'splice_near' END "
        "WHEN raa = aaa THEN 'synonymous' WHEN aaa = 'Ter' THEN 'nonsense' ELSE 'missense' END AS variant_type, "
        "CASE WHEN reason IS NOT NULL THEN NULL WHEN indel AND shift THEN 0.9999::DOUBLE WHEN indel THEN CASE WHEN in_dom THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END "
        "WHEN cp IS NULL THEN CASE zone WHEN 'canonical' THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END "
        "WHEN raa = aaa THEN CASE WHEN near THEN 0.4::DOUBLE ELSE 0.05::DOUBLE END WHEN aaa = 'Ter' THEN 0.9999::DOUBLE "
        "ELSE least(greatest(CAST((cp * 31 + l_partkey * 7) % 1000 AS DOUBLE) / 1000, 0.005::DOUBLE), 0.995::DOUBLE) END AS probability "
        "FROM (SELECT *, CASE WHEN chrom <> chromosome THEN 'Not on chr' || chromosome WHEN indel THEN NULL "
        "WHEN NOT regexp_full_match(ref, '[ACGT]') OR NOT regexp_full_match(alt, '[ACGT]') THEN 'Invalid alleles' "
        "WHEN cp IS NULL AND zone IS NULL THEN 'Not in ' || gene || ' CDS' WHEN cp IS NULL THEN NULL "
        "WHEN cr IS NULL THEN 'Ref mismatch: CDS has ' || have || ' at cDNA ' || cp || ', VCF says ' || ref "
        "WHEN raa IS NULL OR aaa IS NULL THEN 'Unknown codon' END AS reason FROM (SELECT *, length(ref) <> 1 OR length(alt) <> 1 AS indel, "
        "abs(length(ref) - length(alt)) % 3 <> 0 AS shift, EXISTS (SELECT 1 FROM domains d WHERE d.gene = q.gene AND q.aap BETWEEN d.start_aa AND d.end_aa) AS in_dom "
        "FROM vcf_translated q) q0) q1"),
}
# The same steps where a gene's lines make one file, numbered in file order.
_GENE_STEPS = ("lines", "parsed", "alleles", "marked", "translated", "classified")
SQL_HELPERS["gene_lines"] = SQL_VIEWS["vcf_lines"].replace("PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, value",
                                                           "PARTITION BY gene ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, value")
for _before, _step in zip(_GENE_STEPS, _GENE_STEPS[1:]):
    SQL_HELPERS[f"gene_{_step}"] = (SQL_HELPERS[f"vcf_{_step}"].replace(f"vcf_{_before}", f"gene_{_before}")
                                    .replace("PARTITION BY l_suppkey, chrom, pos, ref, alt, bad IS NULL ORDER BY l_orderkey, l_linenumber, l_partkey, allele",
                                             "PARTITION BY gene, chrom, pos, ref, alt, bad IS NULL ORDER BY line, allele"))
SQL_VIEWS.update(SQL_HELPERS)
_ORDER = [*dims.TABLES, "cds_bases", *VIEWS, "domain_flags", "flag_wide", "known_path", "ev_in", "vcf_parsed", "vcf_alleles",
          "vcf_marked", "gmap", "gbound", "gzones", "gcoding", "vcf_translated", "vcf_classified", *[f"gene_{n}" for n in _GENE_STEPS]]


def _mentions(text: str) -> list[str]:
    names = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text))
    return [n for n in [*_BASE_TABLES, *_ORDER] if n in names]


def with_views(body: str) -> str:
    """Prepend the CTEs of all views that ``body`` mentions, directly or not."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for n in set(re.findall(r"\b\w+\b", text)) & set(SQL_VIEWS):
            if n not in needed and re.search(rf"(FROM|JOIN|,)\s+{n}\b", text):
                needed.add(n)
                todo.append(SQL_VIEWS[n])
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in _ORDER if n in needed)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
