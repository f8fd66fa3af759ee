"""Scans and sinks: each query writes derived rows to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import parsing as P
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query
from helixframe.session import shared_dir
from helixframe.sources import readers as RD, writers as WR

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K4 = ", ".join(KEY)


@query("scan_vcf", """
SELECT gene, count(*) AS n_data, CAST(max(h.n) AS BIGINT) AS n_header, TRUE AS format_ok FROM vcf_lines,
 (SELECT 2 * count(*) AS n FROM supplier) h GROUP BY gene""")
def scan_vcf(spark, sf):
    """VCF text per gene with two header lines per supplier; data lines counted after the scan."""
    path = shared_dir(spark, "vcf")
    lines = view(spark, sf, "vcf_lines").select("gene", "value")
    heads = view(spark, sf, "supplier").select(F.explode(F.array(F.lit("##fileformat=VCFv4.2"), F.lit(
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"))).alias("value"))
    WR.write_lines(heads.withColumn("gene", F.explode(F.array(*map(F.lit, RD.supported_genes())))).unionByName(lines), path, ["gene"])
    return RD.vcf_format_check(RD.read_lines(spark, path), "gene")


@query("scan_vcf_lines", f"SELECT gene, value FROM vcf_lines")
def scan_vcf_lines(spark, sf):
    path = shared_dir(spark, "vcf-lines")
    WR.write_lines(view(spark, sf, "vcf_lines").select("gene", "value"), path, ["gene"])
    return RD.read_vcf(spark, path).select("gene", "value")


@query("scan_csv", f"SELECT {K4}, gene, aa_pos, aa_ref, aa_alt, af, CAST(label AS BIGINT) AS label FROM variants")
def scan_csv(spark, sf):
    path = shared_dir(spark, "csv")
    v = view(spark, sf, "variants").select(*KEY, "gene", "aa_pos", "aa_ref", "aa_alt", "af", "label")
    v.write.option("header", "true").csv(path)
    schema = ("l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, gene string, aa_pos bigint, aa_ref string, "
              "aa_alt string, af double, label bigint")
    return RD.read_table(spark, [path, path + "-missing"], schema)


@query("scan_json_nested", """
SELECT p_partkey AS doc_id, k AS ord, CASE k WHEN 0 THEN 'BRCA1' ELSE 'PALB2' END AS gene, 'c.' || (p_partkey * 10 + k) || 'A>G' AS hgvs_c,
  CASE k WHEN 0 THEN p_size / 1000.0::DOUBLE ELSE p_size / 500.0::DOUBLE END AS frequency FROM part, (SELECT unnest([0, 1]) AS k) u""")
def scan_json_nested(spark, sf):
    """One founder document per part; the two entries use different key names."""
    path = shared_dir(spark, "founders")
    doc = F.expr("""to_json(named_struct('doc_id', p_partkey, 'mutations', array(
      named_struct('gene', 'brca1', 'hgvs_c', concat('c.', CAST(p_partkey * 10 AS STRING), 'A>G'), 'hgvs_cdna', CAST(NULL AS STRING),
        'frequency_kz', p_size / 1000D, 'estimated_frequency', CAST(NULL AS DOUBLE)),
      named_struct('gene', 'PALB2', 'hgvs_c', CAST(NULL AS STRING), 'hgvs_cdna', concat('c.', CAST(p_partkey * 10 + 1 AS STRING), 'A>G'),
        'frequency_kz', CAST(NULL AS DOUBLE), 'estimated_frequency', p_size / 500D))))""")
    WR.write_lines(view(spark, sf, "part").select(doc.alias("value")), path)
    return RD.read_founders(spark, path, multi_line=False).select("doc_id", "ord", "gene", "hgvs_c", "frequency")


@query("scan_wide_tsv", f"""
SELECT {K4}, aa_pos * 3 + 1000 AS pos, aa_ref, p_mlp AS score FROM variants WHERE aa_pos * 3 + 1000 BETWEEN 1300 AND 4000""")
def scan_wide_tsv(spark, sf):
    path = shared_dir(spark, "wide")
    v = view(spark, sf, "variants").select(
        *KEY, F.expr("aa_pos * 3 + 1000").alias("hg38_pos(1-based)"), F.col("aa_ref").alias("aaref"), F.col("aa_alt").alias("aaalt"), "gene",
        F.col("p_mlp").alias("REVEL_score"), F.col("p_tree").alias("CADD_phred"), "af", "af_eas", "af_nfe", "mutation")
    v.write.options(header="true", sep="\t").csv(path)
    wide = RD.read_wide_tsv(spark, path, {**{k: [k] for k in KEY}, "pos": ["pos(1-based)", "hg38_pos(1-based)", "pos"],
                                          "aa_ref": ["aaref"], "raw": ["REVEL_score"]})
    out = RD.in_region(wide, "pos", 1300, 4000)
    return out.select(*[F.col(k).cast("bigint").alias(k) for k in KEY], "pos", "aa_ref", P.first_score(F.col("raw")).alias("score"))


@query("scan_comment_tsv", f"""
SELECT l_orderkey, v.gene, r.aa AS aa_ref, aa_pos, a.aa AS aa_alt, p_tree AS am_score FROM variants v JOIN residues r ON r.aa = v.aa_ref JOIN residues a ON a.aa = v.aa_alt
WHERE v.gene = 'BRCA2'""")
def scan_comment_tsv(spark, sf):
    path = shared_dir(spark, "comment")
    res = view(spark, sf, "residues")
    r, a = res.select(F.col("aa").alias("aa_ref"), F.col("one").alias("r1")), res.select(F.col("aa").alias("aa_alt"), F.col("one").alias("a1"))
    v = view(spark, sf, "variants").join(r, "aa_ref").join(a, "aa_alt")
    rows = v.select(F.concat_ws("\t", "gene", F.concat("r1", F.col("aa_pos").cast("string"), "a1"), F.col("p_tree").cast("string"),
                                F.col("l_orderkey").cast("string")).alias("value"))
    extra = view(spark, sf, "supplier").select(F.explode(F.array(
        F.lit("# copyright and usage notes"), F.lit("uniprot_id\tprotein_variant\tam_pathogenicity\tnote"))).alias("value"))
    WR.write_lines(rows.unionByName(extra), path)
    raw = RD.read_comment_tsv(spark, path, ["uniprot_id", "protein_variant", "am_pathogenicity", "note"]).filter("uniprot_id = 'BRCA2'")
    out = RD.protein_token(raw, "protein_variant", res)
    return out.select(F.col("note").cast("bigint").alias("l_orderkey"), F.col("uniprot_id").alias("gene"), "aa_ref", "aa_pos", "aa_alt",
                      F.col("am_pathogenicity").cast("double").alias("am_score"))


@query("scan_release_summary", f"""
SELECT l_orderkey, l_partkey, gene, CASE WHEN label = 1 THEN 'Pathogenic' ELSE 'Benign' END AS significance, CAST(eval_year AS BIGINT) AS year
FROM variants WHERE gene IN ('BRCA1', 'PALB2') AND l_partkey % 7 <> 0""")
def scan_release_summary(spark, sf):
    """Gzip summary found by header name; every seventh row is cut short and dropped."""
    path = shared_dir(spark, "release")
    v = view(spark, sf, "variants")
    full = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.lit("single nucleotide variant"), F.col("gene"),
                       F.when(F.col("label") == 1, "Pathogenic").otherwise("Benign"),
                       F.concat(F.lit("Jan 05, "), F.col("eval_year").cast("string")), F.col("l_partkey").cast("string"))
    cut = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.lit("single nucleotide variant"), F.col("gene"))
    rows = v.select(F.when(F.col("l_partkey") % 7 == 0, cut).otherwise(full).alias("value"))
    head = view(spark, sf, "supplier").select(F.lit("#AlleleID\tType\tGeneSymbol\tClinicalSignificance\tLastEvaluated\tVariationID").alias("value"))
    WR.write_lines(rows.unionByName(head), path, compression="gzip")
    out = RD.read_by_header(spark, path, "#AlleleID", {
        "l_orderkey": "#AlleleID", "gene": "GeneSymbol", "significance": "ClinicalSignificance", "date": "LastEvaluated", "l_partkey": "VariationID"})
    year = F.element_at(F.split(F.replace("date", F.lit(","), F.lit("")), r"\s+"), -1).try_cast("bigint")
    return out.filter(F.col("gene").isin("BRCA1", "PALB2")).select(
        F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_partkey").cast("bigint").alias("l_partkey"), "gene", "significance", year.alias("year"))


HIT = """CASE event_id % 5
 WHEN 0 THEN '{"dbnsfp": {"aa": {"pos": [' || CAST(user_id AS STRING) || ', 7], "ref": "A", "alt": "V"}, "revel": {"score": ' || CAST(value AS STRING) || '}, "bayesdel": {"add_af": {"score": 0.25}}}, "cadd": {"phred": 12.5}}'
 WHEN 1 THEN '{"dbnsfp": [{"aa": [{"pos": ' || CAST(user_id AS STRING) || ', "ref": "G", "alt": "S"}], "revel": {"score": [' || CAST(value AS STRING) || ', 0.1]}, "bayesdel": {"add_af": 0.5}}, {"aa": {"pos": 1}}], "cadd": 3.5}'
 WHEN 2 THEN '{"dbnsfp": {"aa": {"pos": ' || CAST(user_id AS STRING) || ', "ref": "K", "alt": "E"}, "revel": ' || CAST(value AS STRING) || ', "bayesdel": 0.75}}'
 WHEN 3 THEN '{"cadd": {"phred": 1.5}}' ELSE 'not json' END"""


@query("scan_nested_hits", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(user_id AS VARCHAR) || ',7' WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN CAST(user_id AS VARCHAR) ELSE '' END AS positions,
  CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'G' WHEN 2 THEN 'K' END AS aa_ref, CASE event_id % 5 WHEN 0 THEN 'V' WHEN 1 THEN 'S' WHEN 2 THEN 'E' END AS aa_alt,
  CASE WHEN event_id % 5 < 3 THEN value END AS revel, CASE event_id % 5 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.75::DOUBLE END AS bayesdel,
  CASE event_id % 5 WHEN 0 THEN 12.5::DOUBLE WHEN 1 THEN 3.5::DOUBLE WHEN 3 THEN 1.5::DOUBLE END AS cadd_phred FROM events""")
def scan_nested_hits(spark, sf):
    path = shared_dir(spark, "hits")
    e = view(spark, sf, "events").select("event_id", F.expr(HIT).alias("hit"))
    WR.write_lines(e.select(F.concat(F.col("event_id").cast("string"), F.lit("\t"), "hit").alias("value")), path)
    out = RD.read_hits(spark, path).withColumn("event_id", F.col("id").cast("bigint")).drop("id")
    return out.withColumn("positions", F.coalesce(F.array_join(F.col("positions").cast("array<string>"), ","), F.lit("")))


@query("scan_fixed_width", "SELECT structure, resnum, x, y, z, plddt FROM residue_xyz")
def scan_fixed_width(spark, sf):
    path = shared_dir(spark, "atoms")
    r = view(spark, sf, "residue_xyz")
    fmt = "ATOM  %5d  %-3s RES A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f"
    ca = F.format_string(fmt, F.col("resnum"), F.lit("CA"), F.col("resnum"), "x", "y", "z", F.lit(1.0), F.col("plddt"))
    cb = F.format_string(fmt, F.col("resnum"), F.lit("CB"), F.col("resnum"), "y", "x", "z", F.lit(1.0), F.lit(0.0))
    lines = r.select("structure", F.explode(F.array(F.lit("HEADER"), ca, cb)).alias("value"))
    WR.write_lines(lines, path, ["structure"])
    return RD.read_atoms(spark, path).withColumn("structure", F.col("structure").cast("bigint"))


@query("sink_csv_json", """
SELECT gene, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pathogenic, round(max(p_tree), 6) AS max_probability FROM variants GROUP BY gene""")
def sink_csv_json(spark, sf):
    """Annotated table as Parquet by gene, predictions as quoted CSV, summary as JSON; all read back."""
    base = shared_dir(spark, "sink")
    v = view(spark, sf, "variants").select("gene", F.concat("aa_ref", F.col("aa_pos").cast("string"), "aa_alt").alias("variant"),
                                           F.col("label").alias("prediction"), F.col("p_tree").alias("probability"), F.lit("n/a").alias("risk_tier"))
    WR.write_annotated(v, f"{base}/table")
    table = spark.read.parquet(f"{base}/table")
    WR.write_predictions_csv(table, f"{base}/csv")
    csv = spark.read.schema("gene string, variant string, prediction int, probability double, risk_tier string").option("header", "true").csv(f"{base}/csv")
    WR.write_summary_json(csv.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("n_pathogenic"),
                                                  F.max("probability").alias("max_probability")), f"{base}/json")
    out = spark.read.schema("gene string, n bigint, n_pathogenic bigint, max_probability double").json(f"{base}/json")
    return out.withColumn("max_probability", F.round("max_probability", 6))


REQUEST = [
    "CASE WHEN event_id % 9 = 0 THEN 'TP53' ELSE lower(gene) END AS gene", "'Ala' AS aa_ref",
    "CAST(event_id % 300 + 1 AS BIGINT) AS aa_pos", "'Val' AS aa_alt",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE prediction END AS prediction", "probability",
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE '  Lab #' || CAST(user_id AS STRING) || ' <b>-.x! ' END AS institution",
    "'KZ;' || prediction AS country"]


@query("append_observation", """
SELECT event_id % 300 + 1 AS aa_pos, gene, prediction, institution, country, count(*) AS n, round(sum(probability), 6) AS total FROM (
SELECT event_id, gene, left(prediction, 20) AS prediction, round(probability, 4) AS probability,
  CASE WHEN event_id % 4 = 0 THEN 'anonymous' ELSE 'Lab ' || user_id || ' b-.x' END AS institution, 'KZ' || prediction AS country
FROM cohort_obs WHERE event_id % 9 <> 0 AND event_id % 13 <> 0) x GROUP BY ALL""")
def append_observation(spark, sf):
    path = shared_dir(spark, "observations")
    rows = WR.observation_rows(view(spark, sf, "cohort_obs").selectExpr("ts", *REQUEST), F.col("ts"))
    half = F.col("aa_pos") % 2
    rows = rows.withColumn("aa_pos", F.regexp_extract("variant", r"(\d+)", 1).cast("bigint"))
    for attempt in range(2):  # every batch is sent twice and counts once
        for batch in range(2):
            WR.append_observations(rows.filter(half == batch).drop("aa_pos"), path, f"b{batch}")
    # an attempt that died before its manifest leaves rows that do not count
    rows.drop("aa_pos").write.parquet(f"{path}/data/batch=b9")
    log = WR.read_observations(spark, path, rows.drop("aa_pos").schema)
    return (log.withColumn("aa_pos", F.regexp_extract("variant", r"(\d+)", 1).cast("bigint"))
            .groupBy("aa_pos", "gene", "prediction", "institution", "country")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("probability"), 6).alias("total")))
