"""Input checks, labels and identifiers. Bad rows stay, with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe import constants as K
from helixframe.functions import parsing as P

VALID_CODES = [r[0] for r in K.RESIDUES] + [r[1] for r in K.RESIDUES] + ["Fs"]


def label_by_id_sets(df: DataFrame, key: str, pathogenic: DataFrame, benign: DataFrame) -> DataFrame:
    """1 if the id is in the pathogenic set, else 0 if in the benign set; others drop."""
    p = pathogenic.select(key).distinct().withColumn("_p", F.lit(1))
    b = benign.select(key).distinct().withColumn("_b", F.lit(0))
    return (df.join(p, key, "left").join(b, key, "left").withColumn("label", F.coalesce("_p", "_b"))
            .drop("_p", "_b").filter("label IS NOT NULL"))


def estimated_cdna(cdna: Column, aa_pos: Column) -> Column:
    return F.coalesce(cdna, aa_pos * 3 - 1)


def proxy_cdna(aa_pos: Column) -> Column:
    return F.greatest(aa_pos * 3, F.lit(1))


def validate_requests(df: DataFrame, genes: DataFrame) -> DataFrame:
    """Normalise residue and mutation text and list every error of a row.

    Needs gene, cdna_pos, aa_ref, aa_alt, mutation. Valid rows have no errors.
    """
    g = genes.select(F.upper("gene").alias("_gene"), F.col("cds_length").alias("_max"))
    out = df.withColumn("gene", F.upper("gene")).join(g, F.col("gene") == F.col("_gene"), "left")
    out = out.withColumns({
        "aa_ref": P.title_case(F.col("aa_ref")), "aa_alt": P.title_case(F.col("aa_alt")),
        "mutation": F.when(F.col("mutation") == "Unknown", F.col("mutation")).otherwise(F.upper("mutation"))})
    m = F.col("mutation")
    good = (m == "Unknown") | m.isin(K.VARIANT_TYPE_TOKENS) | m.rlike("^[ACGT]>[ACGT]$")
    return out.withColumn("errors", F.array_compact(F.array(
        F.when(F.col("_gene").isNull(), "Unsupported gene"),
        F.when(F.col("cdna_pos") < 1, "cDNA_pos must be positive"),
        F.when(F.col("cdna_pos") > F.col("_max"), "cDNA position exceeds gene length"),
        F.when(~F.col("aa_ref").isin(VALID_CODES), "Invalid reference amino acid"),
        F.when(~F.col("aa_alt").isin(VALID_CODES), "Invalid alternate amino acid"),
        F.when(~good, "Invalid mutation")))).drop("_gene", "_max")


def validate_configs(df: DataFrame, config: str, required: list[str] | None = None) -> DataFrame:
    """Missing required keys of a JSON configuration; without any the gene is available."""
    need = F.array(*map(F.lit, required or K.CONFIG_REQUIRED))
    keys = F.json_object_keys(F.col(config))
    out = df.withColumn("missing", F.array_except(need, F.coalesce(keys, F.array().cast("array<string>"))))
    return out.withColumn("available", F.size("missing") == 0)


def add_identifiers(df: DataFrame) -> DataFrame:
    """hgvs_c, hgvs_p and the gene-qualified variant name."""
    protein = F.concat(F.col("aa_ref"), F.col("aa_pos").cast("string"), F.col("aa_alt"))
    prefix = F.when(F.coalesce(F.col("transcript"), F.lit("")) != "", F.concat("transcript", F.lit(":c."))).otherwise("c.")
    return df.withColumns({
        "hgvs_c": F.concat(prefix, F.col("cdna_pos").cast("string"), F.col("mutation")),
        "hgvs_p": F.concat(F.lit("p."), protein), "variant": F.concat(F.col("gene"), F.lit(":p."), protein)})


def match_benchmark(bench: DataFrame, predictions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Benchmark rows with a prediction, and those without."""
    return bench.join(predictions, keys), bench.join(predictions.select(*keys), keys, "left_anti")


def attach_predictors(bench: DataFrame, hits: DataFrame, scores: list[str], order: list[str]) -> DataFrame:
    """Scores of the last hit per (gene, position, residues); a hit may list several positions."""
    keys = ["gene", "aa_pos", "aa_ref", "aa_alt"]
    each = hits.select("gene", F.posexplode("positions").alias("_i", "aa_pos"), "aa_ref", "aa_alt", *order, *scores)
    last = each.groupBy(*keys).agg(F.max_by(F.struct(*scores), F.struct(*order, "_i")).alias("_s"))
    return (bench.join(last, keys, "left")
            .select(*[bench[c] for c in bench.columns if c not in scores], *[F.col(f"_s.{s}").alias(s) for s in scores]))


def align_vectors(df: DataFrame, vectors: DataFrame, key: str, vector: str, name: str, size: int) -> DataFrame:
    """First ``size`` elements of another table's vector by row id, 0 and has_<name> = 0 when absent."""
    v = vectors.select(key, F.col(vector).alias("_v"))
    cols = [F.coalesce(F.try_element_at("_v", F.lit(i + 1)).cast("double"), F.lit(0.0)).alias(f"{name}_{i}") for i in range(size)]
    return df.join(v, key, "left").select(*df.columns, *cols, F.col("_v").isNotNull().cast("int").alias(f"has_{name}"))
