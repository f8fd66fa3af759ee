"""Readers for variant, annotation and structure files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from helixframe import constants as K
from helixframe.functions import parsing as P

VCF_CHECK_FORMAT, VCF_CHECK_HEADER = 50, 100


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The given paths that can be listed; Spark itself skips empty files."""
    keep = []
    for p in paths:
        try:
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            keep.append(p)
    return keep


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with their file, block start and a number rising within the block.

    (file, block, seq) gives file order without a global sort or a one-task window.
    """
    return spark.read.text(path).select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"))


def is_data(value: Column) -> Column:
    return (P.strip(value) != "") & ~P.strip(value).startswith("#")


def read_vcf(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Data lines of VCF text: blank, ``##`` and ``#`` lines are dropped."""
    return read_lines(spark, path).filter(is_data(F.col("value")))


def vcf_format_check(lines: DataFrame, file: str = "file") -> DataFrame:
    """Per file: data and header line counts and whether it looks like VCF.

    A file passes with ``##fileformat=VCF`` in its first 50 lines, ``#CHROM`` in its
    first 100, or else when its first data line has five tab columns. Only the
    first 100 lines are ranked; Spark prunes the rest before the shuffle.
    """
    v = F.col("value")
    counts = lines.groupBy(file).agg(F.count_if(is_data(v)).alias("n_data"), F.count_if(v.startswith("#")).alias("n_header"))
    order = W.partitionBy(file).orderBy("block", "seq")
    head = lines.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= VCF_CHECK_HEADER)
    marks = head.groupBy(file).agg(
        F.coalesce(F.bool_or(v.startswith("##fileformat=VCF") & (F.col("_rn") <= VCF_CHECK_FORMAT)), F.lit(False)).alias("_f"),
        F.bool_or(v.startswith("#CHROM")).alias("_c"))
    first = lines.filter(is_data(v)).groupBy(file).agg(F.min_by(F.size(F.split("value", "\t")), F.struct("block", "seq")).alias("_w"))
    ok = F.col("_f") | F.col("_c") | (F.coalesce(F.col("_w"), F.lit(5)) >= 5)
    return counts.join(marks, file).join(first, file, "left").withColumn("format_ok", ok).drop("_f", "_c", "_w")


def read_table(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType, **options: str) -> DataFrame:
    """Typed CSV read; missing and empty files are skipped, bad cells become NULL."""
    have = existing_paths(spark, [paths] if isinstance(paths, str) else paths)
    if not have:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(header="true", mode="PERMISSIVE", **options).csv(have)


def read_wide_tsv(spark: SparkSession, path: str, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Pick columns of a wide score dump by header, the first alias present.

    Names are matched against the header Spark reads, so only the picked columns
    are parsed; columns without any alias present are NULL.
    """
    raw = spark.read.options(header="true", sep="\t").csv(path)
    cols = []
    for name, aliases in wanted.items():
        hit = next((a for a in aliases if a in raw.columns), None)
        cols.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(name))
    return raw.select(*cols)


def in_region(df: DataFrame, position: str, start: int, end: int) -> DataFrame:
    return df.withColumn(position, P.to_int(F.col(position))).filter(F.col(position).between(start, end))


def read_comment_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """TSV with ``#`` comment lines and header rows; headers may repeat across part files."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).options(sep="\t", comment="#").csv(path)
    return raw.filter(F.col(f"`{columns[0]}`") != columns[0])


def protein_token(df: DataFrame, token: str, residues: DataFrame) -> DataFrame:
    """Split ``A1V`` into three-letter residues and a position."""
    one = residues.select("one", "aa")
    t = F.col(token)
    out = df.withColumn("_r", F.substring(t, 1, 1)).withColumn("_a", F.right(t, F.lit(1))).withColumn(
        "aa_pos", F.substr(t, F.lit(2), F.length(t) - 2).try_cast("bigint"))
    r, a = one.select(F.col("one").alias("_r"), F.col("aa").alias("_r3")), one.select(F.col("one").alias("_a"), F.col("aa").alias("_a3"))
    return (out.join(r, "_r", "left").join(a, "_a", "left").withColumn("aa_ref", F.coalesce("_r3", "_r"))
            .withColumn("aa_alt", F.coalesce("_a3", "_a")).drop("_r", "_a", "_r3", "_a3"))


def read_by_header(spark: SparkSession, path: str, header_prefix: str, wanted: dict[str, str], sep: str = "\t") -> DataFrame:
    """Delimited text (also gzip) whose columns are found by header name.

    Rows too short for any wanted column are dropped, repeated header rows too.
    Only the one header line reaches the driver.
    """
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith(header_prefix)).limit(1).collect()
    if not head:
        raise ValueError(f"no header line starting with {header_prefix!r} in {path}")
    index = {name: i for i, name in enumerate(head[0]["value"].strip().split(sep))}
    missing = [h for h in wanted.values() if h not in index]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    need = max(index[h] for h in wanted.values()) + 1
    parts = lines.filter(~F.col("value").startswith(header_prefix)).select(
        F.explode(F.array(F.split("value", sep))).alias("p")).filter(F.size("p") >= need)
    return parts.select(*[F.trim(F.col("p")[index[h]]).alias(n) for n, h in wanted.items()])


def read_founders(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Founder documents ``{"mutations": [...]}`` to one row per entry, alternative keys merged."""
    entry = ("gene string, hgvs_c string, hgvs_cdna string, hgvs_p string, type string, mutation_type string, "
             "common_name string, population string, frequency_kz double, estimated_frequency double, notes string, "
             "source string, clinvar_id string, pathogenicity string, cdna_pos bigint")
    doc = spark.read.schema(f"mutations array<struct<{', '.join(c.replace(' ', ':', 1) for c in entry.split(', '))}>>, doc_id bigint")
    rows = doc.json(path, multiLine=multi_line).select("doc_id", F.posexplode("mutations").alias("ord", "m"))
    m = F.col("m")
    out = rows.select(
        "doc_id", "ord", F.upper(m["gene"]).alias("gene"), F.coalesce(m["hgvs_c"], m["hgvs_cdna"]).alias("hgvs_c"),
        F.coalesce(m["frequency_kz"], m["estimated_frequency"]).alias("frequency"),
        F.coalesce(m["common_name"], m["hgvs_c"], m["hgvs_cdna"]).alias("name"),
        F.coalesce(m["population"], F.lit("Kazakh")).alias("population"), F.coalesce(m["notes"], m["source"], F.lit("")).alias("source"),
        F.coalesce(m["type"], m["mutation_type"], F.lit("")).alias("mutation_type"), m["clinvar_id"].alias("clinvar_id"))
    return out.filter((F.coalesce("gene", F.lit("")) != "") & (F.coalesce("hgvs_c", F.lit("")) != ""))


def nested_hit(json: Column) -> dict[str, Column]:
    """Columns of an annotation hit whose levels may be scalar, list or object; the
    first element of a list wins. The text is parsed once into a variant value."""
    v = F.try_parse_json(json)

    def pick(kind: str, *paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])

    roots = ("$.dbnsfp[0]", "$.dbnsfp")
    aas = [f"{r}{a}" for r in roots for a in (".aa[0]", ".aa")]
    return {
        "positions": F.coalesce(*[F.try_variant_get(v, f"{a}.pos", "array<bigint>") for a in aas],
                                F.array_compact(F.array(pick("bigint", *[f"{a}.pos" for a in aas])))),
        "aa_ref": pick("string", *[f"{a}.ref" for a in aas]), "aa_alt": pick("string", *[f"{a}.alt" for a in aas]),
        "revel": pick("double", *[f"{r}.revel{s}" for r in roots for s in (".score[0]", ".score", "[0]", "")]),
        "bayesdel": pick("double", *[f"{r}.bayesdel{s}" for r in roots for s in (".add_af.score", ".add_af", "")]),
        "cadd_phred": pick("double", "$.cadd.phred", "$.cadd"),
    }


def read_hits(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Annotation hits from text of an id, a tab and the hit's JSON: id and the columns of ``nested_hit``."""
    parts = F.split("value", "\t", 2)
    lines = spark.read.text(path).select(parts[0].alias("id"), parts[1].alias("hit"))
    return lines.select("id", *[c.alias(n) for n, c in nested_hit(F.col("hit")).items()])


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """CA atoms of fixed-width structure text: resnum, x, y, z and confidence."""
    lines = spark.read.text(path)

    def cut(start: int, end: int) -> Column:
        return F.trim(F.substring("value", start, end - start + 1))

    ca = F.col("value").startswith("ATOM") & (cut(13, 16) == "CA")
    extra = [c for c in lines.columns if c != "value"]
    return lines.filter(ca).select(
        *extra, cut(23, 26).try_cast("bigint").alias("resnum"), *[cut(a, b).try_cast("double").alias(n) for n, a, b in (
            ("x", 31, 38), ("y", 39, 46), ("z", 47, 54), ("plddt", 61, 66))])


def supported_genes() -> list[str]:
    return [g[0] for g in K.GENES]
