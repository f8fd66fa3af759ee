"""Text parsing as Column builders: VCF fields, protein and cDNA notation, score lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from helixframe import constants as K

_CHROM = r"^([1-9]|1[0-9]|2[0-2]|[XxYy]|[Mm][Tt]?)$"
_INT = r"^\s*[+-]?\d+\s*$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def to_int(text: Column) -> Column:
    """Whole-number text to BIGINT, anything else to NULL."""
    return F.when(text.rlike(_INT), F.trim(text).try_cast("bigint"))


def to_double(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def field(parts: Column, i: int) -> Column:
    """Zero-based element or NULL."""
    return F.try_element_at(parts, F.lit(i + 1))


def chromosome(text: Column) -> Column:
    """Lower-case, every ``chr`` removed; NULL unless 1-22, X, Y, M or MT."""
    name = F.replace(F.lower(text), F.lit("chr"), F.lit(""))
    return F.when(name.rlike(_CHROM), name)


def sample_value(fmt: Column, sample: Column, key: str) -> Column:
    """Value of a FORMAT key in a sample field, NULL where either is short."""
    at = F.array_position(F.split(fmt, ":"), key)
    return F.when(at > 0, F.try_element_at(F.split(sample, ":"), at.cast("int")))


def amino_change(text: Column) -> Column:
    """Struct (ref, pos, alt) of the first ``p.RefPosAlt``; ``*`` reads as Ter."""
    pattern = r"p\.([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2}|\*)"
    alt = F.regexp_extract(text, pattern, 3)
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", F.struct(
        hit.alias("ref"), F.regexp_extract(text, pattern, 2).try_cast("bigint").alias("pos"),
        F.when(alt == "*", "Ter").otherwise(alt).alias("alt")))


def is_missense(change: Column) -> Column:
    """Both residues standard, different and no stop."""
    return F.coalesce(change["ref"].isin(K.STANDARD_RESIDUES) & change["alt"].isin(K.STANDARD_RESIDUES)
                      & (change["ref"] != change["alt"]), F.lit(False))


def cdna_position(text: Column) -> Column:
    """Number after ``c.``, NULL when absent."""
    return F.regexp_extract(text, r"c\.(\d+)", 1).try_cast("bigint")


def mutant_token(text: Column) -> Column:
    """Struct (ref, pos, alt) of a one-letter token such as ``M1361L``; NULL for
    multi-mutants, malformed tokens and unchanged residues."""
    pattern = r"^([A-Z])(\d+)([A-Z*])$"
    ref, alt = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 3)
    return F.when((ref != "") & (ref != alt), F.struct(
        ref.alias("ref"), F.regexp_extract(text, pattern, 2).try_cast("bigint").alias("pos"), alt.alias("alt")))


def _parts(text: Column) -> Column:
    return F.transform(F.split(text, ";"), lambda p: F.trim(p))


def first_score(text: Column) -> Column:
    """First parseable number of a ``;`` list; ``.``, ``NA`` and blanks are missing."""
    numbers = F.transform(F.filter(_parts(text), lambda p: ~p.isin("", ".", "NA")), lambda p: p.try_cast("double"))
    return F.try_element_at(F.filter(numbers, lambda x: x.isNotNull()), F.lit(1))


def first_position(text: Column) -> Column:
    """First positive whole number of a ``;`` list."""
    numbers = F.transform(_parts(text), lambda p: to_int(p))
    return F.try_element_at(F.filter(numbers, lambda x: x > 0), F.lit(1))


def genomic_id(text: Column) -> Column:
    """``chr-pos-ref-alt`` to a struct with the first error, NULL error when valid."""
    p = F.split(text, "-")
    error = (F.when(F.size(p) != 4, "Expected format: chr-pos-ref-alt")  # fixed values: texts of the identifier check
             .when(~field(p, 0).rlike(_CHROM), "Invalid chromosome in variant")
             .when(~field(p, 1).rlike(r"^\d+$"), "Invalid position in variant")
             .when(~field(p, 2).rlike("^[ACGT]+$"), "Invalid ref allele in variant")
             .when(~field(p, 3).rlike("^[ACGT]+$"), "Invalid alt allele in variant"))
    return F.struct(field(p, 0).alias("chrom"), field(p, 1).try_cast("bigint").alias("pos"),
                    field(p, 2).alias("ref"), field(p, 3).alias("alt"), error.alias("error"))


def title_case(code: Column) -> Column:
    """First letter upper, rest lower, for codes of two letters and more."""
    return F.when(F.length(code) >= 2, F.concat(F.upper(F.substring(code, 1, 1)), F.lower(F.substr(code, F.lit(2)))))\
        .otherwise(code)


def clean_text(text: Column, limit: int = 100) -> Column:
    """Keep word characters, blanks, ``-`` and ``.``; trim; cut to the field's length."""
    return F.left(strip(F.regexp_replace(text, r"(?U)[^\w\s\-\.]", "")), F.lit(limit))


def single_base_alleles(alleles: Column) -> Column:
    """Struct (ref, alt) of an ``A/G`` text, NULL unless two single bases."""
    p = F.split(alleles, "/")
    return F.when((F.size(p) == 2) & (F.length(field(p, 0)) == 1) & (F.length(field(p, 1)) == 1),
                  F.struct(field(p, 0).alias("ref"), field(p, 1).alias("alt")))
