"""Evidence codes per variant and their combination into five classes.

``evidence_rules`` returns, per code, a condition and a rationale; the caller
chooses whether to build only the code list (cheap) or the full map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe import constants as K

Rules = dict[str, tuple[Column, Column]]


def is_underrepresented(population: Column) -> Column:
    return F.coalesce(F.lower(population).isin(K.UNDERREPRESENTED), F.lit(False))


def population_af(population: Column, af_global: Column, by_code: dict[str, Column]) -> Column:
    """Frequency column to judge by: the stated population, the EAS proxy for
    under-represented ones, else global. Codes without a column fall back to global."""
    p = F.lower(population)
    out = F.when(is_underrepresented(population), by_code.get("eas", af_global))
    for code, col in by_code.items():
        out = out.when(p == code, col)
    return out.otherwise(af_global)


def population_label(population: Column, known: list[str]) -> Column:
    return (F.when(is_underrepresented(population), "Kazakh (EAS proxy)")
            .when(F.lower(population).isin(known), F.upper(population)).otherwise("global"))


def _percent(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def frequency_rules(af: Column, gene: Column, ba1: Column, bs1: Column,
                    sparse: Column | None = None, label: Column | None = None) -> Rules:
    sparse = F.lit(False) if sparse is None else sparse
    label = F.lit("global") if label is None else label
    factor = F.when(sparse, K.SPARSE_MULTIPLIER).otherwise(1.0)
    ba1, bs1 = ba1 * factor, bs1 * factor
    note = F.when(sparse, " (threshold relaxed for underrepresented population)").otherwise("")
    return {
        "PM2_insufficient": ((af == 0) & sparse, F.concat(
            F.lit("Absent from population database ("), label,
            F.lit(" AF = 0), but the population is insufficiently represented; PM2 withheld"))),
        "PM2": ((af == 0) & ~sparse, F.concat(
            F.lit("Variant absent from population database ("), label, F.lit(" AF = 0)"))),
        "BA1": (af > ba1, F.concat(
            F.lit("Allele frequency ("), _percent(af, 3), F.lit(", "), label,
            F.lit(") exceeds stand-alone benign threshold ("), _percent(ba1, 1), F.lit(") for "), gene, note)),
        "BS1": ((af > bs1) & ~(af > ba1), F.concat(
            F.lit("Population frequency ("), _percent(af, 4), F.lit(", "), label,
            F.lit(") exceeds threshold ("), _percent(bs1, 3), F.lit(") for "), gene, note)),
    }


def structure_rules(dist_dna: Column, dist_palb2: Column, critical: Column) -> Rules:
    near_dna = (dist_dna <= K.PM1_DISTANCE) & (dist_dna != K.DISTANCE_UNKNOWN)
    near_partner = (dist_palb2 <= K.PM1_DISTANCE) & (dist_palb2 != K.DISTANCE_UNKNOWN)
    reasons = F.array_join(F.array_compact(F.array(
        F.when(near_dna, F.concat(F.lit("within "), dist_dna.cast("string"), F.lit("A of DNA binding interface"))),
        F.when(near_partner, F.concat(F.lit("within "), dist_palb2.cast("string"),
                                      F.lit("A of primary interaction interface"))),
        F.when(critical, "inside a critical functional repeat or domain"),
    )), " & ")
    return {"PM1": (near_dna | near_partner | critical, F.concat(F.lit("Structural disruption: "), reasons))}


def founder_text(population: Column, frequency: Column, source: Column) -> Column:
    """Rationale of a founder mutation with its population, frequency among the affected and source."""
    return F.concat(F.lit("Known "), F.coalesce(population, F.lit("regional")), F.lit(" founder mutation, found in "),
                    F.when(frequency.isNull(), "an unknown share").otherwise(_percent(frequency, 1)), F.lit(" of affected individuals, more than in controls ("),
                    F.coalesce(source, F.lit("published literature")), F.lit(")"))


def known_rules(same_change: Column, same_position: Column, founder: Column, founder_reason: Column | None = None) -> Rules:
    return {
        "PS1": (same_change, F.lit("Same amino acid change as an established pathogenic variant")),
        "PM5": (same_position & ~same_change,
                F.lit("Different pathogenic missense variant established at this position")),
        "PS4": (founder, F.lit("Known founder mutation; prevalence in cases exceeds controls") if founder_reason is None else founder_reason),
    }


def null_rules(is_nonsense: Column, is_frameshift: Column, exon_number: Column, total_exons: Column,
               near_last_boundary: Column, canonical_splice: Column) -> Rules:
    null = is_nonsense | is_frameshift
    kind = F.when(is_nonsense, "Nonsense").otherwise("Frameshift")
    informative = F.coalesce(exon_number.isNotNull() & (total_exons > 1), F.lit(False))
    last = informative & F.coalesce(exon_number == total_exons, F.lit(False))
    penultimate = informative & F.coalesce(exon_number == total_exons - 1, F.lit(False)) & near_last_boundary
    moderate = null & (last | penultimate)
    where = F.concat(F.lit(" (exon "), exon_number.cast("string"), F.lit("/"), total_exons.cast("string"), F.lit(")"))
    return {
        "PVS1_moderate": (moderate, F.concat(
            kind, F.when(last, " variant in last exon").otherwise(" variant in last 50nt of penultimate exon"),
            where, F.lit("; may escape nonsense-mediated decay"))),
        "PVS1": ((null & ~moderate) | (canonical_splice & ~null), F.when(
            null, F.concat(F.lit("Pathogenic truncating null variant ("), kind, F.lit(")")))
            .otherwise("Canonical splice site variant disrupting mRNA splicing")),
    }


def other_rules(is_inframe: Column, critical: Column, near_splice: Column, canonical_splice: Column,
                is_null: Column, is_synonymous: Column, probability: Column) -> Rules:
    p = F.format_string("%.3f", probability)
    return {
        "PM4": (is_inframe, F.when(critical, "In-frame indel within a known functional domain")
                .otherwise("In-frame indel outside known functional domain (reduced weight)")),
        "PP3_splice": (near_splice & ~(canonical_splice & ~is_null),
                       F.lit("Near splice site variant with potential splicing impact")),
        "BP7": (is_synonymous & ~near_splice & ~canonical_splice,
                F.lit("Synonymous variant with no predicted splice impact")),
        "PP3": (probability >= K.PP3_MIN, F.concat(F.lit("Model predicts pathogenicity (p="), p, F.lit(")"))),
        "BP4": ((probability <= K.BP4_MAX) & ~(probability >= K.PP3_MIN),
                F.concat(F.lit("Model predicts benign (p="), p, F.lit(")"))),
    }


_OPTIONAL_FLAGS = ("critical", "same_change", "same_position", "founder", "is_nonsense", "is_frameshift",
                   "is_inframe", "near_splice", "canonical_splice", "is_synonymous", "near_last_boundary")


def evidence_rules(af: Column, gene: Column, ba1: Column, bs1: Column, probability: Column,
                   dist_dna: Column | None = None, dist_palb2: Column | None = None,
                   exon_number: Column | None = None, total_exons: Column | None = None,
                   sparse: Column | None = None, label: Column | None = None, founder_reason: Column | None = None, **flags: Column) -> Rules:
    """All codes; flags not given are taken as false and distances as unknown."""
    unknown = set(flags) - set(_OPTIONAL_FLAGS)
    if unknown:
        raise TypeError(f"unknown flags: {sorted(unknown)}")
    f = {n: F.coalesce(flags[n].cast("boolean"), F.lit(False)) if n in flags else F.lit(False)
         for n in _OPTIONAL_FLAGS}
    far = F.lit(K.DISTANCE_UNKNOWN)
    dist_dna = far if dist_dna is None else F.coalesce(dist_dna, far)
    dist_palb2 = far if dist_palb2 is None else F.coalesce(dist_palb2, far)
    none = F.lit(None).cast("int")
    is_null = f["is_nonsense"] | f["is_frameshift"]
    return {
        **structure_rules(dist_dna, dist_palb2, f["critical"]),
        **known_rules(f["same_change"], f["same_position"], f["founder"], founder_reason),
        **frequency_rules(af, gene, ba1, bs1, sparse, label),
        **null_rules(f["is_nonsense"], f["is_frameshift"], none if exon_number is None else exon_number,
                     none if total_exons is None else total_exons, f["near_last_boundary"], f["canonical_splice"]),
        **other_rules(f["is_inframe"], f["critical"], f["near_splice"], f["canonical_splice"], is_null,
                      f["is_synonymous"], probability),
    }


def code_list(rules: Rules) -> Column:
    """Array of the codes that fire, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, (cond, _) in rules.items()]))


def evidence_map(rules: Rules) -> Column:
    """Map of code to rationale for the codes that fire."""
    return F.map_from_entries(F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(code), text)) for code, (cond, text) in rules.items()])))


def strength_counts(codes: Column) -> Column:
    """Struct of code counts per strength class."""
    return F.struct(*[
        F.size(F.array_intersect(codes, F.array(*map(F.lit, names)))).alias(k)
        for k, names in K.EVIDENCE_STRENGTH.items()])


def combine(counts: Column) -> Column:
    """Five-tier class from strength counts. Benign rules come first; the first match wins."""
    n = {k: counts[k] for k in K.EVIDENCE_STRENGTH}
    pvs, ps, pm, pp = (n[k] >= 1 for k in ("pvs", "ps", "pm", "pp"))
    pathogenic = (
        (pvs & (ps | (n["pm"] >= 2) | (pm & pp) | (n["pp"] >= 2)))
        | (n["ps"] >= 2)
        | (ps & ((n["pm"] >= 3) | ((n["pm"] >= 2) & (n["pp"] >= 2)) | (pm & (n["pp"] >= 4)))))
    likely = (
        (pvs & pm) | (ps & n["pm"].between(1, 2)) | (ps & (n["pp"] >= 2)) | (n["pm"] >= 3)
        | ((n["pm"] >= 2) & (n["pp"] >= 2)) | (pm & (n["pp"] >= 4)))
    return (F.when((n["ba"] >= 1) | (n["bs"] >= 2), "Benign")
            .when((n["bs"] >= 1) & (n["bp"] >= 1), "Likely Benign")
            .when(pathogenic, "Pathogenic").when(likely, "Likely Pathogenic")
            .otherwise("Uncertain Significance"))


def classify(df: DataFrame, codes: str = "codes", out: str = "acmg_class") -> DataFrame:
    return (df.withColumn("_strength", strength_counts(F.col(codes)))
            .withColumn(out, combine(F.col("_strength"))).drop("_strength"))


def class_to_binary(cls: Column) -> Column:
    """1 pathogenic side, 0 benign side, -1 unresolved."""
    return (F.when(cls.isin("Pathogenic", "Likely Pathogenic"), 1)
            .when(cls.isin("Benign", "Likely Benign"), 0).otherwise(-1))
