"""Scalar rules as Column builders: tiers, labels, clips and bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from helixframe import constants as K


def risk_tier(p: Column) -> Column:
    """Five risk tiers; all bounds are strict."""
    b = K.RISK_BOUNDS
    return (F.when(p > b["pathogenic"], "pathogenic").when(p > b["likely_pathogenic"], "likely_pathogenic")
            .when(p < b["benign"], "benign").when(p < b["likely_benign"], "likely_benign")
            .otherwise("uncertain"))


def reclassify(p: Column) -> Column:
    """Class of an uncertain variant after scoring."""
    r = K.RECLASS
    return (F.when(p >= r["LP"], "Likely Pathogenic").when(p >= r["PP"], "Possibly Pathogenic")
            .when(p < r["LB"], "Likely Benign").when(p < r["PB"], "Possibly Benign")
            .otherwise("Uncertain (Remains VUS)"))


def reliability_tier(auc: Column) -> Column:
    return (F.when(auc >= 0.90, "HIGH confidence").when(auc >= 0.75, "MODERATE confidence")
            .when(auc >= 0.65, "LOW confidence").otherwise("UNRELIABLE"))


def clip(p: Column, bounds: tuple[float, float]) -> Column:
    lo, hi = bounds
    return F.least(F.greatest(p, F.lit(lo)), F.lit(hi))


def significance_label(text: Column) -> Column:
    """1 / 0 / NULL from a free-text significance."""
    t = F.lower(text)
    path, ben = t.contains("pathogenic"), t.contains("benign")
    return F.when(path & ~ben, 1).when(ben & ~path, 0)


def source_labels(phylop: Column, assay: Column, substitution: Column, evolution: Column) -> dict[str, Column]:
    """Display band per annotation source; a missing score reads ``No data``."""
    lo_a, hi_a = K.SCORE_BANDS["assay"]
    lo_s, hi_s = K.SCORE_BANDS["substitution_model"]
    return {
        "phylop_label": F.when(phylop > 7.0, "Ultra-conserved").when(phylop > 4.0, "Conserved").otherwise("Variable"),
        "assay_label": (F.when(assay.isNull(), "No data").when(assay < lo_a, "Abnormal")
                        .when(assay > hi_a, "Normal").otherwise("Intermediate")),
        "substitution_label": (F.when(substitution.isNull(), "No data").when(substitution > hi_s, "Pathogenic")
                               .when(substitution < lo_s, "Benign").otherwise("Ambiguous")),
        "evolution_label": (F.when(evolution.isNull(), "No data").when(evolution > 0.5, "Pathogenic")
                            .otherwise("Benign")),
    }


def uncertainty_label(width: Column) -> Column:
    return (F.when(width < 0.10, "High Confidence").when(width < 0.25, "Moderate Confidence")
            .otherwise("Low Confidence"))


def widen_interval(lower: Column, upper: Column, widen: Column, factor: float = K.CI_WIDEN) -> dict[str, Column]:
    """Widen an interval about its centre where ``widen`` holds, clipped to [0, 1]."""
    centre, half = (lower + upper) / 2, (upper - lower) / 2
    lo = F.when(widen, clip(centre - half * factor, (0.0, 1.0))).otherwise(lower)
    hi = F.when(widen, clip(centre + half * factor, (0.0, 1.0))).otherwise(upper)
    return {"ci_lower": lo, "ci_upper": hi}


def ood_warnings(af: Column, ba1: Column, aa_pos: Column, aa_length: Column, zero_embedding: Column) -> Column:
    """Names of the out-of-distribution warnings that apply."""
    return F.array_compact(F.array(
        F.when(zero_embedding, "zero_embedding"),
        F.when(aa_pos > aa_length * 0.98, "c_terminal"),
        F.when(af > ba1, "common_variant"),
    ))


def is_truncating(aa_alt: Column, mutation: Column) -> Column:
    m = F.lower(mutation)
    tokens = reduce(lambda a, b: a | b, [m.contains(t.lower()) for t in K.VARIANT_TYPE_TOKENS])
    return aa_alt.isin(K.TRUNCATING_ALT) | tokens


def is_start_loss(aa_pos: Column, aa_ref: Column, aa_alt: Column) -> Column:
    met = ["Met", "M"]
    return (aa_pos == 1) & aa_ref.isin(met) & ~aa_alt.isin(met)


def support_level(nearby: Column) -> Column:
    return F.when(nearby > 100, "HIGH").when(nearby >= 10, "MODERATE").otherwise("LOW")


def impact_band(delta: Column, minimal: float = 0.005, moderate: float = 0.02) -> Column:
    d = F.abs(delta)
    return (F.when(d < minimal, "minimal_impact").when(d < moderate, "moderate_impact")
            .otherwise("significant_impact"))


def width_band(width: Column) -> Column:
    return F.when(width < 0.10, "NARROW").when(width < 0.20, "MODERATE").otherwise("WIDE")


def frequency_code(af: Column, ba1: Column, bs1: Column) -> Column:
    """Single frequency code of an allele frequency; NULL between 0 and bs1."""
    return F.when(af > ba1, "BA1").when(af > bs1, "BS1").when(af == 0, "PM2")


def ancestry(populations: dict[str, Column]) -> Column:
    """Population of the strictly greatest frequency, first in the given order on ties."""
    best = F.greatest(*populations.values())
    out = F.when(best <= 0, "NO_DATA")
    for name, col in populations.items():
        out = out.when(col == best, name)
    return out.otherwise("NO_DATA")
