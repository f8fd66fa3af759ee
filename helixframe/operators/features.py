"""Model features as projections over annotated variants.

Each ``add_*`` function appends one feature family; ``feature_vector`` chains
them and returns the columns in their fixed order.  Missing annotations stay
NULL until the projection, where one ``coalesce`` per column applies the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from helixframe import constants as K
from helixframe.operators import domains as D

N_COMPONENTS = 20


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def _num(col: Column, default: float = 0.0) -> Column:
    return F.coalesce(col.cast("double"), F.lit(default))


def add_relative(df: DataFrame, genes: DataFrame) -> DataFrame:
    g = genes.select("gene", F.col("cds_length").alias("_cds"), F.col("aa_length").alias("_aa"))
    return (df.join(g, "gene", "left").withColumn("relative_cdna_pos", F.col("cdna_pos") / F.col("_cds"))
            .withColumn("relative_aa_pos", F.col("aa_pos") / F.col("_aa")).drop("_cds", "_aa"))


def add_substitution(df: DataFrame, scores: DataFrame, residues: DataFrame) -> DataFrame:
    """Substitution score and residue physics (volume, hydropathy, charge class)."""
    s = scores.select("aa_ref", "aa_alt", F.col("blosum62_score").alias("_s"))
    r = residues.select(F.col("aa").alias("aa_ref"), *[F.col(c).alias(f"_r_{c}") for c in ("volume", "hydro", "charge")])
    a = residues.select(F.col("aa").alias("aa_alt"), *[F.col(c).alias(f"_a_{c}") for c in ("volume", "hydro", "charge")])
    out = df.join(s, ["aa_ref", "aa_alt"], "left").join(r, "aa_ref", "left").join(a, "aa_alt", "left")
    ref, alt = F.col("aa_ref"), F.col("aa_alt")
    score = (F.when(ref == alt, K.SCORE_SAME).when((ref == "Ter") | (alt == "Ter"), K.SCORE_STOP)
             .otherwise(F.coalesce(F.col("_s"), F.lit(K.SCORE_UNKNOWN))))
    rc, ac = F.coalesce(F.col("_r_charge"), F.lit("other")), F.coalesce(F.col("_a_charge"), F.lit("other"))
    rh, ah = _num(F.col("_r_hydro")), _num(F.col("_a_hydro"))
    return out.withColumns({
        "blosum62_score": score.cast("double"),
        "volume_diff": _num(F.abs(F.col("_r_volume") - F.col("_a_volume"))),
        "hydro_diff": F.abs(rh - ah), "ref_hydro": rh, "alt_hydro": ah, "hydro_delta": ah - rh,
        "charge_change": _flag(rc != ac),
        "nonpolar_to_charged": _flag((rc == "nonpolar") & ac.isin("positive", "negative")),
    }).drop("_s", *[f"_{p}_{c}" for p in "ra" for c in ("volume", "hydro", "charge")])


def add_domains(df: DataFrame, domain_table: DataFrame, candidates: DataFrame, genes: DataFrame) -> DataFrame:
    """Generic flags, hit counts, nearest distance and zone score (needs blosum62_score)."""
    out = D.add_flags(D.with_domains(df, domain_table), D.flag_ranges(domain_table, candidates))
    out = out.join(genes.select("gene", F.col("aa_length").alias("_aa")), "gene", "left")
    d, p = F.col("domains"), F.col("aa_pos")
    out = out.withColumns({
        "dist_nearest_domain": D.nearest_distance(d, p, F.col("_aa")),
        "n_domains_hit": D.count_hits(d, p),
        "functional_zone_score": D.zone_score(d, p),
    })
    return out.withColumns({
        "in_multi_domain": _flag(F.col("n_domains_hit") > 1),
        "func_zone_x_blosum": F.col("functional_zone_score") * F.col("blosum62_score"),
    }).drop("domains", "_aa")


def add_substitution_class(df: DataFrame) -> DataFrame:
    transition = F.col("mutation").isin(K.TRANSITIONS)
    return df.withColumns({"is_nonsense": _flag(F.col("aa_alt") == "Ter"), "is_transition": _flag(transition),
                           "is_transversion": _flag(~transition)})


def add_conservation(df: DataFrame, phylop: Column) -> DataFrame:
    p = _num(phylop)
    out = {"phylop_score": p, "high_conservation": _flag(p > 4.0), "ultra_conservation": _flag(p > 7.0),
           "conserv_x_blosum": p * F.col("blosum62_score")}
    if "functional_zone_score" in df.columns:
        out["func_zone_x_phylop"] = F.col("functional_zone_score") * p
    return df.withColumns(out)


def add_functional(df: DataFrame, assay: Column) -> DataFrame:
    m = _num(assay)
    return df.withColumns({"mave_score": m, "has_mave": _flag(m != 0.0), "mave_abnormal": _flag(m.between(0.01, 1.49)),
                           "mave_x_blosum": m * F.col("blosum62_score")})


def add_models(df: DataFrame, am: Column | None = None, eve: Column | None = None) -> DataFrame:
    out: dict[str, Column] = {}
    for name, score, cut in (("am", am, 0.564), ("eve", eve, 0.5)):
        if score is not None:
            s = _num(score)
            out |= {f"{name}_score": s, f"{name}_pathogenic": _flag(s > cut), f"{name}_x_phylop": s * F.col("phylop_score")}
    return df.withColumns(out)


def add_structure(df: DataFrame, rsa: Column, bfactor: Column, dist_dna: Column, dist_palb2: Column,
                  dna_contact: Column, ss: Column) -> DataFrame:
    r = _num(rsa, K.DEFAULT_RSA)
    buried, contact = _flag(r < K.BURIED_RSA), _flag(dna_contact)
    b = F.col("blosum62_score")
    return df.withColumns({
        "rsa": r, "is_buried": buried, "bfactor": _num(bfactor, K.DEFAULT_BFACTOR),
        "dist_dna": _num(dist_dna, K.DISTANCE_UNKNOWN), "dist_palb2": _num(dist_palb2, K.DISTANCE_UNKNOWN),
        "is_dna_contact": contact, "ss_helix": _flag(ss.isin(K.HELIX_CODES)), "ss_sheet": _flag(ss.isin(K.SHEET_CODES)),
        "buried_x_blosum": buried * b, "dna_contact_x_blosum": contact * b,
    })


def add_frequency(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``columns``: gnomad_af, gnomad_popmax_af and gnomad_af_{afr,amr,eas,nfe}."""
    af, popmax = _num(columns["gnomad_af"]), _num(columns["gnomad_popmax_af"])
    return df.withColumns({
        **{n: _num(c) for n, c in columns.items()},
        "gnomad_af_log": F.log10(af + 1e-8), "gnomad_popmax_log": F.log10(popmax + 1e-8),
        "is_rare": _flag(af < 0.001), "is_popmax_rare": _flag(popmax < 0.001),
        "af_x_blosum": af * F.col("blosum62_score"),
    })


def add_splice(df: DataFrame, score: Column) -> DataFrame:
    s = _num(score)
    return df.withColumns({"spliceai_score": s, "splice_pathogenic": _flag(s > 0.5)})


def add_embedding(df: DataFrame, cosine: Column, l2: Column, components: Column) -> DataFrame:
    """Similarity, shift and the first 20 components as columns, 0 where absent."""
    return df.withColumns({
        "esm2_cosine_sim": _num(cosine), "esm2_l2_shift": _num(l2),
        **{f"esm2_pca_{i}": _num(F.try_element_at(components, F.lit(i + 1))) for i in range(N_COMPONENTS)}})


def onehot_columns() -> dict[str, tuple[str, str]]:
    """Indicator column name -> (source column, value)."""
    return {
        **{f"Mutation_{m}": ("mutation", m) for m in K.MUTATIONS},
        **{f"AA_ref_{a}": ("aa_ref", a) for a in K.ONEHOT_RESIDUES},
        **{f"AA_alt_{a}": ("aa_alt", a) for a in K.ONEHOT_RESIDUES},
    }


def add_onehot(df: DataFrame) -> DataFrame:
    return df.withColumns({n: _flag(F.col(c) == v) for n, (c, v) in onehot_columns().items()})


def decode_onehot(prefix: str, values: Sequence[str] = tuple(K.ONEHOT_RESIDUES)) -> Column:
    """Residue whose indicator is 1, the first in order; NULL when none is."""
    return F.coalesce(*[F.when(F.col(f"{prefix}_{v}") == 1, v) for v in values])


def restore_position(relative: Column, aa_length: Column) -> Column:
    """Position from its relative value; halves round to even."""
    return F.bround(relative * aa_length).cast("bigint")


# --- fixed values: names and order of the feature vector ----------------------
FEATURE_ORDER = [
    "cDNA_pos", "AA_pos", "relative_cdna_pos", "relative_aa_pos", "blosum62_score",
    "volume_diff", "hydro_diff", "ref_hydro", "alt_hydro", "hydro_delta",
    *K.DOMAIN_FLAGS,
    "is_nonsense", "is_transition", "is_transversion", "charge_change", "nonpolar_to_charged",
    "phylop_score", "high_conservation", "ultra_conservation", "conserv_x_blosum",
    "mave_score", "has_mave", "mave_abnormal", "mave_x_blosum",
    "dist_nearest_domain", "n_domains_hit", "in_multi_domain", "functional_zone_score",
    "func_zone_x_blosum", "func_zone_x_phylop",
    "rsa", "is_buried", "bfactor", "dist_dna", "dist_palb2", "is_dna_contact", "ss_helix", "ss_sheet",
    "buried_x_blosum", "dna_contact_x_blosum",
    "gnomad_af", "gnomad_popmax_af", "gnomad_af_afr", "gnomad_af_amr", "gnomad_af_eas", "gnomad_af_nfe",
    "gnomad_af_log", "gnomad_popmax_log", "is_rare", "is_popmax_rare", "af_x_blosum",
    "spliceai_score", "splice_pathogenic", "esm2_cosine_sim", "esm2_l2_shift",
    *[f"esm2_pca_{i}" for i in range(N_COMPONENTS)], *onehot_columns(),
    "eve_score", "eve_pathogenic", "eve_x_phylop",
]


def feature_vector(df: DataFrame, dims: dict[str, DataFrame], ann: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """All features in their fixed order. ``ann`` names the annotation columns of ``df``;
    absent ones (NULL literals) take the defaults. Rows with position < 1 get zeros."""
    null = F.lit(None).cast("double")
    a = {n: ann.get(n, null) for n in ("phylop", "assay", "eve", "rsa", "bfactor", "dist_dna", "dist_palb2", "splice",
                                       "cosine", "l2")}
    out = add_relative(df, dims["genes"])
    out = add_substitution(out, dims["blosum62"], dims["residues"])
    out = add_domains(out, dims["domains"], dims["domain_candidates"], dims["genes"])
    out = add_substitution_class(out)
    out = add_conservation(out, a["phylop"])
    out = add_functional(out, a["assay"])
    out = add_models(out, eve=a["eve"])
    out = add_structure(out, a["rsa"], a["bfactor"], a["dist_dna"], a["dist_palb2"],
                        ann.get("dna_contact", F.lit(False)), ann.get("ss", F.lit("C")))
    af = ann.get("gnomad_af", null)
    out = add_frequency(out, {
        "gnomad_af": af, "gnomad_popmax_af": ann.get("gnomad_popmax_af", af),
        **{f"gnomad_af_{p}": ann.get(f"gnomad_af_{p}", null) for p in ("afr", "amr", "eas", "nfe")}})
    out = add_splice(out, a["splice"])
    out = add_embedding(out, a["cosine"], a["l2"], ann.get("components", F.array().cast("array<double>")))
    out = add_onehot(out).withColumn("cDNA_pos", F.col("cdna_pos")).withColumn("AA_pos", F.col("aa_pos"))
    valid = F.col("aa_pos") >= 1
    return out.select(*keep, *[F.when(valid, F.col(f"`{c}`")).otherwise(F.lit(0)).alias(c) for c in FEATURE_ORDER])


def coverage(columns: Sequence[str]) -> Column:
    """Number of non-zero features of a row."""
    return F.size(F.filter(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]), lambda x: x != 0))


def all_zero(columns: Sequence[str]) -> Column:
    return F.forall(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]), lambda x: x == 0)


def frequency_independence(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Counts of frequency-dependent and independent features and the independent
    share of the non-zero values, from the wide table in one pass."""
    dependent = [c for c in features if c in K.FREQUENCY_FEATURES]
    independent = [c for c in features if c not in K.FREQUENCY_FEATURES]
    def nonzero(names: Sequence[str]) -> Column:
        return sum((F.when(F.col(f"`{c}`") != 0, 1).otherwise(0) for c in names), F.lit(0))

    # counted within the row first: two sums travel, not two counters for every column
    rows = df.select(*by, nonzero(independent).alias("_independent"), nonzero(dependent).alias("_dependent"))
    kept, other = F.sum("_independent"), F.sum("_dependent")
    return rows.groupBy(*by).agg(
        F.lit(len(features)).cast("bigint").alias("total_features"),
        F.lit(len(dependent)).cast("bigint").alias("frequency_dependent"),
        F.lit(len(independent)).cast("bigint").alias("frequency_independent"),
        F.round(100.0 * kept / (kept + other), 6).alias("pct_independent"))
