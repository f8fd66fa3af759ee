"""Feature projections over the variant views."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.operators import domains as D, features as FE, structure as S, vectors as VE
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query
from helixframe.session import compile_wide, materialise

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K4 = ", ".join(KEY)


def V(spark, sf):
    return view(spark, sf, "variants")


def subst(spark, sf, df=None):
    return FE.add_substitution(V(spark, sf) if df is None else df, view(spark, sf, "blosum62"), view(spark, sf, "residues"))


VB = "(SELECT v.*, CAST(b.blosum62_score AS DOUBLE) AS bl FROM variants v JOIN blosum62 b ON b.aa_ref = v.aa_ref AND b.aa_alt = v.aa_alt)"
PH = "CAST(aa_pos % 90 AS DOUBLE) / 10"
MAVE = "CASE WHEN aa_pos % 4 = 0 THEN NULL ELSE CAST(aa_pos % 300 AS DOUBLE) / 100 END"
EVE = "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE p_mlp END"


@query("feat_relative_pos", f"""
SELECT {K4}, round(cdna_pos / CAST(g.cds_length AS DOUBLE), 12) AS relative_cdna_pos, round(aa_pos / CAST(g.aa_length AS DOUBLE), 12) AS relative_aa_pos
FROM variants v JOIN genes g ON g.gene = v.gene""")
def feat_relative_pos(spark, sf):
    out = FE.add_relative(V(spark, sf), view(spark, sf, "genes"))
    return out.select(*KEY, *[F.round(c, 12).alias(c) for c in ("relative_cdna_pos", "relative_aa_pos")])


@query("feat_blosum62", f"SELECT {K4}, bl AS blosum62_score FROM {VB} v")
def feat_blosum62(spark, sf):
    return subst(spark, sf).select(*KEY, "blosum62_score")


@query("feat_aa_physics", f"""
SELECT {K4}, abs(r.volume - a.volume) AS volume_diff, round(abs(r.hydro - a.hydro), 9) AS hydro_diff, r.hydro AS ref_hydro, a.hydro AS alt_hydro,
  round(a.hydro - r.hydro, 9) AS hydro_delta, CASE WHEN r.charge <> a.charge THEN 1 ELSE 0 END AS charge_change,
  CASE WHEN r.charge = 'nonpolar' AND a.charge IN ('positive', 'negative') THEN 1 ELSE 0 END AS nonpolar_to_charged
FROM variants v JOIN residues r ON r.aa = v.aa_ref JOIN residues a ON a.aa = v.aa_alt""")
def feat_aa_physics(spark, sf):
    out = subst(spark, sf)
    return out.select(*KEY, "volume_diff", F.round("hydro_diff", 9).alias("hydro_diff"), "ref_hydro", "alt_hydro",
                      F.round("hydro_delta", 9).alias("hydro_delta"), "charge_change", "nonpolar_to_charged")


@query("feat_domain_flags", f"SELECT {K4}, {', '.join(K.DOMAIN_FLAGS)} FROM ev_in")
def feat_domain_flags(spark, sf):
    out = D.add_flags(V(spark, sf), D.flag_ranges(view(spark, sf, "domains"), view(spark, sf, "domain_candidates")))
    return out.select(*KEY, *K.DOMAIN_FLAGS)


def with_domain_features(spark, sf):
    return FE.add_domains(subst(spark, sf), view(spark, sf, "domains"), view(spark, sf, "domain_candidates"), view(spark, sf, "genes"))


@query("feat_domain_counts", f"""
SELECT {K4}, CAST(n AS INT) AS n_domains_hit, CASE WHEN n > 1 THEN 1 ELSE 0 END AS in_multi_domain FROM (
SELECT v.*, (SELECT count(*) FROM domains d WHERE d.gene = v.gene AND v.aa_pos BETWEEN d.start_aa AND d.end_aa) AS n FROM variants v) x""")
def feat_domain_counts(spark, sf):
    return with_domain_features(spark, sf).select(*KEY, "n_domains_hit", "in_multi_domain")


ZONE = """(SELECT gene, aa_pos, sum(CASE WHEN aa_pos BETWEEN start_aa AND end_aa THEN 1::DOUBLE ELSE 1 / (1 + least(abs(aa_pos - start_aa), abs(aa_pos - end_aa)) / 50.0::DOUBLE) END) AS z
  FROM (SELECT DISTINCT v.gene, v.aa_pos, d.name, d.start_aa, d.end_aa FROM variants v JOIN domains d ON d.gene = v.gene) q GROUP BY gene, aa_pos)"""


@query("feat_zone_score", f"""
SELECT {K4}, round(z.z, 9) AS functional_zone_score, round(z.z * v.bl, 9) AS func_zone_x_blosum, round(z.z * ({PH.replace('aa_pos', 'v.aa_pos')}), 9) AS func_zone_x_phylop
FROM {VB} v JOIN {ZONE} z ON z.gene = v.gene AND z.aa_pos = v.aa_pos""")
def feat_zone_score(spark, sf):
    out = FE.add_conservation(with_domain_features(spark, sf), F.expr(PH))
    return out.select(*KEY, *[F.round(c, 9).alias(c) for c in ("functional_zone_score", "func_zone_x_blosum", "func_zone_x_phylop")])


@query("feat_substitution_class", f"""
SELECT {K4}, CASE WHEN aa_alt = 'Ter' THEN 1 ELSE 0 END AS is_nonsense, CASE WHEN m IN ('A>G', 'G>A', 'C>T', 'T>C') THEN 1 ELSE 0 END AS is_transition,
  CASE WHEN m IN ('A>G', 'G>A', 'C>T', 'T>C') THEN 0 ELSE 1 END AS is_transversion FROM (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN 'N>N' ELSE mutation END AS m FROM variants) v""")
def feat_substitution_class(spark, sf):
    v = V(spark, sf).withColumn("mutation", F.expr("CASE WHEN l_partkey % 9 = 0 THEN 'N>N' ELSE mutation END"))
    return FE.add_substitution_class(v).select(*KEY, "is_nonsense", "is_transition", "is_transversion")


@query("feat_conservation", f"""
SELECT {K4}, p AS phylop_score, CASE WHEN p > 4 THEN 1 ELSE 0 END AS high_conservation, CASE WHEN p > 7 THEN 1 ELSE 0 END AS ultra_conservation,
  round(p * bl, 9) AS conserv_x_blosum FROM (SELECT *, {PH} AS p FROM {VB} v) x""")
def feat_conservation(spark, sf):
    out = FE.add_conservation(subst(spark, sf), F.expr(PH))
    return out.select(*KEY, "phylop_score", "high_conservation", "ultra_conservation", F.round("conserv_x_blosum", 9).alias("conserv_x_blosum"))


@query("feat_functional", f"""
SELECT {K4}, m AS mave_score, CASE WHEN m <> 0 THEN 1 ELSE 0 END AS has_mave, CASE WHEN m BETWEEN 0.01::DOUBLE AND 1.49::DOUBLE THEN 1 ELSE 0 END AS mave_abnormal,
  round(m * bl, 9) AS mave_x_blosum FROM (SELECT *, coalesce({MAVE}, 0) AS m FROM {VB} v) x""")
def feat_functional(spark, sf):
    out = FE.add_functional(subst(spark, sf), F.expr(MAVE))
    return out.select(*KEY, "mave_score", "has_mave", "mave_abnormal", F.round("mave_x_blosum", 9).alias("mave_x_blosum"))


@query("feat_am_eve", f"""
SELECT {K4}, p_tree AS am_score, CASE WHEN p_tree > 0.564::DOUBLE THEN 1 ELSE 0 END AS am_pathogenic, round(p_tree * ({PH}), 9) AS am_x_phylop,
  e AS eve_score, CASE WHEN e > 0.5::DOUBLE THEN 1 ELSE 0 END AS eve_pathogenic, round(e * ({PH}), 9) AS eve_x_phylop
FROM (SELECT *, coalesce({EVE}, 0) AS e FROM variants) v""")
def feat_am_eve(spark, sf):
    v = V(spark, sf).withColumn("phylop_score", F.expr(PH))
    out = FE.add_models(v, F.col("p_tree"), F.expr(EVE))
    return out.select(*KEY, "am_score", "am_pathogenic", F.round("am_x_phylop", 9).alias("am_x_phylop"), "eve_score", "eve_pathogenic",
                      F.round("eve_x_phylop", 9).alias("eve_x_phylop"))


STRUCT = {
    "rsa": "CASE WHEN aa_pos % 6 = 0 THEN NULL ELSE CAST(aa_pos % 100 AS DOUBLE) / 100 END",
    "bfactor": "CASE WHEN aa_pos % 6 = 0 THEN NULL ELSE CAST(aa_pos % 77 AS DOUBLE) END",
    "dist_dna": "CASE WHEN aa_pos % 7 = 0 THEN NULL ELSE CAST(aa_pos % 40 AS DOUBLE) / 4 END",
    "dist_palb2": "CASE WHEN aa_pos % 5 = 0 THEN NULL ELSE CAST(aa_pos % 90 AS DOUBLE) / 3 END",
    "dna_contact": "aa_pos % 13 = 0",
    "ss": "CASE aa_pos % 6 WHEN 0 THEN NULL WHEN 1 THEN 'H' WHEN 2 THEN 'G' WHEN 3 THEN 'E' WHEN 4 THEN 'B' ELSE 'C' END",
}
SQL_STRUCT = """coalesce({rsa}, 0.4::DOUBLE) AS rsa, CASE WHEN coalesce({rsa}, 0.4::DOUBLE) < 0.25::DOUBLE THEN 1 ELSE 0 END AS is_buried, coalesce({bfactor}, 50) AS bfactor,
  coalesce({dist_dna}, 999) AS dist_dna, round(coalesce({dist_palb2}, 999), 9) AS dist_palb2, CASE WHEN {dna_contact} THEN 1 ELSE 0 END AS is_dna_contact,
  CASE WHEN {ss} IN ('H', 'G', 'I') THEN 1 ELSE 0 END AS ss_helix, CASE WHEN {ss} IN ('E', 'B') THEN 1 ELSE 0 END AS ss_sheet,
  CASE WHEN coalesce({rsa}, 0.4::DOUBLE) < 0.25::DOUBLE THEN bl ELSE 0 END AS buried_x_blosum, CASE WHEN {dna_contact} THEN bl ELSE 0 END AS dna_contact_x_blosum""".format(**STRUCT)


@query("feat_structure", f"SELECT {K4}, {SQL_STRUCT} FROM {VB} v")
def feat_structure(spark, sf):
    s = {k: F.expr(v) for k, v in STRUCT.items()}
    out = FE.add_structure(subst(spark, sf), s["rsa"], s["bfactor"], s["dist_dna"], s["dist_palb2"], s["dna_contact"], s["ss"])
    return out.select(*KEY, "rsa", "is_buried", "bfactor", "dist_dna", F.round("dist_palb2", 9).alias("dist_palb2"), "is_dna_contact", "ss_helix",
                      "ss_sheet", "buried_x_blosum", "dna_contact_x_blosum")


@query("feat_frequency", f"""
SELECT {K4}, af AS gnomad_af, mx AS gnomad_popmax_af, round(log10(af + 1e-8::DOUBLE), 9) AS gnomad_af_log, round(log10(mx + 1e-8::DOUBLE), 9) AS gnomad_popmax_log,
  CASE WHEN af < 0.001::DOUBLE THEN 1 ELSE 0 END AS is_rare, CASE WHEN mx < 0.001::DOUBLE THEN 1 ELSE 0 END AS is_popmax_rare, round(af * bl, 12) AS af_x_blosum
FROM (SELECT *, greatest(af_afr, af_amr, af_eas, af_nfe) AS mx FROM {VB} v) x""")
def feat_frequency(spark, sf):
    v = subst(spark, sf)
    mx = F.greatest("af_afr", "af_amr", "af_eas", "af_nfe")
    out = FE.add_frequency(v, {"gnomad_af": F.col("af"), "gnomad_popmax_af": mx})
    return out.select(*KEY, "gnomad_af", "gnomad_popmax_af", *[F.round(c, 9).alias(c) for c in ("gnomad_af_log", "gnomad_popmax_log")],
                      "is_rare", "is_popmax_rare", F.round("af_x_blosum", 12).alias("af_x_blosum"))


@query("feat_splice", f"""
SELECT {K4}, coalesce({EVE}, 0) AS spliceai_score, CASE WHEN coalesce({EVE}, 0) > 0.5::DOUBLE THEN 1 ELSE 0 END AS splice_pathogenic FROM variants""")
def feat_splice(spark, sf):
    return FE.add_splice(V(spark, sf), F.expr(EVE)).select(*KEY, "spliceai_score", "splice_pathogenic")


def sql_onehot():
    return ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{n}\"" for n, (c, v) in FE.onehot_columns().items())


@query("feat_onehot", f"""SELECT gene, aa_ref, {', '.join(f'CAST(sum("{n}") AS BIGINT) AS "{n}"' for n in FE.onehot_columns())}
FROM (SELECT gene, aa_ref, {sql_onehot()} FROM variants) v GROUP BY gene, aa_ref""")
def feat_onehot(spark, sf):
    out = FE.add_onehot(V(spark, sf))
    return out.groupBy("gene", "aa_ref").agg(*[F.sum(F.col(f"`{n}`")).cast("bigint").alias(n) for n in FE.onehot_columns()])


def annotations():
    s = {k: F.expr(v) for k, v in STRUCT.items()}
    return {**s, "phylop": F.expr(PH), "assay": F.expr(MAVE), "eve": F.expr(EVE), "splice": F.expr(EVE), "cosine": F.col("p_tree"), "l2": F.col("p_mlp"),
            "components": F.expr("array(p_tree, p_mlp)"), "gnomad_af": F.col("af"), "gnomad_popmax_af": F.greatest("af_afr", "af_amr", "af_eas", "af_nfe"),
            **{f"gnomad_af_{p}": F.col(f"af_{p}") for p in ("afr", "amr", "eas", "nfe")}}


def full_vector(spark, sf, keep=(), rows=None):
    compile_wide(spark)
    dims = {n: view(spark, sf, n) for n in ("genes", "blosum62", "residues", "domains", "domain_candidates")}
    return FE.feature_vector(V(spark, sf) if rows is None else rows, dims, annotations(), keep)


FLAG_COLS = ", ".join(f"CASE WHEN v.aa_pos BETWEEN w.s_{f} AND w.e_{f} THEN 1 ELSE 0 END AS {f}" for f in K.DOMAIN_FLAGS)
FULL = f"""(SELECT v.*, {FLAG_COLS}, z.z,
  abs(r.volume - a.volume) AS volume_diff, abs(r.hydro - a.hydro) AS hydro_diff, r.hydro AS ref_hydro, a.hydro AS alt_hydro, a.hydro - r.hydro AS hydro_delta,
  CASE WHEN r.charge <> a.charge THEN 1 ELSE 0 END AS charge_change, CASE WHEN r.charge = 'nonpolar' AND a.charge IN ('positive', 'negative') THEN 1 ELSE 0 END AS nonpolar_to_charged,
  g.cds_length, g.aa_length, {PH.replace('aa_pos', 'v.aa_pos')} AS ph, coalesce({MAVE.replace('aa_pos', 'v.aa_pos')}, 0) AS ma, coalesce({EVE.replace('l_partkey', 'v.l_partkey').replace('p_mlp', 'v.p_mlp')}, 0) AS ev,
  greatest(v.af_afr, v.af_amr, v.af_eas, v.af_nfe) AS mx, nd.nd, nd.nn
  FROM {VB} v LEFT JOIN flag_wide w ON w.gene = v.gene
  JOIN {ZONE} z ON z.gene = v.gene AND z.aa_pos = v.aa_pos JOIN genes g ON g.gene = v.gene JOIN residues r ON r.aa = v.aa_ref JOIN residues a ON a.aa = v.aa_alt
  JOIN (SELECT q.gene, q.aa_pos, count(*) FILTER (q.aa_pos BETWEEN d.start_aa AND d.end_aa) AS nn, least(min(CASE WHEN q.aa_pos BETWEEN d.start_aa AND d.end_aa THEN 0
      ELSE least(abs(q.aa_pos - d.start_aa), abs(q.aa_pos - d.end_aa)) END), max(q.aa_len)) / CAST(max(q.aa_len) AS DOUBLE) AS nd
    FROM (SELECT DISTINCT gene, aa_pos, aa_len FROM variants) q JOIN domains d ON d.gene = q.gene GROUP BY q.gene, q.aa_pos) nd ON nd.gene = v.gene AND nd.aa_pos = v.aa_pos)"""
VEC = {
    "cDNA_pos": "cdna_pos", "AA_pos": "aa_pos", "relative_cdna_pos": "cdna_pos / CAST(cds_length AS DOUBLE)", "relative_aa_pos": "aa_pos / CAST(aa_length AS DOUBLE)",
    "blosum62_score": "bl", "is_nonsense": "CASE WHEN aa_alt = 'Ter' THEN 1 ELSE 0 END",
    "is_transition": "CASE WHEN mutation IN ('A>G', 'G>A', 'C>T', 'T>C') THEN 1 ELSE 0 END", "is_transversion": "CASE WHEN mutation IN ('A>G', 'G>A', 'C>T', 'T>C') THEN 0 ELSE 1 END",
    "phylop_score": "ph", "high_conservation": "CASE WHEN ph > 4 THEN 1 ELSE 0 END", "ultra_conservation": "CASE WHEN ph > 7 THEN 1 ELSE 0 END", "conserv_x_blosum": "ph * bl",
    "mave_score": "ma", "has_mave": "CASE WHEN ma <> 0 THEN 1 ELSE 0 END", "mave_abnormal": "CASE WHEN ma BETWEEN 0.01::DOUBLE AND 1.49::DOUBLE THEN 1 ELSE 0 END", "mave_x_blosum": "ma * bl",
    "dist_nearest_domain": "nd", "n_domains_hit": "nn", "in_multi_domain": "CASE WHEN nn > 1 THEN 1 ELSE 0 END", "functional_zone_score": "z", "func_zone_x_blosum": "z * bl", "func_zone_x_phylop": "z * ph",
    "gnomad_af": "af", "gnomad_popmax_af": "mx", "gnomad_af_afr": "af_afr", "gnomad_af_amr": "af_amr", "gnomad_af_eas": "af_eas", "gnomad_af_nfe": "af_nfe",
    "gnomad_af_log": "log10(af + 1e-8::DOUBLE)", "gnomad_popmax_log": "log10(mx + 1e-8::DOUBLE)", "is_rare": "CASE WHEN af < 0.001::DOUBLE THEN 1 ELSE 0 END",
    "is_popmax_rare": "CASE WHEN mx < 0.001::DOUBLE THEN 1 ELSE 0 END", "af_x_blosum": "af * bl",
    "spliceai_score": "ev", "splice_pathogenic": "CASE WHEN ev > 0.5::DOUBLE THEN 1 ELSE 0 END", "esm2_cosine_sim": "p_tree", "esm2_l2_shift": "p_mlp",
    **{f"esm2_pca_{i}": ("p_tree", "p_mlp")[i] if i < 2 else "0" for i in range(20)},
    **{n: f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END" for n, (c, v) in FE.onehot_columns().items()},
    "eve_score": "ev", "eve_pathogenic": "CASE WHEN ev > 0.5::DOUBLE THEN 1 ELSE 0 END", "eve_x_phylop": "ev * ph",
}
STRUCT_VEC = {
    "rsa": f"coalesce({STRUCT['rsa']}, 0.4::DOUBLE)", "is_buried": f"CASE WHEN coalesce({STRUCT['rsa']}, 0.4::DOUBLE) < 0.25::DOUBLE THEN 1 ELSE 0 END",
    "bfactor": f"coalesce({STRUCT['bfactor']}, 50)", "dist_dna": f"coalesce({STRUCT['dist_dna']}, 999)", "dist_palb2": f"coalesce({STRUCT['dist_palb2']}, 999)",
    "is_dna_contact": f"CASE WHEN {STRUCT['dna_contact']} THEN 1 ELSE 0 END", "ss_helix": f"CASE WHEN {STRUCT['ss']} IN ('H', 'G', 'I') THEN 1 ELSE 0 END",
    "ss_sheet": f"CASE WHEN {STRUCT['ss']} IN ('E', 'B') THEN 1 ELSE 0 END", "buried_x_blosum": f"CASE WHEN coalesce({STRUCT['rsa']}, 0.4::DOUBLE) < 0.25::DOUBLE THEN bl ELSE 0 END",
    "dna_contact_x_blosum": f"CASE WHEN {STRUCT['dna_contact']} THEN bl ELSE 0 END",
}


def vec_sql(c):
    return VEC.get(c) or STRUCT_VEC.get(c) or c


@query("feature_vector", f"""
SELECT gene, aa_ref, aa_alt AS alt, count(*) AS n, {', '.join(f'round(sum(CAST({vec_sql(c)} AS DOUBLE)), 9) AS "{c}"' for c in FE.FEATURE_ORDER)}
FROM {FULL} v GROUP BY gene, aa_ref, aa_alt""")
def feature_vector(spark, sf):
    """Full vector of every row, compared as sums per gene and substitution."""
    out = full_vector(spark, sf, ["gene", "aa_ref", "aa_alt"])
    return out.groupBy("gene", "aa_ref", F.col("aa_alt").alias("alt")).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.col(f"`{c}`").cast("double")), 9).alias(c) for c in FE.FEATURE_ORDER])


NONZERO = " + ".join(f"CASE WHEN CAST({vec_sql(c)} AS DOUBLE) <> 0 THEN 1 ELSE 0 END" for c in FE.FEATURE_ORDER)


@query("feature_coverage", f"""
SELECT {K4}, CAST(nz AS INT) AS nonzero, round(100.0::DOUBLE * nz / {len(FE.FEATURE_ORDER)}, 6) AS pct FROM (SELECT v.*, {NONZERO} AS nz FROM {FULL} v) x""")
def feature_coverage(spark, sf):
    n = FE.coverage(FE.FEATURE_ORDER)
    return full_vector(spark, sf, KEY).select(*KEY, n.alias("nonzero"), F.round(100.0 * n / len(FE.FEATURE_ORDER), 6).alias("pct"))


@query("embedding_missing_flag", "SELECT vec_id, vec_id % 3 = 0 AS missing FROM embeddings")
def embedding_missing_flag(spark, sf):
    e = view(spark, sf, "embeddings").withColumn("c", F.expr("CASE WHEN vec_id % 3 = 0 THEN array() ELSE embedding END"))
    e = FE.add_embedding(e, F.lit(None), F.lit(None), F.col("c"))
    return e.select("vec_id", FE.all_zero([f"esm2_pca_{i}" for i in range(20)] + ["esm2_cosine_sim", "esm2_l2_shift"]).alias("missing"))


PAIRS = """(SELECT a.vec_id // 2 AS pair, a.embedding AS wt, b.embedding AS mut FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"""


def pairs(spark, sf):
    e = view(spark, sf, "embeddings")
    return (e.groupBy(F.floor(F.col("vec_id") / 2).alias("pair"))
            .agg(F.max(F.struct(F.col("vec_id") % 2 == 0, "embedding")).getField("embedding").alias("wt"),
                 F.max(F.struct(F.col("vec_id") % 2 == 1, "embedding")).getField("embedding").alias("mut"),
                 F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n"))


@query("embedding_shift", f"""
SELECT pair, round(dot / (sqrt(ww) * sqrt(mm) + 1e-8::DOUBLE), 6) AS cosine, round(sqrt(dd), 6) AS l2_shift FROM (
SELECT pair, sum(w * m) AS dot, sum(w * w) AS ww, sum(m * m) AS mm, sum((m - w) * (m - w)) AS dd FROM (
  SELECT pair, CAST(unnest(wt) AS DOUBLE) AS w, CAST(unnest(mut) AS DOUBLE) AS m FROM {PAIRS} p) x GROUP BY pair) y""")
def embedding_shift(spark, sf):
    cos, l2 = VE.cosine_and_shift(F.col("wt"), F.col("mut"))
    return pairs(spark, sf).select("pair", F.round(cos, 6).alias("cosine"), F.round(l2, 6).alias("l2_shift"))


@query("embedding_pca")
def embedding_pca(spark, sf):
    """Components of all difference vectors; SQL has no solver, the distances they keep are compared below."""
    diff = pairs(spark, sf).select("pair", VE.difference(F.col("wt"), F.col("mut")).alias("diff"))
    return VE.principal_components(diff, "diff", 20)


WIDTH = 20  # components of the feature vector
DIFFS = f"""d AS (SELECT pair, list_transform(range({WIDTH}), lambda i: CAST(mut[i + 1] AS DOUBLE) - CAST(wt[i + 1] AS DOUBLE)) AS v FROM {{pairs}} p),
m AS (SELECT {', '.join(f'avg(v[{i + 1}]) AS m{i}' for i in range(WIDTH))} FROM d),
c AS (SELECT pair, [{', '.join(f'v[{i + 1}] - m{i}' for i in range(WIDTH))}] AS v FROM d, m)""".replace("{pairs}", PAIRS)


def rotated(spark, sf):
    """Pairs with all components of the first WIDTH places of their difference: a rotation about the mean, which keeps distances."""
    p = pairs(spark, sf)
    diff = VE.difference(F.slice("wt", 1, WIDTH), F.slice("mut", 1, WIDTH))
    return VE.principal_components(p.withColumn("diff", diff), "diff", WIDTH)


def squares(a, b=None):
    terms = F.transform(a, lambda x: x * x) if b is None else F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


@query("embedding_pca_distances", f"""WITH {DIFFS}
SELECT c.pair, round(sqrt(list_dot_product(c.v, c.v)), 6) AS from_mean, round(list_distance(c.v, o.v), 6) AS to_next FROM c LEFT JOIN c o ON o.pair = c.pair + 1""")
def embedding_pca_distances(spark, sf):
    """Distances in the space of all components equal those of the centred vectors."""
    r = materialise(rotated(spark, sf).select("pair", "pca_components"), "rotated")
    nxt = r.select((F.col("pair") - 1).alias("pair"), F.col("pca_components").alias("other"))
    return r.join(nxt, "pair", "left").select("pair", F.round(F.sqrt(squares("pca_components")), 6).alias("from_mean"),
                                              F.round(F.sqrt(squares("pca_components", "other")), 6).alias("to_next"))


@query("feat_embedding", f"""WITH {DIFFS}, s AS (
SELECT pair, dot / (sqrt(ww) * sqrt(mm) + 1e-8::DOUBLE) AS cosine, sqrt(dd) AS l2 FROM (
SELECT pair, sum(w * m) AS dot, sum(w * w) AS ww, sum(m * m) AS mm, sum((m - w) * (m - w)) AS dd FROM (
  SELECT pair, CAST(unnest(wt) AS DOUBLE) AS w, CAST(unnest(mut) AS DOUBLE) AS m FROM {PAIRS} p) x GROUP BY pair) y)
SELECT s.pair, CASE WHEN s.pair % 5 = 0 THEN 0 ELSE round(cosine, 6) END AS esm2_cosine_sim, CASE WHEN s.pair % 5 = 0 THEN 0 ELSE round(l2, 6) END AS esm2_l2_shift,
  CASE WHEN s.pair % 5 = 0 THEN 0 ELSE round(list_dot_product(c.v, c.v), 5) END AS energy FROM s JOIN c USING (pair)""")
def feat_embedding(spark, sf):
    """Similarity, shift and principal components of every pair as feature columns, 0 where a pair has no embedding; the components by their energy."""
    have = F.col("pair") % 5 != 0
    cos, l2 = VE.cosine_and_shift(F.col("wt"), F.col("mut"))
    out = FE.add_embedding(rotated(spark, sf), F.when(have, cos), F.when(have, l2), F.when(have, F.col("pca_components")))
    energy = sum((F.col(f"esm2_pca_{i}") * F.col(f"esm2_pca_{i}") for i in range(WIDTH)), F.lit(0.0))
    return out.select("pair", F.round("esm2_cosine_sim", 6).alias("esm2_cosine_sim"), F.round("esm2_l2_shift", 6).alias("esm2_l2_shift"), F.round(energy, 5).alias("energy"))


@query("rsa_from_confidence", """
SELECT structure, resnum, round(CASE WHEN plddt >= 90 THEN 0.1::DOUBLE WHEN plddt >= 70 THEN 0.15::DOUBLE + (90 - plddt) * 0.01::DOUBLE
  WHEN plddt >= 50 THEN 0.35::DOUBLE + (70 - plddt) * 0.015::DOUBLE ELSE 0.65::DOUBLE + (50 - plddt) * 0.01::DOUBLE END, 9) AS rsa,
  CASE WHEN plddt >= 80 THEN 'H' WHEN plddt >= 60 THEN 'C' ELSE '-' END AS ss FROM residue_xyz""")
def rsa_from_confidence(spark, sf):
    rsa, ss = S.rsa_from_confidence(F.col("plddt"))
    return view(spark, sf, "residue_xyz").select("structure", "resnum", F.round(rsa, 9).alias("rsa"), ss.alias("ss"))


@query("structure_regions", f"""
SELECT {K4}, ss, CASE WHEN aa_pos % 50 = 7 THEN 0.05::DOUBLE WHEN aa_pos % 50 = 9 THEN 0.35::DOUBLE WHEN aa_pos % 50 = 11 THEN 0.3::DOUBLE WHEN ss = 'E' THEN 0.15::DOUBLE
  WHEN ss = 'H' THEN 0.25::DOUBLE ELSE 0.6::DOUBLE END AS rsa, linker FROM (SELECT *, CASE WHEN aa_pos BETWEEN 1007 AND 1022 OR aa_pos BETWEEN 100 AND 140 THEN 'H' WHEN aa_pos BETWEEN 130 AND 160 THEN 'E' ELSE 'C' END AS ss,
  CASE WHEN aa_pos BETWEEN 41 AND 1001 THEN 'N_linker' WHEN aa_pos BETWEEN 2086 AND 2401 THEN 'mid_linker' WHEN aa_pos BETWEEN 3103 AND 3259 THEN 'C_linker' ELSE 'uncharacterized' END AS linker FROM variants) v""")
def structure_regions(spark, sf):
    p = F.col("aa_pos")
    ss = S.residue_class(p, {"H": [(1007, 1022), (100, 140)], "E": [(130, 160)]}, "C")
    linker = S.residue_class(p, {"N_linker": [(41, 1001)], "mid_linker": [(2086, 2401)], "C_linker": [(3103, 3259)]}, "uncharacterized")
    rsa = S.region_rsa(p, p % 50 == 7, p % 50 == 9, p % 50 == 11, ss)
    return V(spark, sf).select(*KEY, ss.alias("ss"), rsa.alias("rsa"), linker.alias("linker"))


@query("window_extract", """
SELECT doc_id, substr(text, s, e - s + 1) AS wild, substr(text, s, pos - s) || '#' || substr(text, pos + 1, e - pos) AS mutant FROM (
SELECT *, greatest(pos - 50, 1) AS s, least(pos + 50, length(text)) AS e FROM (SELECT doc_id, text, 1 + (doc_id * 37) % length(text) AS pos FROM documents WHERE length(text) > 0) x) y""")
def window_extract(spark, sf):
    """Context windows over whole texts, standing in for protein sequences."""
    d = view(spark, sf, "documents").filter(F.length("text") > 0).withColumn("pos", F.expr("1 + (doc_id * 37) % length(text)"))
    wild, mutant = S.context_window(F.col("text"), F.col("pos"), F.lit("#"))
    return d.select("doc_id", wild.alias("wild"), mutant.alias("mutant"))
