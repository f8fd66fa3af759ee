"""Evidence rules and decisions, over the variant views."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.functions import evidence as EV, rules as R
from helixframe.operators import annotate as A, domains as D, features as FE, lookups as L, support as S
from helixframe.plans import features as PF
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K4 = ", ".join(KEY)
POP = ("CASE l_linenumber % 6 WHEN 1 THEN 'EAS' WHEN 2 THEN 'nfe' WHEN 3 THEN 'kazakh' WHEN 4 THEN 'AFR' "
       "WHEN 5 THEN 'sas' END")


def known_pathogenic(v):
    return v.filter("split = 'train' AND label = 1 AND aa_alt <> 'Ter'").select(
        *L.VARIANT_KEY).distinct()


def inputs(spark, sf):
    v = view(spark, sf, "variants")
    return A.evidence_inputs(v, view(spark, sf, "genes"), view(spark, sf, "domains"),
                             view(spark, sf, "domain_candidates"), known_pathogenic(v))


def sql_codes(af="af", sparse="FALSE", p="p_tree"):
    """SQL text of the code list of the variant views."""
    f = f"(CASE WHEN {sparse} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)"
    return f"""concat_ws(',',
      CASE WHEN critical THEN 'PM1' END,
      CASE WHEN same_change THEN 'PS1' END,
      CASE WHEN same_position AND NOT same_change THEN 'PM5' END,
      CASE WHEN {af} = 0 AND {sparse} THEN 'PM2_insufficient' END,
      CASE WHEN {af} = 0 AND NOT {sparse} THEN 'PM2' END,
      CASE WHEN {af} > ba1 * {f} THEN 'BA1' END,
      CASE WHEN {af} > bs1 * {f} AND NOT {af} > ba1 * {f} THEN 'BS1' END,
      CASE WHEN is_nonsense THEN 'PVS1' END,
      CASE WHEN {p} >= 0.70::DOUBLE THEN 'PP3' END,
      CASE WHEN {p} <= 0.20::DOUBLE THEN 'BP4' END)"""


def sql_count(codes, names):
    return f"CAST(len(list_intersect(string_split({codes}, ','), {names})) AS BIGINT)"


def sql_class(source, codes="codes", out="acmg_class"):
    """SQL relation: source.* plus acmg_class, the ladder written rule by rule."""
    counts = ", ".join(f"{sql_count(codes, names)} AS {out}_{k}" for k, names in K.EVIDENCE_STRENGTH.items())
    return f"""(SELECT *, CASE
      WHEN {out}_ba >= 1 THEN 'Benign' WHEN {out}_bs >= 2 THEN 'Benign'
      WHEN {out}_bs >= 1 AND {out}_bp >= 1 THEN 'Likely Benign'
      WHEN {out}_pvs >= 1 AND {out}_ps >= 1 THEN 'Pathogenic'
      WHEN {out}_pvs >= 1 AND {out}_pm >= 2 THEN 'Pathogenic'
      WHEN {out}_pvs >= 1 AND {out}_pm >= 1 AND {out}_pp >= 1 THEN 'Pathogenic'
      WHEN {out}_pvs >= 1 AND {out}_pp >= 2 THEN 'Pathogenic'
      WHEN {out}_ps >= 2 THEN 'Pathogenic'
      WHEN {out}_ps >= 1 AND {out}_pm >= 3 THEN 'Pathogenic'
      WHEN {out}_ps >= 1 AND {out}_pm >= 2 AND {out}_pp >= 2 THEN 'Pathogenic'
      WHEN {out}_ps >= 1 AND {out}_pm >= 1 AND {out}_pp >= 4 THEN 'Pathogenic'
      WHEN {out}_pvs >= 1 AND {out}_pm >= 1 THEN 'Likely Pathogenic'
      WHEN {out}_ps >= 1 AND {out}_pm >= 1 AND {out}_pm <= 2 THEN 'Likely Pathogenic'
      WHEN {out}_ps >= 1 AND {out}_pp >= 2 THEN 'Likely Pathogenic'
      WHEN {out}_pm >= 3 THEN 'Likely Pathogenic'
      WHEN {out}_pm >= 2 AND {out}_pp >= 2 THEN 'Likely Pathogenic'
      WHEN {out}_pm >= 1 AND {out}_pp >= 4 THEN 'Likely Pathogenic'
      ELSE 'Uncertain Significance' END AS {out}
      FROM (SELECT *, {counts} FROM {source}) cnt)"""


EV_CODES = f"(SELECT *, {sql_codes()} AS codes FROM ev_in) ec"


def with_codes(spark, sf):
    return inputs(spark, sf).withColumn("codes", EV.code_list(A.rules_for(F.col("p_tree"))))


@query("evidence_classes", f"""
SELECT gene, acmg_class, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pathogenic
FROM {sql_class(EV_CODES)} c GROUP BY gene, acmg_class""")
def evidence_classes(spark, sf):
    """Flagship: variants per gene and evidence class."""
    return (EV.classify(with_codes(spark, sf)).groupBy("gene", "acmg_class")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_pathogenic")))


@query("risk_tier", f"""
SELECT {K4}, p_tree, CASE WHEN p_tree > 0.9::DOUBLE THEN 'pathogenic' WHEN p_tree > 0.7::DOUBLE THEN 'likely_pathogenic'
 WHEN p_tree < 0.1::DOUBLE THEN 'benign' WHEN p_tree < 0.3::DOUBLE THEN 'likely_benign' ELSE 'uncertain' END AS risk_tier
FROM variants""")
def risk_tier(spark, sf):
    return view(spark, sf, "variants").select(*KEY, "p_tree", R.risk_tier(F.col("p_tree")).alias("risk_tier"))


@query("pop_af_select", f"""
SELECT {K4}, pop, CASE lower(pop) WHEN 'kazakh' THEN af_eas WHEN 'eas' THEN af_eas WHEN 'nfe' THEN af_nfe
  WHEN 'afr' THEN af_afr WHEN 'amr' THEN af_amr ELSE af END AS af_used,
  CASE WHEN pop = 'kazakh' THEN 'Kazakh (EAS proxy)' WHEN pop IS NULL THEN 'global' ELSE upper(pop) END AS pop_label
FROM (SELECT *, {POP} AS pop FROM variants) v""")
def pop_af_select(spark, sf):
    p = F.col("pop")
    return (view(spark, sf, "variants").withColumn("pop", F.expr(POP)).select(
        *KEY, "pop",
        EV.population_af(p, F.col("af"), {k: F.col(c) for k, c in A.POPULATION_COLUMNS.items()}).alias("af_used"),
        EV.population_label(p, list(K.POPULATION_AF)).alias("pop_label")))


SPARSE = "(pop IS NOT NULL AND pop = 'kazakh')"
AF_POP = ("(CASE lower(pop) WHEN 'kazakh' THEN af_eas WHEN 'eas' THEN af_eas WHEN 'nfe' THEN af_nfe "
          "WHEN 'afr' THEN af_afr ELSE af END)")


@query("acmg_frequency", f"""
SELECT {K4}, concat_ws(',', CASE WHEN a = 0 AND s THEN 'PM2_insufficient' END, CASE WHEN a = 0 AND NOT s THEN 'PM2' END,
  CASE WHEN a > b THEN 'BA1' END, CASE WHEN a > c AND NOT a > b THEN 'BS1' END) AS codes
FROM (SELECT *, ba1 * m AS b, bs1 * m AS c FROM (SELECT *, {AF_POP} AS a, {SPARSE} AS s,
   CASE WHEN {SPARSE} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS m
  FROM (SELECT v.*, g.ba1, g.bs1, {POP} AS pop FROM variants v JOIN genes g ON v.gene = g.gene) x) y) z""")
def acmg_frequency(spark, sf):
    v = view(spark, sf, "variants").join(view(spark, sf, "genes").select("gene", "ba1", "bs1"), "gene")
    p = F.expr(POP)
    af = EV.population_af(p, F.col("af"), {k: F.col(c) for k, c in A.POPULATION_COLUMNS.items()})
    codes = EV.code_list(EV.frequency_rules(af, F.col("gene"), F.col("ba1"), F.col("bs1"),
                                            EV.is_underrepresented(p)))
    return v.select(*KEY, F.array_join(codes, ",").alias("codes"))


DIST = "CASE WHEN aa_pos % 7 = 0 THEN NULL ELSE CAST(aa_pos % 40 AS DOUBLE) / 4 END"
DIST2 = "CASE WHEN aa_pos % 5 = 0 THEN 999 ELSE CAST(aa_pos % 90 AS DOUBLE) / 3 END"


@query("acmg_structure", f"""
SELECT {K4}, concat_ws(' & ',
  CASE WHEN d1 <= 5 AND d1 <> 999 THEN 'within ' || round(d1, 2) || 'A of DNA binding interface' END,
  CASE WHEN d2 <= 5 AND d2 <> 999 THEN 'within ' || round(d2, 2) || 'A of primary interaction interface' END,
  CASE WHEN critical THEN 'inside a critical functional repeat or domain' END) AS reasons,
  (d1 <= 5 OR d2 <= 5 OR critical) AS pm1
FROM (SELECT *, round(coalesce({DIST}, 999), 2) AS d1, round({DIST2}, 2) AS d2 FROM ev_in) e""")
def acmg_structure(spark, sf):
    e = (inputs(spark, sf).withColumn("d1", F.round(F.coalesce(F.expr(DIST), F.lit(999.0)), 2))
         .withColumn("d2", F.round(F.expr(DIST2), 2)))
    cond, text = EV.structure_rules(F.col("d1"), F.col("d2"), F.col("critical"))["PM1"]
    return e.select(*KEY, F.replace(text, F.lit("Structural disruption: "), F.lit("")).alias("reasons"),
                    cond.alias("pm1"))


@query("acmg_known", f"""
SELECT {K4}, concat_ws(',', CASE WHEN same_change THEN 'PS1' END, CASE WHEN same_position AND NOT same_change THEN 'PM5' END,
  CASE WHEN cdna_pos % 97 = 0 THEN 'PS4' END) AS codes FROM ev_in""")
def acmg_known(spark, sf):
    r = EV.known_rules(F.col("same_change"), F.col("same_position"), F.expr("cdna_pos % 97 = 0"))
    return inputs(spark, sf).select(*KEY, F.array_join(EV.code_list(r), ",").alias("codes"))


EXON = "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(FLOOR((cdna_pos - 1) / 150) AS INT) + 1 END"
TOTAL = "CAST(CEIL(aa_len * 3 / CAST(150 AS DOUBLE)) AS INT)"


@query("acmg_null", f"""
SELECT {K4}, CASE WHEN NOT (nonsense OR fs) THEN CASE WHEN canon THEN 'PVS1' END
  WHEN exon IS NOT NULL AND total > 1 AND (exon = total OR (exon = total - 1 AND near)) THEN 'PVS1_moderate'
  ELSE 'PVS1' END AS code
FROM (SELECT *, aa_alt = 'Ter' AS nonsense, l_partkey % 6 = 0 AS fs, l_partkey % 10 = 3 AS canon,
  {EXON} AS exon, {TOTAL} AS total, (cdna_pos - 1) % 150 >= 100 AS near FROM variants) v""")
def acmg_null(spark, sf):
    r = EV.null_rules(F.expr("aa_alt = 'Ter'"), F.expr("l_partkey % 6 = 0"), F.expr(EXON), F.expr(TOTAL),
                      F.expr("(cdna_pos - 1) % 150 >= 100"), F.expr("l_partkey % 10 = 3"))
    code = F.coalesce(*[F.when(c, k) for k, (c, _) in r.items()])
    return view(spark, sf, "variants").select(*KEY, code.alias("code"))


@query("acmg_other", f"""
SELECT {K4}, concat_ws(',', CASE WHEN indel THEN 'PM4' END, CASE WHEN near AND NOT (canon AND NOT nul) THEN 'PP3_splice' END,
  CASE WHEN syn AND NOT near AND NOT canon THEN 'BP7' END, CASE WHEN p_mlp >= 0.7::DOUBLE THEN 'PP3' END,
  CASE WHEN p_mlp <= 0.2::DOUBLE THEN 'BP4' END) AS codes,
  CASE WHEN indel AND critical THEN 'In-frame indel within a known functional domain'
   WHEN indel THEN 'In-frame indel outside known functional domain (reduced weight)' END AS pm4_text
FROM (SELECT *, l_partkey % 8 = 0 AS indel, l_partkey % 7 = 0 AS near, l_partkey % 14 = 0 AS canon,
  aa_alt = 'Ter' AS nul, l_orderkey % 3 = 0 AS syn FROM ev_in) e""")
def acmg_other(spark, sf):
    r = EV.other_rules(F.expr("l_partkey % 8 = 0"), F.col("critical"), F.expr("l_partkey % 7 = 0"),
                       F.expr("l_partkey % 14 = 0"), F.col("is_nonsense"), F.expr("l_orderkey % 3 = 0"),
                       F.col("p_mlp"))
    return inputs(spark, sf).select(*KEY, F.array_join(EV.code_list(r), ",").alias("codes"),
                                    F.when(r["PM4"][0], r["PM4"][1]).alias("pm4_text"))


# Every input of the rules, so that each of the fifteen codes fires in the views.
FOUNDER = {"population": "CASE l_partkey % 3 WHEN 0 THEN 'Kazakh' WHEN 1 THEN 'Ashkenazi' END", "frequency": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_partkey % 90 AS DOUBLE) / 1000 END",
           "source": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'registry ' || CAST(l_suppkey % 7 AS STRING) END"}
FLAGS = {"founder": "cdna_pos % 97 = 0", "is_frameshift": "l_partkey % 26 = 0", "near_last_boundary": "(cdna_pos - 1) % 150 >= 100", "canonical_splice": "l_partkey % 30 = 3",
         "near_splice": "l_partkey % 11 = 0", "is_inframe": "l_partkey % 8 = 1", "is_synonymous": "l_orderkey % 13 = 0"}


def full_rules():
    f = {k: F.expr(e) for k, e in FOUNDER.items()}
    return A.rules_for(F.col("p_tree"), F.expr(POP), dist_dna=F.round(F.expr(DIST), 2), dist_palb2=F.round(F.expr(DIST2), 2), exon_number=F.expr(EXON),
                       total_exons=F.expr(TOTAL), founder_reason=EV.founder_text(f["population"], f["frequency"], f["source"]),
                       **{k: F.expr(e) for k, e in FLAGS.items()})


def _sql_rules():
    """Code -> (condition, rationale) in SQL over the columns of FULL_IN."""
    pct = lambda x, n: f"printf('%.{n}f%%', {x} * 100)"
    relaxed = "CASE WHEN s THEN ' (threshold relaxed for underrepresented population)' ELSE '' END"
    kind = "CASE WHEN is_nonsense THEN 'Nonsense' ELSE 'Frameshift' END"
    escape = "(nul AND exon IS NOT NULL AND total > 1 AND (exon = total OR (exon = total - 1 AND near_last_boundary)))"
    near = "concat_ws(' & ', CASE WHEN d1 <= 5 AND d1 <> 999 THEN 'within ' || d1 || 'A of DNA binding interface' END, " \
           "CASE WHEN d2 <= 5 AND d2 <> 999 THEN 'within ' || d2 || 'A of primary interaction interface' END, CASE WHEN critical THEN 'inside a critical functional repeat or domain' END)"
    return {
        "PM1": ("(d1 <= 5 OR d2 <= 5 OR critical)", f"'Structural disruption: ' || {near}"),
        "PS1": ("same_change", "'Same amino acid change as an established pathogenic variant'"),
        "PM5": ("same_position AND NOT same_change", "'Different pathogenic missense variant established at this position'"),
        "PS4": ("founder", f"'Known ' || coalesce(f_population, 'regional') || ' founder mutation, found in ' || coalesce({pct('f_frequency', 1)}, 'an unknown share') || "
                           "' of affected individuals, more than in controls (' || coalesce(f_source, 'published literature') || ')'"),
        "PM2_insufficient": ("a = 0 AND s", "'Absent from population database (' || lab || ' AF = 0), but the population is insufficiently represented; PM2 withheld'"),
        "PM2": ("a = 0 AND NOT s", "'Variant absent from population database (' || lab || ' AF = 0)'"),
        "BA1": ("a > b1", f"'Allele frequency (' || {pct('a', 3)} || ', ' || lab || ') exceeds stand-alone benign threshold (' || {pct('b1', 1)} || ') for ' || gene || {relaxed}"),
        "BS1": ("a > b2 AND NOT a > b1", f"'Population frequency (' || {pct('a', 4)} || ', ' || lab || ') exceeds threshold (' || {pct('b2', 3)} || ') for ' || gene || {relaxed}"),
        "PVS1_moderate": (escape, f"{kind} || CASE WHEN exon = total THEN ' variant in last exon' ELSE ' variant in last 50nt of penultimate exon' END || ' (exon ' || exon || '/' || total || "
                                  "'); may escape nonsense-mediated decay'"),
        "PVS1": (f"((nul AND NOT {escape}) OR (canonical_splice AND NOT nul))", f"CASE WHEN nul THEN 'Pathogenic truncating null variant (' || {kind} || ')' ELSE 'Canonical splice site variant disrupting mRNA splicing' END"),
        "PM4": ("is_inframe", "CASE WHEN critical THEN 'In-frame indel within a known functional domain' ELSE 'In-frame indel outside known functional domain (reduced weight)' END"),
        "PP3_splice": ("near_splice AND NOT (canonical_splice AND NOT nul)", "'Near splice site variant with potential splicing impact'"),
        "BP7": ("is_synonymous AND NOT near_splice AND NOT canonical_splice", "'Synonymous variant with no predicted splice impact'"),
        "PP3": ("p_tree >= 0.70::DOUBLE", "'Model predicts pathogenicity (p=' || printf('%.3f', p_tree) || ')'"),
        "BP4": ("p_tree <= 0.20::DOUBLE", "'Model predicts benign (p=' || printf('%.3f', p_tree) || ')'"),
    }


FULL_IN = f"""(SELECT *, is_nonsense OR is_frameshift AS nul, ba1 * m AS b1, bs1 * m AS b2 FROM (SELECT *, {AF_POP} AS a, {SPARSE} AS s, CASE WHEN {SPARSE} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS m,
  CASE WHEN pop = 'kazakh' THEN 'Kazakh (EAS proxy)' WHEN pop IS NULL THEN 'global' ELSE upper(pop) END AS lab FROM (SELECT *, {POP} AS pop, round(coalesce({DIST}, 999), 2) AS d1, round({DIST2}, 2) AS d2, {EXON} AS exon, {TOTAL} AS total,
  {', '.join(f'{e} AS f_{k}' for k, e in FOUNDER.items())}, {', '.join(f'{e} AS {k}' for k, e in FLAGS.items())} FROM ev_in) e0) e1) e2"""
FULL_CODES = f"(SELECT *, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, (c, _) in _sql_rules().items())}) AS codes FROM {FULL_IN}) ec"


@query("acmg_evidence", f"SELECT {K4}, concat_ws(' | ', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}={chr(39)} || {t} END' for n, (c, t) in _sql_rules().items())}) AS evidence FROM {FULL_IN}")
def acmg_evidence(spark, sf):
    """Full code -> rationale map of every variant, all fifteen codes."""
    m = EV.evidence_map(full_rules())
    shown = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " | ")
    return inputs(spark, sf).select(*KEY, shown.alias("evidence"))


@query("acmg_combine", f"SELECT {K4}, codes, acmg_class FROM {sql_class(FULL_CODES)} c")
def acmg_combine(spark, sf):
    e = inputs(spark, sf).withColumn("codes", EV.code_list(full_rules()))
    return EV.classify(e).select(*KEY, F.array_join("codes", ",").alias("codes"), "acmg_class")


PAIR = (f"(SELECT *, {sql_codes()} AS codes, {sql_codes(AF_POP, SPARSE)} AS pop_codes "
        f"FROM (SELECT *, {POP} AS pop FROM ev_in) q) ec")


@query("acmg_population_pair", f"""
SELECT pop, acmg_class AS global_class, pop_class, count(*) AS n
FROM {sql_class(sql_class(PAIR) + ' c1', 'pop_codes', 'pop_class')} c2 GROUP BY pop, acmg_class, pop_class""")
def acmg_population_pair(spark, sf):
    e = inputs(spark, sf).withColumn("pop", F.expr(POP))
    e = (e.withColumn("codes", EV.code_list(A.rules_for(F.col("p_tree"))))
         .withColumn("pop_codes", EV.code_list(A.rules_for(F.col("p_tree"), F.col("pop")))))
    e = EV.classify(EV.classify(e, "codes", "global_class"), "pop_codes", "pop_class")
    return e.groupBy("pop", "global_class", "pop_class").agg(F.count(F.lit(1)).alias("n"))


@query("critical_domain", f"""
SELECT {K4}, critical, EXISTS (SELECT 1 FROM domains d WHERE d.gene = e.gene AND e.aa_pos BETWEEN d.start_aa AND d.end_aa)
 AS in_any_domain FROM ev_in e""")
def critical_domain(spark, sf):
    e = D.with_domains(inputs(spark, sf), view(spark, sf, "domains"))
    return e.select(*KEY, "critical", (D.count_hits(F.col("domains"), F.col("aa_pos")) > 0).alias("in_any_domain"))


HIST = """tr AS (SELECT * FROM variants WHERE split = 'train'),
hist AS (SELECT gene, aa_pos, count(*) AS n FROM tr GROUP BY gene, aa_pos),
near AS (SELECT q.gene, q.aa_pos, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS nearby
  FROM (SELECT DISTINCT gene, aa_pos FROM variants) q
  LEFT JOIN hist h ON h.gene = q.gene AND h.aa_pos BETWEEN q.aa_pos - 50 AND q.aa_pos + 50
  GROUP BY q.gene, q.aa_pos)"""


@query("data_support", f"""
WITH {HIST}, same AS (SELECT gene, aa_ref, aa_alt, count(*) AS n FROM tr GROUP BY ALL)
SELECT {K4}, nearby, coalesce(s.n, 0) AS same_substitution, critical AS in_known_domain,
  CASE WHEN nearby > 100 THEN 'HIGH' WHEN nearby >= 10 THEN 'MODERATE' ELSE 'LOW' END AS level
FROM ev_in e JOIN near n ON n.gene = e.gene AND n.aa_pos = e.aa_pos
LEFT JOIN same s ON s.gene = e.gene AND s.aa_ref = e.aa_ref AND s.aa_alt = e.aa_alt""")
def data_support(spark, sf):
    e = inputs(spark, sf)
    out = S.data_support(e, view(spark, sf, "variants").filter("split = 'train'"), F.col("critical"))
    return out.select(*KEY, "nearby", "same_substitution", "in_known_domain", "level")


@query("confidence_interval_widen", f"""
SELECT {K4}, round(lo, 9) AS ci_lower, round(hi, 9) AS ci_upper, round((hi - lo) / 3.29::DOUBLE, 9) AS ci_std,
  CASE WHEN hi - lo < 0.10::DOUBLE THEN 'High Confidence' WHEN hi - lo < 0.25::DOUBLE THEN 'Moderate Confidence'
   ELSE 'Low Confidence' END AS label
FROM (SELECT *, CASE WHEN w THEN least(greatest((a + b) / 2 - (b - a) / 2 * 1.5::DOUBLE, 0), 1) ELSE a END AS lo,
   CASE WHEN w THEN least(greatest((a + b) / 2 + (b - a) / 2 * 1.5::DOUBLE, 0), 1) ELSE b END AS hi
 FROM (SELECT *, {SPARSE} AS w, least(p_tree, p_mlp) AS a, greatest(p_tree, p_mlp) AS b
   FROM (SELECT *, {POP} AS pop FROM variants) q) r) t""")
def confidence_interval_widen(spark, sf):
    v = (view(spark, sf, "variants").withColumn("pop", F.expr(POP))
         .withColumn("a", F.least("p_tree", "p_mlp")).withColumn("b", F.greatest("p_tree", "p_mlp")))
    ci = R.widen_interval(F.col("a"), F.col("b"), EV.is_underrepresented(F.col("pop")))
    v = v.withColumns(ci).withColumn("w", F.col("ci_upper") - F.col("ci_lower"))
    return v.select(*KEY, F.round("ci_lower", 9).alias("ci_lower"), F.round("ci_upper", 9).alias("ci_upper"),
                    F.round(F.col("w") / 3.29, 9).alias("ci_std"), R.uncertainty_label(F.col("w")).alias("label"))


@query("ood_warnings", f"""
SELECT {K4}, concat_ws(',', CASE WHEN aa_pos % 3 <> 0 THEN 'zero_embedding' END,
  CASE WHEN aa_pos > aa_length * 0.98::DOUBLE THEN 'c_terminal' END, CASE WHEN af > ba1 THEN 'common_variant' END) AS warnings
FROM (SELECT v.*, g.ba1, g.aa_length FROM variants v JOIN genes g ON v.gene = g.gene) e""")
def ood_warnings(spark, sf):
    v = view(spark, sf, "variants").join(view(spark, sf, "genes").select("gene", "ba1", "aa_length"), "gene")
    w = R.ood_warnings(F.col("af"), F.col("ba1"), F.col("aa_pos"), F.col("aa_length"), F.expr("aa_pos % 3 <> 0"))
    return v.select(*KEY, F.array_join(w, ",").alias("warnings"))


PHYLO = "CAST(aa_pos % 90 AS DOUBLE) / 10"
ASSAY = "CASE WHEN aa_pos % 4 = 0 THEN NULL ELSE CAST(aa_pos % 400 AS DOUBLE) / 100 END"


@query("source_labels", f"""
SELECT {K4}, CASE WHEN ph > 7 THEN 'Ultra-conserved' WHEN ph > 4 THEN 'Conserved' ELSE 'Variable' END AS phylop_label,
 CASE WHEN ma IS NULL THEN 'No data' WHEN ma < 1.49::DOUBLE THEN 'Abnormal' WHEN ma > 2.5::DOUBLE THEN 'Normal'
  ELSE 'Intermediate' END AS assay_label,
 CASE WHEN p_tree > 0.564::DOUBLE THEN 'Pathogenic' WHEN p_tree < 0.34::DOUBLE THEN 'Benign' ELSE 'Ambiguous' END AS substitution_label,
 CASE WHEN ev IS NULL THEN 'No data' WHEN ev > 0.5::DOUBLE THEN 'Pathogenic' ELSE 'Benign' END AS evolution_label
FROM (SELECT *, {PHYLO} AS ph, {ASSAY} AS ma, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE p_mlp END AS ev FROM variants) v""")
def source_labels(spark, sf):
    lab = R.source_labels(F.expr(PHYLO), F.expr(ASSAY), F.col("p_tree"),
                          F.expr("CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE p_mlp END"))
    return view(spark, sf, "variants").select(*KEY, *[c.alias(n) for n, c in lab.items()])


@query("vus_reclass", f"""
SELECT {K4}, CASE WHEN p_tree >= 0.8::DOUBLE THEN 'Likely Pathogenic' WHEN p_tree >= 0.6::DOUBLE THEN 'Possibly Pathogenic'
 WHEN p_tree < 0.1::DOUBLE THEN 'Likely Benign' WHEN p_tree < 0.2::DOUBLE THEN 'Possibly Benign'
 ELSE 'Uncertain (Remains VUS)' END AS classification FROM variants""")
def vus_reclass(spark, sf):
    return view(spark, sf, "variants").select(*KEY, R.reclassify(F.col("p_tree")).alias("classification"))


@query("active_learning_priority", f"""
WITH {HIST}, sizes AS (SELECT gene, count(*) AS train_n FROM tr GROUP BY gene)
SELECT {K4}, nearby, round(d * sc * nv, 12) AS priority,
  CASE WHEN r = '' THEN 'moderate priority' ELSE r END AS reason
FROM (SELECT *, concat_ws('; ', CASE WHEN d > 0.3::DOUBLE THEN 'high model disagreement (' || printf('%.3f', d) || ')' END,
    CASE WHEN sc > 0.02::DOUBLE THEN 'data-scarce gene (' || train_n || ' training)' END, CASE WHEN nv > 0.5::DOUBLE THEN 'low positional coverage (' || nearby || ' nearby)' END) AS r
  FROM (SELECT v.*, n.nearby, z.train_n, round(abs(p_tree - p_mlp), 9) AS d, 1 / sqrt(CAST(z.train_n AS DOUBLE)) AS sc,
    1 / (1::DOUBLE + n.nearby) AS nv
   FROM variants v JOIN near n ON n.gene = v.gene AND n.aa_pos = v.aa_pos JOIN sizes z ON z.gene = v.gene) a) b""")
def active_learning_priority(spark, sf):
    v = view(spark, sf, "variants")
    out = S.priorities(v, v.filter("split = 'train'"), F.col("p_tree"), F.col("p_mlp"))
    return out.select(*KEY, "nearby", F.round("priority", 12).alias("priority"), "reason")


IND = [c for c in FE.FEATURE_ORDER if c not in K.FREQUENCY_FEATURES]
DEP = [c for c in FE.FEATURE_ORDER if c in K.FREQUENCY_FEATURES]


def sql_nonzero(columns):
    return " + ".join(f"count(*) FILTER (CAST({PF.vec_sql(c)} AS DOUBLE) <> 0)" for c in columns)


@query("frequency_independence", f"""
SELECT gene, {len(IND) + len(DEP)} AS total_features, {len(DEP)} AS frequency_dependent, {len(IND)} AS frequency_independent,
  round(100.0::DOUBLE * ({sql_nonzero(IND)}) / ({sql_nonzero(IND + DEP)}), 6) AS pct_independent FROM {PF.FULL} v GROUP BY gene""")
def frequency_independence(spark, sf):
    """Share of (non-zero) features of the full vector that do not depend on population frequency."""
    return FE.frequency_independence(PF.full_vector(spark, sf, ["gene"]), FE.FEATURE_ORDER, ["gene"])


@query("reliability_tier", """
WITH d AS (SELECT gene, p_tree AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
  FROM variants GROUP BY gene, p_tree),
c AS (SELECT *, sum(n) OVER (PARTITION BY gene ORDER BY s) - n AS below FROM d),
a AS (SELECT gene, CAST(sum(p * (2 * below + n)) AS DOUBLE) / CAST(2 * sum(p) * sum(n) AS DOUBLE) AS auc FROM c GROUP BY gene)
SELECT gene, round(auc, 9) AS auc, CASE WHEN auc >= 0.9::DOUBLE THEN 'HIGH confidence' WHEN auc >= 0.75::DOUBLE THEN 'MODERATE confidence'
 WHEN auc >= 0.65::DOUBLE THEN 'LOW confidence' ELSE 'UNRELIABLE' END AS status FROM a""")
def reliability_tier(spark, sf):
    from helixframe.operators import metrics as M
    auc = M.roc_auc(view(spark, sf, "variants"), ["gene"], "p_tree", "label")
    return auc.select("gene", F.round("roc_auc", 9).alias("auc"), R.reliability_tier(F.col("roc_auc")).alias("status"))
