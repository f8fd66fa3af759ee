"""Join operators over the annotation views."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import (aggregates as AG, domains as D, features as FE, lookups as L, neighbours as N, quality as Q, ranking as RK, structure as S,
                                  support, training as TR)
from helixframe.plans.features import FULL, full_vector, vec_sql
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K4 = ", ".join(KEY)
VK = "gene, aa_pos, aa_ref, aa_alt"


@query("annot_exact_then_position", f"""
SELECT {K4}, coalesce(e.score, p.mean_score, 0) AS score FROM variants v
LEFT JOIN annot_variant e ON e.gene = v.gene AND e.aa_pos = v.aa_pos AND e.aa_ref = v.aa_ref AND e.aa_alt = v.aa_alt
LEFT JOIN annot_position p ON p.gene = v.gene AND p.aa_pos = v.aa_pos""")
def annot_exact_then_position(spark, sf):
    out = L.exact_then_position(view(spark, sf, "variants"), view(spark, sf, "annot_variant"), view(spark, sf, "annot_position"),
                                "score", "out", position_value="mean_score")
    return out.select(*KEY, F.col("out").alias("score"))


CDNA_POS = "SELECT gene, cdna_pos, MAX(((cdna_pos * 7) % 300) / CAST(100 AS DOUBLE)) AS score FROM variants WHERE cdna_pos % 2 = 0 GROUP BY gene, cdna_pos"


def cdna_scores(spark, sf):
    v = view(spark, sf, "variants").filter("cdna_pos % 2 = 0")
    return v.groupBy("gene", "cdna_pos").agg(F.max(F.expr("((cdna_pos * 7) % 300) / CAST(100 AS DOUBLE)")).alias("score"))


@query("annot_exact_then_cdna", f"""
WITH c AS ({CDNA_POS})
SELECT {K4}, coalesce(e.score, c.score, 0) AS score FROM variants v
LEFT JOIN annot_variant e ON e.gene = v.gene AND e.aa_pos = v.aa_pos AND e.aa_ref = v.aa_ref AND e.aa_alt = v.aa_alt
LEFT JOIN c ON c.gene = v.gene AND c.cdna_pos = v.cdna_pos""")
def annot_exact_then_cdna(spark, sf):
    """The assay source falls back on the cDNA position."""
    out = L.exact_then_position(view(spark, sf, "variants"), view(spark, sf, "annot_variant"), cdna_scores(spark, sf),
                                "score", "out", position="cdna_pos")
    return out.select(*KEY, F.col("out").alias("score"))


@query("annot_position_only", f"""
WITH c AS ({CDNA_POS}) SELECT {K4}, coalesce(c.score, 0) AS score FROM variants v LEFT JOIN c ON c.gene = v.gene AND c.cdna_pos = v.cdna_pos""")
def annot_position_only(spark, sf):
    return L.by_key(view(spark, sf, "variants"), cdna_scores(spark, sf), ["gene", "cdna_pos"], {"score": 0.0}).select(*KEY, "score")


@query("annot_variant_only", f"""
SELECT {K4}, coalesce(e.score, 0) AS score FROM variants v
LEFT JOIN annot_variant e ON e.gene = v.gene AND e.aa_pos = v.aa_pos AND e.aa_ref = v.aa_ref AND e.aa_alt = v.aa_alt""")
def annot_variant_only(spark, sf):
    return L.by_key(view(spark, sf, "variants"), view(spark, sf, "annot_variant"), L.VARIANT_KEY, {"score": 0.0}).select(*KEY, "score")


@query("annot_gene_fallback", f"""
WITH own AS (SELECT * FROM annot_position WHERE gene NOT IN ('PALB2', 'RAD51D')),
shared AS (SELECT aa_pos, max(max_score) AS max_score FROM annot_position GROUP BY aa_pos)
SELECT {K4}, coalesce(CASE WHEN v.gene NOT IN ('PALB2', 'RAD51D') THEN o.max_score ELSE s.max_score END, 0) AS score
FROM variants v LEFT JOIN own o ON o.gene = v.gene AND o.aa_pos = v.aa_pos LEFT JOIN shared s ON s.aa_pos = v.aa_pos""")
def annot_gene_fallback(spark, sf):
    pos = view(spark, sf, "annot_position")
    shared = pos.groupBy("aa_pos").agg(F.max("max_score").alias("max_score"))
    out = L.gene_then_shared(view(spark, sf, "variants"), pos.filter("gene NOT IN ('PALB2', 'RAD51D')"), shared,
                             ["aa_pos"], "max_score", "score")
    return out.select(*KEY, "score")


@query("domain_range_join", f"""
SELECT {K4}, (SELECT arg_min(name, ord) FROM domains d WHERE d.gene = v.gene AND v.aa_pos BETWEEN d.start_aa AND d.end_aa) AS first_domain,
  (SELECT count(*) FROM domains d WHERE d.gene = v.gene AND v.aa_pos BETWEEN d.start_aa AND d.end_aa) AS n_domains FROM variants v""")
def domain_range_join(spark, sf):
    v = D.with_domains(view(spark, sf, "variants"), view(spark, sf, "domains"))
    d, p = F.col("domains"), F.col("aa_pos")
    return v.select(*KEY, D.first_hit(d, p).alias("first_domain"), D.count_hits(d, p).cast("bigint").alias("n_domains"))


@query("nearest_domain", f"""
SELECT {K4}, round(least(coalesce(min(CASE WHEN v.aa_pos BETWEEN d.start_aa AND d.end_aa THEN 0 ELSE least(abs(v.aa_pos - d.start_aa), abs(v.aa_pos - d.end_aa)) END), v.aa_len), v.aa_len)
  / CAST(v.aa_len AS DOUBLE), 12) AS distance FROM variants v LEFT JOIN domains d ON d.gene = v.gene GROUP BY {K4}, v.aa_len""")
def nearest_domain(spark, sf):
    v = D.with_domains(view(spark, sf, "variants"), view(spark, sf, "domains"))
    return v.select(*KEY, F.round(D.nearest_distance(F.col("domains"), F.col("aa_pos"), F.col("aa_len")), 12).alias("distance"))


@query("nearby_band_join", f"""
WITH h AS (SELECT gene, aa_pos, count(*) AS n FROM variants WHERE split = 'train' GROUP BY gene, aa_pos),
q AS (SELECT DISTINCT gene, aa_pos FROM variants),
c AS (SELECT q.gene, q.aa_pos, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS nearby FROM q LEFT JOIN h ON h.gene = q.gene AND abs(h.aa_pos - q.aa_pos) <= 50 GROUP BY q.gene, q.aa_pos)
SELECT {K4}, nearby FROM variants v JOIN c ON c.gene = v.gene AND c.aa_pos = v.aa_pos""")
def nearby_band_join(spark, sf):
    v = view(spark, sf, "variants")
    return support.nearby_counts(v, v.filter("split = 'train'")).select(*KEY, "nearby")


def _scored(spark, sf):
    """Test-split predictions, one row per protein variant."""
    t = view(spark, sf, "variants").filter("split = 'test'").select(*L.VARIANT_KEY, *KEY, "p_tree")
    return RK.keep_last(t, L.VARIANT_KEY, KEY).select(*L.VARIANT_KEY, "p_tree")


SCORED = f"""scored AS (SELECT {VK}, p_tree FROM (SELECT *, row_number() OVER (PARTITION BY {VK} ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
  FROM variants WHERE split = 'test') z WHERE rn = 1)"""


@query("benchmark_match", f"""
WITH {SCORED} SELECT {K4}, s.p_tree AS matched_p, s.p_tree IS NOT NULL AS matched FROM bench b
LEFT JOIN scored s ON s.gene = b.gene AND s.aa_pos = b.aa_pos AND s.aa_ref = b.aa_ref AND s.aa_alt = b.aa_alt""")
def benchmark_match(spark, sf):
    hit, miss = Q.match_benchmark(view(spark, sf, "bench").drop("p_tree"), _scored(spark, sf), L.VARIANT_KEY)
    return (hit.select(*KEY, F.col("p_tree").alias("matched_p"), F.lit(True).alias("matched"))
            .unionByName(miss.select(*KEY, F.lit(None).cast("double").alias("matched_p"), F.lit(False).alias("matched"))))


@query("overlap_flags", f"""
SELECT {K4}, EXISTS (SELECT 1 FROM variants t WHERE t.split <> 'test' AND t.gene = b.gene AND t.aa_pos = b.aa_pos AND t.aa_ref = b.aa_ref AND t.aa_alt = b.aa_alt) AS in_training,
  EXISTS (SELECT 1 FROM variants t WHERE t.split = 'test' AND t.gene = b.gene AND t.aa_pos = b.aa_pos AND t.aa_ref = b.aa_ref AND t.aa_alt = b.aa_alt) AS in_test FROM bench b""")
def overlap_flags(spark, sf):
    v = view(spark, sf, "variants")
    b = view(spark, sf, "bench").drop("in_training", "in_test")
    out = L.membership(b, v.filter("split <> 'test'"), L.VARIANT_KEY, "in_training")
    return L.membership(out, v.filter("split = 'test'"), L.VARIANT_KEY, "in_test").select(*KEY, "in_training", "in_test")


@query("novel_anti_join", f"""
SELECT {K4} FROM variants c WHERE split = 'cal' AND NOT EXISTS (SELECT 1 FROM variants t WHERE t.split = 'train' AND t.gene = c.gene AND t.aa_pos = c.aa_pos
  AND t.aa_ref = c.aa_ref AND t.aa_alt = c.aa_alt)""")
def novel_anti_join(spark, sf):
    v = view(spark, sf, "variants")
    return v.filter("split = 'cal'").join(v.filter("split = 'train'").select(*L.VARIANT_KEY), L.VARIANT_KEY, "left_anti").select(*KEY)


@query("holdout_semi_join", f"""
SELECT {K4} FROM variants v WHERE EXISTS (SELECT 1 FROM annot_variant a WHERE a.gene = v.gene AND a.aa_pos = v.aa_pos AND a.aa_ref = v.aa_ref AND a.aa_alt = v.aa_alt)""")
def holdout_semi_join(spark, sf):
    return view(spark, sf, "variants").join(view(spark, sf, "annot_variant"), L.VARIANT_KEY, "left_semi").select(*KEY)


@query("score_left_join_dedup", f"""
WITH p AS (SELECT {VK}, p_mlp FROM (SELECT *, row_number() OVER (PARTITION BY {VK} ORDER BY {K4}) AS rn FROM variants WHERE split = 'test') x WHERE rn = 1),
j AS (SELECT b.*, p.p_mlp AS pred FROM bench b LEFT JOIN p ON p.gene = b.gene AND p.aa_pos = b.aa_pos AND p.aa_ref = b.aa_ref AND p.aa_alt = b.aa_alt)
SELECT {VK}, source, pred, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY {VK}, source ORDER BY {K4}) AS rn FROM j) y WHERE rn = 1""")
def score_left_join_dedup(spark, sf):
    test = view(spark, sf, "variants").filter("split = 'test'").select(*L.VARIANT_KEY, *KEY, F.col("p_mlp").alias("pred"))
    pred = RK.keep_first(test, L.VARIANT_KEY, KEY).select(*L.VARIANT_KEY, "pred")
    b = RK.keep_first(view(spark, sf, "bench").select(*L.VARIANT_KEY, "source", *KEY), [*L.VARIANT_KEY, "source"], KEY)
    return b.join(pred, L.VARIANT_KEY, "left").select(*L.VARIANT_KEY, "source", "pred", "l_orderkey")


@query("multi_predictor_join", f"""
WITH hits AS (SELECT {K4}, gene, unnest([aa_pos, aa_pos + 1]) AS pos, aa_ref, aa_alt, p_mlp AS revel, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE p_tree * 40 END AS cadd FROM variants WHERE split = 'cal'),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene, pos, aa_ref, aa_alt ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, pos DESC) AS rn FROM hits) x WHERE rn = 1)
SELECT b.l_orderkey, b.l_linenumber, b.l_partkey, b.l_suppkey, h.revel, h.cadd FROM bench b LEFT JOIN last h ON h.gene = b.gene AND h.pos = b.aa_pos AND h.aa_ref = b.aa_ref AND h.aa_alt = b.aa_alt""")
def multi_predictor_join(spark, sf):
    hits = view(spark, sf, "variants").filter("split = 'cal'").select(
        *KEY, "gene", F.expr("array(aa_pos, aa_pos + 1)").alias("positions"), "aa_ref", "aa_alt", F.col("p_mlp").alias("revel"),
        F.expr("CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE p_tree * 40 END").alias("cadd"))
    out = Q.attach_predictors(view(spark, sf, "bench"), hits, ["revel", "cadd"], KEY)
    return out.select(*KEY, "revel", "cadd")


@query("position_known_pathogenic", f"SELECT {K4}, same_position FROM ev_in")
def position_known_pathogenic(spark, sf):
    from helixframe.plans.evidence import known_pathogenic
    v = view(spark, sf, "variants")
    return L.membership(v, known_pathogenic(v), ["gene", "aa_pos"], "same_position").select(*KEY, "same_position")


FOUNDERS = """SELECT gene, 'c.' || CAST(cdna_pos AS STRING) || mutation AS hgvs_c, l_orderkey AS ord, l_linenumber AS ord2, l_partkey AS ord3, l_suppkey AS ord4 FROM variants WHERE label = 1"""


@query("founder_lookup", f"""
WITH f0 AS ({FOUNDERS}), f AS (SELECT gene, hgvs_c, ord, ord2, ord3, ord4 FROM (SELECT *, row_number() OVER (PARTITION BY gene, hgvs_c ORDER BY ord, ord2, ord3, ord4) AS rn FROM f0) x WHERE rn = 1),
q AS (SELECT DISTINCT gene, cdna_pos, mutation FROM variants),
ex AS (SELECT q.gene, q.cdna_pos, q.mutation, f.hgvs_c FROM q JOIN f ON f.gene = q.gene AND f.hgvs_c = 'c.' || q.cdna_pos || q.mutation),
ap AS (SELECT d.gene, d.cdna_pos, arg_min(f.hgvs_c, (f.ord, f.ord2, f.ord3, f.ord4)) AS hgvs_c FROM (SELECT DISTINCT gene, cdna_pos FROM q) d
  JOIN f ON f.gene = d.gene AND contains(f.hgvs_c, CAST(d.cdna_pos AS VARCHAR)) GROUP BY d.gene, d.cdna_pos)
SELECT q.gene, q.cdna_pos, q.mutation, coalesce(ex.hgvs_c, ap.hgvs_c) AS founder,
  CASE WHEN ex.hgvs_c IS NOT NULL THEN 'exact' WHEN ap.hgvs_c IS NOT NULL THEN 'position_approximate' END AS match_type
FROM q LEFT JOIN ex USING (gene, cdna_pos, mutation) LEFT JOIN ap ON ap.gene = q.gene AND ap.cdna_pos = q.cdna_pos""")
def founder_lookup(spark, sf):
    v = view(spark, sf, "variants")
    founders = v.filter("label = 1").selectExpr(
        "gene", "'c.' || CAST(cdna_pos AS STRING) || mutation AS hgvs_c", "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord")
    out = N.founder_match(v.select("gene", "cdna_pos", "mutation").distinct(), founders)
    return out.select("gene", "cdna_pos", "mutation", "founder", "match_type")


@query("id_either_key_join", """
WITH r AS (SELECT l_partkey AS key, min(eval_year) AS year FROM variants WHERE split = 'train' GROUP BY l_partkey)
SELECT o.o_orderkey, coalesce(a.year, b.year) AS year FROM orders o LEFT JOIN r a ON a.key = o.o_orderkey LEFT JOIN r b ON b.key = o.o_custkey""")
def id_either_key_join(spark, sf):
    rel = view(spark, sf, "variants").filter("split = 'train'").groupBy(F.col("l_partkey").alias("key")).agg(F.min("eval_year").alias("year"))
    out = L.either_key(view(spark, sf, "orders").select("o_orderkey", "o_custkey"), rel, "o_orderkey", "o_custkey", "key", "year", "year")
    return out.select("o_orderkey", "year")


VECTOR_SIZE = 64  # elements of the supplied vectors


@query("cross_id_row_align", f"""
SELECT e.vec_id, {', '.join(f'coalesce(CAST(x.embedding[{i + 1}] AS DOUBLE), 0) AS extra_{i}' for i in range(VECTOR_SIZE))},
  CASE WHEN x.vec_id IS NULL THEN 0 ELSE 1 END AS has_extra
FROM embeddings e LEFT JOIN (SELECT * FROM embeddings WHERE label % 2 = 0) x ON x.vec_id = e.vec_id""")
def cross_id_row_align(spark, sf):
    e = view(spark, sf, "embeddings")
    return Q.align_vectors(e.select("vec_id"), e.filter("label % 2 = 0"), "vec_id", "embedding", "extra", VECTOR_SIZE)


SCALED = [c for c in FE.FEATURE_ORDER if not AG.is_leak(c)]
ROW_ID = "(l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 31 + l_suppkey) % 1000000"
VARIANT = "aa_ref || CAST(aa_pos AS VARCHAR) || aa_alt"


@query("contrastive_neighbour", f"""
WITH f AS MATERIALIZED (SELECT {K4}, gene, split, label, p_tree, {VARIANT} AS name, {ROW_ID} AS id, {', '.join(f'CAST({vec_sql(c)} AS DOUBLE) AS "x_{c}"' for c in SCALED)} FROM {FULL} v),
m AS (SELECT {', '.join(f'avg("x_{c}") AS "m_{c}", CASE WHEN stddev_pop("x_{c}") = 0 THEN 1 ELSE stddev_pop("x_{c}") END AS "s_{c}"' for c in SCALED)} FROM f WHERE split = 'train'),
x AS MATERIALIZED (SELECT {K4}, gene, split, label, name, id, CASE WHEN p_tree > 0.5::DOUBLE THEN 0 ELSE 1 END AS side,
  [{', '.join(f'("x_{c}" - "m_{c}") / "s_{c}"' for c in SCALED)}] AS v FROM f, m),
t AS MATERIALIZED (SELECT gene, label, id, min(name) AS name, min(v) AS v FROM x WHERE split = 'train' GROUP BY gene, label, id),
b AS (SELECT q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey, min({{'d': round(list_distance(q.v, t.v), 9), 'id': t.id}}) AS e
  FROM x q JOIN t ON t.gene = q.gene AND t.label = q.side WHERE q.split = 'test' GROUP BY ALL),
c AS (SELECT q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey, q.v, b.e.d AS d, t.name AS other, t.v AS w FROM x q JOIN b USING ({K4}) JOIN t ON t.gene = q.gene AND t.label = q.side AND t.id = b.e.id WHERE q.split = 'test'),
g AS (SELECT *, row_number() OVER (PARTITION BY {K4} ORDER BY round(gap, 9) DESC, place) AS rank FROM (
  SELECT {K4}, unnest(list_transform(list_zip(v, w), lambda e: abs(e[1] - e[2]))) AS gap, unnest(range(len(v))) AS place FROM c) u),
top AS (SELECT {K4}, string_agg(list_extract([{', '.join(f"'{c}'" for c in SCALED)}], place + 1) || ':' || CASE WHEN round(gap, 9) > 2 THEN 'high' WHEN round(gap, 9) > 1 THEN 'moderate' ELSE 'low' END, ',' ORDER BY rank) AS differences
  FROM g WHERE rank <= 5 AND round(gap, 9) >= 0.01::DOUBLE GROUP BY {K4})
SELECT q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey, CASE WHEN differences IS NOT NULL THEN other END AS contrast_variant,
  CASE WHEN differences IS NOT NULL THEN CASE WHEN side = 1 THEN 'Pathogenic' ELSE 'Benign' END END AS contrast_class,
  CASE WHEN differences IS NOT NULL THEN round(d, 4) END AS contrast_distance, differences
FROM x q LEFT JOIN c USING ({K4}) LEFT JOIN top USING ({K4}) WHERE q.split = 'test'""")
def contrastive_neighbour(spark, sf):
    """Nearest training variant of the opposite class in the same gene, on the full scaled vector, and what sets it apart."""
    keep = [*KEY, "gene", "split", "label", "p_tree", F.concat("aa_ref", F.col("aa_pos").cast("string"), "aa_alt").alias("name"), F.expr(ROW_ID).alias("id")]
    table = TR.feature_table(full_vector(spark, sf, keep), SCALED, "label", [*KEY, "gene", "split", "p_tree", "name", "id"])
    table = TR.scaled(table, table.filter("split = 'train'"), len(SCALED))
    train = table.filter("split = 'train'").select("gene", F.col("label").cast("int").alias("label"), "id", "x", "name")
    out = N.contrast(table.filter("split = 'test'").select(*KEY, "gene", "p_tree", "x"), train, ["gene"], "p_tree", "label", "x", "id", SCALED)
    names = train.groupBy(F.col("id").alias("contrast_id")).agg(F.min("name").alias("contrast_variant"))
    shown = F.array_join(F.transform("key_differences", lambda d: F.concat(d["feature"], F.lit(":"), d["importance"])), ",")
    return out.join(names, "contrast_id", "left").select(*KEY, "contrast_variant", "contrast_class", "contrast_distance", shown.alias("differences"))


@query("residue_density", """
WITH d AS (SELECT a.structure, a.resnum, count(*) - 1 AS density FROM residue_xyz a JOIN residue_xyz b ON b.structure = a.structure
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 100 GROUP BY a.structure, a.resnum)
SELECT structure, resnum, density, round(CASE WHEN mx > mn THEN 1 - (density - mn) / CAST(mx - mn AS DOUBLE) ELSE 0.5::DOUBLE END, 3) AS rsa
FROM (SELECT *, min(density) OVER (PARTITION BY structure) AS mn, max(density) OVER (PARTITION BY structure) AS mx FROM d) z""")
def residue_density(spark, sf):
    out = S.residue_density(view(spark, sf, "residue_xyz"), ["structure"])
    return out.select("structure", "resnum", "density", F.round("rsa", 3).alias("rsa"))


@query("residue_fragment_union", """
WITH f AS (SELECT structure, 0 AS fragment, resnum, x, plddt FROM residue_xyz WHERE resnum <= 250
  UNION ALL SELECT structure, 1, resnum, x + 1, plddt / 2 FROM residue_xyz WHERE resnum > 150)
SELECT structure, resnum, arg_max(x, fragment) AS x, arg_max(plddt, fragment) AS plddt FROM f GROUP BY structure, resnum""")
def residue_fragment_union(spark, sf):
    r = view(spark, sf, "residue_xyz")
    first = r.filter("resnum <= 250").select("structure", F.lit(0).alias("fragment"), "resnum", "x", "plddt")
    second = r.filter("resnum > 150").selectExpr("structure", "1 AS fragment", "resnum", "x + 1 AS x", "plddt / 2 AS plddt")
    return S.merge_fragments([first, second], ["structure", "resnum"], "fragment").select("structure", "resnum", "x", "plddt")


@query("structure_tier_merge", """
WITH sp AS (SELECT s.structure, CAST(p AS BIGINT) AS resnum FROM (SELECT DISTINCT structure FROM residue_xyz) s, unnest(range(1, 421)) u(p)),
ex AS (SELECT structure, resnum FROM residue_xyz WHERE p_partkey % 3 = 0), af AS (SELECT structure, resnum, plddt FROM residue_xyz WHERE p_partkey % 4 <> 0)
SELECT sp.structure, sp.resnum, coalesce(af.plddt, 0) AS af_plddt, CASE WHEN ex.resnum IS NOT NULL THEN 'PDB_experimental' WHEN af.plddt >= 70 THEN 'AlphaFold_v4' ELSE 'curated_estimate' END AS data_tier
FROM sp LEFT JOIN ex ON ex.structure = sp.structure AND ex.resnum = sp.resnum LEFT JOIN af ON af.structure = sp.structure AND af.resnum = sp.resnum""")
def structure_tier_merge(spark, sf):
    r = view(spark, sf, "residue_xyz")
    lengths = r.select("structure").distinct().withColumn("length", F.lit(420).cast("bigint"))
    out = S.merge_tiers(lengths, r.filter("p_partkey % 3 = 0").select("structure", "resnum"),
                        r.filter("p_partkey % 4 <> 0").select("structure", "resnum", "plddt"), "structure")
    return out.select("structure", "resnum", "af_plddt", "data_tier")


@query("position_chain_fallback", f"""
WITH c AS ({CDNA_POS}) SELECT {K4}, coalesce(a.score, b.score, 0) AS score FROM (SELECT *, cdna_pos + l_partkey % 2 AS cp FROM variants) v
LEFT JOIN c a ON a.gene = v.gene AND a.cdna_pos = v.cp LEFT JOIN c b ON b.gene = v.gene AND b.cdna_pos = v.cp - 1""")
def position_chain_fallback(spark, sf):
    v = view(spark, sf, "variants").withColumn("cdna_pos", F.expr("cdna_pos + l_partkey % 2"))
    return L.position_chain(v, cdna_scores(spark, sf), "score", "out").select(*KEY, F.col("out").alias("score"))


@query("residue_region_distance", """
SELECT a.structure, a.resnum, round(coalesce(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 999), 9) AS dist
FROM residue_xyz a LEFT JOIN residue_xyz b ON b.structure = a.structure AND b.resnum <> a.resnum AND (b.resnum BETWEEN 100 AND 140 OR b.resnum BETWEEN 300 AND 320)
GROUP BY a.structure, a.resnum""")
def residue_region_distance(spark, sf):
    out = S.region_distance(view(spark, sf, "residue_xyz"), ["structure"], [(100, 140), (300, 320)])
    return out.select("structure", "resnum", F.round("dist", 9).alias("dist"))
