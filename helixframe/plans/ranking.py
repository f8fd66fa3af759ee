"""Windows, ranking, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import evidence as EV
from helixframe.operators import annotate as A, benchmark as B, lookups as L, ranking as RK, sampling as SA, support as S
from helixframe.plans.evidence import AF_POP, HIST, K4, KEY, POP, SPARSE, inputs, sql_codes
from helixframe.plans.fixtures import view
from helixframe.plans.registry import query

VK = "gene, aa_pos, aa_ref, aa_alt"


@query("topn_per_gene", f"""
WITH {HIST}, sizes AS (SELECT gene, count(*) AS train_n FROM tr GROUP BY gene),
p AS (SELECT v.*, round(abs(p_tree - p_mlp) / sqrt(CAST(z.train_n AS DOUBLE)) / (1::DOUBLE + n.nearby), 12) AS priority FROM variants v JOIN near n ON n.gene = v.gene AND n.aa_pos = v.aa_pos JOIN sizes z ON z.gene = v.gene)
SELECT gene, {K4}, priority, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY gene ORDER BY priority DESC, {K4}) AS INT) AS rank FROM p) x WHERE rank <= 50""")
def topn_per_gene(spark, sf):
    v = view(spark, sf, "variants")
    p = S.priorities(v, v.filter("split = 'train'"), F.col("p_tree"), F.col("p_mlp")).withColumn("priority", F.round("priority", 12))
    out = RK.top_n(p, ["gene"], [F.col("priority").desc(), *[F.col(k) for k in KEY]], 50)
    return out.select("gene", *KEY, "priority", "rank")


CON = {"a_tree": "p_tree - 0.4D", "b_mlp": "0.5D - p_mlp", "c_af": "af * 100", "d_eas": "-af_eas * 100", "e_nfe": "af_nfe * 100", "f_pos": "aa_pos / 4000D - 0.5D",
       "g_cdna": "(cdna_pos % 7 - 3) / 7D", "h_year": "(eval_year - 2020) / 10D", "i_label": "label * 0.00001D", "j_zero": "aa_pos * 0D"}
UN = " UNION ALL ".join(f"SELECT {K4}, '{n}' AS feature, {e.replace('D', '::DOUBLE')} AS value FROM variants" for n, e in CON.items())


@query("topk_contributions", f"""
SELECT {K4}, rank, feature, round(value, 9) AS value, CASE WHEN value > 0 THEN 'pathogenic' ELSE 'benign' END AS direction FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY {K4} ORDER BY abs(value) DESC, feature) AS INT) AS rank FROM ({UN}) u WHERE abs(value) >= 0.0001::DOUBLE) x WHERE rank <= 8""")
def topk_contributions(spark, sf):
    """Top eight per row, near-zero ones left out; the array never leaves its row."""
    top = RK.top_contributions({n: F.expr(e) for n, e in CON.items()}, 8, 0.0001)
    # exploded as an expression: of a column of its own Spark asks first whether it is empty, and works it out for that once more
    out = view(spark, sf, "variants").select(*KEY, F.posexplode(top).alias("i", "t"))
    return out.select(*KEY, (F.col("i") + 1).alias("rank"), F.col("t.feature").alias("feature"), F.round("t.value", 9).alias("value"), F.col("t.direction").alias("direction"))


DIFF = {"af": ("af * 1000", "af_eas * 1000"), "freq": ("af_nfe * 1000", "af_afr * 1000"), "prob": ("p_tree * 3", "p_mlp * 3"), "pos": ("aa_pos / 1000D", "cdna_pos / 3000D"),
        "year": ("eval_year / 1D", "2018D"), "label": ("label * 1D", "p_tree"), "len": ("aa_len / 1000D", "aa_pos / 1000D")}
DUN = " UNION ALL ".join(f"SELECT {K4}, '{n}' AS feature, abs({a.replace('D', '::DOUBLE')} - {b.replace('D', '::DOUBLE')}) AS d FROM variants" for n, (a, b) in DIFF.items())


@query("topk_feature_diffs", f"""
SELECT {K4}, rank, feature, round(d, 9) AS difference, CASE WHEN d > 2 THEN 'high' WHEN d > 1 THEN 'moderate' ELSE 'low' END AS importance FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY {K4} ORDER BY d DESC, feature) AS INT) AS rank FROM ({DUN}) u) x WHERE rank <= 5 AND d >= 0.01::DOUBLE""")
def topk_feature_diffs(spark, sf):
    top = RK.top_differences({n: (F.expr(a), F.expr(b)) for n, (a, b) in DIFF.items()})
    out = view(spark, sf, "variants").select(*KEY, F.posexplode(top).alias("i", "t"))
    return out.select(*KEY, (F.col("i") + 1).alias("rank"), F.col("t.feature").alias("feature"), F.round("t.difference", 9).alias("difference"), F.col("t.importance").alias("importance"))


@query("latest_per_variant", """
SELECT gene, variant, event_id, prediction FROM (SELECT *, row_number() OVER (PARTITION BY gene, variant ORDER BY ts DESC, event_id DESC) AS rn FROM cohort_obs) x WHERE rn = 1""")
def latest_per_variant(spark, sf):
    obs = view(spark, sf, "cohort_obs").select("gene", "variant", "event_id", "prediction", "ts")
    return RK.keep_last(obs, ["gene", "variant"], ["ts", "event_id"]).select("gene", "variant", "event_id", "prediction")


@query("side_by_side", """
WITH s AS (SELECT *, l_linenumber % 2 AS slot FROM variants),
f AS (SELECT l_orderkey, slot, arg_min(p_tree, (l_linenumber, l_partkey, l_suppkey)) AS p, arg_min(aa_ref || aa_pos || aa_alt, (l_linenumber, l_partkey, l_suppkey)) AS v FROM s GROUP BY l_orderkey, slot)
SELECT a.l_orderkey, a.v AS left_variant, b.v AS right_variant, a.p AS left_p, b.p AS right_p, round(a.p - b.p, 9) AS delta FROM f a JOIN f b ON b.l_orderkey = a.l_orderkey AND a.slot = 0 AND b.slot = 1""")
def side_by_side(spark, sf):
    v = view(spark, sf, "variants").select("l_orderkey", (F.col("l_linenumber") % 2).alias("slot"), "l_linenumber", "l_partkey", "l_suppkey",
                                           F.concat("aa_ref", F.col("aa_pos").cast("string"), "aa_alt").alias("variant"), F.col("p_tree").alias("p"))
    out = B.side_by_side(v, ["l_orderkey"], "slot", ["variant", "p"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("l_orderkey", "left_variant", "right_variant", "left_p", "right_p", F.round(F.col("left_p") - F.col("right_p"), 9).alias("delta"))


SHUFFLED = "(l_orderkey * 104729 + l_partkey * 7919 + l_linenumber * 13 + l_suppkey * 31) % 1000003"
BACKGROUND, RECENT = 100, 50  # rows of the sample and of the report: both are the feature


@query("sample_background", f"SELECT {K4}, gene, p_tree FROM variants ORDER BY {SHUFFLED}, {K4} LIMIT {BACKGROUND}")
def sample_background(spark, sf):
    """Sample of rows without replacement in a shuffled order that SQL can repeat."""
    return SA.seeded_sample(view(spark, sf, "variants"), KEY, BACKGROUND, order=F.expr(SHUFFLED)).select(*KEY, "gene", "p_tree")


@query("recent_analyses", f"SELECT event_id, gene, prediction, probability FROM cohort_obs ORDER BY ts DESC, event_id DESC LIMIT {RECENT}")
def recent_analyses(spark, sf):
    return view(spark, sf, "cohort_obs").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(RECENT).select("event_id", "gene", "prediction", "probability")


@query("sort_predictions", f"SELECT gene, p_tree, {K4} FROM variants ORDER BY gene, p_tree DESC, {K4}")
def sort_predictions(spark, sf):
    return view(spark, sf, "variants").select("gene", "p_tree", *KEY).orderBy("gene", F.col("p_tree").desc(), *KEY)


@query("keep_first_dedup", f"""
SELECT {VK}, source, p_tree, {K4} FROM (SELECT *, row_number() OVER (PARTITION BY {VK}, source ORDER BY {K4}) AS rn FROM bench) x WHERE rn = 1""")
def keep_first_dedup(spark, sf):
    b = view(spark, sf, "bench").select(*L.VARIANT_KEY, "source", "p_tree", *KEY)
    return RK.keep_first(b, [*L.VARIANT_KEY, "source"], KEY).select(*L.VARIANT_KEY, "source", "p_tree", *KEY)


@query("union_sources", """
SELECT source, gene, count(*) AS n, count(dms_score) AS n_scored FROM (SELECT 'assay' AS source, gene, dms_score FROM bench WHERE source = 'assay'
 UNION ALL SELECT 'expert', gene, NULL FROM bench WHERE source = 'expert') x GROUP BY source, gene""")
def union_sources(spark, sf):
    b = view(spark, sf, "bench")
    u = b.filter("source = 'assay'").select("source", "gene", "dms_score").unionByName(b.filter("source = 'expert'").select("source", "gene"), allowMissingColumns=True)
    return u.groupBy("source", "gene").agg(F.count(F.lit(1)).alias("n"), F.count("dms_score").alias("n_scored"))


@query("set_merge_positions", """
WITH a AS (SELECT DISTINCT gene, aa_pos FROM variants WHERE label = 1 AND eval_year < 2018), b AS (SELECT DISTINCT gene, aa_pos FROM variants WHERE label = 1 AND eval_year = 2018),
o AS (SELECT DISTINCT gene, aa_pos FROM variants WHERE label = 1 AND eval_year < 2016), m AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT coalesce(m.gene, o.gene) AS gene, coalesce(m.aa_pos, o.aa_pos) AS aa_pos, CASE WHEN o.gene IS NULL THEN 'added' WHEN m.gene IS NULL THEN 'removed' ELSE 'same' END AS status
FROM m FULL JOIN o ON o.gene = m.gene AND o.aa_pos = m.aa_pos""")
def set_merge_positions(spark, sf):
    v = view(spark, sf, "variants").filter("label = 1")
    pos = lambda c: v.filter(c).select("gene", "aa_pos")
    return B.merge_sets([pos("eval_year < 2018"), pos("eval_year = 2018")], pos("eval_year < 2016"), ["gene", "aa_pos"])


@query("code_set_diff", f"""
SELECT {K4}, array_to_string(list_sort(list_filter(string_split(b, ','), lambda x: x <> '' AND NOT list_contains(string_split(a, ','), x))), ',') AS gained,
  array_to_string(list_sort(list_filter(string_split(a, ','), lambda x: x <> '' AND NOT list_contains(string_split(b, ','), x))), ',') AS lost
FROM (SELECT *, {sql_codes()} AS a, {sql_codes(AF_POP, SPARSE)} AS b FROM (SELECT *, {POP} AS pop FROM ev_in) q) z""")
def code_set_diff(spark, sf):
    e = inputs(spark, sf).withColumn("pop", F.expr(POP))
    a, b = EV.code_list(A.rules_for(F.col("p_tree"))), EV.code_list(A.rules_for(F.col("p_tree"), F.col("pop")))
    gained, lost = B.set_difference(F.col("a"), F.col("b"))
    return e.withColumn("a", a).withColumn("b", b).select(*KEY, F.array_join(gained, ",").alias("gained"), F.array_join(lost, ",").alias("lost"))


@query("subset_views", """
SELECT subset, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pathogenic FROM (SELECT 'all' AS subset, label FROM bench UNION ALL SELECT 'no_training_overlap', label FROM bench WHERE NOT in_training
 UNION ALL SELECT 'test_only', label FROM bench WHERE in_test UNION ALL SELECT 'novel_only', label FROM bench WHERE NOT in_training AND NOT in_test) x GROUP BY subset""")
def subset_views(spark, sf):
    b = view(spark, sf, "bench").withColumn("subset", F.explode(B.subset_names(F.col("in_training"), F.col("in_test"))))
    return b.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_pathogenic"))
