"""Statistics against brute force in numpy, on data with ties and a hot value."""

import math
import re

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from helixframe.operators import aggregates as AG, calibration as C, metrics as M, neighbours as N, ranking as RK, sampling as SA, training as TR, vectors as VE
from helixframe.session import materialise
from helixframe.sources import writers as WR


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    n = 600
    y = rng.integers(0, 2, n)
    a = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    b = np.round(np.clip(rng.normal(0.45 + 0.1 * y, 0.2), 0, 1), 2)
    a[: n // 3] = 0.5  # one score holds a third of the rows
    rows = [(int(i), "g", float(p), float(q), int(t)) for i, (p, q, t) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "id int, gene string, a double, b double, label int"), a, b, y


def auc(s, y):
    p, n = s[y == 1], s[y == 0]
    return float(np.mean((p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None])))


def test_auc_and_single_class(spark, scored):
    df, a, _, y = scored
    assert M.roc_auc(df, ["gene"], "a", "label").first()["roc_auc"] == pytest.approx(auc(a, y))
    assert M.roc_auc(df.filter("label = 1"), ["gene"], "a", "label").first()["roc_auc"] is None


def test_delong_matches_components(scored):
    df, a, b, y = scored
    def comp(s):
        p, n = s[y == 1], s[y == 0]
        w = (p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None])
        return w.mean(1), w.mean(0)
    (a10, a01), (b10, b01) = comp(a), comp(b)
    z = (a10.mean() - b10.mean()) / math.sqrt(np.var(a10 - b10, ddof=1) / len(a10) + np.var(a01 - b01, ddof=1) / len(a01))
    got = M.delong(df, ["gene"], "a", "b", "label").withColumn("p", M.two_sided_p(F.col("z"))).first()
    assert got["z"] == pytest.approx(z, rel=1e-9) and got["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_spearman_and_median(scored):
    df, a, b, _ = scored
    def ranks(v):
        return np.array([np.sum(v < x) + (np.sum(v == x) + 1) / 2 for x in v])
    assert M.spearman(df, ["gene"], "a", "b").first()["spearman_r"] == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
    counts = df.groupBy("gene", F.col("b").alias("score")).agg(F.count("*").alias("n"))
    assert M.median_by_counts(counts, ["gene"]).first()["median"] == pytest.approx(np.median(b))


def test_conformal_quantile(scored):
    df, a, _, y = scored
    s = np.where(y == 1, 1 - a, a)
    n = len(s)
    want = np.quantile(s, min(math.ceil((n + 1) * 0.9) / n, 1.0))
    got = {r["gene"]: r for r in C.conformal_fit(df, "gene", "a", "label").collect()}
    assert got["g"]["quantile"] == pytest.approx(want) and got["_global"]["quantile"] == pytest.approx(want)
    few = {r["gene"]: r for r in C.conformal_fit(df.withColumn("gene", F.when(F.col("id") < 5, "few").otherwise("g")), "gene", "a", "label").collect()}
    assert few["few"]["is_fallback"] and few["few"]["quantile"] == few["_global"]["quantile"]


def test_isotonic_is_monotone_and_exact(scored):
    df, a, _, y = scored
    blocks = C.isotonic_fit(df, "gene", "a", "label")
    got = sorted((r["lo"], r["hi"], r["mean"]) for r in blocks.filter("gene = 'g'").collect())
    assert all(x[2] < z[2] and x[1] < z[0] for x, z in zip(got, got[1:]))
    assert all(m == pytest.approx(y[(a >= lo) & (a <= hi)].mean()) for lo, hi, m in got)
    out = C.isotonic_apply(df, blocks, "gene", "a")
    sliced = C.isotonic_apply(df, blocks, "gene", "a", array_blocks=0)
    assert sorted(map(str, out.select("id", F.round("calibrated", 9)).collect())) == sorted(map(str, sliced.select("id", F.round("calibrated", 9)).collect()))
    assert out.count() == len(a) and out.filter("calibrated IS NULL").count() == 0


def test_beta_interval(spark):
    # Beta(1, 1) is uniform; Beta(1, n + 1) has the closed form 1 - (1 - q) ** (1 / (n + 1))
    df = spark.createDataFrame([(0.5, 0.0), (0.0, 20.0)], "p double, n double")
    u, e = [r[0] for r in df.select(C.beta_interval(F.col("p"), F.col("n"))).collect()]
    assert u == pytest.approx([0.025, 0.975], abs=1e-9)
    assert e == pytest.approx([1 - 0.975 ** (1 / 21), 1 - 0.025 ** (1 / 21)], abs=1e-9)


@pytest.mark.parametrize("dims", [3, 40])
def test_nearest_is_exact_with_small_cells(spark, dims):
    rng = np.random.default_rng(dims)
    t, q = rng.normal(size=(400, dims)).round(2), rng.normal(size=(60, dims)).round(2)
    t[:130] = t[rng.integers(130, 140, 130)]  # many copies of few vectors
    t[:40, 0] += 0.01
    q[:10] = t[rng.integers(0, 400, 10)]
    train = spark.createDataFrame([("k" if i % 3 else "z", [float(x) for x in v], i) for i, v in enumerate(t)], "k string, x array<double>, id long")
    qs = spark.createDataFrame([("k", [float(x) for x in v], i) for i, v in enumerate(q)] + [("k", None, 99)], "k string, x array<double>, q int")
    for size in ({}, {"pivots": 5, "cell_rows": 25}):
        got = {}
        for r in N.nearest(qs, train, ["k"], "x", "id", k=3, **size).collect():
            got.setdefault(r["q"], []).append((r["distance"], r["neighbour_id"]))
        assert got.pop(99) == [(None, None)]
        for i, found in got.items():
            d = np.round(np.sqrt(((t - q[i]) ** 2).sum(1)), 9)
            assert sorted(found) == sorted((x, n) for n, x in enumerate(d.tolist()) if n % 3)[:3]


def test_contrast_names_what_differs(spark):
    train = spark.createDataFrame([("g", 0, 1, [0.0, 0.0, 5.0]), ("g", 1, 2, [0.0, 1.0, 0.0]), ("g", 1, 2, [0.0, 1.0, 0.0])], "gene string, label int, id long, x array<double>")
    qs = spark.createDataFrame([("g", 0.9, [0.5, 0.0, 0.005], 1), ("g", 0.1, [0.0, 2.5, 0.0], 2), ("g", 0.1, [0.0, 1.0, 0.0], 3), ("h", 0.9, [0.0, 0.0, 0.0], 4)],
                               "gene string, p double, x array<double>, q int")
    got = {r["q"]: r for r in N.contrast(qs, train, ["gene"], "p", "label", "x", "id", ["a", "b", "c"]).collect()}
    assert [tuple(d) for d in got[1]["key_differences"]] == [("c", 0.005, 5.0, 4.995, "high"), ("a", 0.5, 0.0, 0.5, "low")]
    assert (got[1]["contrast_id"], got[1]["contrast_class"]) == (1, "Benign")
    assert (got[2]["contrast_id"], got[2]["contrast_class"], got[2]["contrast_distance"], got[2]["key_differences"][0]["importance"]) == (2, "Pathogenic", 1.5, "moderate")
    assert len(got) == 4 and all(got[q][c] is None for q in (3, 4) for c in ("contrast_id", "contrast_class", "contrast_distance", "key_differences"))


def test_founder_containment(spark):
    f = spark.createDataFrame([("G", "c.5266dup", 1), ("G", "c.26A>G", 2)], "gene string, hgvs_c string, ord int")
    q = spark.createDataFrame([("G", 26, "A>G"), ("G", 52, "A>T"), ("G", 2, "A>T"), ("G", 99, "A>T")], "gene string, cdna_pos int, mutation string")
    got = {r["cdna_pos"]: (r["founder"], r["match_type"]) for r in N.founder_match(q, f).collect()}
    assert got == {26: ("c.26A>G", "exact"), 52: ("c.5266dup", "position_approximate"), 2: ("c.5266dup", "position_approximate"), 99: (None, None)}


def test_splits_are_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "big").otherwise("small"))
    run = lambda d: {r["id"]: r["split"] for r in SA.stratified_split(d, ["g"], SA.hash_order(["id"]), 2**53, ["id"]).collect()}
    first = run(df)
    assert first == run(df.repartition(7)) and sum(v == "train" for v in first.values()) == 600
    folds = SA.kfold(df, ["g"], SA.hash_order(["id"]), 2**53, ["id"], 10).groupBy("g", "fold").count().collect()
    assert {r["count"] for r in folds if r["g"] == "big"} == {90}


def test_keep_first_on_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), (3000 - F.col("id")).alias("o"), F.col("id").alias("v"))
    out = RK.keep_first(df, ["k"], ["o"])
    assert out.count() == 2001 - 0 - 0 and out.filter("k = 0").first()["v"] == 999


def test_slices_follow_the_scores(spark):
    df = spark.range(60_000).select((F.col("id") / 1e9).alias("narrow"), (F.col("id") * 1e6 - 3e9).alias("wide"), F.lit("g").alias("g"))
    for value in ("narrow", "wide"):
        sizes = [r["count"] for r in M.with_slices(df, ["g"], value).groupBy("_slice").count().collect()]
        assert len(sizes) > 100 and max(sizes) < 60_000 / 20
        ends = M.with_slices(df, ["g"], value).groupBy("_slice").agg(F.min(value).alias("a"), F.max(value).alias("b")).orderBy("_slice").collect()
        assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:]))


def test_nan_scores_are_missing(spark):
    rows = [("g", 0.1, 0), ("g", 0.9, 1), ("g", float("nan"), 1), ("g", None, 0)]
    r = M.roc_auc(spark.createDataFrame(rows, "gene string, s double, y int"), ["gene"], "s", "y").first()
    assert (r["n"], r["roc_auc"]) == (2, 1.0)


def test_nearest_keeps_all_queries(spark):
    train = spark.createDataFrame([("k", [0.0, 0.0], 7), ("k", [0.0, 0.0], 3)], "k string, x array<double>, id long")
    qs = spark.createDataFrame([("k", [1.0, 0.0], 1), ("k", [1.0, 0.0], 1), ("z", [0.0, 0.0], 2)], "k string, x array<double>, q int")
    got = sorted((r["k"], r["neighbour_id"], r["distance"]) for r in N.nearest(qs, train, ["k"], "x", "id").collect())
    assert got == [("k", 3, 1.0), ("k", 3, 1.0), ("z", None, None)]
    assert N.nearest(qs, train.limit(0), [], "x", "id").filter("neighbour_id IS NULL").count() == 3


def test_isotonic_tree(spark):
    """Blocks that reach over many nodes of the tree, against pooling in one list."""
    rng = np.random.default_rng(8)
    for shape in (lambda x: x, lambda x: 1 - x, lambda x: (x * 7) % 1, lambda x: 0.5 + 0 * x):
        x = np.sort(rng.random(3000))
        y = (rng.random(3000) < shape(x)).astype(int)
        df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(x, y)], "gene string, s double, y int")
        got = sorted((r["gene"], r["lo"], r["hi"], r["weight"], r["mean"]) for r in C.isotonic_fit(df, "gene", "s", "y", node_rows=15).collect())
        want = C._pool_adjacent(pd.DataFrame({"lo": x, "hi": x, "weight": 1.0, "mean": y.astype(float)}))
        want = [(g, *r) for g in ("_universal", "g") for r in want[["lo", "hi", "weight", "mean"]].itertuples(index=False, name=None)]
        assert len(got) == len(want) and all(a[:4] == b[:4] and a[4] == pytest.approx(b[4]) for a, b in zip(got, want))


def test_bootstrap_replicates(spark):
    rng = np.random.default_rng(9)
    s, y = rng.integers(0, 400, 3000) / 400, rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    got = {r["rep"]: (r["roc_auc"], r["pr_auc"]) for r in C.bootstrap_replicates(df, "s", "y", 40).collect()}
    counts = M.score_counts(df, [], "s", "y").select("score", "pos", "neg", *[F.xxhash64(F.lit(42), F.lit(c), "score").alias(f"key_{c}") for c in ("pos", "neg")])
    pdf = counts.toPandas().sort_values("score", ascending=False)
    pos, neg = (C.draws(pdf[f"key_{c}"].to_numpy(), pdf[c].to_numpy(float), 40) for c in ("pos", "neg"))
    for rep, (roc, pr) in got.items():
        p, n = pos[:, rep], neg[:, rep]
        tp, fp = np.cumsum(p), np.cumsum(n)
        assert roc == pytest.approx((n * (tp - p / 2)).sum() / (p.sum() * n.sum()))
        prec = np.append(1.0, np.where(tp + fp > 0, tp / np.maximum(tp + fp, 1), 1.0))
        assert pr == pytest.approx((p * (prec[1:] + prec[:-1]) / 2).sum() / p.sum())
    assert len(got) == 40
    ci = C.bootstrap_metric_ci(df, "s", "y", 200).first()
    assert ci["roc_auc_lo"] < M.roc_auc(df, [], "s", "y").first()["roc_auc"] < ci["roc_auc_hi"] and ci["replicates"] == 200


def test_areas_in_one_pass(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(rng.integers(0, 50)) / 50, int(rng.integers(0, 2))) for i in range(600)], "g string, s double, y int")
    got = {r["g"]: r for r in M.areas(df, ["g"], "s", "y").collect()}
    for r in M.roc_auc(df, ["g"], "s", "y").join(M.pr_metrics(df, ["g"], "s", "y"), "g").collect():
        assert all(got[r["g"]][c] == pytest.approx(r[c]) for c in ("n", "roc_auc", "pr_auc", "average_precision"))


def test_principal_axes(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 7)) * np.array([9, 5, 3, 2, 1, 0.5, 0.1]) + 4
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(-1, None)], "id long, x array<double>").repartition(40)
    got = {r["id"]: r["pca_components"] for r in VE.principal_components(df, "x", 3).collect()}
    c = x - x.mean(axis=0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:3]
    axes *= np.sign(axes[np.arange(3), np.argmax(np.abs(axes), axis=1)])[:, None]
    assert got.pop(-1) is None and np.allclose([got[i] for i in range(900)], c @ axes.T, atol=1e-6)
    assert VE.principal_components(df.limit(0), "x", 3).count() == 0


def test_profile_and_constant_columns(spark):
    df = spark.range(500).selectExpr("id", "7.0 AS same", "CAST(NULL AS DOUBLE) AS none", "IF(id = 499, 1.0, 0.0) AS rare", "IF(id % 2 = 0, NULL, 3) AS holes")
    got = {r["feature"]: r for r in AG.column_profile(df, ["id", "same", "none", "rare", "holes"]).collect()}
    assert [got[c]["constant"] for c in ("id", "same", "none", "rare", "holes")] == [False, True, True, False, True]
    assert (got["id"]["lo"], got["id"]["hi"], got["id"]["mean"], got["holes"]["n"]) == (0, 499, 249.5, 250) and got["id"]["std"] == pytest.approx(np.arange(500).std())
    assert AG.drop_constant(df, ["id", "same", "none", "rare", "holes"]).columns == ["id", "rare"]


def test_observations_are_appended_once(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "concat('v', id) AS v")
    path = str(tmp_path / "log")
    assert WR.read_observations(spark, path, "id long, v string").count() == 0
    for _ in range(2):
        WR.append_observations(rows, path, "a")
    WR.append_observations(rows.filter("id < 3"), path, "b")
    rows.write.parquet(f"{path}/data/batch=c")  # an attempt that did not publish
    assert WR.published(spark, path) == ["a", "b"] and WR.read_observations(spark, path, "id long, v string").count() == 13
    WR.append_observations(rows, path, "c")
    assert WR.read_observations(spark, path, "id long, v string").count() == 23


def test_oversampling_balances_exactly(spark):
    df = spark.range(130).select(F.col("id").alias("row"), (F.col("id") < 40).cast("double").alias("y"), (F.col("id") % 10).alias("f"),
                                 F.array((F.col("id") % 17).cast("double"), F.rand(1), F.lit(0.0)).alias("x"))
    df = materialise(df, "oversample-test")
    made = TR.oversample(df, "y", "x", "row").collect()
    assert len(made) == 50 and {r["y"] for r in made} == {1.0} and {r["fold"] for r in made} == {0}
    small = np.array([r["x"] for r in df.filter("y = 1").collect()])
    for r in made:  # every row lies between a minority row and one of its five nearest
        v = np.array(r["x"])
        d = np.sqrt(((small[:, None] - small[None]) ** 2).sum(-1))
        ends = [(i, j) for i in range(40) for j in np.argsort(d[i], kind="stable")[1:8]]
        assert min(np.linalg.norm(small[i] - v) + np.linalg.norm(v - small[j]) - d[i, j] for i, j in ends) < 1e-9
    by_fold = TR.oversample(df, "y", "x", "row", fold="f").groupBy("fold").count().collect()
    assert {r["fold"]: r["count"] for r in by_fold} == {f: 45 for f in range(10)}
    assert TR.oversample(df.filter("y = 1"), "y", "x", "row").count() == 0


def test_fallback_is_not_shuffled_by_gene(spark):
    """A join on gene alone made as many tasks as there are genes, each with all rows of one."""
    from helixframe.operators import lookups as L
    rows = spark.range(100).selectExpr("IF(id % 2 = 0, 'BRCA1', 'BRCA2') AS gene", "id AS aa_pos")
    own, shared = rows.filter("gene = 'BRCA1'").selectExpr("gene", "aa_pos", "aa_pos AS s"), rows.selectExpr("aa_pos", "-aa_pos AS s")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        looked = L.gene_then_shared(rows, own, shared, ["aa_pos"], "s", "out")
        assert looked.filter("out = IF(gene = 'BRCA1', aa_pos, -aa_pos)").count() == 100
        plan = looked._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [gene#" in plan and not re.search(r"SortMergeJoin \[gene#\d+\]", plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
