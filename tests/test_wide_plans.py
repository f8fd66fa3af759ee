"""Plans of wide rows: an exploded array is worked out once, features are counted in their row, wide code is compiled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helixframe.operators import aggregates as AG, features as FE, neighbours as N, training as TR
from helixframe.plans import features as PF

KEYS = ("topk_contributions", "topk_feature_diffs")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exploded_arrays_are_not_asked_for_their_size(spark):
    for key in KEYS:
        assert "size(" not in plan(entry.queries()[key](spark, entry.SMOKE_DIR)), key


def test_wide_projections_stay_below_the_compiler_limit(spark):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    PF.full_vector(spark, entry.SMOKE_DIR)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_frequency_independence_counts_in_the_row(spark):
    wide = spark.createDataFrame([("A", 1.0, 0, 2.0), ("A", None, 3, float("nan")), ("A", 0.0, 0, 0.0), ("B", 5.0, None, 0.0)],
                                 "gene string, gnomad_af double, aa int, `AA>x` double")
    out = FE.frequency_independence(wide, ["gnomad_af", "aa", "AA>x"], ["gene"])
    rows = {r["gene"]: r for r in out.collect()}
    assert [rows[g]["pct_independent"] for g in "AB"] == [75.0, 0.0]
    assert (rows["A"]["total_features"], rows["A"]["frequency_dependent"], rows["A"]["frequency_independent"]) == (3, 1, 2)
    # two sums, whatever the number of features
    aggregate = next(line for line in plan(out).splitlines() if "Aggregate" in line)
    assert aggregate.count("sum(") <= 3 and "count(" not in aggregate


def test_scaling_is_compiled(spark):
    table = spark.createDataFrame([("train", [1.0, 5.0]), ("train", [3.0, 5.0]), ("test", [4.0, 7.0])], "split string, x array<double>")
    out = TR.scaled(table, table.filter("split = 'train'"), 2)
    assert sorted(r["x"] for r in out.collect()) == [[-1.0, 0.0], [1.0, 0.0], [2.0, 2.0]]
    # a function of the elements would be interpreted
    assert "lambda" not in plan(out)


def test_profile_with_and_without_gaps(spark):
    rows = np.random.default_rng(3).normal(5, 2, (200, 3))
    for gap in (False, True):
        v = rows.copy()
        if gap:
            v[::7, 1] = np.nan
        df = spark.createDataFrame([(r.tolist(),) for r in v], "x array<double>").repartition(3)
        out = {r["feature"]: r for r in AG.array_profile(df, "x", list("abc")).collect()}
        for i, c in enumerate("abc"):
            known = v[~np.isnan(v[:, i]), i]
            assert out[c]["n"] == len(known) and np.allclose([out[c][n] for n in ("lo", "hi", "mean", "std")], [known.min(), known.max(), known.mean(), known.std()])


def test_search_measures_few_pairs_of_indicators(monkeypatch):
    """Vectors of indicators, as the features are, lie in boxes that a query need not open."""
    rng = np.random.default_rng(5)
    def made(n):
        kinds = rng.integers(0, 8, (n, 3))
        return np.hstack([np.eye(8)[kinds].reshape(n, 24) * 4, rng.normal(size=(n, 4))])
    a, b, ids = made(200), made(6000), rng.permutation(6000)
    pairs, whole = [], N._best_of_all
    def counted(a, b, *rest):
        pairs.append(len(a) * len(b))
        return whole(a, b, *rest)
    monkeypatch.setattr(N, "_best_of_all", counted)
    for k in (1, 4):
        pairs.clear()
        got, want = N.best_of(a, b, ids, k, 9), whole(a, b, ids, k, 9)
        assert all(np.array_equal(x, y) for x, y in zip(got, want)) and sum(pairs) < 0.5 * len(a) * len(b)


def test_cells_follow_the_rows_and_vectors_travel_packed(spark, monkeypatch):
    """The blocks that a vector meets, and so the disk, grow no faster than the table."""
    tables, write = {}, N.materialise
    def kept(df, name, *rest):
        tables[name] = write(df, name, *rest)
        return tables[name]
    monkeypatch.setattr(N, "materialise", kept)
    rng = np.random.default_rng(7)
    for n in (600, 1800):
        v = np.eye(8)[rng.integers(0, 8, (n, 3))].reshape(n, 24) + rng.normal(0, 0.01, (n, 24))
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, x array<double>").coalesce(2)
        found = {r["id"]: r["neighbour_id"] for r in N.nearest(df.filter("id < 50"), df, [], "x", "id", pivots=2, cell_rows=100).collect()}
        assert found == {i: i for i in range(50)}
        cells = tables["neighbour-cells"].groupBy("_cell").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("packs")).collect()
        assert sum(r["n"] for r in cells) == n and len(cells) >= n // 200 and max(r["n"] for r in cells) <= 400
        assert tables["neighbour-train"].count() < n / 10
