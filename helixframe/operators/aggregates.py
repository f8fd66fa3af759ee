"""Aggregates over annotation, variant and log tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixframe import constants as K
from helixframe.functions import rules
from helixframe.operators import metrics as M, ranking
from helixframe.session import materialise

FREQUENCIES = ("af", "popmax", "afr", "amr", "eas", "nfe")


def position_mean(df: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Mean per position, missing values (NULL or NaN) ignored."""
    clean = [F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")) for s in scores]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(s) for c, s in zip(clean, scores)])


def position_mean_first(df: DataFrame, variant: Sequence[str], position: Sequence[str], order: Sequence[str],
                        scores: Sequence[str]) -> DataFrame:
    """Mean per position over the first row of each variant that has any score."""
    have = reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in scores])
    return position_mean(ranking.keep_first(df.filter(have), variant, order), position, scores)


def position_max(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(score).alias(score))


def last_score(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """Score of the last written row per key."""
    return df.groupBy(*keys).agg(F.max_by(score, F.struct(*order)).alias(score))


def frequency_max(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Maximum of each frequency column, never below 0."""
    return df.groupBy(*keys).agg(*[F.greatest(F.max(c), F.lit(0.0)).alias(c) for c in columns])


def pick_source(sources: Sequence[Column]) -> Column:
    """The struct with the larger ``af``; the first on ties and when all are 0.
    Each struct: af, afr, amr, eas, nfe, sas."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("af", "afr", "amr", "eas", "nfe", "sas")])
    best = zero
    for s in sources:
        best = F.when(F.coalesce(s["af"], F.lit(0.0)) > best["af"], s).otherwise(best)
    return best


def popmax(struct: Column) -> Column:
    return F.greatest(*[F.coalesce(struct[n], F.lit(0.0)) for n in ("afr", "amr", "eas", "nfe", "sas")])


def combine_counts(pairs: Sequence[tuple[str, str]], min_ac: int, min_af: float):
    """Allele count, number and frequency over several sources, and the filter
    ``an > 0``, ``ac >= min_ac``, ``af >= min_af`` as a function of a DataFrame."""
    def total(i: int) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(F.col(p[i]), F.lit(0)) for p in pairs])

    def apply(df: DataFrame) -> DataFrame:
        out = df.withColumn("ac", total(0)).withColumn("an", total(1)).filter("an > 0")
        out = out.withColumn("af", F.col("ac") / F.col("an"))
        return out.filter((F.col("ac") >= min_ac) & (F.col("af") >= min_af))
    return apply


def splice_max(transcripts: Column, matches) -> Column:
    """Largest of the four delta scores of the first matching transcript."""
    hit = F.try_element_at(F.filter(transcripts, matches), F.lit(1))
    return F.greatest(*[F.coalesce(hit[d], F.lit(0.0)) for d in ("ds_ag", "ds_al", "ds_dg", "ds_dl")])


def score_bands(df: DataFrame, keys: Sequence[str], score: str, low: float, high: float) -> DataFrame:
    s = F.col(score)
    return df.filter(s.isNotNull()).groupBy(*keys).agg(
        F.count_if(s < low).alias("below"), F.count_if((s >= low) & (s <= high)).alias("between"), F.count_if(s > high).alias("above"))


def pathogenic_positions(df: DataFrame) -> DataFrame:
    """Distinct (gene, aa_pos) of pathogenic missense SNVs; stays one row per position
    so that a gene of any size is never one list."""
    return df.select("gene", "aa_pos").distinct()


def sorted_positions(positions: DataFrame) -> DataFrame:
    """One sorted list per gene; at most a protein's length of positions each."""
    return positions.groupBy("gene").agg(F.sort_array(F.collect_set("aa_pos")).alias("positions"))


def class_balance(df: DataFrame, group: str = "gene", label: str = "label") -> DataFrame:
    """n, pathogenic, benign and percent per group with an ALL row (rollup)."""
    out = df.rollup(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pathogenic"),
                               F.count_if(F.col(label) == 0).alias("benign"))
    return (out.withColumn(group, F.coalesce(group, F.lit("ALL")))
            .withColumn("pct_pathogenic", 100.0 * F.col("pathogenic") / F.col("n")))


def class_balance_without(df: DataFrame, source: Column, group: str = "gene", label: str = "label") -> DataFrame:
    """Balance before and after removing the rows of a source."""
    kept = ~source
    out = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(F.col(label) == 0).alias("benign_before"),
        F.count_if(kept).alias("n_after"), F.count_if(kept & (F.col(label) == 0)).alias("benign_after"))
    pct = F.when(F.col("n_after") > 0, 100.0 * (F.col("n_after") - F.col("benign_after")) / F.col("n_after")).otherwise(0.0)
    return out.withColumn("pct_pathogenic_after", pct)


def unpivot_populations(df: DataFrame, columns: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per row and population: population, pop_af. Exploded map-side."""
    pairs = F.array(*[F.struct(F.lit(n).alias("population"), F.coalesce(F.col(c), F.lit(0.0)).alias("pop_af")) for n, c in columns.items()])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.population", "_p.pop_af")


def population_counts(df: DataFrame, columns: dict[str, str], group: str = "gene") -> DataFrame:
    """Non-zero count, its share and the mean of the non-zero values per group x population."""
    long = unpivot_populations(df, columns, [group])
    hit = F.col("pop_af") > 0
    return long.groupBy(group, "population").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("nonzero"),
        F.coalesce(F.avg(F.when(hit, F.col("pop_af"))), F.lit(0.0)).alias("mean_nonzero_af"))


def any_population(df: DataFrame, columns: Sequence[str], group: str = "gene") -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("total"),
                                 F.count_if(F.greatest(*columns) > 0).alias("nonzero_any_pop"))


def evidence_disparity(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """PM2 / BS1 / BA1 counts and percents per gene x population. Needs ba1, bs1."""
    long = unpivot_populations(df, columns, ["gene", "ba1", "bs1"])
    code = rules.frequency_code(F.col("pop_af"), F.col("ba1"), F.col("bs1"))
    n = F.count(F.lit(1))
    out = long.withColumn("code", code).groupBy("gene", "population").agg(
        n.alias("n"), *[F.count_if(F.col("code") == c).alias(c) for c in ("PM2", "BS1", "BA1")])
    return out.withColumns({f"pct_{c}": 100.0 * F.col(c) / F.col("n") for c in ("PM2", "BS1", "BA1")})


def af_recalibration(df: DataFrame, columns: dict[str, str], global_af: str = "af") -> DataFrame:
    """Frequency codes gained and lost when judged by a population's own frequency,
    per gene x population with an ALL row per population."""
    long = unpivot_populations(df, columns, ["gene", "ba1", "bs1", global_af])
    old = F.coalesce(rules.frequency_code(F.col(global_af), F.col("ba1"), F.col("bs1")), F.lit("-"))
    new = F.coalesce(rules.frequency_code(F.col("pop_af"), F.col("ba1"), F.col("bs1")), F.lit("-"))
    # shrink to (gene, population, old, new) first, then expand the totals
    pairs = (long.withColumn("_old", old).withColumn("_new", new).groupBy("gene", "population", "_old", "_new")
             .agg(F.count(F.lit(1)).alias("_n")).withColumn("gene", F.explode(F.array("gene", F.lit("ALL")))))
    o, n, c = F.col("_old"), F.col("_new"), F.col("_n")
    sums = {"total": F.sum("_n"), "total_changed": F.sum(F.when(o != n, c).otherwise(0))}
    for code in ("PM2", "BS1", "BA1"):
        sums[f"{code}_gained"] = F.sum(F.when((n == code) & (o != code), c).otherwise(0))
        sums[f"{code}_lost"] = F.sum(F.when((o == code) & (n != code), c).otherwise(0))
    return pairs.groupBy("gene", "population").agg(*[v.alias(k) for k, v in sums.items()])


def ancestry_bias(df: DataFrame, columns: dict[str, str], score: str, label: str) -> DataFrame:
    """Rows by assigned population: labels and AUC (NULL below 5 rows or for one class)."""
    assigned = df.withColumn("population", rules.ancestry({n: F.col(c) for n, c in columns.items()}))
    auc = M.roc_auc(assigned, ["population"], score, label)
    return auc.select("population", "n", F.col("n_pos").alias("n_pathogenic"), F.col("n_neg").alias("n_benign"),
                      F.when(F.col("n") >= 5, F.col("roc_auc")).alias("auc"))


def cohort_counts(df: DataFrame) -> DataFrame:
    """Observations, distinct variants by gene and prediction, from one pre-aggregate."""
    per = df.groupBy("gene", "prediction", "variant").agg(F.count(F.lit(1)).alias("n"))
    wide = per.withColumn("_d", F.explode(F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("key")),
        F.struct(F.lit("gene").alias("kind"), F.col("gene").alias("key")),
        F.struct(F.lit("prediction").alias("kind"), F.col("prediction").alias("key")))))
    return wide.groupBy(F.col("_d.kind").alias("kind"), F.col("_d.key").alias("key")).agg(
        F.sum("n").alias("observations"), F.count_distinct("gene", "variant").alias("unique_variants"))


def benchmark_metadata(df: DataFrame) -> DataFrame:
    """Per source and per gene: label distribution, overlap counts, gene and citation lists.

    Rows shrink to the distinct combinations first, so the lists (bounded by the
    number of genes and of cited works) are built from a small table.
    """
    label = F.coalesce(F.col("label").cast("string"), F.lit("none"))
    small = df.groupBy("source", "gene", "citation", label.alias("lab"), "in_training", "in_test").agg(F.count(F.lit(1)).alias("n"))
    wide = small.withColumn("_d", F.explode(F.array(
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")), F.struct(F.lit("gene").alias("kind"), F.col("gene").alias("key")))))

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    return wide.groupBy(F.col("_d.kind").alias("kind"), F.col("_d.key").alias("key")).agg(
        F.sum("n").alias("n_variants"), count(F.col("lab") == "1").alias("pathogenic"), count(F.col("lab") == "0").alias("benign"),
        count(F.col("lab") == "none").alias("unlabeled"), count(F.col("in_training")).alias("in_training"), count(F.col("in_test")).alias("in_test"),
        count(~F.col("in_training") & ~F.col("in_test")).alias("novel"), F.sort_array(F.collect_set("gene")).alias("genes"),
        F.sort_array(F.collect_set("citation")).alias("citations"))


def importance(long: DataFrame) -> DataFrame:
    """(feature, value) -> mean absolute value, share of the largest, rank, and
    selection at or above the median share. The windows run over one row per feature."""
    agg = long.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))
    w = W.partitionBy()
    out = agg.withColumn("normalised", F.col("importance") / (F.max("importance").over(w) + 1e-10))
    out = out.withColumn("rank", F.row_number().over(W.orderBy(F.col("importance").desc(), "feature")))
    return out.withColumn("selected", F.col("normalised") >= F.percentile("normalised", 0.5).over(w))


def agreement(df: DataFrame, group: str = "gene") -> DataFrame:
    """Rule class against the true label: resolved, VUS rate, agreement and Cohen's kappa,
    per gene and overall. Needs acmg_binary (-1 unresolved) and label."""
    cells = df.groupBy(group, "acmg_binary", "label").agg(F.count(F.lit(1)).alias("n"))
    wide = cells.withColumn(group, F.explode(F.array(group, F.lit("ALL"))))

    def count(p: int, y: int) -> Column:
        return F.sum(F.when((F.col("acmg_binary") == p) & (F.col("label") == y), F.col("n")).otherwise(0))

    out = wide.groupBy(group).agg(F.sum("n").alias("total"), count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 1).alias("fn"),
                                  count(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    observed = (tp + tn) / n
    out = out.withColumn("resolved", F.expr("tp + fp + fn + tn")).withColumn("vus", F.expr("total - (tp + fp + fn + tn)"))
    return out.withColumns({
        "vus_rate": F.col("vus") / F.col("total"), "agreement": F.when(n > 0, observed).otherwise(0.0),
        "kappa": F.when((n > 0) & (expected < 1), (observed - expected) / (1 - expected)).otherwise(0.0)})


def code_frequency(df: DataFrame, codes: str = "codes") -> DataFrame:
    return df.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def vus_summary(df: DataFrame, group: str = "gene") -> DataFrame:
    """Class counts, reclassified, novel and median probability per group. Needs
    classification, novel, probability."""
    cls = [f"n_{c}" for c in ("lp", "pp", "vus", "pb", "lb")]
    names = ["Likely Pathogenic", "Possibly Pathogenic", "Uncertain (Remains VUS)", "Possibly Benign", "Likely Benign"]
    counts = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("classification") == n).alias(c) for c, n in zip(cls, names)],
        F.count_if("novel").alias("n_novel"))
    med = M.median_by_counts(df.groupBy(group, F.col("probability").alias("score")).agg(F.count(F.lit(1)).alias("n")), [group])
    return counts.withColumn("n_reclassified", F.col("n") - F.col("n_vus")).join(med, group)


def histogram(df: DataFrame, value: str, bins: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Counts per equal-width bin; the upper edge belongs to the last bin."""
    b = F.least(F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return df.filter(F.col(value).between(lo, hi)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


PROFILE_DDL = "n array<double>, mean array<double>, m2 array<double>, lo array<double>, hi array<double>"


def array_profile(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """One row per place of an array column: n (known values, neither NULL nor NaN), lo, hi, mean, std (of the population) and whether it is constant.

    One pass for all places: a task leaves one row of moments about its own means, and
    these merge by place, so nothing is lost to cancellation.
    """
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = (np.zeros(width) for _ in range(3))
        lo, hi = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            known = ~np.isnan(v)
            if known.all():  # without gaps nothing is masked, and the batch is not copied for each measure
                k = np.full(width, float(len(v)))
                m = v.mean(axis=0)
                least, most = v.min(axis=0), v.max(axis=0)
                v -= m
                square = np.einsum("ij,ij->j", v, v)
            else:
                k = known.sum(axis=0)
                m = np.where(known, v, 0).sum(axis=0) / np.maximum(k, 1)
                square = (np.where(known, v - m, 0) ** 2).sum(axis=0)
                least, most = np.where(known, v, np.inf).min(axis=0), np.where(known, v, -np.inf).max(axis=0)
            d, both = m - mean, np.maximum(n + k, 1)
            m2 += square + d * d * n * k / both
            mean += d * k / both
            n += k
            lo, hi = np.minimum(lo, least), np.maximum(hi, most)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.float64())) for x in (n, mean, m2, lo, hi)], ["n", "mean", "m2", "lo", "hi"])

    parts = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, PROFILE_DDL)
    each = materialise(parts.select(F.posexplode(F.arrays_zip("n", "mean", "m2", "lo", "hi")).alias("i", "p")).select("i", "p.*").filter("n > 0"), "profile")  # a row per task and place
    means = each.groupBy("i").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all"))
    out = each.join(means, "i").groupBy("i").agg(
        F.sum("n").cast("long").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("all").alias("mean"),
        F.sqrt(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("all")) * (F.col("mean") - F.col("all"))) / F.sum("n")).alias("std"))
    every = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(names)], "i int, feature string")
    constant = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))
    return every.join(out, "i", "left").select("feature", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "lo", "hi", "mean", F.when(constant, 0.0).otherwise(F.col("std")).alias("std"),
                                               constant.alias("constant"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``array_profile`` of numeric columns, one row per column."""
    return array_profile(df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x")), "x", columns)


def drop_constant(df: DataFrame, columns: Sequence[str], profile: DataFrame | None = None) -> DataFrame:
    """The table without those of the columns that are constant (at most one distinct value); the profile has one row per column."""
    profile = column_profile(df, columns) if profile is None else profile
    return df.drop(*[r["feature"] for r in profile.filter("constant").select("feature").collect()])


def is_leak(column: str, names: Sequence[str] = tuple(K.LEAK_FEATURES), prefix: str = "Mutation_") -> bool:
    """Does the feature tell the gene or the variant's place?"""
    return column in names or column.startswith(prefix)


def drop_leaks(df: DataFrame, names: Sequence[str] = tuple(K.LEAK_FEATURES), prefix: str = "Mutation_") -> DataFrame:
    """Drop gene-identifying features: a metadata change only."""
    return df.drop(*[c for c in df.columns if is_leak(c, names, prefix)])


def master_dataset(parts: Sequence[DataFrame], annotate) -> DataFrame:
    """Union of the gene and proxy tables (missing columns NULL), annotated once."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return annotate(union)
