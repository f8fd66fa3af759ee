"""First-of-key, numbering and top-k, written so that no hot key sits in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by ``order``. Combines map-side, one shuffle,
    so a key held by a third of all rows costs no more than any other."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the last by ``order`` (last write wins)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def number_rows(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str | Column],
                out: str = "row_number") -> DataFrame:
    """Row number within ``group``, counted in two levels.

    ``bucket`` must rise with ``order`` (a file block, a slice of the key range).
    Only bucket totals are windowed per group; rows are numbered inside their
    bucket, so a group of any size spreads over its buckets.
    """
    b = df.withColumn("_bucket", bucket)
    totals = b.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = W.partitionBy(*group, "_bucket").orderBy(*order)
    return (b.withColumn("_rn", F.row_number().over(inner))
            .join(offsets, [*group, "_bucket"])
            .withColumn(out, F.col("_off") + F.col("_rn")).drop("_bucket", "_rn", "_off"))


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group. The ``row_number() <= n`` form lets Spark prune
    each partition to n rows per group before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def top_contributions(values: dict[str, Column], k: int, floor: float | None = None) -> Column:
    """Top ``k`` of named values by (-abs, name) as an array of structs with a direction."""
    entries = F.array(*[F.struct((-F.abs(v)).alias("neg"), F.lit(n).alias("feature"), v.alias("value"))
                        for n, v in values.items()])
    if floor is not None:
        entries = F.filter(entries, lambda e: F.abs(e["value"]) >= floor)
    return F.transform(F.slice(F.sort_array(entries), 1, k), lambda e: F.struct(
        e["feature"].alias("feature"), e["value"].alias("value"),
        F.when(e["value"] > 0, "pathogenic").otherwise("benign").alias("direction")))


def top_differences(values: dict[str, tuple[Column, Column]], k: int = 5, floor: float = 0.01) -> Column:
    """Top ``k`` absolute differences of named pairs, small ones dropped, with a band."""
    entries = F.array(*[F.struct((-F.abs(a - b)).alias("neg"), F.lit(n).alias("feature"))
                        for n, (a, b) in values.items()])
    kept = F.filter(F.slice(F.sort_array(entries), 1, k), lambda e: -e["neg"] >= floor)
    return F.transform(kept, lambda e: F.struct(
        e["feature"].alias("feature"), (-e["neg"]).alias("difference"),
        F.when(-e["neg"] > 2.0, "high").when(-e["neg"] > 1.0, "moderate").otherwise("low").alias("importance")))
