"""How much training data lies near a variant, and what to test next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixframe import constants as K
from helixframe.functions import rules


def nearby_counts(queries: DataFrame, training: DataFrame, window: int = K.NEARBY_WINDOW,
                  position: str = "aa_pos", out: str = "nearby") -> DataFrame:
    """Training rows of the same gene within ``window`` positions of each query row.

    Both sides shrink to (gene, position) first, so the sliding window runs over
    at most one row per protein position and the join back is on distinct keys.
    """
    hist = training.groupBy("gene", position).agg(F.count(F.lit(1)).alias("_n"))
    spine = queries.select("gene", position).distinct().withColumn("_n", F.lit(0).cast("bigint"))
    w = W.partitionBy("gene").orderBy(position).rangeBetween(-window, window)
    per_pos = hist.unionByName(spine).groupBy("gene", position).agg(F.sum("_n").alias("_n"))
    near = per_pos.select("gene", position, F.sum("_n").over(w).alias(out))
    return queries.join(near, ["gene", position], "left")


def data_support(queries: DataFrame, training: DataFrame, in_known_domain: Column) -> DataFrame:
    """Nearby and same-substitution counts with a LOW / MODERATE / HIGH level."""
    same = training.groupBy("gene", "aa_ref", "aa_alt").agg(F.count(F.lit(1)).alias("_same"))
    return (nearby_counts(queries, training)
            .join(same, ["gene", "aa_ref", "aa_alt"], "left")
            .withColumn("same_substitution", F.coalesce("_same", F.lit(0)))
            .withColumn("in_known_domain", in_known_domain)
            .withColumn("level", rules.support_level(F.col("nearby"))).drop("_same"))


def priorities(queries: DataFrame, training: DataFrame, p1: Column, p2: Column) -> DataFrame:
    """Disagreement x scarcity x novelty, with the reason text."""
    sizes = training.groupBy("gene").agg(F.count(F.lit(1)).alias("train_n"))
    out = nearby_counts(queries, training).join(sizes, "gene", "left")
    out = (out.withColumn("disagreement", F.round(F.abs(p1 - p2), 9))
           .withColumn("scarcity", 1.0 / F.sqrt(F.col("train_n").cast("double")))
           .withColumn("novelty", 1.0 / (1.0 + F.col("nearby"))))
    reason = F.array_join(F.array_compact(F.array(
        F.when(F.col("disagreement") > 0.3, F.format_string("high model disagreement (%.3f)", "disagreement")),
        F.when(F.col("scarcity") > 0.02, F.format_string("data-scarce gene (%d training)", "train_n")),
        F.when(F.col("novelty") > 0.5, F.format_string("low positional coverage (%d nearby)", "nearby")))), "; ")
    return (out.withColumn("priority", F.col("disagreement") * F.col("scarcity") * F.col("novelty"))
            .withColumn("reason", F.when(reason == "", "moderate priority").otherwise(reason)))
