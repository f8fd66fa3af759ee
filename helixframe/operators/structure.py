"""Residue coordinates: density, region distance, fragment and tier merging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from helixframe import constants as K
from helixframe.operators import ranking


def residue_density(residues: DataFrame, group: Sequence[str], radius: float = K.NEIGHBOUR_RADIUS) -> DataFrame:
    """Neighbours closer than ``radius`` per residue (itself excluded) and the
    min-max scaled accessibility 1 - (d - min) / (max - min) of its structure.

    Points are pooled to distinct coordinates, each looks into the 27 grid cells
    around it, so only near points ever meet in the join.
    """
    g, xyz = list(group), ["x", "y", "z"]
    pts = residues.groupBy(*g, *xyz).agg(F.count(F.lit(1)).alias("_c"))
    cells = [F.floor(F.col(c) / radius).alias(f"_{c}") for c in xyz]
    right = pts.select(*g, *[F.col(c).alias(f"r{c}") for c in xyz], F.col("_c").alias("_rc"), *cells)
    left = pts.select(*g, *xyz, *cells)
    for c in xyz:
        left = left.withColumn(f"_{c}", F.explode(F.array(F.col(f"_{c}") - 1, F.col(f"_{c}"), F.col(f"_{c}") + 1)))
    d2 = sum(((F.col(c) - F.col(f"r{c}")) * (F.col(c) - F.col(f"r{c}")) for c in xyz), F.lit(0.0))
    near = (left.join(right, [*g, "_x", "_y", "_z"]).filter(d2 < radius * radius)
            .groupBy(*g, *xyz).agg((F.sum("_rc") - 1).alias("density")))
    ends = near.groupBy(*g).agg(F.min("density").alias("_lo"), F.max("density").alias("_hi"))  # map-side; no window over a structure
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = F.when(hi > lo, 1 - (F.col("density") - lo) / (hi - lo)).otherwise(0.5)
    return residues.join(near, [*g, *xyz]).join(ends, g).withColumn("rsa", scaled).drop("_lo", "_hi")


def region_distance(residues: DataFrame, group: Sequence[str], regions: Sequence[tuple[int, int]],
                    out: str = "dist", default: float = K.DISTANCE_UNKNOWN) -> DataFrame:
    """Least distance to any residue of the regions (itself excluded).

    A structure's region residues, at most the regions' total length, travel as
    one array to each of its residues: no pairs are emitted.
    """
    inside = reduce(lambda a, b: a | b, [F.col("resnum").between(a, b) for a, b in regions])
    # one row per residue number, so that the regions' length bounds the array
    ref = residues.filter(inside).groupBy(*group, "resnum", "x", "y", "z").agg(F.lit(1).alias("_one")).groupBy(*group).agg(F.collect_list(F.struct("resnum", "x", "y", "z")).alias("_ref"))

    def dist(p: Column) -> Column:
        return F.sqrt(sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in "xyz"), F.lit(0.0)))

    others = F.filter("_ref", lambda p: p["resnum"] != F.col("resnum"))
    return (residues.join(ref, list(group), "left")
            .withColumn(out, F.coalesce(F.array_min(F.transform(others, dist)), F.lit(default))).drop("_ref"))


def rsa_from_confidence(score: Column) -> tuple[Column, Column]:
    """Accessibility and secondary-structure estimate from the model confidence."""
    rsa = (F.when(score >= 90, 0.10).when(score >= 70, 0.15 + (90 - score) * 0.01)
           .when(score >= 50, 0.35 + (70 - score) * 0.015).otherwise(0.65 + (50 - score) * 0.01))
    return rsa, F.when(score >= 80, "H").when(score >= 60, "C").otherwise("-")


def merge_fragments(fragments: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """Union of overlapping fragments; the later fragment overwrites a residue."""
    return ranking.keep_last(reduce(DataFrame.unionByName, fragments), keys, [order])


def merge_tiers(lengths: DataFrame, experimental: DataFrame, model: DataFrame, group: str,
                min_confidence: float = 70.0) -> DataFrame:
    """Per position 1..length: experimental, else a confident model, else curated."""
    spine = lengths.select(group, F.explode(F.expr("sequence(1L, length)")).alias("resnum"))
    e = experimental.select(group, "resnum").distinct().withColumn("_e", F.lit(True))
    m = model.select(group, "resnum", "plddt")
    out = spine.join(e, [group, "resnum"], "left").join(m, [group, "resnum"], "left")
    tier = (F.when(F.col("_e"), "PDB_experimental").when(F.col("plddt") >= min_confidence, "AlphaFold_v4")
            .otherwise("curated_estimate"))
    return out.withColumn("data_tier", tier).withColumn("af_plddt", F.coalesce("plddt", F.lit(0.0))).drop("_e", "plddt")


def residue_class(position: Column, intervals: dict[str, Sequence[tuple[int, int]]], default: str) -> Column:
    """First named interval list that covers the position."""
    out = None
    for name, ranges in intervals.items():
        hit = reduce(lambda a, b: a | b, [position.between(a, b) for a, b in ranges])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def region_rsa(position: Column, buried: Column, dna_contact: Column, partner_contact: Column, ss: Column) -> Column:
    """Accessibility estimate from curated residue classes."""
    return (F.when(buried, 0.05).when(dna_contact, 0.35).when(partner_contact, 0.30)
            .when(ss == "E", 0.15).when(ss == "H", 0.25).otherwise(0.60))


def context_window(sequence: Column, position: Column, alt: Column, window: int = K.CONTEXT_WINDOW) -> tuple[Column, Column]:
    """Residues within ``window`` of a 1-based position, and the same with the change."""
    start = F.greatest(position - window, F.lit(1))
    end = F.least(position + window, F.length(sequence))
    wild = F.substr(sequence, start.cast("int"), (end - start + 1).cast("int"))
    return wild, F.overlay(wild, alt, (position - start + 1).cast("int"), F.lit(1))
