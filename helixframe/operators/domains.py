"""Protein-domain features: range membership, distance and zone score.

A domain table is small per gene, so the ranges of a gene travel as one array
and every row is tested in place: one equi-join on gene, no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe import constants as K


def domain_arrays(domains: DataFrame) -> DataFrame:
    """gene -> array of (ord, name, start_aa, end_aa) in configured order."""
    return domains.groupBy("gene").agg(
        F.sort_array(F.collect_list(F.struct("ord", "name", "start_aa", "end_aa"))).alias("domains"))


def with_domains(df: DataFrame, domains: DataFrame) -> DataFrame:
    return df.join(domain_arrays(domains), "gene", "left")


def _inside(d: Column, pos: Column) -> Column:
    return pos.between(d["start_aa"], d["end_aa"])


def _edge(d: Column, pos: Column) -> Column:
    return F.least(F.abs(pos - d["start_aa"]), F.abs(pos - d["end_aa"]))


def hits(domains: Column, pos: Column) -> Column:
    return F.filter(domains, lambda d: _inside(d, pos))


def first_hit(domains: Column, pos: Column) -> Column:
    """Name of the first configured domain that covers the position."""
    return F.try_element_at(hits(domains, pos), F.lit(1))["name"]


def count_hits(domains: Column, pos: Column) -> Column:
    return F.coalesce(F.size(hits(domains, pos)), F.lit(0))


def nearest_distance(domains: Column, pos: Column, aa_length: Column) -> Column:
    """Distance to the closest domain edge over protein length, 0 inside a domain."""
    each = F.transform(domains, lambda d: F.when(_inside(d, pos), F.lit(0)).otherwise(_edge(d, pos)).cast("bigint"))
    return F.least(F.coalesce(F.array_min(each), aa_length), aa_length) / aa_length


def zone_score(domains: Column, pos: Column) -> Column:
    """Sum over domains of 1 inside, else 1 / (1 + edge distance / 50)."""
    return F.aggregate(
        F.coalesce(domains, F.array()), F.lit(0.0),
        lambda acc, d: acc + F.when(_inside(d, pos), F.lit(1.0)).otherwise(1.0 / (1.0 + _edge(d, pos) / 50.0)))


def flag_ranges(domains: DataFrame, candidates: DataFrame, flags: list[str] | None = None) -> DataFrame:
    """Wide dim: per gene and flag, the range of the first configured candidate."""
    names = list(flags or K.DOMAIN_FLAGS)
    best = (domains.join(candidates, "name").groupBy("gene", "flag")
            .agg(F.min_by(F.struct("start_aa", "end_aa"), "rank").alias("range")))
    return best.groupBy("gene").pivot("flag", names).agg(F.first("range"))


def add_flags(df: DataFrame, ranges: DataFrame, pos: str = "aa_pos") -> DataFrame:
    """One 0/1 column per generic domain flag."""
    flags = [c for c in ranges.columns if c != "gene"]
    wide = ranges.select("gene", *[F.col(f).alias(f"_r_{f}") for f in flags])
    out = df.join(wide, "gene", "left")
    for f in flags:
        r = F.col(f"_r_{f}")
        out = out.withColumn(f, F.coalesce(F.col(pos).between(r["start_aa"], r["end_aa"]), F.lit(False)).cast("int"))
    return out.drop(*[f"_r_{f}" for f in flags])
