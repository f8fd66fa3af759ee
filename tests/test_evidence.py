"""Boundaries and invariants of the evidence rules."""

import itertools

import pytest
from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.functions import evidence as EV, rules as R


def codes(spark, **over):
    row = {"af": 0.00001, "gene": "BRCA2", "ba1": 0.001, "bs1": 0.0001, "p": 0.5, "dna": 999.0, "palb2": 999.0,
           "critical": False, "nonsense": False, "frameshift": False, "inframe": False, "near": False, "canonical": False,
           "synonymous": False, "exon": None, "total": None, "edge": False, "sparse": False, **over}
    schema = ("af double, gene string, ba1 double, bs1 double, p double, dna double, palb2 double, critical boolean, nonsense boolean, "
              "frameshift boolean, inframe boolean, near boolean, canonical boolean, synonymous boolean, exon int, total int, edge boolean, sparse boolean")
    df = spark.createDataFrame([tuple(row.values())], schema)
    c = F.col
    rules = EV.evidence_rules(
        c("af"), c("gene"), c("ba1"), c("bs1"), c("p"), dist_dna=c("dna"), dist_palb2=c("palb2"), exon_number=c("exon"), total_exons=c("total"),
        sparse=c("sparse"), critical=c("critical"), is_nonsense=c("nonsense"), is_frameshift=c("frameshift"), is_inframe=c("inframe"),
        near_splice=c("near"), canonical_splice=c("canonical"), is_synonymous=c("synonymous"), near_last_boundary=c("edge"))
    out = df.select(EV.evidence_map(rules).alias("m"), EV.code_list(rules).alias("l")).first()
    assert set(out["m"]) == set(out["l"]) and all(out["m"].values())
    return set(out["l"])


@pytest.mark.parametrize("over,want", [
    ({"dna": 5.0}, {"PM1"}), ({"dna": 5.01}, set()), ({"palb2": 3.0}, {"PM1"}), ({"critical": True}, {"PM1"}),
    ({"af": 0.0}, {"PM2"}), ({"af": 0.0, "sparse": True}, {"PM2_insufficient"}), ({"af": 0.001}, {"BS1"}), ({"af": 0.0011}, {"BA1"}),
    ({"af": 0.0001}, set()), ({"af": 0.0011, "sparse": True}, {"BS1"}), ({"p": 0.70}, {"PP3"}), ({"p": 0.6999}, set()), ({"p": 0.20}, {"BP4"}),
    ({"nonsense": True}, {"PVS1"}), ({"nonsense": True, "exon": 10, "total": 10}, {"PVS1_moderate"}),
    ({"frameshift": True, "exon": 9, "total": 10, "edge": True}, {"PVS1_moderate"}), ({"frameshift": True, "exon": 9, "total": 10}, {"PVS1"}),
    ({"canonical": True, "near": True}, {"PVS1"}), ({"near": True}, {"PP3_splice"}), ({"nonsense": True, "canonical": True, "near": True}, {"PVS1", "PP3_splice"}),
    ({"synonymous": True}, {"BP7"}), ({"synonymous": True, "near": True}, {"PP3_splice"}), ({"inframe": True}, {"PM4"}),
])
def test_code_boundaries(spark, over, want):
    assert codes(spark, **over) == want


def test_combination_ladder(spark):
    cases = [
        (["BA1", "PVS1", "PS1"], "Benign"), (["BS1", "BS2"], "Benign"), (["BS1", "BP4"], "Likely Benign"), (["BP4", "BP7"], "Uncertain Significance"),
        (["PVS1", "PS1"], "Pathogenic"), (["PVS1", "PM1", "PM2"], "Pathogenic"), (["PVS1", "PM2", "PP3"], "Pathogenic"), (["PVS1", "PP3", "PP1"], "Pathogenic"),
        (["PS1", "PS4"], "Pathogenic"), (["PS1", "PM1", "PM2", "PM4"], "Pathogenic"), (["PS1", "PM1", "PM2", "PP1", "PP3"], "Pathogenic"),
        (["PVS1", "PM1"], "Likely Pathogenic"), (["PS1", "PM1"], "Likely Pathogenic"), (["PS1", "PP1", "PP3"], "Likely Pathogenic"),
        (["PM1", "PM2", "PM5"], "Likely Pathogenic"), (["PM1", "PM2", "PP3", "PP1"], "Likely Pathogenic"), (["PM5", "PM2", "PP3"], "Uncertain Significance"),
        (["PVS1"], "Uncertain Significance"), (["PVS1", "PP3"], "Uncertain Significance"), (["PVS1_moderate", "PM2", "PM1"], "Likely Pathogenic"), ([], "Uncertain Significance"),
    ]
    df = spark.createDataFrame([(c, w) for c, w in cases], "codes array<string>, want string")
    bad = EV.classify(df).filter("acmg_class <> want").collect()
    assert not bad


def test_exclusive_codes_over_a_grid(spark):
    grid = list(itertools.product([0.0, 1e-5, 1e-4, 1e-3, 0.0011, 0.006], [0.0, 0.2, 0.21, 0.69, 0.7, 1.0], [g[0] for g in K.GENES], [None, "kazakh", "eas", "sas"]))
    df = spark.createDataFrame(grid, "af double, p double, gene string, pop string").join(
        spark.createDataFrame([(g[0], g[9], g[10]) for g in K.GENES], "gene string, ba1 double, bs1 double"), "gene")
    rules = EV.evidence_rules(F.col("af"), F.col("gene"), F.col("ba1"), F.col("bs1"), F.col("p"), sparse=EV.is_underrepresented(F.col("pop")))
    out = df.withColumn("codes", EV.code_list(rules))
    both = lambda a, b: F.array_contains("codes", a) & F.array_contains("codes", b)
    assert out.filter(both("BA1", "BS1") | both("PP3", "BP4") | both("PM2", "PM2_insufficient")).count() == 0
    assert out.filter("af > 0.0100001").count() == 0


def test_risk_tier_bounds_are_strict(spark):
    rows = [(0.9, "likely_pathogenic"), (0.9001, "pathogenic"), (0.7, "uncertain"), (0.3, "uncertain"), (0.2999, "likely_benign"), (0.1, "likely_benign"), (0.0999, "benign")]
    df = spark.createDataFrame(rows, "p double, want string")
    assert df.filter(R.risk_tier(F.col("p")) != F.col("want")).count() == 0
