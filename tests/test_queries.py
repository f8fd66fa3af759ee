"""Registered queries against their SQL twins at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
KEYS = [
    "evidence_classes", "acmg_population_pair", "consequence_tiers", "vcf_skip_report", "splice_zones", "codon_translate", "input_validate",
    "annot_exact_then_position", "founder_lookup", "residue_density", "feature_vector", "af_recalibration", "compound_het", "benchmark_subsets",
    "predictor_comparison", "delong_test", "optimise_weights", "isotonic_apply", "conformal_coverage", "stratified_split", "scan_nested_hits",
    "scan_release_summary", "st_cohort_stats", "vcf_scored", "st_vcf_annotate", "contrastive_neighbour", "acmg_evidence", "acmg_combine", "variant_report",
    "zero_variance_drop", "master_dataset", "feat_embedding", "append_observation", "weight_report", "active_learning_priority",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", KEYS)
def test_twin(spark, con, name):
    ok, message, *_ = compare(spark, con, SF, name)
    assert ok, message


def test_entry_and_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
