"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; each query is
planned and fully executed (noop sink) once after a short warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from helixframe.plans import catalog
from helixframe.session import build_session

HEADLINE = [
    "evidence_classes", "acmg_evidence", "consequence_tiers", "vcf_dedup", "vcf_type_counts", "compound_het",
    "annot_exact_then_position", "feature_vector", "data_support", "nearby_band_join", "domain_range_join",
    "af_recalibration", "evidence_disparity", "master_dataset", "agg_position_mean_nan", "roc_auc_grouped",
    "benchmark_subsets", "predictor_comparison", "delong_test", "spearman_grouped", "conformal_coverage",
    "optimise_weights", "isotonic_apply", "stratified_split", "topn_per_gene", "topk_contributions",
    "keep_first_dedup", "founder_lookup", "cdna_genomic_map", "splice_zones", "residue_density",
    "contrastive_neighbour", "bootstrap_ci_models", "cohort_stats", "scan_vcf_lines", "scan_wide_tsv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["risk_tier"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
