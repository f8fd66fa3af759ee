"""Evidence inputs for a table of protein variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe import constants as K
from helixframe.functions import evidence
from helixframe.operators import domains as D

POPULATION_COLUMNS = {"afr": "af_afr", "amr": "af_amr", "eas": "af_eas", "nfe": "af_nfe"}


def evidence_inputs(variants: DataFrame, genes: DataFrame, domain_table: DataFrame, candidates: DataFrame,
                    known: DataFrame) -> DataFrame:
    """Add gene thresholds, domain flags, criticality and known-pathogenic flags.

    ``known`` holds established pathogenic protein variants (gene, aa_pos, aa_ref, aa_alt).
    """
    out = variants.join(genes.select("gene", "ba1", "bs1", "aa_length"), "gene", "left")
    out = D.add_flags(out, D.flag_ranges(domain_table, candidates))
    out = out.withColumn("critical", (F.col("in_critical_repeat_region") + F.col("in_DNA_binding")) > 0)
    out = out.withColumn("is_nonsense", F.col("aa_alt") == "Ter")
    # one join on the position; its known changes (at most all residue pairs) travel along
    change = F.concat("aa_ref", F.lit(">"), "aa_alt")
    at = known.groupBy("gene", "aa_pos").agg(F.collect_set(change).alias("_known"))
    return (out.join(at, ["gene", "aa_pos"], "left").withColumn("same_position", F.col("_known").isNotNull())
            .withColumn("same_change", F.coalesce(F.array_contains("_known", change), F.lit(False))).drop("_known"))


def rules_for(probability: Column, population: Column | None = None, **extra: Column) -> evidence.Rules:
    """Evidence rules over the columns ``evidence_inputs`` leaves; ``extra`` adds flags, distances, exon numbers and the founder's rationale."""
    flags = {n: F.col(n) for n in ("critical", "same_change", "same_position", "is_nonsense")}
    flags.update(extra)
    if population is None:
        af, sparse, label = F.col("af"), None, None
    else:
        af = evidence.population_af(population, F.col("af"), {k: F.col(c) for k, c in POPULATION_COLUMNS.items()})
        sparse = evidence.is_underrepresented(population)
        label = evidence.population_label(population, list(K.POPULATION_AF))
    return evidence.evidence_rules(af, F.col("gene"), F.col("ba1"), F.col("bs1"), probability,
                                   sparse=sparse, label=label, **flags)
