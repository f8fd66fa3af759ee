"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.llm import (bitsliced, classifier, conversations, decontaminate, line_dedup, mixing, ngram_join, periodic_runs, ppm, quality_rules,
                            suffix_dedup, token_output, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, base verdict and final verdict of every document."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.STATS, "base_failed", "kept",
                      F.size("removed_lines").cast("long").alias("n_removed_lines"), "removed_words")


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when the sources are mixed by weight."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items they contain."""
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op9_decontaminate"] = decontaminate.ORACLE


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, length and checksum of every document's ids, read back from the files."""
    return token_output.round_trip(table(spark, sf_dir, "documents"))


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity component of every document."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every document."""
    return classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of every page, read back through the capture index."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses to earlier ones, and a digest of what is left."""
    out = line_dedup.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query
def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probability of every document."""
    return ppm.score_texts(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document loses because 200 bytes around them occur elsewhere."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    rows = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.repair(rows, absent=F.col("absent"))


@query
def op12_bitsliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of every fiftieth vector by inner product."""
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some with repeated tails, and what is left of the text."""
    docs = periodic_runs.repeat_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.collapse_runs(docs))
