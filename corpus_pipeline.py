"""Corpus pipeline: five stages from raw documents to encoded token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontaminate, mixing, ngram_join, quality_rules, token_output
from helixframe.session import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents that fail the quality rules.

    Null and empty texts fail; a null source is a host of its own; equal rows share a
    verdict; an empty table stays empty; extra columns pass through whatever their names.
    """
    return quality_rules.apply(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    The smallest id stays, then the smallest text hash; equal rows are one document; rows
    without an id or without words stay; an empty table stays empty; extra columns pass through.
    """
    return ngram_join.apply(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain none; equal rows go or stay together; without items or
    documents nothing goes; extra columns pass through.
    """
    return decontaminate.apply(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it.

    Null texts have size 0; a null source comes last; equal rows share one draw, ties are
    drawn by hash; an empty table stays empty; extra columns pass through.
    """
    return mixing.apply(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixture in files; returns what they hold of each document.

    Null texts are empty (their end id alone); copies and equal ids follow each other; an
    empty table gives no files and no rows; only id and text are read.
    """
    return token_output.round_trip(docs)


STAGES = [("quality rules", keep_quality), ("n-gram Jaccard join", keep_one_of_each), ("benchmark decontamination", drop_benchmark),
          ("mixing sources", mix), ("token ids", write_ids)]
# Tokenisation and random draws are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage reads what the last one wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs
