"""Sinks: annotated tables, prediction exports, summaries and the observation log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixframe.functions import parsing as P
from helixframe.sources.readers import supported_genes

MANIFEST = "batch_id string, n long"
PREDICTION_COLUMNS = ("gene", "variant", "prediction", "probability", "risk_tier")


def write_annotated(df: DataFrame, path: str, partition_by: Sequence[str] = ("gene",), fmt: str = "parquet") -> None:
    df.write.mode("append").partitionBy(*partition_by).format(fmt).save(path)


def write_predictions_csv(df: DataFrame, path: str, columns: Sequence[str] = PREDICTION_COLUMNS) -> None:
    """Selected columns, every field quoted."""
    df.select(*columns).write.options(header="true", quoteAll="true").csv(path)


def write_summary_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_lines(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "none") -> None:
    """One string column ``value`` (and partition columns) as text."""
    w = df.write.option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).text(path)


def observation_rows(requests: DataFrame, timestamp: Column) -> DataFrame:
    """Validated, sanitised rows of the observation log; invalid ones are left out.

    Needs gene, aa_ref, aa_pos, aa_alt, prediction, probability, institution, country.
    """
    required = ["gene", "aa_ref", "aa_pos", "aa_alt", "prediction", "probability"]
    ok = F.upper("gene").isin(supported_genes())
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return requests.filter(ok).select(
        timestamp.alias("timestamp"), F.upper("gene").alias("gene"),
        F.concat(F.col("aa_ref"), F.col("aa_pos").cast("string"), F.col("aa_alt")).alias("variant"),
        F.left(F.col("prediction").cast("string"), F.lit(20)).alias("prediction"),
        F.round(F.col("probability").cast("double"), 4).alias("probability"),
        P.clean_text(F.coalesce("institution", F.lit("anonymous"))).alias("institution"),
        P.clean_text(F.coalesce("country", F.lit("unknown")), 60).alias("country"))


def append_observations(rows: DataFrame, path: str, batch_id: str) -> None:
    """Append a batch once, however often the call is repeated.

    The rows replace whatever an earlier attempt left under the batch id, and the batch
    counts from when its manifest is there: one small row with the number of rows, written
    last. A batch that is published already is left as it is.
    """
    spark = rows.sparkSession
    if batch_id in published(spark, path):
        return
    rows.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
    n = spark.read.schema(rows.schema).parquet(f"{path}/data/batch={batch_id}").count()
    spark.createDataFrame([(batch_id, n)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/batch={batch_id}")


def published(spark: SparkSession, path: str) -> list[str]:
    """Batches whose manifest is there; a writer's file appears only when it is whole."""
    try:
        names = spark.read.schema(MANIFEST).json(f"{path}/manifest").select("batch_id").collect()  # one row per batch
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted({r["batch_id"] for r in names})


def read_observations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all published batches; what a failed attempt left behind is not read."""
    batches = published(spark, path)
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/batch={b}" for b in batches])
