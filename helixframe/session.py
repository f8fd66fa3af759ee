"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; sizes (memory, partitions) belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# HotSpot never compiles a method above this size: where Spark's fused code for a wide projection
# grows beyond, it runs in the interpreter unless Spark cuts it into methods of its own.
WIDE = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app: str = "helixframe", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **WIDE, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def compile_wide(spark: SparkSession) -> None:
    """Keep the generated code of wide projections in methods that the JVM compiles."""
    for key, value in WIDE.items():
        spark.conf.set(key, value)


VECTORS = "zstd"  # codec of tables of long vectors


_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Where that setting is unset a temporary folder serves a local master; on a cluster
    executors would not see each other's files there, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _fallback:
            _fallback[app] = tempfile.mkdtemp(prefix="helixframe-")
        base = _fallback[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder, compressed by the session's codec or the given one, and read it back.

    Cuts the lineage: plans that use the table several times read files instead of
    recomputing it, and a lost executor costs no more than a re-read.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
