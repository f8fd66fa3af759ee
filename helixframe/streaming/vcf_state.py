"""Uploads of VCF text as a stream with keyed state: line numbers and duplicates over all files of an upload.

An upload may arrive as several files in several micro-batches. Its state is the number of
data lines so far and a map of the alleles seen, so memory follows one batch, not the
upload; every line gets its number and the places of its repeated alleles. Rows of a
micro-batch are taken in file order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from helixframe.operators import vcf as V
from helixframe.sources.vcf_source import stream_vcf_ranges

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
LINE_DDL = "upload string, file string, line long, value string, parsed boolean, repeats array<int>"


class Uploads(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getValueState("lines", "n long")
        self.seen = handle.getMapState("seen", "chrom string, pos long, ref string, alt string", "line long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["file", "range_start", "data_line"], kind="stable")
        n = int(self.lines.get()[0]) if self.lines.exists() else 0
        known = n > 0
        here: dict[tuple, int] = {}
        lines, repeats = [], []
        for parsed, chrom, pos, ref, alts in zip(batch["parsed"], batch["chrom"], batch["pos"], batch["ref"], batch["alts"]):
            n += 1
            lines.append(n)
            again = []
            for place, alt in enumerate(alts if parsed else ()):
                if alt is None:  # unsupported alleles take no part
                    continue
                allele = (chrom, int(pos), ref, alt)
                if allele in here or (known and self.seen.containsKey(allele)):
                    again.append(place)
                else:
                    here[allele] = n
            repeats.append(again)
        for allele, line in here.items():
            self.seen.updateValue(allele, (line,))
        self.lines.update((n,))
        out = batch[["upload", "file", "value", "parsed"]].copy()
        out.insert(2, "line", lines)
        out["repeats"] = repeats
        yield out

    def close(self) -> None:
        pass


def read_uploads(spark: SparkSession, path: str, upload: str = "/([^/]+)/[^/]*$") -> DataFrame:
    """Data lines of arriving VCF files with their upload (the file's folder) and place."""
    return stream_vcf_ranges(spark, path).withColumn("upload", F.regexp_extract("file", upload, 1))


def number_and_mark(lines: DataFrame) -> DataFrame:
    """Line numbers of every data line and the places of its alleles that the upload held before."""
    parsed = V.parse_lines(lines)
    alts = F.transform(F.split("alt", ","), lambda a: F.when((F.trim(a) != "*") & ~F.trim(a).startswith("<"), F.trim(a)))
    rows = parsed.select("upload", "file", "range_start", "data_line", "value", "parsed", "chrom", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), "ref", alts.alias("alts"))
    return rows.groupBy("upload").transformWithStateInPandas(Uploads(), LINE_DDL, "Append", "None")


def marked_alleles(lines: DataFrame) -> DataFrame:
    """One row per allele of the parsed lines, with the skip reason of unsupported and repeated ones."""
    alleles = V.explode_alleles(V.parse_lines(lines.drop("parsed")).filter("parsed"))
    repeat = F.array_contains("repeats", F.col("allele"))
    return alleles.withColumn("skip", F.coalesce("skip", F.when(repeat, "Duplicate variant"))).drop("repeats")
