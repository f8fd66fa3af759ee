"""Quality rules: per-text statistics and cross-document line frequency.

A line (lower-cased, digits as 0, white space folded) that more documents of one
host hold than the limit allows is boilerplate: it is removed, and a document that
loses nearly all its words this way is rejected. Documents are told apart by their whole
texts as they stand: exact copies count as one, for a line and for its host, and any
difference, of a digit too, makes distinct documents.

Null or empty texts have no words and fail the base rule; a null host is a host of
its own; equal rows get equal verdicts; an empty table gives an empty result; other
columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from helixframe.llm.rows import boxed, unboxed, without_lines
from helixframe.llm.text import SPACES, raw, window_hashes, word_hashes
from helixframe.session import materialise

SYMBOLS = b"#*$%&|<>"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz" + b"0" * 9)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
PROFILE = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string()), ("identity", pa.int64())]
                    + [(c, pa.int64()) for c in STATS]
                    + [("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))])
PROFILE_DDL = ("row_key long, doc_id long, host string, identity long, " + ", ".join(f"{c} long" for c in STATS)
               + ", lines array<long>, line_words array<int>")


def repeated_words(words: np.ndarray, k: int = 5) -> int:
    """Words inside a k-word window that the text holds twice or more."""
    windows = window_hashes(words, k)
    if len(windows) < 2:
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = counts[back] > 1
    if not hit.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def profile_text(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Statistics in the order of STATS, then hash and word count of each line (hash 0: no word)."""
    b = raw(text)
    words = word_hashes(b)
    parts = b.split(b"\n")
    full = [p for p in parts if p.split(None, 1)]
    chars = len(text or "") - (len(b) - len(b.translate(None, SPACES)))
    stats = [len(words), chars, len(b) - len(b.translate(None, SYMBOLS)), len(full) - len(set(full)), repeated_words(words)]
    hashes, counts = [], []
    for p in parts:
        w = p.translate(FOLD).split()
        h = xxhash.xxh3_64_intdigest(b" ".join(w)) if w else 0
        hashes.append(h - (1 << 64) if h >= 1 << 63 else h)
        counts.append(len(w))
    return stats, hashes, counts


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [profile_text(t) for t in batch["text"].to_pylist()]
        columns = [batch["row_key"], batch["doc_id"], batch["host"], batch["identity"]]
        columns += [pa.array([d[0][i] for d in done], pa.int64()) for i in range(len(STATS))]
        columns += [pa.array([d[1] for d in done], pa.list_(pa.int64())), pa.array([d[2] for d in done], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, schema=PROFILE)


def row_key(id_col: str, host_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(host_col), F.col(text_col))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          min_words: int = 10, max_repeat_pct: int = 20, min_line_docs: int = 10, max_line_share: float = 0.005,
          min_kept_share: float = 0.2) -> DataFrame:
    """One row per document: row_key, doc_id, host, statistics, removed lines, base_failed, kept.

    A line is removed when more than ``min_line_docs`` distinct documents of its host
    and more than ``max_line_share`` of them hold it. A document is rejected when
    the base rule fails, or when fewer than ``min_words`` words or less than
    ``min_kept_share`` of its words remain.
    """
    rows = docs.select(row_key(id_col, host_col, text_col).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(host_col).cast("string").alias("host"), F.xxhash64(text_col).alias("identity"), F.col(text_col).alias("text"))
    profile = materialise(rows.mapInArrow(_profile, PROFILE_DDL), "line-profile")
    each = profile.select("row_key", "host", "identity", F.posexplode(F.arrays_zip("lines", "line_words")).alias("pos", "l"))
    each = each.select("row_key", "host", "identity", "pos", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words")).filter("words > 0")
    hosts = profile.select("host", "identity").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    # Upper bound first (rows, combined map-side): nearly all lines end here.
    held = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_line_docs)
    often = materialise(held, "line-often")
    h = F.struct("host", "line")
    near = each.join(often.select("host", "line"), (each["host"].eqNullSafe(often["host"])) & (each["line"] == often["line"]), "left_semi")
    near = materialise(near, "line-near")
    distinct = (near.select("host", "line", "identity").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("line_docs"))
                .filter(F.col("line_docs") > min_line_docs).withColumnRenamed("host", "h").withColumnRenamed("line", "l"))
    hosts = hosts.withColumnRenamed("host", "hh")
    above = (distinct.join(hosts, F.col("h").eqNullSafe(F.col("hh")))
             .filter(F.col("line_docs") > max_line_share * F.col("host_docs")).select("h", "l"))
    gone = (near.join(above, near["host"].eqNullSafe(above["h"]) & (near["line"] == above["l"]), "left_semi")
            .dropDuplicates(["row_key", "pos"])
            .groupBy("row_key").agg(F.sort_array(F.collect_list("pos")).alias("removed_lines"), F.sum("words").alias("removed_words")))
    removed = F.coalesce("removed_words", F.lit(0))
    left = F.col("n_words") - removed
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    depleted = (removed > 0) & ((left < min_words) | (left < min_kept_share * F.col("n_words")))
    return (profile.drop("lines", "line_words", "identity").join(gone, "row_key", "left")
            .select("row_key", "doc_id", "host", *STATS, base.alias("base_failed"), (~base & ~depleted).alias("kept"),
                    F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
                    removed.cast("long").alias("removed_words")))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          length_col: str | None = "n_chars", **limits) -> DataFrame:
    """Documents that pass, without their boilerplate lines, in the input's columns."""
    verdicts = judge(docs, id_col, text_col, host_col, **limits).filter("kept").select(F.col("row_key").alias("judged"), "removed_lines").dropDuplicates(["judged"])
    joined = boxed(docs, key=row_key(id_col, host_col, text_col)).join(verdicts, F.col("key") == F.col("judged"))
    out = without_lines(joined, F.col("row").getField(text_col), "removed_lines", "left_text")
    changed = {text_col: F.col("left_text")}
    if length_col and length_col in docs.columns:
        length = F.length("left_text").cast(docs.schema[length_col].dataType)
        changed[length_col] = F.when(F.size("removed_lines") > 0, length).otherwise(F.col("row").getField(length_col))
    return unboxed(out, docs.columns, **changed)
