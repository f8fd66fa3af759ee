"""Benchmark decontamination: short test items inside long documents.

Size-partitioned MinHash containment search. Documents are partitioned by the power
of two of their shingle count; a document's sketch keeps the smallest shingle hash
of each of ``bins`` slices of the hash range (one-permutation MinHash), with bins in
proportion to the partition's size, so that short items stay visible in documents of
any length. The ratio follows the smallest item: each of its shingles then survives
in the sketch often enough that all being missed has odds below ``miss``. An item
sharing a sketch value is a candidate; candidates are verified on the shingles
themselves. Only DataFrame functions are used.

Texts are lower-cased (A-Z); shingles have five words; a text with fewer words is one
shingle, so a shorter item only matches a document of the same few words; null or
empty texts match nothing; pairs are distinct; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.llm.rows import boxed, unboxed
from helixframe.session import materialise

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOW), r"[\x20\x09-\x0D]+")
    return F.array_remove(parts, "")


def _positions(words: Column, k: int) -> Column:
    """0-based starts of the windows; one start when the text is shorter; none when it is empty."""
    n = F.size(words)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column, k: int) -> Column:
    """Sorted distinct hashes; missing words of a short text hash as null."""
    return F.sort_array(F.array_distinct(F.transform(
        _positions(words, k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))))


def shingle_texts(words: Column, k: int) -> Column:
    return F.array_distinct(F.transform(_positions(words, k), lambda i: F.concat_ws(" ", F.slice(words, i + 1, k))))


def bin_ratio_bits(smallest: int, containment: float, miss: float) -> int | None:
    """log2 of bins per shingle of the partition's upper size; None: keep every shingle."""
    hits = math.floor(smallest * containment)
    if hits < 4:
        return None
    survive = 1 - miss ** (1 / hits)
    load = 4.0
    while load > 1 / 16 and (1 - math.exp(-load)) / load < survive:
        load /= 2
    return None if load <= 1 / 16 else -int(math.log2(load))


def sketch(hashes: Column, ratio_bits: int | None) -> Column:
    """Smallest hash of each bin; bins are ranges of the (signed) hash order."""
    if ratio_bits is None:
        return hashes
    size_bits = F.ceil(F.log2(F.size(hashes) + F.lit(1))).cast("int")
    shift = F.greatest(F.lit(64) - F.greatest(size_bits + ratio_bits, F.lit(1)), F.lit(0))
    def first(h: Column, i: Column) -> Column:
        before = F.get(hashes, i - 1)
        return (i == 0) | (F.call_function("shiftright", h, shift) != F.call_function("shiftright", before, shift))
    return F.filter(hashes, first)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", k: int = 5, containment: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """Pairs doc_id, item_id, n_shingles (of the item), n_common, containment at or above the limit."""
    it = items.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words")).filter("size(words) > 0")
    it = it.select("item_id", shingle_hashes(F.col("words"), k).alias("hashes"), shingle_texts(F.col("words"), k).alias("item_shingles"))
    it = materialise(it, "items")
    smallest = it.agg(F.min(F.size("hashes"))).first()[0]
    ratio = bin_ratio_bits(smallest or 1, containment, miss)
    index = materialise(it.select("item_id", F.explode("hashes").alias("h")), "item-index")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    hashed = (rows.select("row_key", words_of(F.col("text")).alias("words"))
              .select("row_key", shingle_hashes(F.col("words"), k).alias("hashes"))
              .select("row_key", F.explode(sketch(F.col("hashes"), ratio)).alias("h")))
    found = materialise(hashed.join(index, "h").select("row_key", "item_id").distinct(), "item-candidates")

    keys = materialise(found.select("row_key").distinct(), "item-documents")
    near = (rows.join(keys, "row_key", "left_semi")
            .select("doc_id", "row_key", words_of(F.col("text")).alias("words"))
            .select("doc_id", "row_key", shingle_texts(F.col("words"), k).alias("shingles")))
    common = F.size(F.array_intersect("shingles", "item_shingles"))
    n = F.size("item_shingles")
    return (near.join(found, "row_key").join(it.select("item_id", "item_shingles"), "item_id")
            .select("doc_id", "item_id", n.cast("long").alias("n_shingles"), common.cast("long").alias("n_common"))
            .filter(F.col("n_common") >= containment * F.col("n_shingles") - 1e-9)
            .withColumn("containment", F.col("n_common") / F.col("n_shingles")).distinct())


def apply(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Documents that contain no item, in the input's columns (whatever their names)."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    bad = find_items(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, "key", "text", **params)
    bad = materialise(bad.select("doc_id").distinct(), "contaminated")
    return unboxed(boxed(docs, key=key).join(bad, F.col("key") == F.col("doc_id"), "left_anti"), docs.columns)


ORACLE = """
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM w WHERE len(w) > 0
), n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE kind = 1 GROUP BY 1
), c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_common FROM s d JOIN s i ON d.s = i.s AND d.kind = 0 AND i.kind = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_common, n_common / n_shingles AS containment
FROM c JOIN n USING (item_id) WHERE 100 * n_common >= 80 * n_shingles
"""
