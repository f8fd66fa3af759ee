"""Input rows carried as one struct, so that no column of theirs can clash with an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def boxed(docs: DataFrame, **extra: Column) -> DataFrame:
    """``row`` (the whole input row) and the given columns."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def unboxed(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The input's columns again, some replaced."""
    return df.select(*[(replaced[c] if c in replaced else F.col("row").getField(c)).alias(c) for c in columns])


def without_lines(df: DataFrame, text: Column, gone: str, out: str) -> DataFrame:
    """Column ``out``: the text without the lines at the positions in array ``gone``; unchanged where that is NULL or empty."""
    df = df.withColumn("_lines_of_text", F.when(F.size(gone) > 0, F.split(text, "\n", -1)))
    parts = F.col("_lines_of_text")
    # positions left are a set difference; both uses of the parts keep them a column of its own, split once a row
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    return df.withColumn(out, F.when(parts.isNotNull(), kept).otherwise(text)).drop("_lines_of_text")
