"""Annotation look-ups: equi-joins per level, combined by ``coalesce``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

VARIANT_KEY = ["gene", "aa_pos", "aa_ref", "aa_alt"]


def exact_then_position(df: DataFrame, exact: DataFrame, by_position: DataFrame, value: str, out: str,
                        position: str = "aa_pos", default: float | None = 0.0,
                        position_value: str | None = None) -> DataFrame:
    """Score of the same protein variant, else of its position, else ``default``.

    ``position`` is the position column of ``df`` and ``by_position`` (amino-acid
    or cDNA, whichever the source is keyed by).
    """
    e = exact.select(*VARIANT_KEY, F.col(value).alias("_exact"))
    p = by_position.select("gene", position, F.col(position_value or value).alias("_pos"))
    joined = df.join(e, VARIANT_KEY, "left").join(p, ["gene", position], "left")
    levels = [F.col("_exact"), F.col("_pos")] + ([] if default is None else [F.lit(default)])
    return joined.withColumn(out, F.coalesce(*levels)).drop("_exact", "_pos")


def position_chain(df: DataFrame, scores: DataFrame, value: str, out: str, position: str = "cdna_pos",
                   offsets: tuple[int, ...] = (0, -1), default: float = 0.0) -> DataFrame:
    """Try the look-up at ``position + offset`` for each offset in turn."""
    s = scores.select("gene", F.col(position).alias("_p"), F.col(value).alias("_v"))
    levels: list[Column] = []
    for i, off in enumerate(offsets):
        s_i = s.select("gene", (F.col("_p") - off).alias(position), F.col("_v").alias(f"_v{i}"))
        df = df.join(s_i, ["gene", position], "left")
        levels.append(F.col(f"_v{i}"))
    return df.withColumn(out, F.coalesce(*levels, F.lit(default))).drop(*[f"_v{i}" for i in range(len(offsets))])


def by_key(df: DataFrame, table: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join on ``keys`` with one default per taken column."""
    t = table.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in defaults])
    out = df.join(t, keys, "left")
    for c, d in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(f"_t_{c}"), F.lit(d)))
    return out.drop(*[f"_t_{c}" for c in defaults])


def gene_then_shared(df: DataFrame, gene_table: DataFrame, shared: DataFrame, keys: list[str], value: str,
                     out: str, default: float = 0.0) -> DataFrame:
    """Gene-specific table, or the shared one for genes whose own table is empty. The list of
    genes is broadcast: a shuffle by gene would make one task of a gene."""
    have = gene_table.select("gene").distinct().withColumn("_has", F.lit(True))
    g = gene_table.select("gene", *keys, F.col(value).alias("_own"))
    s = shared.select(*keys, F.col(value).alias("_shared"))
    joined = df.join(F.broadcast(have), "gene", "left").join(g, ["gene", *keys], "left").join(s, keys, "left")
    pick = F.when(F.col("_has"), F.col("_own")).otherwise(F.col("_shared"))
    return joined.withColumn(out, F.coalesce(pick, F.lit(default))).drop("_has", "_own", "_shared")


def membership(df: DataFrame, keys_table: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Boolean column: is the key present in the other table (NULL-safe false)."""
    k = keys_table.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return df.join(k, keys, "left").withColumn(out, F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def either_key(df: DataFrame, table: DataFrame, first: str, second: str, key: str, value: str, out: str) -> DataFrame:
    """Match ``table.key`` on column ``first``, else on ``second``: two equi-joins, no OR."""
    a = table.select(F.col(key).alias(first), F.col(value).alias("_a"))
    b = table.select(F.col(key).alias(second), F.col(value).alias("_b"))
    return (df.join(a, first, "left").join(b, second, "left")
            .withColumn(out, F.coalesce("_a", "_b")).drop("_a", "_b"))
