"""Small dimension tables, each from one Python source of truth.

Every table here has a fixed number of rows (the largest is the 441-row
substitution table).
``sql_values`` renders the same rows as a SQL ``VALUES`` list.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from helixframe import constants as K

@lru_cache(maxsize=None)
def substitution_rows() -> list[tuple[str, str, int]]:
    """All ordered residue pairs with their substitution score."""
    names = [r[0] for r in K.RESIDUES]
    score: dict[tuple[str, str], int] = {}
    order: list[str] = []
    for line in K.SUBSTITUTION_TRIANGLE.strip().splitlines():
        head, *cells = line.split()
        for other, cell in zip(order, cells):
            score[head, other] = score[other, head] = int(cell)
        order.append(head)
    rows = []
    for a in names:
        for b in names:
            if a == b:
                value = K.SCORE_SAME
            elif "Ter" in (a, b):
                value = K.SCORE_STOP
            else:
                value = score[a, b]
            rows.append((a, b, value))
    return rows


@lru_cache(maxsize=None)
def exon_rows(coding: int = 150, spacing: int = 1000) -> list[tuple[str, int, int, int, int]]:
    """Synthetic exon layout of the fixtures: ``coding`` bases per exon, one exon
    every ``spacing`` bases along the strand. Rows: gene, k, start, end, first cDNA base."""
    rows = []
    for g in K.GENES:
        gene, strand, lo, hi, cds = g[0], g[3], g[4], g[5], g[6]
        for k, first in enumerate(range(1, cds + 1, coding)):
            size = min(coding, cds - first + 1)
            if strand == "+":
                start = lo + k * spacing
                rows.append((gene, k, start, start + size - 1, first))
            else:
                end = hi - k * spacing
                rows.append((gene, k, end - size + 1, end, first))
    return rows


TABLES: dict[str, tuple[tuple[str, ...], object]] = {
    "genes": (K.GENE_COLUMNS, lambda: K.GENES),
    "domains": (K.DOMAIN_COLUMNS, lambda: K.DOMAINS),
    "domain_candidates": (
        ("flag", "name", "rank"),
        lambda: [(f, n, i) for f, names in K.DOMAIN_FLAGS.items() for i, n in enumerate(names)],
    ),
    "codons": (("codon", "aa"), lambda: sorted(K.GENETIC_CODE.items())),
    "residues": (K.RESIDUE_COLUMNS, lambda: K.RESIDUES),
    "blosum62": (("aa_ref", "aa_alt", "blosum62_score"), substitution_rows),
    "exons": (("gene", "k", "exon_start", "exon_end", "first_cdna"), exon_rows),
}


def dim(spark: SparkSession, name: str) -> DataFrame:
    """The table as a local relation: Catalyst knows its exact size and decides on
    broadcasting by the session's threshold, so no join hint is needed."""
    return spark.sql(sql_values(name))


def _literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return f"CAST({value} AS BIGINT)"


@lru_cache(maxsize=None)
def sql_values(name: str) -> str:
    """``SELECT * FROM (VALUES ...) t(cols)`` ; the same text serves Spark and DuckDB."""
    columns, rows = TABLES[name]
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows())
    return f"SELECT * FROM (VALUES {body}) t({', '.join(columns)})"


def first_configured_domains(flag_candidates: dict[str, list[str]] | None = None) -> list[tuple]:
    """Resolve each generic domain flag to the first configured candidate per gene."""
    by_gene: dict[str, dict[str, tuple[int, int]]] = {}
    for gene, name, start, end, _ in K.DOMAINS:
        by_gene.setdefault(gene, {})[name] = (start, end)
    out = []
    for flag, names in (flag_candidates or K.DOMAIN_FLAGS).items():
        for gene, have in by_gene.items():
            hit = next((n for n in names if n in have), None)
            if hit:
                out.append((gene, flag, *have[hit]))
    return out
