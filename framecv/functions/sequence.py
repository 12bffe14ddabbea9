"""Expressions on base sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The order in which the bases are numbered, and their complements.
BASES = "ACGT"
COMPLEMENTS = "TGCA"


def center_kmer(seq: Column, k: int, length: int = 36) -> Column:
    return F.substring(seq, length // 2 - k // 2 + 1, k)


def has_motif(seq: Column, motif: str = "CACGTG", start: int = 15) -> Column:
    """Whether ``motif`` sits at the zero-based position; false for short or missing sequences."""
    end = start + len(motif)
    hit = (F.length(seq) >= end) & (F.substring(seq, start + 1, len(motif)) == motif)
    return F.coalesce(hit, F.lit(False))


def flank(seq: Column, n: int, start: int = 15, end: int = 21) -> Column:
    return F.concat_ws("_", F.substring(seq, start - n + 1, n), F.substring(seq, end + 1, n))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def mutation_plan(df: DataFrame, seq: str) -> DataFrame:
    """One row per position: residue number and code, and those of the paired residue."""
    spread = df.withColumn("residue", F.explode(F.sequence(F.lit(1), F.length(seq))))
    spread = spread.withColumn("base", F.substring(F.col(seq), F.col("residue"), F.lit(1)))
    paired = F.translate("base", BASES, COMPLEMENTS)
    code = F.nullif(F.instr(F.lit(BASES), F.col("base")), F.lit(0)) - 1
    return spread.select(
        *df.columns, "residue", "base", code.alias("code"),
        (F.lit(2) * F.length(seq) + 1 - F.col("residue")).alias("paired_residue"),
        paired.alias("paired_base"), (F.lit(3) - code).alias("paired_code"))
