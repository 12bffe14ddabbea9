"""Expressions on sequences and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from framecv.catalog.base import query, rounded, sequences, sql, table
from framecv.functions.scalars import derive_labels, log_intensity
from framecv.functions.sequence import center_kmer, flank, has_motif, mutation_plan, reverse_complement
from framecv.operators.quantiles import value_distribution

_COMPLEMENT = "translate(seq, 'ACGT', 'TGCA')"


@query(sql("SELECT doc_id, substr(seq, 13, 12) AS k12, substr(seq, 14, 10) AS k10, substr(seq, 15, 8) AS k8, substr(seq, 16, 6) AS k6 FROM seqs", "seqs"))
def center_kmers(spark, sf_dir):
    seq = F.col("seq")
    return sequences(spark, sf_dir).select("doc_id", *[center_kmer(seq, k).alias(f"k{k}") for k in (12, 10, 8, 6)])


def _at_15(column: str, motif: str) -> str:
    return f"length({column}) >= {15 + len(motif)} AND substr({column}, 16, {len(motif)}) = '{motif}'"


@query(sql(f"""SELECT doc_id, {_at_15('seq', 'CACGTG')} AS has_ebox, {_at_15('seq', 'CG')} AS has_step, {_at_15('text', 'en')} AS in_text,
    {_at_15('lang', 'en')} AS in_code FROM seqs JOIN documents USING (doc_id)""", "seqs"))
def motif_at_position(spark, sf_dir):
    """Motif at a fixed place; texts that end before it never match."""
    both = sequences(spark, sf_dir).drop("n_chars").join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    return both.select("doc_id", has_motif(F.col("seq")).alias("has_ebox"), has_motif(F.col("seq"), "CG").alias("has_step"),
                       has_motif(F.col("text"), "en").alias("in_text"), has_motif(F.col("lang"), "en").alias("in_code"))


@query(sql("""SELECT doc_id, substr(seq, 15, 1) || '_' || substr(seq, 22, 1) AS flank_1, substr(seq, 14, 2) || '_' || substr(seq, 22, 2) AS flank_2,
    substr(seq, 13, 3) || '_' || substr(seq, 22, 3) AS flank_3 FROM seqs""", "seqs"))
def motif_flanks(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", *[flank(F.col("seq"), n).alias(f"flank_{n}") for n in (1, 2, 3)])


@query(sql("""SELECT flank, count(*) AS n, min(v) AS low, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS high
    FROM (SELECT substr(seq, 15, 1) || '_' || substr(seq, 18, 1) AS flank, n_chars::DOUBLE AS v FROM seqs) GROUP BY flank""",
           "seqs", rounds="low q25 q50 q75 high"))
def flank_distributions(spark, sf_dir):
    """Box-plot table of a value per flank."""
    rows = sequences(spark, sf_dir).select(flank(F.col("seq"), 1, 15, 17).alias("flank"), F.col("n_chars").cast("double").alias("v"))
    return rounded(value_distribution(rows, "flank", "v"))


@query(sql(f"SELECT doc_id, reverse({_COMPLEMENT}) AS paired FROM seqs", "seqs"))
def reverse_complements(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", reverse_complement(F.col("seq")).alias("paired"))


@query(sql("""SELECT doc_id, i AS residue, substr(seq, i, 1) AS base, CAST(instr('ACGT', substr(seq, i, 1)) - 1 AS INTEGER) AS code, 73 - i AS paired_residue,
    translate(substr(seq, i, 1), 'ACGT', 'TGCA') AS paired_base, CAST(4 - instr('ACGT', substr(seq, i, 1)) AS INTEGER) AS paired_code
    FROM (SELECT *, unnest(range(1, 37))::INTEGER AS i FROM seqs)""", "seqs"))
def mutation_plans(spark, sf_dir):
    """Residue, base and pairing of every position."""
    return mutation_plan(sequences(spark, sf_dir).select("doc_id", "seq"), "seq").drop("seq")


@query("SELECT doc_id, round(ln(n_chars::DOUBLE), 6) AS log_value FROM documents")
def log_intensities(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").select("doc_id", log_intensity(F.col("n_chars")).alias("log_value")))


@query("""SELECT s_suppkey, CASE WHEN v < 0 THEN 0 WHEN v < 1 THEN 1 ELSE 2 END AS binding_type, CAST(v < 0 AS INTEGER) AS improving
    FROM (SELECT s_suppkey, s_acctbal / 3000.0::DOUBLE - 1.0::DOUBLE AS v FROM supplier)""")
def derived_labels(spark, sf_dir):
    values = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 3000.0 - 1.0).alias("v"))
    return derive_labels(values, "v").drop("v")
