"""Exact deduplication by two-pass Bloom filtering (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framecv.llm.bloom import filter_bits, possibly_held, repeated_bits
from framecv.llm.common import quoted, without
from framecv.session import materialize

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def text_key(text: Column) -> Column:
    """SHA-256 (lowercase hex) of a text with each run of white space replaced by one space; null counts as empty."""
    plain = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(F.encode(plain, "UTF-8"), 256)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Mark all but the first of equal texts. Texts are equal when they are identical after each run of white
    space is replaced by one space.

    Returns every row and column of df and keep_id (smallest id of the group), group_size, kept (id = keep_id) and
    text_sha256. With key_col the digest is taken from that column, which text_key() has made.

    The first pass counts the bits of the keys; the second finds the rows whose bits were all set more than once.
    Only those rows shuffle; the others are unique and pass straight through. Groups are counted with a map-side
    combine, so a group with a third of all rows is no burden to one task, and the join back is one that Spark
    can split (the groups are read from a table).

    Null texts are empty texts, and all empty texts are one group. Rows that repeat the id and the text are all
    kept: they are the same document. A null id is never the smallest; a group of null ids only has keep_id
    null and keeps all. Columns of df with a result's name are left out. An empty table gives an empty result.
    """
    text_key_col = text_key(quoted(text_col)) if key_col is None else quoted(key_col)
    keyed = df.withColumn("_key", text_key_col)
    narrow = keyed.select(quoted(id_col).alias("id"), F.col("_key"))
    if key_col is None:
        narrow = materialize(narrow)
    bits = filter_bits(narrow.count())
    bitmaps = materialize(repeated_bits(narrow, "_key", bits))
    groups = materialize(
        possibly_held(narrow, "_key", bitmaps, bits, "_maybe").where("_maybe")
        .groupBy("_key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    flagged = possibly_held(keyed, "_key", bitmaps, bits, "_maybe")
    own = quoted(id_col)
    alone = flagged.where("not _maybe").select(
        *[quoted(c) for c in without(df, RESULT).columns], own.alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.col("_key").alias("text_sha256"))
    renamed = groups.select(F.col("_key").alias("_group"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
    several = flagged.where("_maybe").join(renamed, F.col("_key") == F.col("_group")).select(
        *[quoted(c) for c in without(df, RESULT).columns], F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        own.eqNullSafe(F.col("_keep")).alias("kept"), F.col("_key").alias("text_sha256"))
    return alone.unionByName(several)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact_dedup keeps, with the columns of df."""
    return exact_dedup(df.select(*[quoted(c) for c in df.columns]), id_col, text_col).where("kept").select(
        *[quoted(c) for c in df.columns])
