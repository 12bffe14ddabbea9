"""Bloom filters as tables of bitmaps (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framecv.llm.common import quoted

#: One bitmap of Spark's bitmap functions holds this many bits (4 KB).
BITMAP_BITS = 32_768


def filter_bits(rows: int, bits_per_row: int = 16, most_bits: int = 2**30) -> int:
    """Size of the filter: a power of two of at least bits_per_row bits a row, at most most_bits (128 MB).

    Beyond most_bits more rows are taken as possibly repeated and shuffle; the result stays the same.
    """
    want = BITMAP_BITS
    while want < rows * bits_per_row and want < most_bits:
        want *= 2
    return want


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(bits)) for salt in (11, 23)]


def repeated_bits(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """First pass: the bits that were set more than once, as bitmaps of 4 KB (columns bucket and bitmap).

    The bits are counted with a map-side combine, so a group of copies adds two rows a task to the shuffle.
    At most bits / 8 bytes result.
    """
    seen = (keys.select(F.explode(F.array_distinct(F.array(*_places(F.col(key), bits)))).alias("bit"))
            .groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select((F.col("bit") + 1).alias("bit")))
    return _bitmaps(seen)


def held_bits(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The bits of all keys, as bitmaps; at most bits / 8 bytes."""
    return _bitmaps(keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("bit")).distinct().select((F.col("bit") + 1).alias("bit")))


def _bitmaps(bits: DataFrame) -> DataFrame:
    return (bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap")))


def possibly_held(df: DataFrame, key: str, bitmaps: DataFrame, bits: int, flag: str) -> DataFrame:
    """Flag the rows of which all bits are in the bitmaps. A row whose key went in is always flagged."""
    out, columns = df, [quoted(c) for c in df.columns]
    hits = []
    for i, place in enumerate(_places(F.col(key), bits)):
        side = bitmaps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_bitmap{i}"))
        # at most bits / 8 bytes, see filter_bits
        out = out.join(F.broadcast(side), F.bitmap_bucket_number(place + 1) == F.col(f"_bucket{i}"), "left")
        at = F.bitmap_bit_position(place + 1)
        byte = F.conv(F.hex(F.substring(F.col(f"_bitmap{i}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hits.append(F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    flagged = hits[0]
    for hit in hits[1:]:
        flagged = flagged & hit
    return out.select(*columns, flagged.alias(flag))
