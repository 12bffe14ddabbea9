"""Exact positions inside groups, also when one group holds most of the rows.

A window over a group runs in one task, so it is used only for groups of at most
``max_rows`` rows. Larger ("hot") groups are cut into slices along their own order;
a position is then the number of rows in the earlier slices plus the position in the
slice. At most N / max_rows groups can be hot, which bounds everything broadcast here:
the hot keys and one count per slice and hot group.
The input is read more than once: pass a scan or a materialized table, not the result
of a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from framecv.session import materialize

MAX_ROWS = 2_000_000
# Rows of a slice of the sorted hot groups, where they are so many that every core has one.
SLICE_ROWS = 1_000_000


def _weight(weight: str | None) -> Column:
    return F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Groups with more than ``max_rows`` rows and their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > max_rows)


def split_hot(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_ROWS
              ) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of ordinary groups, rows of hot groups (with ``_rows``), and the hot keys.

    The sizes are counted when this is called, from the keys alone. Without a hot group the
    rows come back as they are, and the plan on top of them needs no second branch.
    """
    hot = hot_keys(df, keys, max_rows)
    if hot.count() == 0:
        return df, None, None
    hot = materialize(hot)
    cold = df.join(F.broadcast(hot), list(keys), "left_anti")
    warm = df.join(F.broadcast(hot), list(keys), "inner")
    return cold, warm, hot


def window_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str | None = None) -> DataFrame:
    """Adds ``_pos`` (rows before this one in the group) and ``_n`` (rows of the group)."""
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(*order)
    if weight is None:
        return df.withColumns({"_pos": (F.row_number().over(ordered) - 1).cast("bigint"),
                               "_n": F.count(F.lit(1)).over(group)})
    w = _weight(weight)
    before = F.sum(w).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({"_pos": F.coalesce(before, F.lit(0).cast("bigint")), "_n": F.sum(w).over(group)})


def order_slices(warm: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int) -> DataFrame:
    """The rows sorted by key and order, written once with ``_slice`` (it never decreases along the order) and ``_at`` (it grows with every row).

    Spark samples the ranges, so a row is compared with a few edges and no row carries them. A slice is sorted and streamed, never held as a whole.
    """
    rows = warm.count()
    wanted = max(warm.sparkSession.sparkContext.defaultParallelism, rows // SLICE_ROWS)
    slices = max(1, min(rows // max(1, max_rows // 2), wanted))
    ranged = warm.repartitionByRange(slices, *keys, *order).sortWithinPartitions(*keys, *order)
    return materialize(ranged.withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def ordered_position(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``_pos`` and ``_n`` to the rows of ``order_slices``: the place of a row in its slice and the rows of earlier slices, so nothing is shuffled."""
    counts = stored.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*keys)
    before = F.sum("_size").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_slice", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_size").over(group).alias("_n"))
    joined = stored.join(F.broadcast(offsets), [*keys, "_slice"], "inner")
    return joined.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_slice", "_at", "_shift")


def slice_offsets(sliced: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows before each slice and rows of the whole group; one row per slice."""
    counts = sliced.groupBy(*keys, "_slice").agg(F.sum(_weight(weight)).alias("_size"))
    group = Window.partitionBy(*keys)
    before = F.sum("_size").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*keys, "_slice", "_size",
                         F.coalesce(before, F.lit(0)).cast("bigint").alias("_before"),
                         F.sum("_size").over(group).alias("_n"))


def sliced_position(sliced: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str | None = None) -> DataFrame:
    """``window_position`` over (group, slice), moved on by the rows of earlier slices."""
    offsets = slice_offsets(sliced, keys, weight).drop("_size")
    inside = window_position(sliced, [*keys, "_slice"], order, weight).drop("_n")
    joined = inside.join(F.broadcast(offsets), [*keys, "_slice"], "inner")
    return joined.withColumn("_pos", F.col("_pos") + F.col("_before")).drop("_slice", "_before")


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str | None = None,
                  max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds ``_pos`` (zero-based) and ``_n`` to every row. ``order`` must be total inside a group."""
    cold, warm, _ = split_hot(df, keys, max_rows)
    out = window_position(cold, keys, order, weight)
    if warm is None:
        return out
    sliced = order_slices(warm.drop("_rows"), keys, order, max_rows)
    placed = ordered_position(sliced, keys) if weight is None else sliced_position(sliced.drop("_at"), keys, order, weight)
    return out.unionByName(placed)
