"""Labels, tail windows and block averages over the frames of each entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framecv.functions.hashing import HASH_SPAN, hash52
from framecv.functions.scalars import numeric_features
from framecv.operators.position import (MAX_ROWS, order_slices, ordered_position, sliced_position, split_hot,
                                        window_position, with_position)


def join_labels(frames: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Inner join, one label row per entity; neither side has to be small. Spark splits the entities that are skewed."""
    return frames.join(labels, key)


def frame_positions(df: DataFrame, key: str, order: Sequence[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Zero-based position in the entity and the size of the entity, on every row."""
    out = with_position(df.where(F.col(key).isNotNull()), [key], order, max_rows=max_rows)
    return out.withColumnsRenamed({"_pos": "position", "_n": "group_size"})


def _kept(n: Column, pct: float) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), (n.cast("double") * (F.lit(float(pct)) / F.lit(100.0))).cast("bigint"))


def _tail_cold(cold: DataFrame, key: str, order: Sequence[str], pct: float) -> DataFrame:
    placed = window_position(cold, [key], order)
    return placed.where(F.col("_pos") >= F.col("_n") - _kept(F.col("_n"), pct)).drop("_pos", "_n")


def _tail_hot(warm: DataFrame, key: str, order: Sequence[str], pct: float, max_rows: int) -> DataFrame:
    """Finds the first kept row of each hot entity; the rows themselves are only filtered."""
    point = F.struct(*order)
    placed = ordered_position(order_slices(warm.select(key, *[c for c in order if c != key]), [key], order, max_rows), [key])
    cuts = placed.where(F.col("_pos") == F.col("_n") - _kept(F.col("_n"), pct)).select(key, point.alias("_cut"))
    return warm.join(F.broadcast(cuts), key, "inner").where(point >= F.col("_cut")).drop("_cut")


def tail_percent(df: DataFrame, key: str, order: Sequence[str], pct: float, max_rows: int = MAX_ROWS) -> DataFrame:
    """The last ``pct`` percent of the rows of each entity, one row at least; rows without an entity are left out."""
    df = df.where(F.col(key).isNotNull())
    if pct <= 0 or pct >= 100:
        return df
    cold, warm, _ = split_hot(df, [key], max_rows)
    tail = _tail_cold(cold, key, order, pct)
    return tail if warm is None else tail.unionByName(_tail_hot(warm, key, order, pct, max_rows).drop("_rows"))


def _means(placed: DataFrame, key: str, n: int, features: Sequence[str], label: str | None) -> DataFrame:
    block = F.expr(f"_pos div {int(n)}")
    full = placed.where(block < F.expr(f"_n div {int(n)}"))
    aggs = [F.avg(F.col(f"`{c}`")).alias(c) for c in features]
    if label is not None:
        aggs.append(F.min_by(F.col(label), F.col("_pos")).alias(label))
    return full.groupBy(key, block.alias("block")).agg(*aggs)


def _blocks_cold(cold, key, order, n, seed, label, features):
    drawn = cold.withColumn("_draw", hash52(*[F.col(c) for c in order], seed, "block"))
    return _means(window_position(drawn, [key], ["_draw", *order]), key, n, features, label)


#: Slices of one hot entity. A slice is sorted and streamed, so it may grow with a very large entity; its count is broadcast.
MAX_SLICES = 1 << 14


def draw_slices(drawn: DataFrame, max_rows: int) -> DataFrame:
    """Slices of hot entities along ``_draw``: it is uniform, so equal ranges of it hold equal shares."""
    slices = F.expr(f"least({MAX_SLICES}, greatest(1, _rows div {max(1, max_rows // 2)}))")
    return drawn.withColumn("_slice", F.floor(F.col("_draw") / F.lit(float(HASH_SPAN)) * slices)).drop("_rows")


def _blocks_hot(warm, key, order, n, seed, label, features, max_rows):
    drawn = warm.withColumn("_draw", hash52(*[F.col(c) for c in order], seed, "block"))
    sliced = draw_slices(drawn, max_rows)
    return _means(sliced_position(sliced, [key], ["_draw", *order]), key, n, features, label)


def _needed(df, key, order, label, features):
    """Narrow to what the blocks use, so that the shuffle carries nothing else."""
    names = dict.fromkeys([key, *order, *features, *([label] if label else []), *(["_rows"] if "_rows" in df.columns else [])])
    return df.select(*[F.col(f"`{c}`") for c in names])


def block_average(df: DataFrame, key: str, order: Sequence[str], n: int, seed: int, label: str | None = None,
                  features: Sequence[str] | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Seeded shuffle inside the entity, full blocks of ``n`` rows, mean of the features.

    The remainder is dropped; the label is that of the first row of the block.
    """
    if n < 1:
        raise ValueError("block size must be at least 1")
    features = features or numeric_features(df, [key, *order, *([label] if label else [])])
    cold, warm, _ = split_hot(_needed(df.where(F.col(key).isNotNull()), key, order, label, features), [key], max_rows)
    blocks = _blocks_cold(cold, key, order, n, seed, label, features)
    return blocks if warm is None else blocks.unionByName(_blocks_hot(warm, key, order, n, seed, label, features, max_rows))


def tail_blocks(frames: DataFrame, key: str, order: Sequence[str], pct: float, n: int, seed: int,
                label: str | None = None, features: Sequence[str] | None = None, labels: DataFrame | None = None,
                max_rows: int = MAX_ROWS) -> DataFrame:
    """Label join, tail filter and block average with one shuffle of the frames.

    Hot entities are told apart once, before anything is shuffled.
    """
    if n < 1:
        raise ValueError("block size must be at least 1")
    features = features or numeric_features(frames, [key, *order, *([label] if label else [])])
    cold, warm, hot = split_hot(frames.where(F.col(key).isNotNull()), [key], max_rows)
    tailed = 0 < pct < 100

    cold = _needed(cold if labels is None else cold.join(labels, key, "inner"), key, order, label, features)
    blocks = _blocks_cold(_tail_cold(cold, key, order, pct) if tailed else cold, key, order, n, seed, label, features)
    if warm is None:
        return blocks
    if labels is not None:
        few = labels.join(F.broadcast(hot.select(key)), key, "left_semi")
        warm = warm.join(F.broadcast(few), key, "inner")
    warm = _needed(warm, key, order, label, features)
    if tailed:
        warm = _tail_hot(warm, key, order, pct, max_rows)
    return blocks.unionByName(_blocks_hot(warm, key, order, n, seed, label, features, max_rows))
