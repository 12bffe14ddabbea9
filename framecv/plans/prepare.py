"""From raw frames to standardised training and test tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from framecv.functions.hashing import hash52
from framecv.operators.frames import _kept, draw_slices, tail_blocks
from framecv.operators.perturb import scramble_labels
from framecv.operators.position import MAX_ROWS, order_slices, ordered_position, split_hot, window_position
from framecv.operators.split import split_entities
from framecv.operators.stats import fit_stats, standardize
from framecv.session import materialize


@dataclass
class Prepared:
    """Standardised rows of both sides, and the training statistics they were scaled with."""

    train: DataFrame
    test: DataFrame
    stats: DataFrame


def standardized_blocks(frames: DataFrame, labels: DataFrame, key: str, label: str, order: Sequence[str],
                        features: Sequence[str], pct: float, n: int, seed: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """Label join, tail filter, block average, statistics and scaling.

    The blocks are written once to the shared folder: the statistics and the scaled rows both
    need them, and they are ``n`` times fewer than the frames.
    """
    blocks = materialize(tail_blocks(frames, key, order, pct, n, seed, label, features, labels, max_rows))
    return standardize(blocks, fit_stats(blocks, features), features)


def prepare_experiment(frames: DataFrame, labels: DataFrame, key: str, label: str, order: Sequence[str],
                       features: Sequence[str], pct: float, n: int, seed: int, test_fraction: float = 0.2,
                       stratify: bool = False, scramble: float = 0.0, max_rows: int = MAX_ROWS) -> Prepared:
    """Split by entity, scramble the training labels only, and scale both sides by the training statistics.

    The blocks do not depend on the split, so all frames are reduced in one pass.
    """
    blocks = materialize(tail_blocks(frames, key, order, pct, n, seed, label, features, labels, max_rows))
    split = split_entities(blocks, key, test_fraction, seed, label if stratify else None)
    sided = materialize(blocks.join(split, key))
    train = sided.where(~F.col("is_test")).drop("is_test")
    train = scramble_labels(train, key, label, scramble, seed)
    stats = fit_stats(train, features)
    test = sided.where(F.col("is_test")).drop("is_test")
    return Prepared(standardize(train, stats, features), standardize(test, stats, features), stats)


def _settings_by_keep(settings: DataFrame) -> dict[float, dict[int, list[tuple[str, int]]]]:
    """The settings (one row per trial at most) as keep -> base block size -> (setting, block size).

    A base is a common divisor of the sizes it serves: blocks of single rows have their own, all others share the greatest.
    """
    out: dict[float, dict[int, list]] = {}
    for r in settings.collect():
        out.setdefault(float(r["keep"]), {}).setdefault(0, []).append((r["setting"], int(r["navg"])))
    for keep, found in out.items():
        sizes = [s for s in found[0] if s[1] > 0]
        single, others = [s for s in sizes if s[1] == 1], [s for s in sizes if s[1] > 1]
        out[keep] = ({1: single} if single else {}) | ({math.gcd(*[n for _, n in others]): others} if others else {})
    return out


def _in_keep(keep: float) -> Column:
    n = F.col("_n")
    if keep <= 0 or keep >= 100:
        return F.lit(True)
    return F.col("_pos") >= n - _kept(n, keep)


def tail_blocks_by_setting(frames: DataFrame, settings: DataFrame, key: str, order: Sequence[str], seed: int,
                           label: str, features: Sequence[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """Block averages for many settings at once: ``setting, key, block``, the features and the label.

    ``settings``: rows ``(setting, keep, navg)``, one per setting. The frames are shuffled once, however many settings there are: inside an
    entity every keep has a running count along the draw, base blocks are added up from the rows, and the blocks of every size from the base
    blocks, all in the partitions of that shuffle. Only hot entities are shuffled again, slice by slice.
    """
    plan = _settings_by_keep(settings)
    keeps = sorted(plan)
    bases = [(i, base, plan[keep][base]) for i, keep in enumerate(keeps) for base in sorted(plan[keep])]
    names = dict.fromkeys([key, *order, label, *features])
    narrow = frames.where(F.col(key).isNotNull()).select(*names)
    cold, warm, _ = split_hot(narrow, [key], max_rows)
    draw = hash52(*[F.col(c) for c in order], seed, "block")

    def drawn(placed: DataFrame) -> DataFrame:
        flags = {f"_in{i}": _in_keep(keep).cast("bigint") for i, keep in enumerate(keeps)}
        return placed.withColumns(flags | {"_draw": draw})

    def running(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        along = Window.partitionBy(*by).orderBy("_draw", *order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({f"_at{i}": F.sum(f"_in{i}").over(along) - 1 for i in range(len(keeps))})

    def blocks(rows: DataFrame) -> DataFrame:
        # the base blocks of every keep that holds the row
        spots = [F.when(F.col(f"_in{i}") == 1, F.struct(F.lit(number).alias("base"), F.expr(f"_at{i} div {base}").alias("part"), F.col(f"_at{i}").alias("at"),
                                                        (F.col("_n") if keeps[i] <= 0 or keeps[i] >= 100 else _kept(F.col("_n"), keeps[i])).alias("rows")))
                 for number, (i, base, _) in enumerate(bases)]
        spread = rows.select(key, label, *features, F.explode(F.array_compact(F.array(*spots))).alias("_s"))
        sums = [f for j, c in enumerate(features) for f in (F.sum(c).alias(f"_sum{j}"), F.count(c).alias(f"_n{j}"))]
        parts = spread.groupBy(key, F.col("_s.base").alias("_base"), F.col("_s.part").alias("_part"), F.col("_s.rows").alias("_rows")).agg(
            *sums, F.min_by(label, F.col("_s.at")).alias(label))
        sizes = F.array(*[F.array(*[F.struct(F.lit(name).alias("setting"), F.lit(n).cast("bigint").alias("n"), F.lit(n // base).cast("bigint").alias("parts"))
                                    for name, n in served]) for _, base, served in bases])
        sized = parts.withColumn("_z", F.explode(F.get(sizes, F.col("_base"))))
        block = F.expr("_part div _z.parts")
        full = sized.where(block < F.expr("_rows div _z.n"))
        return full.groupBy(F.col("_z.setting").alias("setting"), key, block.alias("block")).agg(
            *[F.try_divide(F.sum(f"_sum{j}"), F.sum(f"_n{j}")).alias(c) for j, c in enumerate(features)], F.min_by(label, "_part").alias(label))

    if not bases:
        empty = narrow.select(F.lit("").alias("setting"), key, F.lit(0).cast("bigint").alias("block"), *[F.col(c).cast("double").alias(c) for c in features], label)
        return empty.where(F.lit(False))
    out = blocks(running(drawn(window_position(cold, [key], order)), [key]))
    if warm is None:
        return out
    placed = drawn(ordered_position(order_slices(warm, [key], order, max_rows), [key]))
    sliced = draw_slices(placed, max_rows)
    counts = sliced.groupBy(key, "_slice").agg(*[F.sum(f"_in{i}").alias(f"_c{i}") for i in range(len(keeps))])
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_slice", *[F.coalesce(F.sum(f"_c{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(keeps))])
    # one row per slice of a hot entity, see position.py
    moved = running(sliced, [key, "_slice"]).join(F.broadcast(offsets), [key, "_slice"])
    moved = moved.withColumns({f"_at{i}": F.col(f"_at{i}") + F.col(f"_b{i}") for i in range(len(keeps))})
    return out.unionByName(blocks(moved))


def standardize_by_setting(blocks: DataFrame, features: Sequence[str], by: Sequence[str] = ("setting",)) -> DataFrame:
    """Scale with the statistics of the rows of the same setting. There is one statistics row per setting."""
    aggs = [f for c in features for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]
    joined = blocks.join(F.broadcast(blocks.groupBy(*by).agg(*aggs)), list(by), "inner")
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.col(c) - F.col(f"_m_{c}"))
              for c in features}
    return joined.withColumns(scaled).select(*blocks.columns)
