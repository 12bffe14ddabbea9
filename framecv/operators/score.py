"""Reference-state score and the threshold sweep on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from framecv.functions.scalars import linspace_point
from framecv.session import materialize


def standard_score_sum(frames: DataFrame, terms: Sequence[str], name: str = "sum_z") -> DataFrame:
    """Population z-score of each term over all rows, summed per row."""
    stats = frames.agg(*[f for c in terms for f in (
        F.avg(F.col(f"`{c}`")).alias(f"m_{c}"), F.stddev_pop(F.col(f"`{c}`")).alias(f"s_{c}"))])
    marked = frames.withColumn("_z", stats.select(F.struct("*")).scalar())
    total = F.lit(0.0)
    for c in terms:
        sd = F.col(f"_z.`s_{c}`")
        total = total + (F.col(f"`{c}`") - F.col(f"_z.`m_{c}`")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return marked.withColumn(name, total).drop("_z")


def reference_entity(labels: DataFrame, key: str, value: str) -> Column:
    """Entity with the smallest absolute label, as a scalar."""
    return labels.agg(F.min_by(F.col(key), F.struct(F.abs(value), F.col(key)))).scalar()


def reference_state_score(frames: DataFrame, labels: DataFrame, key: str, value: str, terms: Sequence[str],
                          train: DataFrame | None = None, sign_flip: bool = True) -> DataFrame:
    """Model-free entity prediction: summed z-scores relative to the reference entity.

    The frames are aggregated once per entity and written; the reference is a row of that table. The ids of the training
    side and the labels are written too, as they are used more than once.
    """
    known = materialize(labels.select(key, value).distinct())
    if train is not None:
        ids = materialize(train.select(key).distinct())
        frames, known = frames.join(ids, key, "left_semi"), known.join(ids, key, "left_semi")
    scored = standard_score_sum(frames.select(key, *[F.col(f"`{c}`") for c in terms]), terms)
    entities = materialize(scored.groupBy(key).agg(F.avg("sum_z").alias("_mean"),
                                                   F.coalesce(F.stddev_pop("sum_z"), F.lit(0.0)).alias("yerr")))
    origin = entities.where(F.col(key) == reference_entity(known, key, value)).agg(F.max("_mean")).scalar()
    delta = entities.withColumn("_delta", F.col("_mean") - origin)
    y_pred = -F.col("_delta") if sign_flip else F.col("_delta")
    return delta.join(known, key, "inner").select(
        key, F.col("_delta").alias("pred_mean"), y_pred.alias("y_pred"), "yerr", F.col(value).alias("y_true"))


def threshold_sweep(df: DataFrame, score: str, truth: str, steps: int = 1000) -> DataFrame:
    """Accuracy of ``score > threshold`` at evenly spaced thresholds.

    Each row is counted once, under the number of thresholds below its score; the curve is a
    running sum over those ``steps + 1`` counters. Rows without a score or a truth do not count.
    """
    df = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    bounds = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).select(F.struct("*")).scalar()
    s, lo, hi = F.col(score).cast("double"), F.col("_b.lo").cast("double"), F.col("_b.hi").cast("double")
    width = (hi - lo) / F.lit(float(max(steps - 1, 1)))
    guess = F.coalesce(F.floor(F.try_divide(s - lo, width)), F.lit(0)).cast("int")
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(steps - 1))
    below = F.greatest(F.col("_g") - 1, F.lit(0))
    for d in (-1, 0, 1):
        i = F.col("_g") + d
        inside = (i >= 0) & (i < steps) & (linspace_point(i, lo, hi, steps) < s)
        below = below + F.when(inside, 1).otherwise(0)
    placed = df.withColumn("_b", bounds).withColumn("_g", guess).withColumn("_below", below)
    counters = placed.groupBy("_below").agg(F.sum(truth).alias("_pos"), F.count(F.lit(1)).alias("_all"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("_below"))
    full = grid.join(counters, "_below", "left").na.fill(0, ["_pos", "_all"])
    upto = Window.partitionBy(F.lit(0)).orderBy("_below").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    curve = full.select(
        F.col("_below").alias("step"),
        F.sum("_pos").over(every).alias("_p"), F.sum("_all").over(every).alias("_n"),
        F.sum("_pos").over(upto).alias("_p_low"), F.sum("_all").over(upto).alias("_n_low"),
    ).where(F.col("step") < steps).withColumn("_b", bounds)
    right = (F.col("_p") - F.col("_p_low")) + (F.col("_n_low") - F.col("_p_low"))
    return curve.select("step", linspace_point(F.col("step"), lo, hi, steps).alias("threshold"),
                        F.try_divide(right.cast("double"), F.col("_n").cast("double")).alias("accuracy"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """First threshold of the highest accuracy; one row."""
    best = F.max_by(F.struct("step", "threshold", "accuracy"), F.struct("accuracy", (-F.col("step")).alias("first")))
    return sweep.agg(best.alias("b")).select("b.*")


def nearest_mean(df: DataFrame, key: str, x: str, at: Column, y: str, k: int = 5) -> DataFrame:
    """Mean of ``y`` over the ``k`` rows nearest to ``at`` on ``x``; a top-k, merged over the partitions."""
    near = df.withColumn("_d", F.abs(F.col(x) - at)).where(F.col("_d").isNotNull()).orderBy("_d", key).limit(k)
    return near.agg(F.avg(y).alias("nearest_mean"), F.count(F.lit(1)).alias("k"))
