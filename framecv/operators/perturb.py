"""Label scrambling and label noise, decided per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from framecv.functions.hashing import gaussian, hash52
from framecv.functions.scalars import truncated_count
from framecv.operators.split import entity_table, hash_rank
from framecv.session import materialize


def scrambled_labels(df: DataFrame, key: str, label: str, fraction: float, seed: int, min_count: int = 0) -> DataFrame:
    """One row per entity: its label after ``int(n * fraction)`` entities took another entity's original label.

    The donor of rank r is rank (r + 1 + draw mod (n - 1)) mod n, hence never the entity itself.
    """
    both = donor_table(df, key, label, seed)
    chosen = (F.col("rank") < F.greatest(truncated_count(F.col("n"), fraction), F.lit(min_count).cast("bigint"))) & (F.col("n") > 1)
    return both.select(key, F.when(chosen, F.col("donated")).otherwise(F.col(label)).alias(label), chosen.alias("scrambled"))


def donor_table(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """One row per entity: its label, ``rank`` and ``n``, and ``donated``, the label of its donor."""
    ranked = materialize(hash_rank(entity_table(df, key, label).drop("n_rows"), key, hash52(F.col(key), seed, "scramble")))
    n, rank = F.col("n"), F.col("rank")
    step = F.pmod(hash52(F.col(key), seed, "donor"), F.greatest(n - 1, F.lit(1)))
    takers = ranked.withColumn("_donor", (rank + 1 + step) % n)
    donors = ranked.select(F.col("rank").alias("_donor"), F.col(label).alias("donated"))
    return takers.join(donors, "_donor", "inner").drop("_donor")


def scramble_labels(df: DataFrame, key: str, label: str, fraction: float, seed: int, min_count: int = 0) -> DataFrame:
    if fraction <= 0 and min_count == 0:
        return df
    labels = scrambled_labels(df, key, label, fraction, seed, min_count).select(key, label)
    return df.drop(label).join(labels, key).select(*df.columns)


def add_gaussian_noise(df: DataFrame, label: str, level: float, seed: int, row_id: Sequence[str]) -> DataFrame:
    """``y + N(0, level * sd)`` per row, with the population sd of the label over all rows."""
    if level <= 0:
        return df
    spread = df.agg(F.stddev_pop(label)).scalar()
    draw = gaussian(*[F.col(c) for c in row_id], seed, "noise")
    return df.withColumn(label, F.col(label) + draw * F.lit(float(level)) * spread)


def flipped_labels(df: DataFrame, key: str, label: str, level: float, seed: int, task: str) -> DataFrame:
    """One row per entity: its label after ``max(1, int(n * level))`` entities changed class."""
    ranked = materialize(hash_rank(entity_table(df, key, label).drop("n_rows"), key, hash52(F.col(key), seed, "flip")))
    hit = F.col("rank") < F.greatest(truncated_count(F.col("n"), level), F.lit(1).cast("bigint"))
    old = F.col(label)
    if task == "bin":
        new = F.lit(1) - old
    else:
        # classes of all entities; one that only later rows of an entity have is no choice
        classes = ranked.agg(F.array_sort(F.collect_set(label))).scalar()
        others = F.filter(F.col("_classes"), lambda c: c != old)
        pick = F.pmod(hash52(F.col(key), seed, "class"), F.greatest(F.size(others), F.lit(1))).cast("int")
        ranked = ranked.withColumn("_classes", classes)
        new = F.coalesce(F.get(others, pick), old)
    dtype = df.schema[label].dataType
    return ranked.select(key, F.when(hit, new).otherwise(old).cast(dtype).alias(label), hit.alias("flipped"))


def add_label_noise(df: DataFrame, key: str, label: str, level: float, seed: int, task: str = "reg",
                    row_id: Sequence[str] = ()) -> DataFrame:
    """Label noise of a task. ``row_id`` names the columns that tell rows apart; regression needs it, as each row has a draw
    of its own."""
    if level <= 0:
        return df
    if task == "reg":
        if not row_id:
            raise ValueError("row_id is needed: the noise is drawn row by row")
        return add_gaussian_noise(df, label, level, seed, list(row_id))
    labels = flipped_labels(df, key, label, level, seed, task).select(key, label)
    return df.drop(label).join(labels, key).select(*df.columns)
