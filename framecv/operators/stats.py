"""Training statistics and standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def fit_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: mean and sample standard deviation of every feature, in one pass."""
    aggs = []
    for c in features:
        aggs += [F.avg(F.col(f"`{c}`")).alias(f"mean_{c}"), F.stddev_samp(F.col(f"`{c}`")).alias(f"std_{c}")]
    return df.agg(*aggs)


def stats_long(stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: ``colname, mean, std``."""
    entries = [F.struct(F.lit(c).alias("colname"), F.col(f"`mean_{c}`").alias("mean"), F.col(f"`std_{c}`").alias("std"))
               for c in features]
    return stats.select(F.inline(F.array(*entries)))


def stats_wide(long: DataFrame, features: Sequence[str]) -> DataFrame:
    aggs = []
    for c in features:
        hit = F.col("colname") == c
        aggs += [F.max(F.when(hit, F.col("mean"))).alias(f"mean_{c}"), F.max(F.when(hit, F.col("std"))).alias(f"std_{c}")]
    return long.agg(*aggs)


def centred(x: Column, mean: Column, std: Column, zero_std: str = "center") -> Column:
    """Standard score; with no spread the value is centred only ('center') or divided by 1 ('one')."""
    no_spread = F.isnull(std) | F.isnan(std) | (std == 0) if zero_std == "center" else (std == 0)
    return F.when(no_spread, x - mean).otherwise((x - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std))


def standardize(df: DataFrame, stats: DataFrame, features: Sequence[str], zero_std: str = "center") -> DataFrame:
    """Apply the one-row statistics as a scalar subquery: no join, no shuffle."""
    row = stats.select(F.struct("*")).scalar()
    marked = df.withColumn("_stats", row)
    scaled = {c: centred(F.col(f"`{c}`"), F.col(f"_stats.`mean_{c}`"), F.col(f"_stats.`std_{c}`"), zero_std)
              for c in features}
    return marked.withColumns(scaled).drop("_stats")


def fold_train_stats(df: DataFrame, features: Sequence[str], by: Sequence[str], fold: str = "fold") -> DataFrame:
    """Statistics of the training part of every fold, from per-fold moments combined over the other folds.

    The rows are read once; what is joined is one row per fold. Returns ``by, fold`` and ``mean_*``, ``std_*``.
    """
    aggs = []
    for c in features:
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"_n_{c}"), F.avg(x).alias(f"_m_{c}"), F.var_pop(x).alias(f"_v_{c}")]
    every = list(by) or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    parts = source.groupBy(*every, fold).agg(*aggs)
    # moments around the overall mean keep the sums below free of cancellation
    around = Window.partitionBy(*every)
    for c in features:
        n, m = F.col(f"_n_{c}"), F.col(f"_m_{c}")
        overall = F.try_divide(F.sum(n * m).over(around), F.sum(n).over(around))
        parts = parts.withColumns({f"_o_{c}": overall, f"_d_{c}": m - overall})
    held = parts.select(*every, F.col(fold).alias("_held"))
    pairs = held.join(parts, every, "inner").where(F.col(fold) != F.col("_held"))
    combined = []
    for c in features:
        n, d, v = F.col(f"_n_{c}"), F.col(f"_d_{c}"), F.col(f"_v_{c}")
        total = F.sum(n)
        shift = F.try_divide(F.sum(n * d), total)
        spread = F.sum(n * (v + d * d)) - total * shift * shift
        combined += [(F.first(f"_o_{c}") + shift).alias(f"mean_{c}"),
                     F.sqrt(F.try_divide(F.greatest(spread, F.lit(0.0)), F.nullif(total - 1, F.lit(0)))).alias(f"std_{c}")]
    out = pairs.groupBy(*every, "_held").agg(*combined).withColumnRenamed("_held", fold)
    return out if by else out.drop("_all")


def standardize_by_fold(df: DataFrame, stats: DataFrame, features: Sequence[str], by: Sequence[str],
                        fold: str = "fold") -> DataFrame:
    """Standardise each row with the statistics of the training part of its own fold.

    The statistics are broadcast: they hold one row per fold of every repeat or level in ``by``.
    """
    joined = df.join(F.broadcast(stats), [*by, fold], "inner")
    scaled = {c: centred(F.col(f"`{c}`"), F.col(f"`mean_{c}`"), F.col(f"`std_{c}`")) for c in features}
    return joined.withColumns(scaled).drop(*[f"mean_{c}" for c in features], *[f"std_{c}" for c in features])
