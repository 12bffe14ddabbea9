"""Partial dependence of a fitted model on one feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from framecv.functions.scalars import linspace_point
from framecv.operators.position import MAX_ROWS
from framecv.operators.quantiles import quantiles

# The grid covers the central part of the feature, at plotting position 0.4.
LOW, HIGH, PLOTTING = 0.05, 0.95, 0.4


def feature_grid(source: DataFrame, feature: str, points: int = 50, max_rows: int = MAX_ROWS) -> DataFrame:
    """The grid of a feature as rows, one column ``grid``."""
    one = source.sparkSession.range(1)
    return with_grid(one, source, feature, points, max_rows).select(F.explode("_grid").alias("grid"))


def with_grid(df: DataFrame, source: DataFrame, feature: str, points: int = 50, max_rows: int = MAX_ROWS) -> DataFrame:
    """Adds ``_grid``, the values of the feature in ``source`` to predict at: all distinct ones if there
    are fewer than ``points``, else an even grid from the 5th to the 95th percentile."""
    few = source.select(feature).distinct().where(F.col(feature).isNotNull()).limit(points)
    values = few.agg(F.array_sort(F.collect_list(F.col(feature).cast("double")))).scalar()
    ends = quantiles(source, feature, {"lo": LOW, "hi": HIGH}, alphap=PLOTTING, betap=PLOTTING, max_rows=max_rows)
    lo, hi = F.col("_ends.lo").cast("double"), F.col("_ends.hi").cast("double")
    even = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: linspace_point(i, lo, hi, points))
    marked = df.withColumns({"_values": values, "_ends": ends.select(F.struct("lo", "hi")).scalar()})
    grid = F.when(F.size("_values") < points, F.col("_values")).otherwise(even)
    return marked.withColumn("_grid", grid).drop("_values", "_ends")


def individual_curves(model: PipelineModel, df: DataFrame, feature: str, row_id: list[str], points: int = 50,
                      max_rows: int = MAX_ROWS) -> DataFrame:
    """Prediction of each row at each grid value: ``row_id, grid, predicted``. Nothing is shuffled."""
    spread = with_grid(df, df, feature, points, max_rows)
    spread = spread.withColumn("grid", F.explode("_grid")).withColumn(feature, F.col("grid")).drop("_grid")
    return model.transform(spread).select(*row_id, "grid", F.col("prediction").alias("predicted"))


def partial_dependence(model: PipelineModel, df: DataFrame, feature: str, points: int = 50,
                       max_rows: int = MAX_ROWS) -> DataFrame:
    """Mean prediction at each grid value."""
    curves = individual_curves(model, df, feature, [], points, max_rows)
    return curves.groupBy("grid").agg(F.avg("predicted").alias("average"), F.count(F.lit(1)).alias("n"))


def linear_dependence(rows: DataFrame, model: DataFrame, features: Sequence[str], feature: str, grid: DataFrame) -> DataFrame:
    """Mean prediction of a linear model (one row, see ``fit_whole``) at every value of ``grid``: a line through the mean of the rows.

    The rows are read for their means only.
    """
    means = rows.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in features], F.count(F.lit(1)).alias("_n")).select(F.struct("*")).scalar()
    marked = grid.withColumns({"_m": means, "_f": model.select(F.struct("intercept", "coefficients")).scalar()})
    total = F.col("_f.intercept")
    for i, c in enumerate(features):
        total = total + F.get(F.col("_f.coefficients"), F.lit(i)) * (F.col("grid") if c == feature else F.col(f"_m.`{c}`"))
    return marked.select("grid", total.alias("average"), F.col("_m._n").alias("n"))


def linear_curves(rows: DataFrame, model: DataFrame, features: Sequence[str], feature: str, row_id: Sequence[str]) -> DataFrame:
    """The prediction of every row as a line in one feature: ``row_id, base, slope``. Nothing is copied to a grid."""
    marked = rows.withColumn("_f", model.select(F.struct("intercept", "coefficients")).scalar())
    base, slope = F.col("_f.intercept"), F.get(F.col("_f.coefficients"), F.lit(list(features).index(feature)))
    for i, c in enumerate(features):
        if c != feature:
            base = base + F.get(F.col("_f.coefficients"), F.lit(i)) * F.col(f"`{c}`").cast("double")
    return marked.select(*row_id, base.alias("base"), slope.alias("slope"))
