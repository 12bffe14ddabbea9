"""Exact quantiles per group, by position and never by collecting a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from framecv.operators.position import MAX_ROWS, with_position
from framecv.session import materialize


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), alphap: float = 1.0,
              betap: float = 1.0, max_rows: int = MAX_ROWS) -> DataFrame:
    """One column per named probability, with ``n, low, high``.

    ``alphap = betap = 1`` interpolates linearly between order statistics; 0.4 is the
    approximately unbiased plotting position. Equal values are counted before they are ranked.
    """
    keys = list(by) or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    # ranking reads the counted values several times, so they are written once
    counted = materialize(source.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w")))
    placed = with_position(counted, keys, [value], weight="_w", max_rows=max_rows)
    n, x = F.col("_n").cast("double"), F.col(value)
    aggs = [F.max("_n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")]
    marks = {}
    for name, p in probs.items():
        at = n * F.lit(float(p)) + F.lit(alphap + p * (1.0 - alphap - betap))
        base = F.floor(F.least(F.greatest(at, F.lit(1.0)), F.greatest(n - 1, F.lit(1.0))))
        share = F.least(F.greatest(at - base, F.lit(0.0)), F.lit(1.0))
        upper = F.least(base + 1, F.col("_n"))

        def holds(rank):
            return (F.col("_pos") < rank) & (rank <= F.col("_pos") + F.col("_w"))

        aggs += [F.max(F.when(holds(base), x)).alias(f"_lo_{name}"), F.max(F.when(holds(upper), x)).alias(f"_hi_{name}"),
                 F.max(share).alias(f"_g_{name}")]
        marks[name] = (F.lit(1.0) - F.col(f"_g_{name}")) * F.col(f"_lo_{name}") + F.col(f"_g_{name}") * F.col(f"_hi_{name}")
    out = placed.groupBy(*keys).agg(*aggs)
    return out.select(*by, "n", "low", *[c.alias(name) for name, c in marks.items()], "high")


def value_distribution(df: DataFrame, group: str, value: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Box-plot table: count, extremes and quartiles per group."""
    return quantiles(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, [group], max_rows=max_rows)
