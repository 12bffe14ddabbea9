"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def truncated_count(n: Column, fraction: float | Column) -> Column:
    """``int(n * fraction)`` in double arithmetic."""
    return (n.cast("double") * (fraction if isinstance(fraction, Column) else F.lit(float(fraction)))).cast("bigint")


def is_close(a: Column, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def binarize(value: Column, threshold: float = 0.0) -> Column:
    """1 where the value is strictly above the threshold (0.0 on log scale, 1.0 on raw)."""
    return (value > F.lit(float(threshold))).cast("int")


def linspace_point(i: Column, lo: Column, hi: Column, steps: int) -> Column:
    """Point ``i`` of ``steps`` evenly spaced points; the last one is ``hi`` itself."""
    return F.when(i >= steps - 1, hi).otherwise(lo + i * ((hi - lo) / F.lit(float(max(steps - 1, 1)))))


def argmax_class(scores: Column) -> Column:
    """Index of the largest entry of an array, the lowest index on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def logit_class(logit: Column) -> Column:
    return (logit > F.lit(0.0)).cast("int")


def log_intensity(intensity: Column) -> Column:
    return F.log(intensity.cast("double"))


def derive_labels(df: DataFrame, value: str, strong_cut: float = 1.0) -> DataFrame:
    """Three-class binding type and the non-binder flag from a signed value."""
    y = F.col(value)
    return df.withColumns({
        "binding_type": F.when(y.isNull(), F.lit(None)).when(y < 0, 0).when(y < strong_cut, 1).otherwise(2).cast("int"),
        "improving": (y < 0).cast("int"),
    })


def clean_feature_name(name: Column) -> Column:
    return F.trim(F.replace(F.replace(name, F.lit("Energy"), F.lit("")), F.lit("Delta_"), F.lit("")))


def fraction_tag(fraction: Column) -> Column:
    """0.25 -> ``0p25``."""
    return F.replace(F.format_string("%.2f", fraction), F.lit("."), F.lit("p"))


def percent_tag(prefix: str, level: Column) -> Column:
    """0.05 -> ``noi05``; the level is truncated to whole percents in double arithmetic."""
    return F.concat(F.lit(prefix), F.format_string("%02d", (level * F.lit(100.0)).cast("int")))


def parse_fraction(tag: Column) -> Column:
    return F.replace(tag, F.lit("p"), F.lit(".")).try_cast("double")


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns other than keys and labels, in schema order."""
    drop = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in drop]


def keep_existing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in columns if c in present]


def ordered_columns(df: DataFrame, key: str) -> DataFrame:
    """Key first, all other columns in alphabetical order."""
    return df.select(key, *sorted(c for c in df.columns if c != key))
