"""Seeded randomness from md5, so that every draw is a pure function of the row."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

HASH_SPAN = 1 << 52


def _text(part) -> Column:
    return (part if isinstance(part, Column) else F.lit(part)).cast("string")


def hash52(*parts) -> Column:
    """Uniform integer in [0, 2**52) from the given columns and literals."""
    digest = F.md5(F.concat_ws("|", *[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform double in (0, 1)."""
    return (hash52(*parts) + F.lit(0.5)) / F.lit(float(HASH_SPAN))


def gaussian(*parts) -> Column:
    """Standard normal draw by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(*parts, "radius")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "angle"))
