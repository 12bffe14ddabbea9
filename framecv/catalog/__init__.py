"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from framecv.catalog.base import ORACLES, QUERIES
from framecv.catalog import (  # noqa: F401
    frames, metrics, modelling, perturbation, reports, sequences, sources, splits, studies)

__all__ = ["ORACLES", "QUERIES"]
