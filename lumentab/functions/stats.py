"""Rates with guarded denominators and Wilson intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def rate(hits: Column, n: Column, digits: int = 6) -> Column:
    """hits / n, null where n is 0."""
    return F.round(hits / F.nullif(n, F.lit(0)), digits)


def wilson(hits: Column, n: Column, digits: int = 6) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a share, within [0, 1]; null where n is 0."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p, zz = hits / m, Z * Z
    middle = p + zz / (2 * m)
    half = Z * F.sqrt((p * (1 - p) + zz / (4 * m)) / m)
    scale = 1 + zz / m
    some = lambda c: F.when(n > 0, F.round(c, digits))
    return some(F.greatest(F.lit(0.0), (middle - half) / scale)), some(F.least(F.lit(1.0), (middle + half) / scale))
