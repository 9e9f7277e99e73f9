"""Proportions and how many observations they need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson_low(k: Column, n: Column, z: float = Z) -> Column:
    return F.when(n > 0, F.greatest(F.lit(0.0), _middle(k, n, z) - _reach(k, n, z)))


def wilson_high(k: Column, n: Column, z: float = Z) -> Column:
    return F.when(n > 0, F.least(F.lit(1.0), _middle(k, n, z) + _reach(k, n, z)))


def _middle(k: Column, n: Column, z: float) -> Column:
    return (k / n + z * z / (2 * n)) / (1 + z * z / n)


def _reach(k: Column, n: Column, z: float) -> Column:
    p = k / n
    return z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)


def calls_needed(p: Column, half_width: Column, z: float = Z) -> Column:
    """Observations for a normal interval of that half width around proportion p."""
    return F.ceil(z * z * p * (1 - p) / (half_width * half_width))


def segments_needed(calls: Column, rate_per_hour: Column, segment_s: Column) -> Column:
    """Segments to listen to for that many calls at that rate."""
    return F.ceil(calls / (rate_per_hour * segment_s / 3600))
