"""Ratios and interval estimates as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.text import _col

# Two-sided 95% normal quantile, full and rounded.
Z95 = 1.959963984540054
Z95_ROUNDED = 1.96


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double, null when the denominator is zero."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def wilson(
    successes: Column | str, total: Column | str, z: float = Z95, clip: bool = True
) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds of a proportion, null for an empty total."""
    n = F.when(_col(total) > 0, _col(total).cast("double"))
    p = _col(successes).cast("double") / n
    scale = 1.0 + z * z / n
    centre = (p + z * z / (2.0 * n)) / scale
    half = z * F.sqrt((p * (1.0 - p) + z * z / (4.0 * n)) / n) / scale
    low, high = centre - half, centre + half
    if clip:
        low = F.when(low.isNotNull(), F.greatest(F.lit(0.0), low))
        high = F.when(high.isNotNull(), F.least(F.lit(1.0), high))
    return low, high


def percent(part: Column | str, whole: Column | str, decimals: int = 4) -> Column:
    return F.bround(ratio(_col(part) * 100.0, whole), decimals)
