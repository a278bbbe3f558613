"""Statistics as Column expressions over already aggregated columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson_lower(successes: Column, total: Column, z: float = Z95) -> Column:
    """Lower bound of Wilson's interval for a share; 0 for an empty total."""
    n, p = total.cast("double"), successes / total
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(total > 0, (centre - half) / (1 + z * z / n)).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null for a whole of 0."""
    return F.when(whole != 0, part.cast("double") / whole)


def range_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """The shared part of two ranges over their union."""
    shared = F.greatest(F.lit(0.0), F.least(high_a, high_b) - F.greatest(low_a, low_b))
    return shared / F.greatest(F.greatest(high_a, high_b) - F.least(low_a, low_b), F.lit(1e-12))


def standardized_difference(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """|difference of means| over the pooled deviation; 0 if that is 0, null with fewer than two values on a side."""
    pooled = F.sqrt((var_a + var_b) / 2)
    return F.when((n_a >= 2) & (n_b >= 2), F.when(pooled == 0, F.lit(0.0)).otherwise(F.abs(mean_a - mean_b) / pooled))


def oneway_icc(k: Column, n: Column, n2: Column, between: Column, within: Column) -> Column:
    """ICC(1) from groups k, values n, sum of squared group sizes n2, and sums of squares between and within groups."""
    msb, msw = between / (k - 1), within / (n - k)
    size = (n - n2 / n) / (k - 1)
    return F.when((k >= 2) & (n > k), (msb - msw) / (msb + (size - 1) * msw))
