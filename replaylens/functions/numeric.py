"""Scalar numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import LOOK_STD_FLOOR


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def log_variance(v: Column) -> Column:
    """log10(v + 1) with v clamped at 0; null where v is not finite."""
    return F.when(finite(v), F.log10(F.greatest(v, F.lit(0.0)) + 1))


def floored(std: Column, floor: float = LOOK_STD_FLOOR) -> Column:
    """A standard deviation that is safe to divide by."""
    return F.greatest(std, F.lit(floor))


def standardize(x: Column, mean: Column, std: Column, floor: float = LOOK_STD_FLOOR) -> Column:
    return (x - mean) / floored(std, floor)


def unstandardize(x: Column, mean: Column, std: Column, floor: float = LOOK_STD_FLOOR) -> Column:
    return x * floored(std, floor) + mean


def sigmoid(z: Column) -> Column:
    """Logistic function that never exponentiates a positive number."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def histogram_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin over [lo, hi]; the last bin is closed."""
    return F.least(F.lit(bins - 1), F.floor((x - lo) / (hi - lo) * bins)).cast("int")
