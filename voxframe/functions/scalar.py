"""Scalar expressions of the image data model; null is the only missing value inside the engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def log10_positive(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def wrap_angle(x: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(x + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def norm(*x: Column) -> Column:
    total = x[0] * x[0]
    for c in x[1:]:
        total = total + c * c
    return F.sqrt(total)


def half_even(x: Column) -> Column:
    return F.rint(x)


def truncated(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def tidy(x: Column, places: int = 6) -> Column:
    """Rounded off the lattice of ties, so the order of a sum doesn't show."""
    return F.round(x + F.lit(1e-9), places)
