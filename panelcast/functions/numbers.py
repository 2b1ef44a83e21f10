"""Numeric helpers: lenient casts, safe ratios, transforms and their inverses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_long(col: str) -> Column:
    """Whole number of a text, 0 where it is none; decimals are cut off."""
    return F.coalesce(F.col(col).try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den where den is positive, else the default."""
    return F.when(den > 0, F.try_divide(num.cast("double"), den)).otherwise(F.lit(float(default)))


def _checked(value: Column, ok: Column, message: str) -> Column:
    return F.when(value.isNull() | ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def log_transform(y: str, offset: float = 1.0) -> Column:
    """ln(y + offset); a non-positive argument stops the job."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    v = F.col(y).cast("double") + offset
    return F.log(_checked(v, v > 0, "value not positive after adding the offset"))


def log_inverse(y: str, offset: float = 1.0) -> Column:
    return F.exp(y) - offset


def sqrt_transform(y: str) -> Column:
    v = F.col(y).cast("double")
    return F.sqrt(_checked(v, v >= 0, "square root of a negative value"))


def sqrt_inverse(y: str) -> Column:
    return F.col(y) * F.col(y)


def log1p_floored(y: str) -> Column:
    return F.log1p(F.greatest(F.col(y).cast("double"), F.lit(0.0)))


def expm1_floored(y: str) -> Column:
    return F.greatest(F.expm1(y), F.lit(0.0))


def volume_bucket(y: str) -> Column:
    """Fixed volume ladder."""
    v = F.col(y)
    return (
        F.when(v < 100, "<100")
        .when(v < 500, "100-500")
        .when(v < 2000, "500-2K")
        .when(v < 10000, "2K-10K")
        .when(v >= 10000, "10K+")
    )
