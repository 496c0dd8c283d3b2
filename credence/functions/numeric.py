"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Splits a double in two halves whose products are exact (2^27 + 1).
_SPLIT = 134217729.0


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def min_max(value: Column, low: float, high: float) -> Column:
    """Position of `value` in [low, high], clamped to [0, 1]; 0 for an empty range."""
    if high <= low:
        return F.lit(0.0)
    return clamp((value - F.lit(low)) / F.lit(high - low), 0.0, 1.0)


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")),
                      F.lit(default))


def round_exact(value: Column, digits: int) -> Column:
    """Round to `digits` decimals by the exact binary value, ties to even.

    `round` and `bround` decide on the printed decimal form, so 8.35 (stored slightly below)
    goes the wrong way.  Here the rounding error of `value * 10^digits` decides when that
    product looks like a tie.  Meant for |value| * 10^digits < 2^52.
    """
    scale = float(10 ** digits)
    product = value * F.lit(scale)
    high = F.lit(_SPLIT) * value - (F.lit(_SPLIT) * value - value)
    error = (high * F.lit(scale) - product) + (value - high) * F.lit(scale)
    floor = F.floor(product).cast("double")
    fraction = product - floor
    nearest = (F.when(fraction > 0.5, floor + 1).when(fraction < 0.5, floor)
               .when(error > 0, floor + 1).when(error < 0, floor)
               .when(F.abs(floor) % 2 == 0, floor).otherwise(floor + 1))
    return nearest / F.lit(scale)


def sentinel_to_null(value: Column, sentinel: float = -1) -> Column:
    return F.nullif(value, F.lit(sentinel).cast("double"))


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded half to even."""
    return F.format_string(f"%.{digits}f", round_exact(value, digits))
