"""Scalar transforms of band values. NaN counts as missing unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(v: Column) -> Column:
    """NaN becomes null."""
    return F.when(F.isnan(v), None).otherwise(v)


def mask_sentinel(v: Column, below: float = -1e20) -> Column:
    """Zero for missing, infinite or sentinel values."""
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < below)
    return F.when(bad, 0.0).otherwise(v)


def sanitize(v: Column) -> Column:
    """Scores into [0, 1]: missing and -inf are 0, +inf is 1."""
    return F.when(v.isNull() | F.isnan(v), 0.0).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def log_positive(v: Column) -> Column:
    return F.log1p(F.greatest(v, F.lit(0.0)))


def dequantise(q: Column, top: Column, mode: Column) -> Column:
    """8-bit levels 1..255 back to 0..top, linearly or by squares; level 0 has no data and is 0."""
    u = (q - 1) / 254.0
    return F.when(q == 0, 0.0).when(mode == "sqrt", u * u * top).otherwise(u * top)


def tilt(vertical: Column, horizontal: Column, eps: float = 1e-6) -> Column:
    return F.atan2(vertical, horizontal + eps)


def tilt_horizontal(vertical: Column, horizontal: Column, eps: float = 1e-6) -> Column:
    return F.atan2(horizontal, F.abs(vertical) + eps)


def transtension(shear: Column, dilation: Column, invariant: Column) -> Column:
    return shear * (F.abs(dilation) + 1) / (invariant + 2)


def dipole(a: Column, b: Column) -> Column:
    """Geometric mean of two responses that must both be there."""
    return F.sqrt(F.greatest(a, F.lit(0.0)) * F.greatest(b, F.lit(0.0)))


def second_largest(*columns: Column) -> Column:
    return F.element_at(F.array_sort(F.array(*columns)), len(columns) - 1)


def in_range(v: Column, low: float, high: float) -> Column:
    """v where low <= v <= high, else null."""
    return F.when(v.between(low, high), v)


def first_valid(low: float, high: float, *columns: Column) -> Column:
    """The first column strictly between the bounds, at two decimals."""
    return F.round(F.coalesce(*(F.when((x > low) & (x < high), x) for x in columns)), 2)


def inclusion_threshold(score: Column, alpha: float = 0.2, beta: float = 0.8) -> Column:
    """Smallest hit probability at which one more emitted cell raises a weighted Tversky score."""
    return alpha * score / (1 - score * (1 - beta - alpha))


def truncated_pareto_mean(alpha: Column, low: Column, high: Column) -> Column:
    """Mean of a Pareto law with exponent alpha between low and high > low (null otherwise); the limit at alpha = 1
    included."""
    ratio = F.when(high > low, F.log(high / low))
    e = 1 - alpha
    near = F.abs(e * ratio) < 1e-9
    top = F.when(near, ratio).otherwise(F.expm1(e * ratio) / F.when(near, 1.0).otherwise(e))
    return alpha * low * top / -F.expm1(-alpha * ratio)


# Fixed values of the scarp and potassic ratios.
UPWARD_WEIGHT, FACE_BASE, CROSS_FLOOR = 1.35, 0.3, 0.08
RELIEF_FLOOR = 9.0
ANTISLOPE_BASE, ANTISLOPE_CROSS_FLOOR = 0.25, 0.10
POTASSIUM_OFFSET, THORIUM_OFFSET = 1.0, 10.0


def tectonic_over_fluvial(down: Column, up: Column, coherence: Column, cross: Column) -> Column:
    """Scarp-like over channel-like response: the stronger face (upward ones weighted) by coherence."""
    return F.greatest(down, UPWARD_WEIGHT * up) * (FACE_BASE + coherence) / (cross + CROSS_FLOOR)


def piedmont_step(step: Column, relief: Column) -> Column:
    return step / F.sqrt(relief + RELIEF_FLOOR)


def antislope(up: Column, coherence: Column, cross: Column) -> Column:
    return up * (ANTISLOPE_BASE + coherence) / (cross + ANTISLOPE_CROSS_FLOOR)


def potassic_ratio(potassium: Column, thorium: Column) -> Column:
    return (potassium + POTASSIUM_OFFSET) / (thorium + THORIUM_OFFSET)
