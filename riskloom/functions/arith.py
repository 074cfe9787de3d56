"""Scalar expressions whose edge cases matter: half-even rounding, IEEE division, clipped logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def round_half_even(value: Column, digits: int) -> Column:
    """Round like binary floating libraries do: scale, round half to even, unscale."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def ieee_divide(numerator: Column, denominator: Column, on_zero: str = "ieee") -> Column:
    """Floating division that yields inf, -inf or NaN on a zero denominator.

    ANSI mode raises on division by zero. ``on_zero="null"`` gives NULL instead.
    """
    n, d = numerator.cast("double"), denominator.cast("double")
    quotient = F.try_divide(n, d)
    if on_zero == "null":
        return quotient
    if on_zero != "ieee":
        raise ValueError(f"on_zero must be 'ieee' or 'null', not {on_zero!r}")
    # try_divide is NULL on a zero denominator; there, 1/d is a signed infinity.
    return F.coalesce(quotient, n * F.pow(d, F.lit(-1.0)))


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def bernoulli_loss(label: Column, probability: Column, eps: float = 1e-15) -> Column:
    """Binary cross-entropy of one row, with the probability kept inside (eps, 1-eps)."""
    p = clip(probability, eps, 1.0 - eps)
    return -(label * F.log(p) + (F.lit(1.0) - label) * F.log(F.lit(1.0) - p))


def linear_blend(weights: Mapping[str, float]) -> Column:
    """Weighted sum of score columns."""
    terms = [F.lit(float(w)) * F.col(c) for c, w in weights.items()]
    return sum(terms[1:], terms[0])


def weighted_average(columns: Sequence[str], weights: Sequence[float]) -> Column:
    """Weighted mean of score columns; the weights need not sum to one."""
    return linear_blend(dict(zip(columns, weights, strict=True))) / F.lit(float(sum(weights)))


def two_way_mix(first: Column, second: Column, weight: Column | float) -> Column:
    """``(1 - w) * first + w * second``."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return (F.lit(1.0) - w) * first + w * second
