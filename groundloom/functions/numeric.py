"""Deterministic arithmetic.

Floating sums depend on the order rows arrive in. Sums here run over whole micro-units held in
two BIGINTs, so a retry, another partition count or another engine gives the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICRO = 1e6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micro(c: Column | str) -> Column:
    """A double as whole micro-units (BIGINT), halves upward; NULL for NaN and infinities."""
    return F.floor(nan_to_null(c) * F.lit(MICRO) + F.lit(0.5)).cast("bigint")


def exact_sum(c: Column | str) -> Column:
    """Sum over whole micro-units. High and low parts are summed apart, so no group is too large for BIGINT, and joined with one rounding."""
    m = micro(c)
    high, low = F.sum(F.shiftright(m, 20)), F.sum(m.bitwiseAND(F.lit((1 << 20) - 1)))
    return (high.cast("double") * F.lit(float(1 << 20)) + low.cast("double")) / F.lit(MICRO)


def exact_mean(c: Column | str) -> Column:
    return exact_sum(c) / F.count(nan_to_null(c))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round half up as floor(x*10^d + 0.5)/10^d: the same bits in any IEEE engine."""
    p = F.lit(float(10**digits))
    return F.floor(col(c) * p + F.lit(0.5)).cast("double") / p


def js_round(c: Column | str) -> Column:
    return F.floor(col(c) + F.lit(0.5)).cast("bigint")


def finite(c: Column | str) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def nan_to_null(c: Column | str) -> Column:
    x = col(c)
    return F.when(finite(x), x)


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), col(c)))


def modulo(c: Column, n: float) -> Column:
    """Floored modulo for doubles: the result is in [0, n)."""
    return c - F.lit(n) * F.floor(c / F.lit(n)).cast("double")


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))
