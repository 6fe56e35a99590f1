"""Normal distribution as column expressions (published rational approximations)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's double-precision normal integral, numerator and denominator,
# highest power first.
HART_NUM = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DEN = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# Acklam's inverse normal, central and tail quotients, highest power first.
ACKLAM_A = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
ACKLAM_B = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
ACKLAM_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
ACKLAM_D = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
ACKLAM_LOW = 0.02425


def _poly(coefs: Sequence[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z."""
    a = F.abs(z)
    bell = F.exp(-a * a / F.lit(2.0))
    near = bell * _poly(HART_NUM, a) / _poly(HART_DEN, a)
    frac = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = a + F.lit(k) / frac
    far = bell / frac / F.lit(2.506628274631)
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def quantile(p: Column) -> Column:
    """Standard normal quantile of p in (0, 1)."""
    q = p - F.lit(0.5)
    s = q * q
    centre = q * _poly(ACKLAM_A, s) / _poly(ACKLAM_B, s)
    low = F.sqrt(F.lit(-2.0) * F.ln(p))
    high = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    return (
        F.when(p < ACKLAM_LOW, _poly(ACKLAM_C, low) / _poly(ACKLAM_D, low))
        .when(p > 1 - ACKLAM_LOW, -_poly(ACKLAM_C, high) / _poly(ACKLAM_D, high))
        .otherwise(centre)
    )
