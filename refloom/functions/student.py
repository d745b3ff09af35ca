"""Student's t distribution as columns: the incomplete beta function by its continued fraction."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' approximation of the gamma function, g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# End of fixed values.
#: Steps of the continued fraction, of which few are needed in the half where it is used.
STEPS = 400
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x >= 0.5."""
    y = x - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + i)
    t = y + 7.5
    return 0.9189385332046727 + (y + 0.5) * F.log(t) - t + F.log(total)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz' method, step by step."""
    floor = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    first = 1 / floor(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def half(s: Column, e: Column) -> Column:
        d, c = 1 / floor(1 + e * s["d"]), floor(1 + e / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(F.get(F.transform(F.array(half(s, even)), lambda v: v), F.lit(0)), odd)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda k: k.cast("double")), start, step)["h"]


def incomplete_beta(x: Column, a: Column, b: Column, y: Column | None = None, log_x: Column | None = None, scale: Column | None = None) -> Column:
    """The regularised incomplete beta function, 0 <= x <= 1, a and b from 0.5 on. y, log_x and scale: 1 - x, ln x and -ln B(a, b), where they are known more exactly."""
    y = 1 - x if y is None else y
    scale = log_gamma(a + b) - log_gamma(a) - log_gamma(b) if scale is None else scale
    front = F.exp(scale + a * (F.log(x) if log_x is None else log_x) + b * F.log(y))
    return F.when(x <= 0, 0.0).when(y <= 0, 1.0).when(x < (a + 1) / (a + b + 2), front * _fraction(x, a, b) / a).otherwise(1 - front * _fraction(y, b, a) / b)


def _gain(a: Column) -> Column:
    """ln of gamma(a + 1/2) / gamma(a): a difference of large numbers from some hundreds on, so there by its series."""
    return F.when(a > 500, F.log(a) / 2 - 1 / (8 * a) + 1 / (192 * a * a * a)).otherwise(log_gamma(a + 0.5) - log_gamma(a))


def two_sided(t: Column, freedom: Column) -> Column:
    """The probability of a t at least as far from 0, with so many degrees of freedom (1 or more); null where either is null."""
    square, a = t * t, freedom / 2
    return incomplete_beta(freedom / (freedom + square), a, F.lit(0.5), square / (freedom + square), -F.log1p(square / freedom), _gain(a) - 0.5 * float(math.log(math.pi)))
