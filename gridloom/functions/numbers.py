"""Numeric column functions and small solvers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(x: Column, y: Column) -> Column:
    """Null unless the divisor is positive."""
    return F.when(y > 0, x / y)


def divided(x: Column, y: Column) -> Column:
    """DuckDB's division of doubles: by zero it is infinite, and 0 / 0 isn't a number (in Spark, an error or null)."""
    return F.when(y == 0, x * F.lit(float("inf"))).otherwise(x / y)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """P10: null stays null."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def rounded(x: Column, digits: int) -> Column:
    """DuckDB's ``round`` of doubles: scaled, halves away from zero, and the sign stays (-0.0 for what rounds to zero from below; Spark's
    ``round`` goes over decimals and has 0.0)."""
    scaled = x * float(10**digits)
    size = F.abs(scaled)
    whole = F.rint(size)
    out = F.signum(scaled) * F.when(size - whole == 0.5, whole + 1).otherwise(whole) / float(10**digits)
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def kilowatts(kwh: Column) -> Column:
    """Energy of a quarter hour as power."""
    return kwh * 4.0


def variation(std: Column, mean: Column) -> Column:
    """M08."""
    return ratio(std, mean)


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = clip(p, edge, 1 - edge)
    return F.ln(q / (1 - q))


def shift_logit(p: Column, gamma: float) -> Column:
    """M12."""
    return 1 / (1 + F.exp(-(logit(p) + gamma)))


def saturation(x: Column, scale: float) -> Column:
    """1 - exp(-x / scale)."""
    return 1 - F.exp(-x / scale)


def root(f: Callable[[float], float], low: float = -10.0, high: float = 10.0, otherwise: float = 0.0, steps: int = 80) -> float:
    """Bisection; ``otherwise`` if the ends have one sign."""
    a, b = f(low), f(high)
    if a == 0:
        return low
    if a * b > 0:
        return otherwise
    for _ in range(steps):
        mid = (low + high) / 2
        if f(mid) * a > 0:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def slope_and_r(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column, least: int = 20, most: float = 5.0) -> tuple[Column, Column]:
    """Least-squares slope (clipped) and Pearson's r from sums."""
    xx, yy, xy = n * sxx - sx * sx, n * syy - sy * sy, n * sxy - sx * sy
    slope = F.when((n >= least) & (xx > 1e-12), F.greatest(F.lit(-most), F.least(F.lit(most), xy / xx)))
    return slope, F.when((n >= least) & (xx > 1e-12) & (yy > 1e-12), xy / F.sqrt(xx * yy))


def incomplete_beta(a: float, b: float, x: float, steps: int = 20_000) -> float:
    """The regularised incomplete beta function, for two numbers of a half at least: the density in the angle t, with
    x = sin(t)**2, is bounded; the middles of equal steps are summed."""
    if not 0 < x < 1:
        return float(x >= 1)
    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + math.log(2)
    width = math.asin(math.sqrt(x)) / steps
    total = 0.0
    for k in range(steps):
        t = (k + 0.5) * width
        total += math.exp(scale + (2 * a - 1) * math.log(math.sin(t)) + (2 * b - 1) * math.log(math.cos(t)))
    return min(1.0, total * width)
