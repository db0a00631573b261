"""Guarded arithmetic and densities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x held to [low, high]; null stays null."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def gaussian_pdf(x: Column, mean: Column | float, sd: Column | float) -> Column:
    mean, sd = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mean, sd))
    z = (x - mean) / sd
    return F.exp(F.lit(-0.5) * z * z) / (sd * F.lit(math.sqrt(2 * math.pi)))


def laplace(u: Column, scale: float) -> Column:
    """Laplace noise of this scale from a uniform in [0, 1)."""
    d = u - F.lit(0.5)
    return F.lit(-float(scale)) * F.signum(d) * F.log(F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(d), F.lit(1e-300)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows that have both, an aggregate; null if either side is constant in them.

    NaN counts as missing. Deviations of a constant are exactly 0, whatever its size, so no tolerance is needed.
    """
    nothing = F.lit(None).cast("double")
    x, y = (F.nanvl(v.cast("double"), nothing) for v in (x, y))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def quick_round(c: Column, digits: int = 6) -> Column:
    """F.round(c, digits), by a product and a quotient where c is not near the middle of two results or large: both give the double nearest to the decimal."""
    unit = 10.0**digits
    whole = F.rint(c * unit)
    clear = (F.abs(c * unit) < 1e9) & (F.abs(c * unit - whole) < 0.499999)
    return F.when(clear, whole / unit).otherwise(F.round(c, digits))
