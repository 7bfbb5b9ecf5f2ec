"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright import constants as C


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside array expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite(column: Column) -> Column:
    """True for a value that is neither null, NaN nor infinite."""
    return F.coalesce(column.isNotNull() & ~F.isnan(column) & (F.abs(column) < F.lit(math.inf)), F.lit(False))


def finite_or_null(column: Column) -> Column:
    return F.when(finite(column), column)


def ratio_or_zero(total: Column, weight: Column) -> Column:
    """total / weight where the weight is positive, otherwise 0."""
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0))


def clip(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(float(low))), F.lit(float(high)))


def smoothstep(column: Column) -> Column:
    u = clip(column, 0.0, 1.0)
    return u * u * (3.0 - 2.0 * u)


def luminance(red: Column, green: Column, blue: Column) -> Column:
    r, g, b = C.LUMINANCE
    return red * r + green * g + blue * b


def snap(column: Column) -> Column:
    """Remove coordinate round-off close to an integer."""
    return F.when(F.abs(column - F.rint(column)) < C.SNAP, F.rint(column)).otherwise(column)


def effective_count(sum_w: Column, sum_w2: Column) -> Column:
    """(sum w)^2 / sum w^2, and 0 for nothing or a non-positive total."""
    return F.when(sum_w > 0, sum_w * sum_w / sum_w2).otherwise(F.lit(0.0))


def rank_bin(zero_based_rank: Column, count: Column, bins: Column) -> Column:
    """Equal-count bin of a rank: min(rank * bins div count, bins - 1)."""
    return F.least(F.floor(zero_based_rank * bins / F.greatest(count, F.lit(1))), bins - 1).cast("long")


def rank_bin_count(frames: Column) -> Column:
    """How many rank bins a stack of ``frames`` supports."""
    return F.least(F.greatest(F.floor(frames / C.MIN_BIN_FRAMES), F.lit(2)), F.lit(C.MAX_RANK_BINS)).cast("long")


def half_of(frame_index: Column) -> Column:
    """Alternating blocks of consecutive frames: 0 or 1."""
    return F.pmod(F.floor(frame_index / C.HALF_BLOCK), F.lit(2)).cast("long")


def top_count(count: Column, percent: Column | int) -> Column:
    """Rows kept by a top-percent cut: at least one, half-to-even rounding."""
    p = F.lit(percent) if isinstance(percent, int) else percent
    return F.least(F.greatest(F.bround(p * count / F.lit(100.0)).cast("long"), F.lit(1)), count)


def kolmogorov_psd(fx: Column, fy: Column, r0: float) -> Column:
    """Phase power spectrum 0.023 r0^(-5/3) f^(-11/3), zero at the origin."""
    f = F.hypot(fx, fy)
    return F.when(f > 0, F.lit(0.023 * r0 ** (-5.0 / 3.0)) * F.pow(f, F.lit(-11.0 / 3.0))).otherwise(F.lit(0.0))


def kolmogorov_structure(rho: Column, r0: float) -> Column:
    """Phase structure function 6.88 (rho / r0)^(5/3)."""
    return F.lit(6.88) * F.pow(rho / F.lit(float(r0)), F.lit(5.0 / 3.0))


def zernike_order(j: Column) -> tuple[Column, Column]:
    """Radial and azimuthal order (n, m) of a one-based mode number; even numbers are cosines (m > 0)."""
    n = F.ceil((F.sqrt(8.0 * j + 1.0) - 3.0) / 2.0 - 1e-9).cast("long")
    place = j - (n * (n + 1) / 2).cast("long")  # 1-based place inside its radial order
    size = F.when(F.pmod(n, F.lit(2)) == 0, F.floor(place / 2) * 2).otherwise(F.floor((place - 1) / 2) * 2 + 1).cast("long")
    m = F.when(size == 0, F.lit(0)).when(F.pmod(j, F.lit(2)) == 0, size).otherwise(-size)
    return n, m.cast("long")
