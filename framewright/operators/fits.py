"""Small fits written as aggregates: moments, slopes, ratios and circular means."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.numeric import clip
from framewright.operators.ordering import medians, quantiles


def disc_moments(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centre and moment-equivalent ellipse of the bright part of each frame.

    Raw moments are enough for the centred ones, so each frame is aggregated once
    after its sky and peak levels are known.
    """
    keys = list(keys)
    levels = quantiles(pixels, keys, "value", {"sky": 0.10, "peak": 0.99})
    lit = pixels.join(levels, keys).where(F.col("value") > F.col("sky") + 0.25 * (F.col("peak") - F.col("sky")))
    w, x, y = F.col("value") - F.col("sky"), F.col("x") + 0.5, F.col("y") + 0.5
    sums = lit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy")).where("n_pixels >= 9")
    out = sums.withColumn("cx", F.col("sx") / F.col("s")).withColumn("cy", F.col("sy") / F.col("s"))
    mxx = F.col("sxx") / F.col("s") - F.col("cx") * F.col("cx")
    myy = F.col("syy") / F.col("s") - F.col("cy") * F.col("cy")
    mxy = F.col("sxy") / F.col("s") - F.col("cx") * F.col("cy")
    mean, spread = (mxx + myy) / 2, F.sqrt(F.greatest((mxx + myy) * (mxx + myy) / 4 - (mxx * myy - mxy * mxy), F.lit(0.0)))
    axis = lambda v: F.sqrt(F.greatest(v * 4, F.lit(0.0)))
    out = out.withColumn("semi_major", axis(mean + spread)).withColumn("semi_minor", axis(mean - spread))
    flattening = F.when(F.col("semi_major") <= 1e-9, 0.0).otherwise(
        F.greatest(1 - F.col("semi_minor") / F.col("semi_major"), F.lit(0.0)))
    return out.withColumn("pa_rad", F.atan2(2 * mxy, mxx - myy) / 2).withColumn("flattening", flattening).drop(
        "s", "sx", "sy", "sxx", "syy", "sxy")


def flattening(accepted: DataFrame, keys: Sequence[str], latitude_rad: float | None = None) -> DataFrame:
    """Globe flattening from the median silhouette axis ratio, with its robust scatter and status."""
    keys = list(keys)
    ratios = accepted.select(*keys, (F.col("height_px") / F.col("width_px")).alias("ratio"))
    counts = ratios.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    middle = medians(ratios, keys, {"axis_ratio": "ratio"})
    deviations = ratios.join(middle, keys).select(*keys, F.abs(F.col("ratio") - F.col("axis_ratio")).alias("deviation"))
    scatter = medians(deviations, keys, {"mad": "deviation"})
    latitude = 0.0 if latitude_rad is None else latitude_rad
    s2, c2 = math.sin(latitude) ** 2, math.cos(latitude) ** 2
    out = counts.join(middle, keys).join(scatter, keys).withColumn("scatter", F.col("mad") * 1.4826).drop("mad")
    polar2 = (F.pow(F.least(F.col("axis_ratio"), F.lit(1.0)), F.lit(2.0)) - s2) / max(c2, 1e-30)
    ratio = F.col("axis_ratio")
    status = (
        F.when(F.col("n_frames") < C.MIN_SILHOUETTES, "unresolved")
        .when((ratio < 0.75) | (ratio <= 0) | (ratio > 1.02) | (F.col("scatter") > 0.03), "unresolved")
        .when(F.lit(c2 < 0.04) | (polar2 <= 0), "unresolved")
        .otherwise("apparent" if latitude_rad is None else "estimated")
    )
    out = out.withColumn("status", status)
    return out.withColumn("flattening", F.when(F.col("status") != "unresolved", 1 - F.sqrt(F.greatest(polar2, F.lit(0.0)))))


# Two-sided 95 % quantiles of Student's distribution for 1 to 30 degrees of freedom.
STUDENT_975 = (
    12.70620473617, 4.30265272975, 3.18244630528, 2.77644510520, 2.57058183564, 2.44691185114, 2.36462425159, 2.30600413520, 2.26215716280,
    2.22813885199, 2.20098516009, 2.17881282967, 2.16036865646, 2.14478668792, 2.13144954556, 2.11990529922, 2.10981557783, 2.10092204024,
    2.09302405441, 2.08596344727, 2.07961384473, 2.07387306790, 2.06865761042, 2.06389856163, 2.05953855275, 2.05552943864, 2.05183051648,
    2.04840714180, 2.04522964213, 2.04227245630,
)


def _student_975(dof: Column) -> Column:
    """Two-sided 95 % Student quantile: published values up to 30 degrees of freedom, the Cornish-Fisher series above."""
    z = 1.959963984540054
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    n = F.greatest(dof, F.lit(1)).cast("double")
    series = z + g1 / n + g2 / (n * n) + g3 / (n * n * n) + g4 / (n * n * n * n)
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in STUDENT_975]), (dof - 1).cast("int")), series)


def significant_slope(samples: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Least-squares rate per group, set to 0 when it is not significant at 95 %."""
    keys = list(keys)
    t, a = F.col(time).cast("double"), F.col(value).cast("double")
    sums = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.var_pop(t).alias("vt"), F.var_pop(a).alias("va"),
        F.covar_pop(t, a).alias("vta"))
    n = F.col("samples")
    slope = F.when(F.col("vt") > 0, F.col("vta") / F.col("vt"))
    out = sums.withColumn("slope", slope)
    residual = F.greatest(F.col("va") - F.col("slope") * F.col("vta"), F.lit(0.0)) * n
    error = F.when(n >= 3, F.sqrt(residual / F.greatest(n - 2, F.lit(1)) / (F.col("vt") * n)))
    out = out.withColumn("standard_error", error).withColumn("threshold", _student_975(n - 2) * F.col("standard_error"))
    applied = F.when((n >= 3) & (F.abs("slope") <= F.col("threshold")), F.lit(0.0)).otherwise(F.col("slope"))
    return out.withColumn("rate", applied).drop("vt", "va", "vta")


def banded_slope(samples: DataFrame, keys: Sequence[str], band: Column, x: Column, y: Column, *,
                 min_band: int = C.LIMB_MIN_BAND_PIXELS, min_total: int = C.LIMB_MIN_PIXELS) -> DataFrame:
    """Slope of y on x after removing each band's own means.

    Only second moments per band are needed, so the demeaning never goes back to
    the samples: one aggregate per band, one per group. A sample with a null x or
    y is left out, which needs no filter below the geometry expressions.
    """
    keys = list(keys)
    per_band = samples.select(*keys, band.alias("_band"), x.alias("_x"), y.alias("_y")).groupBy(*keys, "_band").agg(
        F.count(F.col("_x") + F.col("_y")).alias("n"), F.var_pop("_x").alias("vx"), F.var_pop("_y").alias("vy"), F.covar_pop("_x", "_y").alias("vxy"))
    used = per_band.where(F.col("n") >= min_band).groupBy(*keys).agg(
        F.sum("n").alias("pixels"), F.sum(F.col("n") * F.col("vx")).alias("sxx"),
        F.sum(F.col("n") * F.col("vy")).alias("syy"), F.sum(F.col("n") * F.col("vxy")).alias("sxy"))
    fitted = (F.col("pixels") >= min_total) & (F.col("sxx") > 0)
    raw = F.col("sxy") / F.col("sxx")
    rms = F.sqrt(F.greatest(F.col("syy") - 2 * raw * F.col("sxy") + raw * raw * F.col("sxx"), F.lit(0.0)) / F.col("pixels"))
    return used.select(*keys, "pixels", F.when(fitted, clip(raw, 0.0, C.LIMB_MAX_POWER)).otherwise(F.lit(0.0)).alias("power"),
                       F.when(fitted, rms).alias("rms"), F.when(fitted, "fitted").otherwise("unmeasured").alias("origin"))


def axis_mean(angles: DataFrame, keys: Sequence[str], angle: str) -> DataFrame:
    """Mean direction of undirected axes and its coherence (doubled-angle mean)."""
    keys = list(keys)
    means = angles.groupBy(*keys).agg(F.avg(F.cos(2 * F.col(angle))).alias("c"), F.avg(F.sin(2 * F.col(angle))).alias("s"))
    return means.select(*keys, (F.atan2("s", "c") / 2).alias("axis_rad"), F.hypot("c", "s").alias("coherence"))
