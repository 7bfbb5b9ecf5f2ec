"""Stack-quality summaries: frame counts, weighted quality and effective frame numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.numeric import effective_count
from framewright.operators.ordering import medians

KEY = "capture_id"


def frame_weight(quality: Column, quality_weighting: bool = True) -> Column:
    return F.greatest(quality, F.lit(C.MIN_WEIGHT)) if quality_weighting else F.lit(1.0)


def stack_summary(used: DataFrame, screened: DataFrame | None = None, *, quality_weighting: bool = True) -> DataFrame:
    """One row per capture for the stacked frames, with the screened frames for comparison."""
    weighted = used.withColumn("_w", frame_weight(F.col("quality"), quality_weighting))
    q, w = F.col("quality"), F.col("_w")
    out = weighted.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("frames_stacked"),
        F.avg(q).alias("mean"),
        (F.sum(w * q) / F.sum(w)).alias("weighted_mean"),
        F.min(q).alias("minimum"),
        F.max(q).alias("maximum"),
        effective_count(F.sum(w), F.sum(w * w)).alias("effective_frames"),
    )
    if screened is not None:
        base = screened.where("accepted").groupBy(KEY).agg(
            F.avg("quality").alias("screened_mean"), F.count(F.lit(1)).alias("screened_frames"))
        out = out.join(base, KEY, "left")
    return out.withColumn("snr_gain", F.sqrt("effective_frames"))


def point_summary(chosen: DataFrame, quality: str, *, quality_weighting: bool = True) -> DataFrame:
    """Spread over alignment points of their frame counts, effective counts and weighted quality."""
    weighted = chosen.withColumn("_w", frame_weight(F.col(quality), quality_weighting))
    w = F.col("_w")
    per_point = weighted.groupBy(KEY, "point").agg(
        F.count(F.lit(1)).alias("frames"),
        effective_count(F.sum(w), F.sum(w * w)).alias("effective"),
        (F.sum(w * F.col(quality)) / F.sum(w)).alias("quality"),
    )
    spread = per_point.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("points"),
        *[f(c).alias(f"{c}_{n}") for c in ("frames", "effective", "quality") for n, f in (("min", F.min), ("max", F.max))],
    )
    middle = medians(per_point, [KEY], {"frames_median": "frames", "effective_median": "effective",
                                        "quality_median": "quality"})
    return spread.join(middle, KEY)


def snr_summary(sampled: DataFrame, summary: DataFrame) -> DataFrame:
    """Median single-frame signal, noise and SNR of sampled frames, scaled to the stack."""
    middle = medians(sampled, [KEY], {"signal": "signal", "noise": "noise"})
    frames = sampled.groupBy(KEY).agg(F.count(F.lit(1)).alias("frames_sampled"))
    single = middle.join(frames, KEY).withColumn("snr", F.col("signal") / F.col("noise"))
    return summary.join(single, KEY, "left").withColumn("estimated_snr", F.col("snr") * F.col("snr_gain"))


def sentence() -> Column:
    """One readable line per capture from the columns of :func:`stack_summary`."""
    return F.format_string(
        "%d of %d screened frames stacked; effective %.1f; quality mean %.3f, weighted %.3f (all screened %.3f); "
        "SNR gain x%.1f",
        "frames_stacked", "screened_frames", "effective_frames", "mean", "weighted_mean", "screened_mean", "snr_gain")
