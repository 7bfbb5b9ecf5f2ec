"""Two-sigma screening of measured frames and the accounting of what it removes.

Statistics are one aggregate per capture (map-side combined) joined back on the
capture key; nothing is windowed over a whole capture, so a hot capture is
spread over all tasks that read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.numeric import finite

KEY = "capture_id"


def with_validity(measured: DataFrame) -> DataFrame:
    """``valid``: status ok and all three metrics finite (the angle may be missing)."""
    return measured.withColumn("valid", (F.col("status") == "ok") & _all_finite())


def _all_finite() -> Column:
    flag = F.lit(True)
    for metric in C.METRICS:
        flag = flag & finite(F.col(metric))
    return flag


def screening_statistics(measured: DataFrame) -> DataFrame:
    """Mean, population deviation and two-sigma limits per capture; quality has no upper limit."""
    judged = with_validity(measured).where("valid")
    moments = []
    for metric in C.METRICS:
        moments += [F.avg(metric).alias(f"{metric}_mean"), F.stddev_pop(metric).alias(f"{metric}_std")]
    stats = judged.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_valid"), *moments)
    for metric in C.METRICS:
        mean, spread = F.col(f"{metric}_mean"), C.SIGMA_LIMIT * F.col(f"{metric}_std")
        stats = stats.withColumn(f"{metric}_lower", mean - spread)
        if metric != "quality":
            stats = stats.withColumn(f"{metric}_upper", mean + spread)
    return stats


def screen(measured: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Add ``accepted`` and one rejection flag per metric, all judged on the same valid set.

    Frames exactly on a limit stay; a few units of round-off around the mean
    keep identical measurements together.
    """
    stats = screening_statistics(measured) if stats is None else stats
    judged = with_validity(measured).join(stats.drop("n_valid"), KEY, "left")
    names = []
    for metric, reason in zip(C.METRICS, C.REASONS):
        slack = C.ROUNDOFF_ULPS * C.DOUBLE_EPS * F.greatest(F.abs(F.col(f"{metric}_mean")), F.lit(1.0))
        outside = F.col(metric) < F.col(f"{metric}_lower") - slack
        if metric != "quality":
            outside = outside | (F.col(metric) > F.col(f"{metric}_upper") + slack)
        judged = judged.withColumn(reason, F.coalesce(F.col("valid") & outside, F.lit(False)))
        names.append(reason)
    accepted = F.col("valid")
    for reason in names:
        accepted = accepted & ~F.col(reason)
    keep = [c for c in measured.columns] + ["valid", *names]
    return judged.select(*keep, accepted.alias("accepted"))


def reasons(screened: DataFrame) -> Column:
    """Why a frame is out, in fixed order: its status first, then the outlier flags."""
    routed = [F.when(F.col("status") == s, F.lit(s)) for s in C.STATUSES[1:5]]
    flagged = [F.when(F.col(r), F.lit(r)) for r in C.REASONS]
    return F.array_compact(F.array(*routed, *flagged))


def reason_counts(screened: DataFrame) -> DataFrame:
    return (
        screened.select(KEY, F.explode(reasons(screened)).alias("reason"))
        .groupBy(KEY, "reason")
        .agg(F.count(F.lit(1)).alias("frames"))
    )


def exclusion_counts(screened: DataFrame) -> DataFrame:
    """Excluded frames per capture by quality and shape, with their overlap."""
    shape = F.col("width_outlier") | F.col("height_outlier") | F.col("status").isin("clipped_target", "no_target")
    other = F.col("status").isin("invalid", "saturated")
    count = lambda flag: F.count_if(flag)
    return screened.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_total"),
        count(F.col("accepted")).alias("accepted"),
        count(F.col("low_quality")).alias("quality"),
        count(shape).alias("shape"),
        count(F.col("low_quality") & shape).alias("quality_shape_overlap"),
        count(other).alias("other"),
        count(~F.col("accepted")).alias("excluded"),
    )


def plot_rows(screened: DataFrame) -> DataFrame:
    """Per-frame display rows: score, mask and reasons."""
    return screened.select(KEY, "frame_index", F.col("quality").alias("score"), "accepted",
                           F.concat_ws(",", reasons(screened)).alias("reasons"))
