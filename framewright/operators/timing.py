"""Time bases, cadence, epochs, poses and motion references of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright import constants as C
from framewright.operators.ordering import medians, previous_row, rank_rows, running_sum
from framewright.session import materialise

KEY = "capture_id"


def capture_ends(frames: DataFrame) -> DataFrame:
    """First and last tick and number of frames of each capture, written."""
    return materialise(frames.groupBy(KEY).agg(
        F.min("ts_ticks").alias("_t0"), F.max("ts_ticks").alias("_t1"), F.count(F.lit(1)).alias("_all")), "ends")


def _seconds(ticks: str) -> Column:
    """Seconds between the capture's first tick and ``ticks``: integers are subtracted before they become doubles."""
    return (F.col(ticks) - F.col("_t0")) / F.lit(float(C.TICKS_PER_SECOND))


def with_seconds(frames: DataFrame) -> DataFrame:
    """Seconds since the first frame."""
    first = capture_ends(frames).select(KEY, "_t0")
    return frames.join(first, KEY).withColumn("t_s", _seconds("ts_ticks")).drop("_t0")


def with_cadence(frames: DataFrame, cadence_s: float | None = None) -> DataFrame:
    """Seconds from the frame position when nothing was recorded; the origin says so."""
    if cadence_s is not None and not 0 < cadence_s < float("inf"):
        raise ValueError("cadence must be positive and finite")
    placed = rank_rows(frames, [KEY], "frame_index", "frame_index", name="_rank")
    return placed.withColumn("t_s", (F.col("_rank") - 1) * F.lit(float(cadence_s or 1.0))).withColumn(
        "origin", F.lit("inferred" if cadence_s is None else "user")).drop("_rank")


def intervals(frames: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Frame-to-frame tick interval in capture order (null for the first frame)."""
    return previous_row(frames, [KEY], "frame_index", "frame_index", "ts_ticks", name="_previous",
                        partitions=partitions).withColumn("interval_ticks", F.col("ts_ticks") - F.col("_previous")).drop("_previous")


def capture_timing(frames: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Duration, median cadence, duplicates and interval limits; reversed or span-less times are invalid."""
    gaps = intervals(frames, partitions=partitions)
    second = F.lit(float(C.TICKS_PER_SECOND))
    gap = F.col("interval_ticks")
    out = gaps.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_frames"),
        ((F.max("ts_ticks") - F.min("ts_ticks")) / second).alias("duration_s"),
        F.count_if(gap == 0).alias("duplicate_intervals"), F.count_if(gap < 0).alias("reversed"),
        (F.min(gap) / second).alias("minimum_interval_s"), (F.max(gap) / second).alias("maximum_interval_s"))
    middle = medians(gaps, [KEY], {"_median": "interval_ticks"})
    valid = (F.col("reversed") == 0) & ((F.col("n_frames") == 1) | (F.col("duration_s") > 0))
    return out.join(middle, KEY, "left").select(
        KEY, F.when(valid, "available").otherwise("invalid").alias("status"), "n_frames", "duration_s",
        (F.col("_median") / second).alias("median_cadence_s"), "duplicate_intervals", "minimum_interval_s", "maximum_interval_s")


def ticks_to_utc(ticks: Column) -> Column:
    """100 ns ticks since year 1 as a timestamp (the last decimal is below a microsecond)."""
    return F.timestamp_micros(F.floor((ticks - C.TICKS_AT_UNIX_EPOCH) / 10).cast("long"))


def is_absolute(ticks: Column) -> Column:
    """Ticks that can be a date of the imaging era rather than a relative counter."""
    return (ticks >= C.TICKS_AT_1900) & (ticks < C.TICKS_AT_2101)


def julian_date(ticks: Column) -> Column:
    return F.lit(C.JD_AT_TICK_ZERO) + ticks / F.lit(float(C.TICKS_PER_DAY))


def midpoint_jd(frames: DataFrame) -> DataFrame:
    """Julian date of each capture's midpoint, null outside the supported years."""
    ends = frames.groupBy(KEY).agg(F.min("ts_ticks").alias("first"), F.max("ts_ticks").alias("last"))
    whole = (F.expr("first div 2") + F.expr("last div 2") + F.expr("(first % 2 + last % 2) div 2")).cast("long")
    return ends.select(KEY, F.when(is_absolute(F.col("first")) & is_absolute(F.col("last")), julian_date(whole)).alias("jd_midpoint"),
                       whole.alias("ticks_midpoint"))


def output_epoch(frames: DataFrame, epoch_s: Column | float) -> DataFrame:
    """The output epoch against the capture midpoint, with UTC where ticks are absolute."""
    epoch = F.lit(float(epoch_s)) if isinstance(epoch_s, (int, float)) else epoch_s
    ends = frames.groupBy(KEY).agg(F.min("ts_ticks").alias("first"), F.max("ts_ticks").alias("last"))
    half = (F.col("last") - F.col("first")) / F.lit(2.0 * C.TICKS_PER_SECOND)
    micros = F.floor((F.col("first") - C.TICKS_AT_UNIX_EPOCH) / 10).cast("long") + F.rint(epoch * 1_000_000).cast("long")
    return ends.select(KEY, epoch.alias("epoch_s"), half.alias("capture_midpoint_s"), (epoch - half).alias("offset_from_midpoint_s"),
                       F.when(is_absolute(F.col("first")), micros).alias("utc_micros"))


def exposure(user_s: Column, recorded_s: Column) -> tuple[Column, Column]:
    """Effective exposure and where it comes from: user, header, or 0 - never the cadence."""
    recorded = F.when(recorded_s > 0, recorded_s)
    value = F.coalesce(user_s, recorded, F.lit(0.0))
    origin = F.when(user_s.isNotNull(), "user").when(recorded.isNotNull(), "header").otherwise("unavailable")
    return value, origin


def poses(frames: DataFrame, *, angle0: float, rate: float, epoch_s: float, exposure_s: float = 0.0,
          freeze_mid_exposure: bool = True) -> DataFrame:
    """Pose time and field angle per frame, at mid-exposure."""
    moment = F.col("t_s") + (0.5 * exposure_s if freeze_mid_exposure else 0.0)
    return frames.withColumn("pose_t_s", moment).withColumn(
        "field_angle_rad", F.lit(angle0) + F.lit(rate) * (F.col("pose_t_s") - F.lit(epoch_s)))


def nearest_pose(posed: DataFrame, target: Column | float) -> DataFrame:
    """The pose nearest to a target time in each capture; equally near poses prefer the earliest frame."""
    goal = F.lit(float(target)) if isinstance(target, (int, float)) else target
    best = F.min_by(F.struct("frame_index", "pose_t_s", "field_angle_rad"), F.struct(F.abs(F.col("pose_t_s") - goal), F.col("frame_index")))
    return posed.groupBy(KEY).agg(best.alias("p")).select(KEY, "p.*")


def unwrapped(frames: DataFrame, angle: str, *, partitions: int | None = None) -> DataFrame:
    """Angles without jumps of more than half a turn between consecutive frames."""
    turn = 2 * 3.141592653589793
    with_last = previous_row(frames, [KEY], "frame_index", "frame_index", angle, name="_last", partitions=partitions)
    step = F.col(angle) - F.col("_last")
    wrapped = F.pmod(step + turn / 2, F.lit(turn)) - turn / 2
    wrapped = F.when((wrapped == -turn / 2) & (step > 0), F.lit(turn / 2)).otherwise(wrapped)
    fix = F.when(F.col("_last").isNull() | (F.abs(step) < turn / 2), F.lit(0.0)).otherwise(wrapped - step)
    return running_sum(with_last, [KEY], "frame_index", "frame_index", fix, name="_fix", partitions=partitions).withColumn(
        "unwrapped", F.col(angle) + F.col("_fix")).drop("_last", "_fix")


def motion_reference(frames: DataFrame, *, policy: str = "middle", partitions: int | None = None) -> DataFrame:
    """Anchor frame of each capture: near the middle in time, or the best frame anywhere.

    The pool is within a tenth of the duration around the middle (at least the four
    nearest frames); the anchor is the frame of at least median pool quality closest
    to the middle, better and earlier frames first.
    """
    if policy == "best":
        best = F.min_by(F.struct("frame_index", "ts_ticks"), F.struct(-F.col("quality"), F.col("frame_index")))
        anchors = frames.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(
            best.alias("a"), F.min("ts_ticks").alias("_t0"), F.count(F.lit(1)).alias("pool"))
        return anchors.select(KEY, F.col("a.frame_index").alias("anchor_index"), _seconds("a.ts_ticks").alias("anchor_s"), "pool")

    def placed(captures: DataFrame) -> DataFrame:
        narrow = frames.select(KEY, "frame_index", "ts_ticks", "quality").join(captures, KEY)
        span = narrow.withColumn("t_s", _seconds("ts_ticks")).withColumn("_span", _seconds("_t1"))
        return span.select(KEY, "frame_index", "quality", "t_s", "_span", F.abs(F.col("t_s") - F.col("_span") / 2).alias("_distance"))

    # What is known of a capture is one written row, and the pool is written once: no task sorts frames for a chain of joins.
    ends = capture_ends(frames)
    near = materialise(placed(ends).where(F.col("_distance") <= 0.1 * F.col("_span")).drop("_span"), "near")
    found = ends.join(near.groupBy(KEY).agg(F.count(F.lit(1)).alias("_near")), KEY, "left")
    short = materialise(found.where(F.coalesce("_near", F.lit(0)) < F.least(F.lit(4), F.col("_all"))).select(*ends.columns), "short")
    # Only captures short of four near frames are ordered by distance.
    few = nearest_rows(placed(short).drop("_span").withColumn("_worse", -F.col("quality")), "_distance", "_worse", 4).drop("_worse")
    pool = near.join(short.select(KEY), KEY, "left_anti").unionByName(materialise(few, "few"))
    middle = medians(pool, [KEY], {"_median": "quality"}, partitions=partitions)
    sizes = pool.groupBy(KEY).agg(F.count(F.lit(1)).alias("pool"))
    good = pool.join(materialise(middle.join(sizes, KEY), "middle"), KEY).where(F.col("quality") >= F.col("_median"))
    best = F.min_by(F.struct("frame_index", "t_s"), F.struct(F.col("_distance"), -F.col("quality"), F.col("frame_index")))
    anchors = good.groupBy(KEY).agg(best.alias("a"), F.max("pool").alias("pool"))
    return anchors.select(KEY, F.col("a.frame_index").alias("anchor_index"), F.col("a.t_s").alias("anchor_s"), "pool")


def nearest_rows(frames: DataFrame, distance: str, worse: str, count: int) -> DataFrame:
    """The ``count`` rows per capture with the least (distance, worse, frame_index).

    Each task first keeps its own best rows, so only ``count`` rows per task and
    capture meet in the final choice.
    """
    entry = F.struct(F.col(distance).alias("d"), F.col(worse).alias("w"), F.col("frame_index").alias("i"))
    spread = frames.withColumn("_part", F.pmod(F.xxhash64("frame_index"), F.lit(1024)))
    local = Window.partitionBy(KEY, "_part").orderBy(distance, worse, "frame_index")
    first = spread.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= count)
    kept = first.withColumn("_entry", entry)
    final = Window.partitionBy(KEY).orderBy("_entry")
    return kept.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= count).drop("_part", "_r", "_entry")


def three_groups(frames: DataFrame, *, reach: int = 64, best: int = 32, partitions: int | None = None) -> DataFrame:
    """Three consecutive groups per capture, each with its best frames of a window around its middle.

    Groups differ by at most one frame, earlier groups being larger; among equal
    qualities the later frames win.
    """
    placed = rank_rows(frames, [KEY], "frame_index", "frame_index", name="_rank", size="_n", partitions=partitions)
    base, extra = F.floor(F.col("_n") / 3), F.col("_n") % 3
    at = F.col("_rank") - 1
    big = extra * (base + 1)
    placed = placed.withColumn("part", F.when(at < big, F.floor(at / (base + 1))).otherwise(
        extra + F.floor((at - big) / F.greatest(base, F.lit(1)))).cast("long"))
    start = F.col("part") * base + F.least(F.col("part"), extra)
    length = base + (F.col("part") < extra).cast("int")
    inside = at - start
    middle = F.floor(length / 2)
    window = placed.where((inside >= middle - reach) & (inside < middle + reach))
    # A window never exceeds 2 * reach frames, so ordering it is a bounded sort.
    return rank_rows(window, [KEY, "part"], "quality", "frame_index", name="_best", descending=True, tie_descending=True).where(
        F.col("_best") <= best).drop("_rank", "_n", "_best")


def order_violations(frames: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Frames whose time lies before that of the frame in front of them."""
    return intervals(frames, partitions=partitions).where(F.col("interval_ticks") < 0)

