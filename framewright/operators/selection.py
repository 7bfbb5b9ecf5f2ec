"""Which screened frames to keep: by count, by quality range, by threshold, by top fraction.

Two tie rules exist on purpose. Count selection prefers the *earliest* of equal
frames; top-fraction subsets of a score sequence prefer the *latest* when higher
scores are better and the earliest when lower scores are better.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.numeric import finite, rank_bin, rank_bin_count, top_count
from framewright.operators.ordering import rank_rows

KEY = "capture_id"


def quality_range(measured: DataFrame) -> DataFrame:
    """Lowest and highest finite quality of each capture, before any screening."""
    q = F.when(finite(F.col("quality")), F.col("quality"))
    return measured.groupBy(KEY).agg(F.min(q).alias("low"), F.max(q).alias("high"))


def _check_percent(percent: int) -> None:
    if not isinstance(percent, int) or isinstance(percent, bool) or not 1 <= percent <= 100:
        raise ValueError("percent must be an integer from 1 to 100")


def select_by_range(screened: DataFrame, percent: int) -> DataFrame:
    """``selected``: accepted and strictly above low + (high - low)(1 - percent/100)."""
    _check_percent(percent)
    bounds = quality_range(screened)
    cutoff = F.col("low") + (F.col("high") - F.col("low")) * F.lit(1 - percent / 100.0)
    everything = F.lit(percent == 100) | F.col("low").isNull() | (F.col("low") == F.col("high"))
    chosen = F.col("accepted") & (everything | F.coalesce(F.col("quality") > cutoff, F.lit(False)))
    return screened.join(bounds, KEY).withColumn("selected", chosen).drop("low", "high")


def ranked(screened: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Accepted frames with their 1-based quality rank (ties: earliest first) and the group size."""
    return rank_rows(screened.where("accepted"), [KEY], "quality", "frame_index", size="n_accepted", descending=True, partitions=partitions)


def select_by_count(screened: DataFrame, percent: int, *, partitions: int | None = None) -> DataFrame:
    """The best ceil(n * percent / 100) accepted frames of each capture."""
    _check_percent(percent)
    quota = F.floor((F.col("n_accepted") * percent + 99) / 100)
    return ranked(screened, partitions=partitions).where(F.col("rank") <= quota)


def count_thresholds(screened: DataFrame, percent: int, *, partitions: int | None = None) -> DataFrame:
    """The last kept frame of each capture as (capture, quality, frame_index).

    One row per capture, so the stacking pass can apply the cut where the pixels
    are read instead of shuffling frames to join a per-frame mask.
    """
    _check_percent(percent)
    quota = F.floor((F.col("n_accepted") * percent + 99) / 100)
    return ranked(screened, partitions=partitions).where(F.col("rank") == quota).select(
        KEY, F.col("quality").alias("cut_quality"), F.col("frame_index").alias("cut_index"))


def within_threshold() -> Column:
    """Row predicate matching :func:`count_thresholds` after a join on the capture."""
    return (F.col("quality") > F.col("cut_quality")) | (
        (F.col("quality") == F.col("cut_quality")) & (F.col("frame_index") <= F.col("cut_index")))


def select_above(screened: DataFrame, threshold: float) -> DataFrame:
    """Accepted frames whose finite quality is strictly above an absolute threshold."""
    if isinstance(threshold, bool) or not threshold >= 0 or threshold == float("inf"):
        raise ValueError("the threshold must be a finite, non-negative score")
    return screened.where(F.col("accepted") & finite(F.col("quality")) & (F.col("quality") > threshold))


def retained_counts(screened: DataFrame) -> DataFrame:
    """How many accepted frames each of the 100 range cut-offs keeps, one row per (capture, percent).

    Each frame contributes one row - the smallest percent that keeps it - and the
    counts are cumulated over at most 100 values per capture, so the cut-offs are
    never multiplied with the frames.
    """
    bounds = quality_range(screened)
    accepted = screened.where("accepted").join(bounds, KEY)
    span = F.col("high") - F.col("low")

    def kept(percent: Column) -> Column:
        return F.col("quality") > F.col("low") + span * (1 - percent / F.lit(100.0))

    # The closed form may be one off next to a cut-off, so test both neighbours exactly.
    guess = F.greatest(F.least(F.ceil((1 - (F.col("quality") - F.col("low")) / span) * 100), F.lit(100)), F.lit(1))
    below, above = F.greatest(guess - 1, F.lit(1)), F.least(guess + 1, F.lit(100))
    first = F.when(kept(below), below).when(kept(guess), guess).when(kept(above), above).otherwise(F.lit(100))
    entry = F.when(span > 0, first).otherwise(F.lit(1)).cast("long")
    per_percent = accepted.groupBy(KEY, entry.alias("percent")).agg(F.count(F.lit(1)).alias("n"))
    per_capture = bounds.join(
        per_percent.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("percent", "n"))).alias("steps")),
        KEY, "left")
    grid = F.sequence(F.lit(1).cast("long"), F.lit(100).cast("long"))
    total_up_to = lambda p: F.aggregate(
        F.map_values(F.map_filter("steps", lambda k, _: k <= p)), F.lit(0).cast("long"), lambda a, x: a + x)
    return per_capture.select(KEY, F.explode(grid).alias("percent"), "steps").select(
        KEY, "percent", F.coalesce(total_up_to(F.col("percent")), F.lit(0)).alias("retained"))


def best_reference(screened: DataFrame) -> DataFrame:
    """Sharpest accepted frame of each capture; equal scores choose the earliest."""
    eligible = screened.where(F.col("accepted") & finite(F.col("quality")))
    best = F.max_by(F.struct("frame_index", "quality"), F.struct(F.col("quality"), -F.col("frame_index")))
    return eligible.groupBy(KEY).agg(best.alias("best")).select(
        KEY, F.col("best.frame_index").alias("reference_index"), F.col("best.quality").alias("reference_quality"))


def display_rank(measured: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """1-based rank for display: best first, ties in capture order, unavailable scores last."""
    shown = F.when(finite(F.col("quality")), F.col("quality")).otherwise(F.lit(float("-inf")))
    return rank_rows(measured.withColumn("_shown", shown), [KEY], "_shown", "frame_index",
                     name="display_rank", descending=True, partitions=partitions).drop("_shown")


def quality_position(measured: DataFrame, *, log_axis: bool = False) -> DataFrame:
    """Score as 0-100 of the capture's range (100 for a flat range), optionally on the log axis."""
    bounds = quality_range(measured)
    scaled = (F.col("quality") - F.col("low")) / (F.col("high") - F.col("low")) * 100
    position = F.when(~finite(F.col("quality")), F.lit(None).cast("double")).when(
        F.col("high") > F.col("low"), scaled).otherwise(F.lit(100.0))
    fraction = position / 100
    if log_axis:
        relative = fraction * 1000
        fraction = F.when(relative <= 1, relative).otherwise(1 + F.log10(F.greatest(relative, F.lit(1.0)))) / 4
    return measured.join(bounds, KEY).withColumn("position", position).withColumn("axis_fraction", fraction).drop("low", "high")


def top_fractions(
    scores: DataFrame,
    keys: list[str],
    score: str,
    index: str,
    percents: tuple[int, ...] = C.RANK_P_GRID,
    *,
    higher_is_better: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Membership of every top-p subset, one row per (group, p, member).

    Each row is ranked once and then repeated only for the subsets it belongs to.
    """
    placed = rank_rows(scores, keys, score, index, name="_rank", size="_n", descending=higher_is_better, tie_descending=higher_is_better, partitions=partitions)
    member = [F.when(F.col("_rank") <= top_count(F.col("_n"), p), F.lit(p)) for p in percents]
    return placed.withColumn("p", F.explode(F.array_compact(F.array(*member)))).drop("_rank", "_n")


def evenly_spaced(ordered: DataFrame, keys: list[str], index: str, samples: int, *, truncate: bool = False,
                  partitions: int | None = None) -> DataFrame:
    """Rows at ``samples`` evenly spaced positions of each group in index order.

    Position k is k (n-1)/(samples-1), rounded half to even or truncated;
    positions that coincide are kept once.
    """
    placed = rank_rows(ordered, keys, index, index, name="_rank", size="_n", partitions=partitions)
    count = F.least(F.col("_n"), F.lit(samples))
    step = (F.col("_n") - 1) / F.greatest(count - 1, F.lit(1)).cast("double")
    position = F.col("_rank") - 1
    # Only positions within one sample of the row's own place can land on it.
    near = F.floor(position / F.greatest(step, F.lit(1.0)))
    hits = F.lit(False)
    for offset in (-1, 0, 1, 2):
        k = near + offset
        at = k * step
        landed = F.floor(at) if truncate else F.bround(at)
        hits = hits | ((k >= 0) & (k < count) & (landed == position))
    return placed.where(hits).drop("_rank", "_n")


def top_per_capture(screened: DataFrame, count: int, *, partitions: int | None = None) -> DataFrame:
    """The ``count`` best accepted frames of each capture, for building a reference."""
    return ranked(screened, partitions=partitions).where(F.col("rank") <= count)


def assign_rank_bins(screened: DataFrame, bins: int | None = None, *, partitions: int | None = None) -> DataFrame:
    """Equal-count quality-rank bin of every accepted frame; the bin count follows the capture size."""
    count = F.lit(bins) if bins else rank_bin_count(F.col("n_accepted"))
    return ranked(screened, partitions=partitions).withColumn("bins", count.cast("long")).withColumn(
        "bin", rank_bin(F.col("rank") - 1, F.col("n_accepted"), F.col("bins")))


def rank_bin_edges(screened: DataFrame, bins: int | None = None, *, partitions: int | None = None) -> DataFrame:
    """The last frame of every rank bin but the worst, as one sorted array per capture.

    At most 15 edges describe a capture, so :func:`bin_from_edges` bins frames where
    they are read; the frames themselves are never shuffled to meet their rank.
    """
    binned = assign_rank_bins(screened, bins, partitions=partitions)
    last = binned.groupBy(KEY, "bins", "bin").agg(
        F.max(F.struct((-F.col("quality")).alias("q"), F.col("frame_index").alias("i"))).alias("edge"))
    inner = F.when(F.col("bin") < F.col("bins") - 1, F.col("edge"))
    return last.groupBy(KEY).agg(F.array_sort(F.collect_list(inner)).alias("edges"))


def bin_from_edges() -> Column:
    """Rank bin of a frame after a join with :func:`rank_bin_edges` on the capture."""
    here = F.struct((-F.col("quality")).alias("q"), F.col("frame_index").alias("i"))
    return F.size(F.filter("edges", lambda e: e < here)).cast("long")


def per_point_best(scores: DataFrame, keys: list[str], point: str, count: int, *, bins: int = 0,
                   partitions: int | None = None) -> DataFrame:
    """Each alignment point's best ``count`` frames, optionally with their equal-count rank bin."""
    groups = [*keys, point]
    placed = rank_rows(scores, groups, "score", "frame_index", size="_n", descending=True, partitions=partitions)
    kept = placed.withColumn("kept", F.least(F.col("_n"), F.lit(count))).where(
        F.col("rank") <= F.col("kept"))
    if bins:
        kept = kept.withColumn("bin", rank_bin(F.col("rank") - 1, F.col("kept"), F.lit(bins)))
    return kept.drop("_n")
