"""Screening and selection over line items read as measured frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions import names
from framewright.operators import quality, screening, selection
from framewright.plans.registry import query
from framewright.sources import tables as T

KEY = "capture_id"

SCREENED = f"""
WITH m AS ({T.MEASUREMENTS_SQL}),
s AS (SELECT capture_id, avg(quality) AS qm, stddev_pop(quality) AS qs, avg(width_px) AS wm, stddev_pop(width_px) AS ws,
             avg(height_px) AS hm, stddev_pop(height_px) AS hs, count(*) AS n FROM m WHERE status = 'ok' GROUP BY 1),
f AS (SELECT m.*, status = 'ok' AS valid,
             coalesce(status = 'ok' AND quality < qm - 2 * qs - 32 * 2.220446049250313e-16 * greatest(abs(qm), 1), false) AS low_quality,
             coalesce(status = 'ok' AND abs(width_px - wm) > 2 * ws + 32 * 2.220446049250313e-16 * greatest(abs(wm), 1), false) AS width_outlier,
             coalesce(status = 'ok' AND abs(height_px - hm) > 2 * hs + 32 * 2.220446049250313e-16 * greatest(abs(hm), 1), false) AS height_outlier
      FROM m LEFT JOIN s USING (capture_id)),
screened AS (SELECT *, valid AND NOT low_quality AND NOT width_outlier AND NOT height_outlier AS accepted FROM f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY quality DESC, frame_index) AS rank,
                  count(*) OVER (PARTITION BY capture_id) AS n_accepted FROM screened WHERE accepted)
"""


def screened(spark, folder):
    return screening.screen(T.measurements(spark, folder))


@query("screen_two_sigma", "FLT-1 S1 S2 S3 SET-6 JN-1 CTL-1", SCREENED + """
SELECT capture_id, frame_index, accepted, low_quality, width_outlier, height_outlier FROM screened""")
def screen_two_sigma(spark, folder):
    return screened(spark, folder).select(KEY, "frame_index", "accepted", *C.REASONS)


@query("screen_statistics", "AGG-6", SCREENED + """
SELECT capture_id, n AS n_valid, round(qm, 6) AS quality_mean, round(qs, 6) AS quality_std, round(qm - 2 * qs, 6) AS quality_lower,
       round(wm, 6) AS width_px_mean, round(ws, 6) AS width_px_std, round(wm - 2 * ws, 6) AS width_px_lower, round(wm + 2 * ws, 6) AS width_px_upper,
       round(hm, 6) AS height_px_mean, round(hs, 6) AS height_px_std, round(hm - 2 * hs, 6) AS height_px_lower, round(hm + 2 * hs, 6) AS height_px_upper
FROM s""")
def screen_statistics(spark, folder):
    stats = screening.screening_statistics(T.measurements(spark, folder))
    return stats.select(KEY, "n_valid", *[F.round(c, 6).alias(c) for c in stats.columns if c not in (KEY, "n_valid")])


@query("screen_reason_counts", "FLT-2", SCREENED + """
SELECT capture_id, reason, count(*) AS frames FROM (
  SELECT capture_id, status AS reason FROM screened WHERE status <> 'ok'
  UNION ALL SELECT capture_id, 'low_quality' FROM screened WHERE low_quality
  UNION ALL SELECT capture_id, 'width_outlier' FROM screened WHERE width_outlier
  UNION ALL SELECT capture_id, 'height_outlier' FROM screened WHERE height_outlier) GROUP BY 1, 2""")
def screen_reason_counts(spark, folder):
    return screening.reason_counts(screened(spark, folder))


@query("screen_exclusion_counts", "FLT-3", SCREENED + """
SELECT capture_id, count(*) AS n_total, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE low_quality) AS quality,
       count(*) FILTER (WHERE width_outlier OR height_outlier OR status IN ('clipped_target', 'no_target')) AS shape,
       count(*) FILTER (WHERE low_quality AND (width_outlier OR height_outlier OR status IN ('clipped_target', 'no_target'))) AS quality_shape_overlap,
       count(*) FILTER (WHERE status IN ('invalid', 'saturated')) AS other, count(*) FILTER (WHERE NOT accepted) AS excluded
FROM screened GROUP BY 1""")
def screen_exclusion_counts(spark, folder):
    return screening.exclusion_counts(screened(spark, folder))


@query("quality_plot_rows", "SUP-19", SCREENED + """
SELECT capture_id, frame_index, round(quality, 6) AS score, accepted,
       concat_ws(',', CASE WHEN status <> 'ok' THEN status END, CASE WHEN low_quality THEN 'low_quality' END,
                 CASE WHEN width_outlier THEN 'width_outlier' END, CASE WHEN height_outlier THEN 'height_outlier' END) AS reasons
FROM screened""")
def quality_plot_rows(spark, folder):
    return screening.plot_rows(screened(spark, folder)).withColumn("score", F.round("score", 6))


@query("quality_range", "AGG-7 S5", f"""
SELECT capture_id, round(min(quality), 6) AS low, round(max(quality), 6) AS high FROM ({T.MEASUREMENTS_SQL}) GROUP BY 1""")
def quality_range(spark, folder):
    bounds = selection.quality_range(T.measurements(spark, folder))
    return bounds.select(KEY, F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("select_quality_range", "FLT-4 S5", SCREENED + """
SELECT capture_id, frame_index, accepted AND quality > low + (high - low) * 0.5::DOUBLE AS selected
FROM screened JOIN (SELECT capture_id, min(quality) AS low, max(quality) AS high FROM m GROUP BY 1) USING (capture_id)""")
def select_quality_range(spark, folder):
    return selection.select_by_range(screened(spark, folder), 50).select(KEY, "frame_index", "selected")


@query("select_frame_count", "FLT-4 S4 WIN-1 SRT-1", SCREENED + """
SELECT capture_id, frame_index, rank FROM ranked WHERE rank <= (n_accepted * 21 + 99) // 100""")
def select_frame_count(spark, folder):
    return selection.select_by_count(screened(spark, folder), 21).select(KEY, "frame_index", "rank")


@query("select_count_threshold", "FLT-4 S4 (one cut row per capture)", SCREENED + """
SELECT capture_id, round(quality, 6) AS cut_quality, frame_index AS cut_index FROM ranked WHERE rank = (n_accepted * 21 + 99) // 100""")
def select_count_threshold(spark, folder):
    cuts = selection.count_thresholds(screened(spark, folder), 21)
    return cuts.withColumn("cut_quality", F.round("cut_quality", 6))


@query("select_absolute", "FLT-5 S7", SCREENED + """
SELECT capture_id, frame_index FROM screened WHERE accepted AND quality > 60""")
def select_absolute(spark, folder):
    return selection.select_above(screened(spark, folder), 60.0).select(KEY, "frame_index")


@query("retained_counts", "AGG-8", SCREENED + """
SELECT capture_id, p AS percent, count(*) FILTER (WHERE accepted AND (p = 100 OR low = high
       OR quality > low + (high - low) * (1 - p / 100.0::DOUBLE))) AS retained
FROM screened JOIN (SELECT capture_id, min(quality) AS low, max(quality) AS high FROM m GROUP BY 1) USING (capture_id),
     (SELECT unnest(range(1, 101)) AS p) GROUP BY 1, 2""")
def retained_counts(spark, folder):
    return selection.retained_counts(screened(spark, folder))


@query("best_reference", "SRT-3 S8", SCREENED + """
SELECT capture_id, frame_index AS reference_index, round(quality, 6) AS reference_quality FROM ranked WHERE rank = 1""")
def best_reference(spark, folder):
    best = selection.best_reference(screened(spark, folder))
    return best.withColumn("reference_quality", F.round("reference_quality", 6))


@query("quality_rank_display", "WIN-2 S23", f"""
SELECT capture_id, frame_index, row_number() OVER (PARTITION BY capture_id ORDER BY shown DESC NULLS LAST, frame_index) AS display_rank
FROM (SELECT *, CASE WHEN status <> 'invalid' THEN quality END AS shown FROM ({T.MEASUREMENTS_SQL}))""")
def quality_rank_display(spark, folder):
    measured = T.measurements(spark, folder).withColumn(
        "quality", F.when(F.col("status") == "invalid", float("nan")).otherwise(F.col("quality")))
    return selection.display_rank(measured).select(KEY, "frame_index", "display_rank")


@query("quality_axis_position", "PRJ-29", f"""
SELECT capture_id, frame_index, round(pos, 6) AS position,
       round(CASE WHEN pos * 10 <= 1 THEN pos * 10 ELSE 1 + log10(greatest(pos * 10, 1)) END / 4, 6) AS axis_fraction
FROM (SELECT capture_id, frame_index, CASE WHEN high > low THEN (quality - low) / (high - low) * 100 ELSE 100.0::DOUBLE END AS pos
      FROM ({T.MEASUREMENTS_SQL}) JOIN (SELECT capture_id, min(quality) AS low, max(quality) AS high FROM ({T.MEASUREMENTS_SQL}) GROUP BY 1)
      USING (capture_id))""")
def quality_axis_position(spark, folder):
    placed = selection.quality_position(T.measurements(spark, folder), log_axis=True)
    return placed.select(KEY, "frame_index", F.round("position", 6).alias("position"),
                         F.round("axis_fraction", 6).alias("axis_fraction"))


def _top(order, tie):
    return f"""
WITH m AS ({T.MEASUREMENTS_SQL}),
r AS (SELECT capture_id, frame_index, row_number() OVER (PARTITION BY capture_id ORDER BY quality {order}, frame_index {tie}) AS rn,
             count(*) OVER (PARTITION BY capture_id) AS n FROM m)
SELECT capture_id, p, frame_index FROM r, (SELECT unnest([5, 10, 25, 50, 100]) AS p)
WHERE rn <= least(n, greatest(1, round_even(p * n / 100.0::DOUBLE, 0)::BIGINT))"""


@query("top_fraction_grid", "WIN-3 S6 PRJ-11 rank", _top("DESC", "DESC"))
def top_fraction_grid(spark, folder):
    return selection.top_fractions(T.measurements(spark, folder), [KEY], "quality", "frame_index").select(
        KEY, "p", "frame_index")


@query("top_fraction_grid_lower", "WIN-3 S6 (lower is better)", _top("ASC", "ASC"))
def top_fraction_grid_lower(spark, folder):
    return selection.top_fractions(T.measurements(spark, folder), [KEY], "quality", "frame_index",
                                   higher_is_better=False).select(KEY, "p", "frame_index")


@query("reference_pool", "SRT-2", SCREENED + "SELECT capture_id, frame_index FROM ranked WHERE rank <= 64")
def reference_pool(spark, folder):
    return selection.top_per_capture(screened(spark, folder), C.TEMPLATE_CANDIDATES).select(KEY, "frame_index")


def _spaced(samples, landing):
    return SCREENED + f"""
SELECT DISTINCT a.capture_id, a.frame_index FROM
 (SELECT capture_id, frame_index, n_accepted, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS pos FROM ranked) a
 JOIN (SELECT unnest(range({samples})) AS k) ON k < least(n_accepted, {samples})
  AND pos = {landing.format(x=f"(k * ((n_accepted - 1) / greatest(least(n_accepted, {samples}) - 1, 1)::DOUBLE))")}"""


@query("evenly_spaced_rounded", "SRT-5 AGG-10 SRC-11", _spaced(8, "round_even({x}, 0)"))
def evenly_spaced_rounded(spark, folder):
    accepted = screened(spark, folder).where("accepted").select(KEY, "frame_index")
    return selection.evenly_spaced(accepted, [KEY], "frame_index", C.NOISE_SAMPLES)


@query("evenly_spaced_truncated", "SRT-5 CTL-7", _spaced(128, "floor({x})"))
def evenly_spaced_truncated(spark, folder):
    accepted = screened(spark, folder).where("accepted").select(KEY, "frame_index")
    return selection.evenly_spaced(accepted, [KEY], "frame_index", 128, truncate=True)


@query("quality_rank_bins", "WIN-5 S19 AGG-4 key", SCREENED + """
SELECT capture_id, frame_index, bins, least((rank - 1) * bins // n_accepted, bins - 1) AS bin, (frame_index // 32) % 2 AS half
FROM (SELECT *, least(greatest(n_accepted // 20, 2), 16) AS bins FROM ranked)""")
def quality_rank_bins(spark, folder):
    from framewright.functions.numeric import half_of
    return selection.assign_rank_bins(screened(spark, folder)).select(
        KEY, "frame_index", "bins", "bin", half_of(F.col("frame_index")).alias("half"))


POINTS = """
WITH pts AS (SELECT l_suppkey % 8 AS capture_id, l_partkey % 50 AS point, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS frame_index,
                    l_extendedprice / 1000 AS score, l_quantity AS frame_quality FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, point ORDER BY score DESC, frame_index) AS rank,
             least(40, count(*) OVER (PARTITION BY capture_id, point)) AS kept FROM pts)
"""


def point_scores(spark, folder):
    item = T.load(spark, folder, "lineitem")
    return item.select(
        (F.col("l_suppkey") % 8).alias(KEY), (F.col("l_partkey") % 50).alias("point"),
        (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("frame_index"),
        (F.col("l_extendedprice") / 1000).alias("score"), F.col("l_quantity").alias("frame_quality"))


@query("point_best_frames", "WIN-4 REG-4 D10", POINTS + """
SELECT capture_id, point, frame_index, rank, least((rank - 1) * 4 // kept, 3) AS bin FROM r WHERE rank <= kept""")
def point_best_frames(spark, folder):
    best = selection.per_point_best(point_scores(spark, folder), [KEY], "point", 40, bins=4)
    return best.select(KEY, "point", "frame_index", "rank", "bin")


@query("point_quality_summary", "AGG-9 (per point)", POINTS + """
, p AS (SELECT capture_id, point, count(*) AS n, sum(frame_quality) * sum(frame_quality) / sum(frame_quality * frame_quality) AS eff,
               sum(frame_quality * frame_quality) / sum(frame_quality) AS wq FROM r WHERE rank <= kept GROUP BY 1, 2)
SELECT capture_id, count(*) AS points, round(median(n), 6) AS frames_median, min(n) AS frames_min, max(n) AS frames_max,
       round(median(eff), 6) AS effective_median, round(min(eff), 6) AS effective_min, round(max(eff), 6) AS effective_max,
       round(median(wq), 6) AS quality_median, round(min(wq), 6) AS quality_min, round(max(wq), 6) AS quality_max FROM p GROUP BY 1""")
def point_quality_summary(spark, folder):
    best = selection.per_point_best(point_scores(spark, folder), [KEY], "point", 40)
    out = quality.point_summary(best, "frame_quality")
    counts = ("points", "frames_min", "frames_max")
    return out.select(KEY, *counts, *[F.round(c, 6).alias(c) for c in out.columns if c not in (KEY, *counts)])


SUMMARY = SCREENED + """
, used AS (SELECT *, greatest(quality, 1e-12) AS w FROM ranked WHERE rank <= (n_accepted * 21 + 99) // 100),
u AS (SELECT capture_id, count(*) AS frames_stacked, avg(quality) AS mean, sum(w * quality) / sum(w) AS weighted_mean, min(quality) AS minimum,
             max(quality) AS maximum, sum(w) * sum(w) / sum(w * w) AS effective_frames FROM used GROUP BY 1),
a AS (SELECT capture_id, avg(quality) AS screened_mean, count(*) AS screened_frames FROM screened WHERE accepted GROUP BY 1)
"""


def summary(spark, folder):
    whole = screened(spark, folder)
    return quality.stack_summary(selection.select_by_count(whole, 21), whole)


@query("stack_quality_summary", "AGG-9 S9 S11", SUMMARY + """
SELECT capture_id, frames_stacked, screened_frames, round(mean, 6) AS mean, round(weighted_mean, 6) AS weighted_mean,
       round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(screened_mean, 6) AS screened_mean,
       round(effective_frames, 6) AS effective_frames, round(sqrt(effective_frames), 6) AS snr_gain FROM u JOIN a USING (capture_id)""")
def stack_quality_summary(spark, folder):
    out = summary(spark, folder)
    counts = ("frames_stacked", "screened_frames")
    return out.select(KEY, *counts, *[F.round(c, 6).alias(c) for c in out.columns if c not in (KEY, *counts)])


@query("stack_quality_text", "SUP-13 FN-5", SUMMARY + """
SELECT capture_id, '-n' || frames_stacked || '-q' || printf('%.3f', weighted_mean) AS tag,
       printf('%d of %d screened frames stacked; effective %.1f; quality mean %.3f, weighted %.3f (all screened %.3f); SNR gain x%.1f',
              frames_stacked, screened_frames, effective_frames, mean, weighted_mean, screened_mean, sqrt(effective_frames)) AS sentence
FROM u JOIN a USING (capture_id)""")
def stack_quality_text(spark, folder):
    out = summary(spark, folder)
    return out.select(KEY, names.quality_tag(F.col("frames_stacked"), F.col("weighted_mean")).alias("tag"),
                      quality.sentence().alias("sentence"))


@query("stack_quality_equal_weights", "AGG-9 S9 (equal weights)", SUMMARY + """
SELECT capture_id, frames_stacked, frames_stacked::DOUBLE AS effective_frames FROM u""")
def stack_quality_equal_weights(spark, folder):
    whole = screened(spark, folder)
    used = selection.select_by_count(whole, 21)
    return quality.stack_summary(used, whole, quality_weighting=False).select(KEY, "frames_stacked", "effective_frames")


@query("screened_top_frames", "M0 slice: FLT-1 FLT-4 AGG-9", SUMMARY + """
SELECT capture_id, frames_stacked, round(weighted_mean, 6) AS weighted_mean, round(effective_frames, 6) AS effective_frames FROM u""")
def screened_top_frames(spark, folder):
    return summary(spark, folder).select(KEY, "frames_stacked", F.round("weighted_mean", 6).alias("weighted_mean"),
                                         F.round("effective_frames", 6).alias("effective_frames"))
