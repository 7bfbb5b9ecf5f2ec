"""Time bases, poses and motion references over events read as time-stamped frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import names
from framewright.operators import timing as TM
from framewright.plans.registry import query
from framewright.sources import tables as T

KEY = "capture_id"
TIMED = f"""
WITH e AS ({T.TIMED_SQL}),
s AS (SELECT *, (ts_ticks - min(ts_ticks) OVER (PARTITION BY capture_id)) / 1e7::DOUBLE AS t_s,
             lag(ts_ticks) OVER (PARTITION BY capture_id ORDER BY frame_index) AS before FROM e)
"""


def timed(spark, folder):
    return T.timed_frames(spark, folder)


@query("frame_seconds", "SUP-2 S18 D4", TIMED + "SELECT capture_id, frame_index, round(t_s, 6) AS t_s FROM s")
def frame_seconds(spark, folder):
    return TM.with_seconds(timed(spark, folder)).select(KEY, "frame_index", F.round("t_s", 6).alias("t_s"))


@query("frame_cadence", "SUP-2 (no timestamps)", TIMED + """
SELECT capture_id, frame_index, (row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1) * 0.5::DOUBLE AS t_s, 'user' AS origin FROM s""")
def frame_cadence(spark, folder):
    return TM.with_cadence(timed(spark, folder), 0.5).select(KEY, "frame_index", "t_s", "origin")


@query("frame_intervals", "WIN-6", TIMED + "SELECT capture_id, frame_index, ts_ticks - before AS interval_ticks FROM s")
def frame_intervals(spark, folder):
    return TM.intervals(timed(spark, folder)).select(KEY, "frame_index", "interval_ticks")


@query("capture_timing", "AGG-23", TIMED + """
SELECT capture_id, CASE WHEN count(*) FILTER (WHERE ts_ticks < before) = 0 AND (count(*) = 1 OR max(ts_ticks) > min(ts_ticks)) THEN 'available' ELSE 'invalid' END AS status,
       count(*) AS n_frames, round(max(t_s), 6) AS duration_s, round(median(ts_ticks - before) / 1e7::DOUBLE, 4) AS median_cadence_s,
       count(*) FILTER (WHERE ts_ticks = before) AS duplicate_intervals, round(min(ts_ticks - before) / 1e7::DOUBLE, 6) AS minimum_interval_s,
       round(max(ts_ticks - before) / 1e7::DOUBLE, 6) AS maximum_interval_s FROM s GROUP BY 1""")
def capture_timing(spark, folder):
    out = TM.capture_timing(timed(spark, folder))
    digits = {"median_cadence_s": 4}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("time_reversals", "S18 (reversed times)", """
WITH d AS (SELECT o_custkey AS capture_id, o_orderkey AS frame_index, epoch_us(o_orderdate) * 10 AS t,
                  lag(epoch_us(o_orderdate) * 10) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT capture_id, frame_index, t - before AS interval_ticks FROM d WHERE t < before""")
def time_reversals(spark, folder):
    frames = T.load(spark, folder, "orders").select(F.col("o_custkey").alias(KEY), F.col("o_orderkey").alias("frame_index"),
                                                    (T.micros("o_orderdate") * 10).alias("ts_ticks"))
    return TM.order_violations(frames).select(KEY, "frame_index", "interval_ticks")


@query("julian_dates", "FN-7 FN-8", TIMED + """
SELECT capture_id, frame_index, round(1721425.5 + ts_ticks / 864000000000.0::DOUBLE, 4) AS jd, (ts_ticks // 10 - 62135596800000000) AS utc_micros FROM s""")
def julian_dates(spark, folder):
    frames = timed(spark, folder)
    return frames.select(KEY, "frame_index", F.round(TM.julian_date(F.col("ts_ticks")), 4).alias("jd"),
                         F.unix_micros(TM.ticks_to_utc(F.col("ts_ticks"))).alias("utc_micros"))


@query("capture_midpoints", "FN-8", TIMED + """
SELECT capture_id, round(1721425.5 + ((min(ts_ticks) + max(ts_ticks)) // 2) / 864000000000.0::DOUBLE, 6) AS jd_midpoint,
       (min(ts_ticks) + max(ts_ticks)) // 2 AS ticks_midpoint FROM s GROUP BY 1""")
def capture_midpoints(spark, folder):
    return TM.midpoint_jd(timed(spark, folder)).withColumn("jd_midpoint", F.round("jd_midpoint", 6))


@query("output_epochs", "FN-7", TIMED + """
SELECT capture_id, 1000.5::DOUBLE AS epoch_s, round((max(ts_ticks) - min(ts_ticks)) / 2e7::DOUBLE, 6) AS capture_midpoint_s,
       round(1000.5 - (max(ts_ticks) - min(ts_ticks)) / 2e7::DOUBLE, 6) AS offset_from_midpoint_s,
       min(ts_ticks) // 10 - 62135596800000000 + 1000500000 AS utc_micros FROM s GROUP BY 1""")
def output_epochs(spark, folder):
    out = TM.output_epoch(timed(spark, folder), 1000.5)
    return out.withColumn("capture_midpoint_s", F.round("capture_midpoint_s", 6)).withColumn(
        "offset_from_midpoint_s", F.round("offset_from_midpoint_s", 6))


POSES = TIMED + ", p AS (SELECT capture_id, frame_index, t_s + 0.01::DOUBLE AS pose_t_s, 0.3::DOUBLE + 1e-5::DOUBLE * (t_s + 0.01::DOUBLE - 5000) AS field_angle_rad FROM s)"


def posed(spark, folder):
    return TM.poses(TM.with_seconds(timed(spark, folder)), angle0=0.3, rate=1e-5, epoch_s=5000.0, exposure_s=0.02)


@query("frame_poses", "PRJ-23 D11", POSES + "SELECT capture_id, frame_index, round(pose_t_s, 6) AS pose_t_s, round(field_angle_rad, 7) AS field_angle_rad FROM p")
def frame_poses(spark, folder):
    return posed(spark, folder).select(KEY, "frame_index", F.round("pose_t_s", 6).alias("pose_t_s"),
                                       F.round("field_angle_rad", 7).alias("field_angle_rad"))


@query("nearest_epoch_pose", "JN-6", POSES + """
SELECT capture_id, frame_index, round(pose_t_s, 6) AS pose_t_s, round(field_angle_rad, 7) AS field_angle_rad FROM p
QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY abs(pose_t_s - 1000000), frame_index) = 1""")
def nearest_epoch_pose(spark, folder):
    out = TM.nearest_pose(posed(spark, folder), 1_000_000.0)
    return out.select(KEY, "frame_index", F.round("pose_t_s", 6).alias("pose_t_s"), F.round("field_angle_rad", 7).alias("field_angle_rad"))


@query("unwrapped_angles", "PRJ-30 PRJ-31 WIN-12", f"""
WITH e AS (SELECT capture_id, frame_index, quality / 10 - floor(quality / 10 / (2 * pi())) * 2 * pi() AS a FROM ({T.TIMED_SQL})),
d AS (SELECT *, a - lag(a) OVER (PARTITION BY capture_id ORDER BY frame_index) AS dd FROM e),
f AS (SELECT *, CASE WHEN dd IS NULL OR abs(dd) < pi() THEN 0 ELSE dd + pi() - floor((dd + pi()) / (2 * pi())) * 2 * pi() - pi() - dd END AS fix FROM d)
SELECT capture_id, frame_index, round(a + sum(fix) OVER (PARTITION BY capture_id ORDER BY frame_index), 6) AS unwrapped FROM f""")
def unwrapped_angles(spark, folder):
    turn = 2 * 3.141592653589793
    frames = timed(spark, folder).withColumn("a", F.col("quality") / 10 - F.floor(F.col("quality") / 10 / turn) * turn)
    return TM.unwrapped(frames, "a").select(KEY, "frame_index", F.round("unwrapped", 6).alias("unwrapped"))


@query("motion_reference", "WIN-13 JN-7 STR-8 S22 SRT-4", TIMED + """
, d AS (SELECT *, abs(t_s - max(t_s) OVER (PARTITION BY capture_id) / 2) AS dist, max(t_s) OVER (PARTITION BY capture_id) AS span FROM s),
r AS (SELECT *, dist <= 0.1 * span AS near, count(*) FILTER (WHERE dist <= 0.1 * span) OVER (PARTITION BY capture_id) AS n_near,
             count(*) OVER (PARTITION BY capture_id) AS n_all, row_number() OVER (PARTITION BY capture_id ORDER BY dist, quality DESC, frame_index) AS rn FROM d),
p AS (SELECT * FROM r WHERE CASE WHEN n_near < least(4, n_all) THEN rn <= 4 ELSE near END),
g AS (SELECT *, count(*) OVER (PARTITION BY capture_id) AS pool, median(quality) OVER (PARTITION BY capture_id) AS med FROM p)
SELECT capture_id, frame_index AS anchor_index, round(t_s, 6) AS anchor_s, pool FROM g WHERE quality >= med
QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY dist, quality DESC, frame_index) = 1""")
def motion_reference(spark, folder):
    return TM.motion_reference(timed(spark, folder)).withColumn("anchor_s", F.round("anchor_s", 6))


@query("motion_reference_best", "WIN-13 (best frame)", TIMED + """
SELECT capture_id, frame_index AS anchor_index, round(t_s, 6) AS anchor_s, n AS pool FROM (SELECT *, count(*) OVER (PARTITION BY capture_id) AS n FROM s)
QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY quality DESC, frame_index) = 1""")
def motion_reference_best(spark, folder):
    return TM.motion_reference(timed(spark, folder), policy="best").withColumn("anchor_s", F.round("anchor_s", 6))


@query("three_group_windows", "WIN-7 WIN-8", TIMED + """
, r AS (SELECT *, ntile(3) OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS part FROM s),
q AS (SELECT *, row_number() OVER (PARTITION BY capture_id, part ORDER BY frame_index) - 1 AS pos, count(*) OVER (PARTITION BY capture_id, part) AS n FROM r),
w AS (SELECT * FROM q WHERE pos >= n // 2 - 12 AND pos < n // 2 + 12)
SELECT capture_id, part, frame_index FROM w QUALIFY row_number() OVER (PARTITION BY capture_id, part ORDER BY quality DESC, frame_index DESC) <= 8""")
def three_group_windows(spark, folder):
    return TM.three_groups(timed(spark, folder), reach=12, best=8).select(KEY, "part", "frame_index")


@query("exposure_origin", "SRC-6 SUP-3 FLT-13", """
WITH e AS (SELECT event_id AS frame_index, CASE WHEN event_id % 3 = 0 THEN 'fps=' || (event_id % 50) || ' gain=1.5 exp=' || value ELSE 'refractor ' || event_id END AS settings,
           CASE WHEN event_id % 7 = 0 THEN 0.25::DOUBLE END AS user_s FROM events),
x AS (SELECT *, CASE WHEN frame_index % 3 = 0 AND frame_index % 50 > 0 AND (SELECT value FROM events v WHERE v.event_id = frame_index) > 0
             THEN (SELECT value FROM events v WHERE v.event_id = frame_index) / 1000 END AS header_s FROM e)
SELECT frame_index, round(coalesce(user_s, header_s, 0), 9) AS exposure_s, CASE WHEN user_s IS NOT NULL THEN 'user' WHEN header_s IS NOT NULL THEN 'header' ELSE 'unavailable' END AS origin,
       (abs(1e-4::DOUBLE) + abs(2e-4::DOUBLE)) * 40 * coalesce(user_s, header_s, 0) > 0.0025 AS moves FROM x""")
def exposure_origin(spark, folder):
    from framewright.functions.geometry import exposure_motion

    i = F.col("event_id")
    settings = F.when(i % 3 == 0, F.concat(F.lit("fps="), (i % 50).cast("string"), F.lit(" gain=1.5 exp="), F.col("value").cast("string"))).otherwise(
        F.concat(F.lit("refractor "), i.cast("string")))
    user = F.when(i % 7 == 0, F.lit(0.25))
    value, origin = TM.exposure(user, names.exposure_seconds(settings))
    rows = T.load(spark, folder, "events").select(i.alias("frame_index"), value.alias("e"), origin.alias("origin"))
    return rows.select("frame_index", F.round("e", 9).alias("exposure_s"), "origin",
                       (exposure_motion(40.0, F.lit(1e-4), F.lit(2e-4), F.col("e")) > 0.0025).alias("moves"))


@query("planet_names", "FN-3 FN-10", """
WITH n AS (SELECT p_partkey AS part, CASE p_size % 6 WHEN 0 THEN '2026-01-02-Jup_' || p_brand WHEN 1 THEN 'saturn-SAT-' || p_type WHEN 2 THEN 'Mars and Venus' WHEN 3 THEN 'Mar_12'
           WHEN 4 THEN 'NEPTUNE' ELSE p_name END AS name FROM part)
SELECT part, CASE WHEN name LIKE '%Jup\\_%' ESCAPE '\\' THEN 'jupiter' WHEN name LIKE 'saturn%' THEN 'saturn' WHEN name = 'NEPTUNE' THEN 'neptune' END AS planet,
       round(2 * pi() / (CASE WHEN name LIKE '%Jup\\_%' ESCAPE '\\' THEN 0.41354 WHEN name LIKE 'saturn%' THEN 0.44401 WHEN name = 'NEPTUNE' THEN 0.67125 END * 86400)::DOUBLE, 12) AS rate FROM n""")
def planet_names(spark, folder):
    kind = F.col("p_size") % 6
    name = (F.when(kind == 0, F.concat(F.lit("2026-01-02-Jup_"), "p_brand")).when(kind == 1, F.concat(F.lit("saturn-SAT-"), "p_type"))
            .when(kind == 2, "Mars and Venus").when(kind == 3, "Mar_12").when(kind == 4, "NEPTUNE").otherwise(F.col("p_name")))
    rows = T.load(spark, folder, "part").select(F.col("p_partkey").alias("part"), names.planet_of(name).alias("planet"))
    return rows.withColumn("rate", F.round(names.rotation_rate(F.col("planet")), 12))


@query("retimed_names", "FN-4 SUP-39", """
WITH n AS (SELECT o_orderkey AS row_id, 'cap-' || strftime(o_orderdate + to_minutes(o_orderkey % 1440), '%Y-%m-%d-%H%M') || '_' || (o_orderkey % 10) || '-R' AS stem,
                  (o_custkey % 400 - 200) * 0.5::DOUBLE AS offset_s, o_orderdate + to_minutes(o_orderkey % 1440) AS base, o_orderkey % 10 AS tenth FROM orders),
m AS (SELECT *, base + to_microseconds(((tenth * 6 + 3 + offset_s) * 1000000)::BIGINT) AS moved FROM n)
SELECT row_id, CASE WHEN abs(offset_s) < 0.05 THEN stem ELSE 'cap-' || strftime(moved, '%Y-%m-%d-%H%M') || '_' || (second(moved) // 6) || '-R' END AS renamed FROM m""")
def retimed_names(spark, folder):
    i = F.col("o_orderkey")
    base = F.timestamp_micros(T.micros("o_orderdate") + (i % 1440) * 60_000_000)
    stem = F.concat(F.lit("cap-"), F.date_format(base, "yyyy-MM-dd-HHmm"), F.lit("_"), (i % 10).cast("string"), F.lit("-R"))
    offset = (F.col("o_custkey") % 400 - 200) * 0.5
    return T.load(spark, folder, "orders").select(i.alias("row_id"), names.retimed_name(stem, offset).alias("renamed"))


@query("free_output_names", "SUP-39", """
SELECT doc_id, source || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END || '.png' AS output
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)""")
def free_output_names(spark, folder):
    from framewright.operators.ordering import rank_rows

    docs = T.load(spark, folder, "documents").select("doc_id", "source")
    placed = rank_rows(docs, ["source"], "doc_id", "doc_id", name="use")
    return placed.select("doc_id", names.free_name(F.col("source"), F.col("use"), ".png").alias("output"))
