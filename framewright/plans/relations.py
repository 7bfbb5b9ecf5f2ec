"""Lookups, set memberships and small per-frame operators that other areas build on."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.geometry import planetocentric
from framewright.operators import frames as FR
from framewright.operators import pixels as PX
from framewright.operators import selection
from framewright.operators import stacking as ST
from framewright.plans.frames import CFA, PX_SQL
from framewright.plans.registry import query
from framewright.plans.screening import POINTS, SCREENED, point_scores, screened
from framewright.sources import tables as T

KEY = "capture_id"


@query("local_choice_lookup", "JN-2 D10", POINTS + """
, c AS (SELECT capture_id, point, frame_index FROM r WHERE rank <= kept)
SELECT p.capture_id, p.point, p.frame_index, c.frame_index IS NOT NULL AS chosen FROM pts p LEFT JOIN c USING (capture_id, point, frame_index)""")
def local_choice_lookup(spark, folder):
    scores = point_scores(spark, folder)
    best = selection.per_point_best(scores, [KEY], "point", 40).select(KEY, "point", "frame_index", F.lit(True).alias("hit"))
    return scores.select(KEY, "point", "frame_index").join(best, [KEY, "point", "frame_index"], "left").select(
        KEY, "point", "frame_index", F.coalesce("hit", F.lit(False)).alias("chosen"))


@query("accumulated_only", "JN-3 JN-1 SRC-13", SCREENED + """
SELECT capture_id, count(*) AS frames, round(sum(width_px), 4) AS width FROM screened WHERE accepted GROUP BY 1""")
def accumulated_only(spark, folder):
    kept = screened(spark, folder).where("accepted").select(KEY, "frame_index")
    return T.measurements(spark, folder).join(kept, [KEY, "frame_index"], "left_semi").groupBy(KEY).agg(
        F.count(F.lit(1)).alias("frames"), F.round(F.sum("width_px"), 4).alias("width"))


@query("ordered_distinct", "AGG-36 FN-15", """
SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def ordered_distinct(spark, folder):
    first = T.load(spark, folder, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda r: r["role"])
    return first.groupBy("conv_id").agg(F.array_join(names, ",").alias("roles"))


@query("interior_pixels", "FLT-17 PRJ-28", PX_SQL + """
SELECT capture_id, frame_index, count(*) AS samples, round(sum(v), 6) AS total FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY 1, 2""")
def interior_pixels(spark, folder):
    b = C.RANK_BORDER_PX
    rows = PX.explode_pixels(T.frames(spark, folder)).where(F.col("y").between(b, 7 - b) & F.col("x").between(b, 7 - b))
    return rows.groupBy(KEY, "frame_index").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("value"), 6).alias("total"))


@query("frame_centroids", "PRJ-28", PX_SQL + """
SELECT capture_id, frame_index, round(sum(abs(v) * x) / sum(abs(v)), 6) AS cx, round(sum(abs(v) * y) / sum(abs(v)), 6) AS cy FROM px GROUP BY 1, 2""")
def frame_centroids(spark, folder):
    out = PX.centroids(PX.explode_pixels(T.frames(spark, folder)), [KEY, "frame_index"])
    return out.select(KEY, "frame_index", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("placed_points", "FLT-8 D9", PX_SQL + """
, s AS (SELECT capture_id, y, x, avg(v) + 0.02::DOUBLE AS value FROM px GROUP BY 1, 2, 3),
b AS (SELECT capture_id, y // 2 AS block_y, x // 2 AS block_x, avg(value) AS level, stddev_pop(value) AS texture FROM s GROUP BY 1, 2, 3),
k AS (SELECT b.*, peak FROM b JOIN (SELECT capture_id, max(value) AS peak FROM s GROUP BY 1) USING (capture_id) WHERE level >= 0.1 * peak),
m AS (SELECT capture_id, median(texture) AS typical FROM k GROUP BY 1)
SELECT capture_id, block_y, block_x, round(level, 8) AS level, round(texture, 8) AS texture FROM k JOIN m USING (capture_id) WHERE texture >= 0.5 * typical AND texture > 1e-4 * abs(peak)""")
def placed_points(spark, folder):
    mean = ST.place(ST.normalise(ST.stack(T.frames(spark, folder), [KEY], F.col("pixels"), F.lit(1.0))), 8, 8)
    out = PX.place_blocks(mean.withColumn("value", F.col("value") + 0.02), [KEY], 2, brightness=C.POINT_MIN_BRIGHTNESS, texture=0.5, floor=1e-4)
    return out.select(KEY, "block_y", "block_x", F.round("level", 8).alias("level"), F.round("texture", 8).alias("texture"))


@query("fourier_shifted_frames", "SUP-20", PX_SQL + """
SELECT capture_id, frame_index, (y + 7) % 8 AS y, (x + 2) % 8 AS x, round(v, 6) + 0.0 AS value FROM px""")
def fourier_shifted_frames(spark, folder):
    moved = FR.fourier_shifted(F.lit(2.0), F.lit(-1.0))
    rows = T.frames(spark, folder).select(KEY, "frame_index", F.posexplode(moved).alias("pos", "value"))
    return ST.place(rows, 8, 8).select(KEY, "frame_index", "y", "x", (F.round("value", 6) + 0.0).alias("value"))


@query("colour_registration_plane", "SUP-14 PRJ-2 PRJ-7", PX_SQL + f"""
, lab AS (SELECT *, {CFA} AS c FROM px),
dm AS (SELECT a.capture_id, a.frame_index, a.y, a.x, channel, CASE WHEN a.c = channel THEN any_value(a.v) ELSE sum(b.v) FILTER (WHERE b.c = channel AND b.k <> a.k)
            / count(*) FILTER (WHERE b.c = channel AND b.k <> a.k) END AS value
  FROM lab a JOIN lab b ON a.frame_index = b.frame_index AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1,
       (SELECT unnest(['R', 'G', 'B']) AS channel) GROUP BY a.capture_id, a.frame_index, a.y, a.x, a.c, channel)
SELECT capture_id, frame_index, y, x, round(sum(value * CASE channel WHEN 'G' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END), 8) AS value FROM dm GROUP BY 1, 2, 3, 4""")
def colour_registration_plane(spark, folder):
    rows = T.frames(spark, folder).select(KEY, "frame_index", F.posexplode(FR.colour_luminance("RGGB")).alias("pos", "value"))
    return ST.place(rows, 8, 8).select(KEY, "frame_index", "y", "x", F.round("value", 8).alias("value"))


@query("planetocentric_latitudes", "FN-9 REG-21", """
SELECT c_custkey AS row_id, round(atan2(sin(lat) * power(1 - 0.064874::DOUBLE, 2), cos(lat)), 9) AS centric FROM (SELECT c_custkey, c_acctbal / 10000 * pi() / 2 AS lat FROM customer)""")
def planetocentric_latitudes(spark, folder):
    lat = F.col("c_acctbal") / 10000 * math.pi / 2
    return T.load(spark, folder, "customer").select(F.col("c_custkey").alias("row_id"), F.round(planetocentric(lat, 0.064874), 9).alias("centric"))


@query("results_in_order", "SRT-6 JN-5", """
SELECT o_orderpriority AS regime, o_custkey AS seed, count(*) AS crops FROM orders GROUP BY 1, 2 ORDER BY 1, 2""")
def results_in_order(spark, folder):
    rows = T.load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("regime"), F.col("o_custkey").alias("seed"))
    return rows.agg(F.count(F.lit(1)).alias("crops")).orderBy("regime", "seed")
