"""Pixel operators and stacks over embeddings read as 8x8 frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions.numeric import finite, half_of, luminance
from framewright.operators import frames as FR
from framewright.operators import pixels as PX
from framewright.operators import quality as Q
from framewright.operators import selection as SEL
from framewright.operators import stacking as ST
from framewright.plans.registry import query
from framewright.session import materialise
from framewright.sources import tables as T

KEY = "capture_id"
PX_SQL = f"WITH px AS ({T.PIXELS_SQL})"
# The score of each 8x8 frame: mean squared Laplacian of the 4x4 interior.
SCORE_SQL = PX_SQL + """
, lap AS (SELECT a.capture_id, a.frame_index, a.y, a.x,
             sum(CASE WHEN a.k = b.k THEN -4 * b.v ELSE b.v END) AS l
          FROM (SELECT * FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5) a
          JOIN px b ON a.frame_index = b.frame_index AND a.capture_id = b.capture_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1
          GROUP BY 1, 2, 3, 4),
score AS (SELECT capture_id, frame_index, avg(l * l) AS quality FROM lap GROUP BY 1, 2)
"""


def scored(spark, folder):
    return T.frames(spark, folder).withColumn("quality", FR.laplacian_score())


@query("laplacian_score", "PRJ-11", SCORE_SQL + "SELECT capture_id, frame_index, round(quality, 8) AS quality FROM score")
def laplacian_score(spark, folder):
    return scored(spark, folder).select(KEY, "frame_index", F.round("quality", 8).alias("quality"))


@query("laplacian_score_sky", "PRJ-11 (sky level removed)", SCORE_SQL + "SELECT capture_id, frame_index, round(quality, 8) AS quality FROM score")
def laplacian_score_sky(spark, folder):
    corners = [0, 7, 56, 63]
    return T.frames(spark, folder).select(KEY, "frame_index", F.round(FR.laplacian_score_above_sky(corners), 8).alias("quality"))


@query("weighted_pixel_stack", "AGG-1 S10 D7", SCORE_SQL + """
SELECT px.capture_id, y, x, round(sum(greatest(quality, 1e-12) * v) / sum(greatest(quality, 1e-12)), 8) AS value,
       round(sum(greatest(quality, 1e-12)), 8) AS coverage FROM px JOIN score USING (capture_id, frame_index) GROUP BY 1, 2, 3""")
def weighted_pixel_stack(spark, folder):
    frames = scored(spark, folder)
    total = ST.stack(frames, [KEY], F.col("pixels"), F.greatest("quality", F.lit(C.MIN_WEIGHT)))
    return ST.place(ST.normalise(total), 8, 8).select(
        KEY, "y", "x", F.round("value", 8).alias("value"), F.round("sum_w", 8).alias("coverage"))


BINNED = SCORE_SQL + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY quality DESC, frame_index) - 1 AS r,
             count(*) OVER (PARTITION BY capture_id) AS n FROM score),
bn AS (SELECT capture_id, frame_index, greatest(quality, 1e-12) AS w, (frame_index // 32) % 2 AS half,
              least(r * least(greatest(n // 20, 2), 16) // n, least(greatest(n // 20, 2), 16) - 1) AS bin FROM rk),
acc AS (SELECT px.capture_id, bin, half, k, y, x, sum(w * v) AS wv, sum(w) AS w FROM px JOIN bn USING (capture_id, frame_index) GROUP BY ALL)
"""


def binned_frames(spark, folder):
    """Frames with weight, quality-rank bin and half, binned where they are read."""
    frames = scored(spark, folder).select(KEY, "frame_index", "quality", "pixels")
    edges = SEL.rank_bin_edges(frames.select(KEY, "frame_index", "quality", F.lit(True).alias("accepted")))
    return frames.join(materialise(edges, "rank-bin-edges"), KEY).select(
        KEY, "frame_index", "pixels", F.greatest("quality", F.lit(C.MIN_WEIGHT)).alias("w"),
        SEL.bin_from_edges().alias("bin"), half_of(F.col("frame_index")).alias("half"))


@query("binned_pixel_stack", "AGG-4 D8 STR-7", BINNED + """
SELECT capture_id, bin, half, y, x, round(wv, 8) AS sum_wv, round(w, 8) AS sum_w FROM acc""")
def binned_pixel_stack(spark, folder):
    total = ST.stack(binned_frames(spark, folder), [KEY, "bin", "half"], F.col("pixels"), F.col("w"))
    return ST.place(total, 8, 8).select(KEY, "bin", "half", "y", "x", F.round("sum_wv", 8).alias("sum_wv"),
                                        F.round("sum_w", 8).alias("sum_w"))


@query("effective_share_per_bin", "AGG-11", BINNED + """
, n AS (SELECT capture_id, bin, sum(w) AS n FROM acc GROUP BY 1, 2)
SELECT capture_id, round(sum(1.0::DOUBLE / (bin + 1) * n) * sum(1.0::DOUBLE / (bin + 1) * n)
       / (sum(n) * sum(1.0::DOUBLE / (bin + 1) / (bin + 1) * n)), 8) AS share FROM n GROUP BY 1""")
def effective_share_per_bin(spark, folder):
    from framewright.operators.fourier import effective_share

    total = ST.stack(binned_frames(spark, folder), [KEY, "bin", "half"], F.col("pixels"), F.col("w"))
    weights = total.select(KEY, "bin").distinct().withColumn("band", F.lit(0)).withColumn("weight", 1.0 / (F.col("bin") + 1))
    return effective_share(total, weights).select(KEY, F.round("share", 8).alias("share"))


@query("saturated_frames", "PRJ-4 FLT-6", PX_SQL + """
SELECT capture_id, frame_index, avg((v >= 0.25)::INT::DOUBLE) > 0.05 AS saturated, round(avg((v >= 0.25)::INT::DOUBLE), 6) AS fraction
FROM px GROUP BY 1, 2""")
def saturated_frames(spark, folder):
    share = PX.share_at_or_above(F.col("pixels"), 0.25)
    return T.frames(spark, folder).select(KEY, "frame_index", (share > C.SATURATED_FRACTION).alias("saturated"),
                                          F.round(share, 6).alias("fraction"))


@query("area_mean_2x2", "PRJ-3", PX_SQL + """
SELECT capture_id, frame_index, y // 2 AS y, x // 2 AS x, round(avg(v), 8) AS value FROM px GROUP BY ALL""")
def area_mean_2x2(spark, folder):
    binned = T.frames(spark, folder).select(KEY, "frame_index", F.posexplode(FR.area_mean(bayer=True)).alias("pos", "value"))
    return ST.place(binned, 4, 4).select(KEY, "frame_index", "y", "x", F.round("value", 8).alias("value"))


@query("luminance_plane", "PRJ-2 S25", """
SELECT label::BIGINT AS capture_id, vec_id AS frame_index, k AS pos,
       round(0.25 * embedding[k + 1]::DOUBLE + 0.5 * embedding[k + 17]::DOUBLE + 0.25 * embedding[k + 33]::DOUBLE, 8) AS value
FROM embeddings, (SELECT unnest(range(16)) AS k)""")
def luminance_plane(spark, folder):
    rgb = T.frames(spark, folder).select(KEY, "frame_index", F.posexplode(F.arrays_zip(
        *[F.slice("pixels", 16 * c + 1, 16).alias(n) for c, n in enumerate(("r", "g", "b"))])).alias("pos", "p"))
    value = luminance(F.col("p.r").cast("double"), F.col("p.g").cast("double"), F.col("p.b").cast("double"))
    return rgb.select(KEY, "frame_index", F.col("pos").cast("long").alias("pos"), F.round(value, 8).alias("value"))


CFA = "CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 'R' WHEN y % 2 = 1 AND x % 2 = 1 THEN 'B' ELSE 'G' END"


@query("site_colours", "PRJ-5", PX_SQL + f"""
SELECT capture_id, {CFA} AS channel, count(*) AS samples, round(sum(v), 6) AS total FROM px GROUP BY 1, 2""")
def site_colours(spark, folder):
    return PX.explode_pixels(T.frames(spark, folder)).withColumn("channel", PX.site_colour("RGGB")).groupBy(KEY, "channel").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("value"), 6).alias("total"))


@query("colour_site_stack", "AGG-2", PX_SQL + f"""
SELECT capture_id, y, x, channel, round(coalesce(sum(CASE WHEN {CFA} = channel THEN v END) / nullif(count(*) FILTER (WHERE {CFA} = channel), 0), 0), 8) AS value,
       count(*) FILTER (WHERE {CFA} = channel)::DOUBLE AS coverage
FROM px, (SELECT unnest(['R', 'G', 'B']) AS channel) GROUP BY 1, 2, 3, 4""")
def colour_site_stack(spark, folder):
    total = colour_stack(spark, folder)
    return total.select(KEY, "y", "x", "channel", F.round("value", 8).alias("value"), F.round("sum_w", 8).alias("coverage"))


def colour_stack(spark, folder):
    zero = F.lit(0.0)
    total = ST.stack(T.frames(spark, folder), [KEY], FR.colour_scatter("RGGB", zero, zero), F.lit(1.0),
                     FR.colour_support("RGGB", zero, zero))
    return ST.place(ST.normalise(total), 8, 8, "RGB")


@query("colour_site_stack_shifted", "AGG-2 PRJ-15 (half-pixel registered)", PX_SQL + f"""
, sh AS (SELECT *, (frame_index % 3) * 0.5::DOUBLE AS dx, (frame_index % 2) * 1.0::DOUBLE AS dy, {CFA} AS channel FROM px),
put AS (SELECT capture_id, channel, v, y - floor(dy)::BIGINT - cy AS ty, x - floor(dx)::BIGINT - cx AS tx,
               (CASE WHEN cy = 0 THEN 1 - (dy - floor(dy)) ELSE dy - floor(dy) END) * (CASE WHEN cx = 0 THEN 1 - (dx - floor(dx)) ELSE dx - floor(dx) END) AS wt
        FROM sh, (SELECT unnest([0, 1]) AS cy), (SELECT unnest([0, 1]) AS cx)),
s AS (SELECT capture_id, ty AS y, tx AS x, channel, sum(wt * v) AS wv, sum(wt) AS w FROM put WHERE ty BETWEEN 0 AND 7 AND tx BETWEEN 0 AND 7 GROUP BY ALL),
grid AS (SELECT DISTINCT capture_id, px.y, px.x, c AS channel FROM px, (SELECT unnest(['R', 'G', 'B']) AS c))
SELECT capture_id, y, x, channel, round(CASE WHEN w > 0 THEN wv / w ELSE 0 END, 8) AS value FROM grid LEFT JOIN s USING (capture_id, y, x, channel)""")
def colour_site_stack_shifted(spark, folder):
    dx, dy = (F.col("frame_index") % 3) * 0.5, (F.col("frame_index") % 2) * 1.0
    total = ST.stack(T.frames(spark, folder), [KEY], FR.colour_scatter("RGGB", dx, dy), F.lit(1.0),
                     FR.colour_support("RGGB", dx, dy))
    return ST.place(ST.normalise(total), 8, 8, "RGB").select(KEY, "y", "x", "channel", F.round("value", 8).alias("value"))


@query("complete_colours", "PRJ-25 JN-8", PX_SQL + f"""
, d AS (SELECT capture_id, y, x, {CFA} AS channel, avg(v) AS value, count(*)::DOUBLE AS cov FROM px GROUP BY ALL),
grid AS (SELECT DISTINCT capture_id, y, x, c AS channel FROM d, (SELECT unnest(['R', 'G', 'B']) AS c)),
o AS (SELECT * FROM (VALUES (0, -1, 0), (1, 0, -1), (2, 0, 1), (3, 1, 0), (4, -1, -1), (5, -1, 1), (6, 1, -1), (7, 1, 1)) t(rank, dy, dx)),
near AS (SELECT g.capture_id, g.y, g.x, g.channel, arg_min(d.value, rank) AS value, arg_min(d.cov, rank) AS cov
         FROM grid g, o JOIN d ON d.capture_id = g.capture_id AND d.channel = g.channel AND d.y = g.y + dy AND d.x = g.x + dx GROUP BY ALL)
SELECT g.capture_id, g.y, g.x, g.channel, round(coalesce(d.value, n.value, 0), 8) AS value, coalesce(d.cov, n.cov, 0) AS coverage, d.value IS NULL AS filled
FROM grid g LEFT JOIN d USING (capture_id, y, x, channel) LEFT JOIN near n USING (capture_id, y, x, channel)""")
def complete_colours(spark, folder):
    direct = colour_stack(spark, folder).withColumnRenamed("sum_w", "coverage").select(
        KEY, "y", "x", "channel", "value", "coverage", "valid")
    return ST.complete_colours(direct, [KEY]).select(
        KEY, "y", "x", "channel", F.round("value", 8).alias("value"), "coverage", "filled")


@query("green_proxy", "PRJ-6 JN-8", PX_SQL + f"""
SELECT a.capture_id, a.frame_index, a.y, a.x, round(CASE WHEN (a.y + a.x) % 2 = 1 THEN any_value(a.v)
       ELSE sum(b.v) FILTER (WHERE (b.y + b.x) % 2 = 1) / count(*) FILTER (WHERE (b.y + b.x) % 2 = 1) END, 8) AS value
FROM px a JOIN px b ON a.frame_index = b.frame_index AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3, 4""")
def green_proxy(spark, folder):
    return _plane_rows(T.frames(spark, folder), FR.green_proxy("RGGB"))


def _plane_rows(frames, plane, channels=""):
    rows = frames.select(KEY, "frame_index", F.posexplode(plane).alias("pos", "value"))
    keep = ["y", "x"] + (["channel"] if channels else [])
    return ST.place(rows, 8, 8, channels).select(KEY, "frame_index", *keep, F.round("value", 8).alias("value"))


@query("bilinear_demosaic", "PRJ-7", PX_SQL + f"""
, lab AS (SELECT *, {CFA} AS c FROM px)
SELECT a.capture_id, a.frame_index, a.y, a.x, channel,
       round(CASE WHEN a.c = channel THEN any_value(a.v) ELSE sum(b.v) FILTER (WHERE b.c = channel AND b.k <> a.k)
             / count(*) FILTER (WHERE b.c = channel AND b.k <> a.k) END, 8) AS value
FROM lab a JOIN lab b ON a.frame_index = b.frame_index AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1,
     (SELECT unnest(['R', 'G', 'B']) AS channel) GROUP BY a.capture_id, a.frame_index, a.y, a.x, a.c, channel""")
def bilinear_demosaic(spark, folder):
    return _plane_rows(T.frames(spark, folder), FR.demosaiced("RGGB"), "RGB")


@query("demosaic_first_stack", "AGG-3", PX_SQL + f"""
, lab AS (SELECT *, {CFA} AS c FROM px),
dm AS (SELECT a.capture_id, a.frame_index, a.y, a.x, channel,
       CASE WHEN a.c = channel THEN any_value(a.v) ELSE sum(b.v) FILTER (WHERE b.c = channel AND b.k <> a.k)
            / count(*) FILTER (WHERE b.c = channel AND b.k <> a.k) END AS value
  FROM lab a JOIN lab b ON a.frame_index = b.frame_index AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1,
       (SELECT unnest(['R', 'G', 'B']) AS channel) GROUP BY a.capture_id, a.frame_index, a.y, a.x, a.c, channel)
SELECT capture_id, y, x, channel, round(avg(value), 8) AS value FROM dm GROUP BY 1, 2, 3, 4""")
def demosaic_first_stack(spark, folder):
    total = ST.stack(T.frames(spark, folder), [KEY], FR.demosaiced("RGGB"), F.lit(1.0))
    return ST.place(ST.normalise(total), 8, 8, "RGB").select(KEY, "y", "x", "channel", F.round("value", 8).alias("value"))


@query("nearest_colour_preview", "PRJ-8 SRC-18", PX_SQL + f"""
, lab AS (SELECT *, {CFA} AS c FROM px)
SELECT a.capture_id, a.frame_index, a.y, a.x, b.c AS channel,
       round(arg_min(b.v, ((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) * 10000
             + (b.y % 2) * 5000 + (b.x % 2) * 2000 - b.y * 20 - b.x), 8) AS value
FROM lab a JOIN lab b ON a.frame_index = b.frame_index AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
GROUP BY 1, 2, 3, 4, 5""")
def nearest_colour_preview(spark, folder):
    return _plane_rows(T.frames(spark, folder), FR.nearest_colours("RGGB"), "RGB")


@query("calibrated_frames", "PRJ-1 SRC-15", PX_SQL + """
, cal AS (SELECT k, 0.001 * k AS bias, 0.002::DOUBLE AS dark, 1 + 0.01 * k AS flat FROM (SELECT unnest(range(64)) AS k)),
rel AS (SELECT k, bias, dark, flat / (SELECT max(flat) FROM cal) AS r FROM cal)
SELECT capture_id, frame_index, k AS pos, round((v - bias - dark) * ((SELECT median(r) FROM rel) / r) * 1.5, 8) AS value
FROM px JOIN rel USING (k)""")
def calibrated_frames(spark, folder):
    from framewright.operators.calibration import Calibration, calibrated

    k = np.arange(64.0)
    tables = Calibration(bias=0.001 * k, dark=np.full(64, 0.002), flat=1 + 0.01 * k, gain=1.5)
    rows = T.frames(spark, folder).select(KEY, "frame_index", F.posexplode(calibrated(F.col("pixels"), tables)).alias("pos", "value"))
    return rows.select(KEY, "frame_index", F.col("pos").cast("long").alias("pos"), F.round("value", 8).alias("value"))


@query("brightness_normalised", "PRJ-24", PX_SQL + """
, s AS (SELECT capture_id, y, x, avg(v) AS value FROM px GROUP BY 1, 2, 3),
g AS (SELECT capture_id, greatest(max(value), 0) AS peak FROM s GROUP BY 1)
SELECT capture_id, y, x, round(value * CASE WHEN peak > 0 THEN 65535 * 0.8::DOUBLE / peak ELSE 1 END, 4) AS value FROM s JOIN g USING (capture_id)""")
def brightness_normalised(spark, folder):
    total = ST.normalise(ST.stack(T.frames(spark, folder), [KEY], F.col("pixels"), F.lit(1.0)))
    return ST.place(ST.brightness(total, [KEY], 80.0, 65535.0), 8, 8).select(KEY, "y", "x", F.round("value", 4).alias("value"))


@query("translated_stack", "PRJ-15 FLT-7 AGG-1 JN-11", PX_SQL + """
, sh AS (SELECT capture_id, frame_index, (frame_index % 5 - 2) * 0.5::DOUBLE AS dx, (frame_index % 3 - 1) * 0.25::DOUBLE AS dy FROM px GROUP BY ALL),
put AS (SELECT px.capture_id, px.frame_index, y - floor(dy)::BIGINT - cy AS ty, x - floor(dx)::BIGINT - cx AS tx,
             v, (CASE WHEN cy = 0 THEN 1 - (dy - floor(dy)) ELSE dy - floor(dy) END) * (CASE WHEN cx = 0 THEN 1 - (dx - floor(dx)) ELSE dx - floor(dx) END) AS wt
        FROM px JOIN sh USING (capture_id, frame_index), (SELECT unnest([0, 1]) AS cy), (SELECT unnest([0, 1]) AS cx) WHERE abs(dx) <= 0.75 AND abs(dy) <= 0.75)
SELECT capture_id, ty AS y, tx AS x, round(sum(wt * v) / sum(wt), 8) AS value, round(sum(wt), 8) AS coverage
FROM put WHERE ty BETWEEN 0 AND 7 AND tx BETWEEN 0 AND 7 GROUP BY 1, 2, 3 HAVING sum(wt) > 0""")
def translated_stack(spark, folder):
    frames = T.frames(spark, folder).withColumn("dx", (F.col("frame_index") % 5 - 2) * 0.5).withColumn(
        "dy", (F.col("frame_index") % 3 - 1) * 0.25).where((F.abs("dx") <= 0.75) & (F.abs("dy") <= 0.75))
    total = ST.stack(frames, [KEY], FR.shifted(F.col("dx"), F.col("dy")), F.lit(1.0),
                     FR.shifted_support(F.col("dx"), F.col("dy")))
    return ST.place(ST.normalise(total), 8, 8).where("valid").select(
        KEY, "y", "x", F.round("value", 8).alias("value"), F.round("sum_w", 8).alias("coverage"))


@query("scatter_to_grid", "PRJ-14 JN-11 SUP-11", PX_SQL + """
, t AS (SELECT capture_id, frame_index, v, y * 0.5::DOUBLE + 0.25::DOUBLE AS ty, x * 0.5::DOUBLE AS tx FROM px),
c AS (SELECT capture_id, v, floor(ty)::BIGINT + cy AS y, floor(tx)::BIGINT + cx AS x,
             (CASE WHEN cy = 0 THEN 1 - (ty - floor(ty)) ELSE ty - floor(ty) END) * (CASE WHEN cx = 0 THEN 1 - (tx - floor(tx)) ELSE tx - floor(tx) END) AS wt
      FROM t, (SELECT unnest([0, 1]) AS cy), (SELECT unnest([0, 1]) AS cx))
SELECT capture_id, y, x, round(sum(wt * v), 6) AS sum_wv, round(sum(wt), 6) AS sum_w FROM c WHERE y BETWEEN 0 AND 3 AND x BETWEEN 0 AND 3 AND wt > 0 GROUP BY 1, 2, 3""")
def scatter_to_grid(spark, folder):
    rows = PX.explode_pixels(T.frames(spark, folder)).withColumn("ty", F.col("y") * 0.5 + 0.25).withColumn("tx", F.col("x") * 0.5)
    return PX.scatter(rows, [KEY], F.col("ty"), F.col("tx"), F.col("value"), 4, 4).select(
        KEY, "y", "x", F.round("sum_wv", 6).alias("sum_wv"), F.round("sum_w", 6).alias("sum_w"))


@query("disc_moments", "AGG-25", PX_SQL + """
, lim AS (SELECT capture_id, frame_index, quantile_cont(v, 0.1) AS sky, quantile_cont(v, 0.99) AS peak FROM px GROUP BY 1, 2),
m AS (SELECT px.capture_id, px.frame_index, x + 0.5::DOUBLE AS px_, y + 0.5::DOUBLE AS py_, v - sky AS w FROM px JOIN lim USING (capture_id, frame_index)
      WHERE v > sky + 0.25::DOUBLE * (peak - sky)),
c AS (SELECT capture_id, frame_index, count(*) AS n, sum(w * px_) / sum(w) AS cx, sum(w * py_) / sum(w) AS cy FROM m GROUP BY 1, 2 HAVING count(*) >= 9),
q AS (SELECT capture_id, frame_index, n, cx, cy, sum(w * (px_ - cx) * (px_ - cx)) / sum(w) AS mxx, sum(w * (py_ - cy) * (py_ - cy)) / sum(w) AS myy,
             sum(w * (px_ - cx) * (py_ - cy)) / sum(w) AS mxy FROM m JOIN c USING (capture_id, frame_index) GROUP BY ALL),
d AS (SELECT *, sqrt(greatest((mxx + myy) * (mxx + myy) / 4 - (mxx * myy - mxy * mxy), 0)) AS disc FROM q)
SELECT capture_id, frame_index, n AS n_pixels, round(cx, 6) AS cx, round(cy, 6) AS cy,
       round(sqrt(greatest(4 * ((mxx + myy) / 2 + disc), 0)), 6) AS semi_major, round(sqrt(greatest(4 * ((mxx + myy) / 2 - disc), 0)), 6) AS semi_minor FROM d""")
def disc_moments(spark, folder):
    from framewright.operators.fits import disc_moments as moments

    out = moments(PX.explode_pixels(T.frames(spark, folder)), [KEY, "frame_index"])
    return out.select(KEY, "frame_index", "n_pixels", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "semi_major", "semi_minor")])


@query("structure_function", "AGG-32", PX_SQL + """
SELECT a.capture_id, lag, round((avg((b.v - a.v) * (b.v - a.v)) FILTER (WHERE b.y = a.y) + avg((b.v - a.v) * (b.v - a.v)) FILTER (WHERE b.x = a.x)) / 2, 8) AS measured
FROM px a, (SELECT unnest([1, 2, 3]) AS lag) JOIN px b ON a.frame_index = b.frame_index AND ((b.y = a.y AND b.x = a.x + lag) OR (b.x = a.x AND b.y = a.y + lag))
GROUP BY 1, 2""")
def structure_function(spark, folder):
    out = PX.structure_function(T.frames(spark, folder), [KEY], 8, 8, 3)
    return out.select(KEY, "lag", F.round("measured", 8).alias("measured"))


@query("split_half_rms", "AGG-31 JN-9", PX_SQL + """
, s AS (SELECT capture_id, (frame_index // 32) % 2 AS half, k, avg(v) AS v FROM px GROUP BY 1, 2, 3)
SELECT a.capture_id, count(*) AS common_samples, round(sqrt(sum((a.v - b.v) * (a.v - b.v)) / greatest(sum(0.5 * (a.v * a.v + b.v * b.v)), 1e-20)), 8) AS relative_rms
FROM s a JOIN s b ON a.capture_id = b.capture_id AND a.k = b.k AND a.half = 0 AND b.half = 1 GROUP BY 1""")
def split_half_rms(spark, folder):
    frames = T.frames(spark, folder).withColumn("half", half_of(F.col("frame_index")))
    halves = ST.normalise(ST.stack(frames, [KEY, "half"], F.col("pixels"), F.lit(1.0)))
    return PX.split_half(halves, [KEY]).withColumn("relative_rms", F.round("relative_rms", 8))


@query("raw_residual", "AGG-31", PX_SQL + """
, s AS (SELECT capture_id, k, avg(v) AS m FROM px GROUP BY 1, 2)
SELECT px.capture_id, count(*) AS samples, count(DISTINCT frame_index) AS frames, round(sqrt(sum((v - m) * (v - m)) / greatest(sum(v * v), 1e-20)), 8) AS relative_rms
FROM px JOIN s USING (capture_id, k) GROUP BY 1""")
def raw_residual(spark, folder):
    frames = T.frames(spark, folder)
    mean = ST.planes_of(ST.normalise(ST.stack(frames, [KEY], F.col("pixels"), F.lit(1.0))), [KEY]).withColumnRenamed("pixels", "model")
    return PX.raw_residual(frames.join(materialise(mean, "mean-plane"), KEY), [KEY]).withColumn("relative_rms", F.round("relative_rms", 8))


@query("layer_coverage", "AGG-5", PX_SQL + """
SELECT y, x, round(sum(CASE WHEN v > 0.1 THEN abs(v) ELSE 0 END), 6) AS bright, round(sum(CASE WHEN v < -0.1 THEN abs(v) ELSE 0 END), 6) AS dark FROM px GROUP BY 1, 2""")
def layer_coverage(spark, folder):
    rows = PX.explode_pixels(T.frames(spark, folder))
    out = ST.layer_coverage(rows, ["y", "x"], {"bright": F.col("value") > 0.1, "dark": F.col("value") < -0.1}, F.abs("value"))
    return out.select("y", "x", F.round("bright", 6).alias("bright"), F.round("dark", 6).alias("dark"))


NOISE = """
, r AS (SELECT a.capture_id, a.frame_index, a.k, abs(sum(b.v * CASE abs(a.y - b.y) + abs(a.x - b.x) WHEN 0 THEN 4 WHEN 1 THEN -2 ELSE 1 END)) / 6 AS resp, avg(b.v) AS lev
        FROM (SELECT * FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6) a JOIN px b ON a.frame_index = b.frame_index AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3),
q AS (SELECT frame_index, quantile_cont(lev, 0.05) AS bg, quantile_cont(lev, 0.995) AS top FROM r GROUP BY 1),
n AS (SELECT capture_id, frame_index, count(*) AS c, avg(lev) - any_value(bg) AS signal, 1.4826 * median(resp) AS noise FROM r JOIN q USING (frame_index)
      WHERE top > bg AND lev > bg + 0.5::DOUBLE * (top - bg) GROUP BY 1, 2)
"""


@query("frame_noise", "PRJ-13 AGG-10", PX_SQL + NOISE + """
SELECT capture_id, frame_index, round(signal, 8) AS signal, round(noise, 8) AS noise FROM n WHERE c >= 4 AND noise > 0""")
def frame_noise(spark, folder):
    frames = T.frames(spark, folder).withColumn("n", FR.frame_noise(minimum=4))
    return frames.where("n is not null").select(KEY, "frame_index", F.round("n.signal", 8).alias("signal"), F.round("n.noise", 8).alias("noise"))


@query("measured_frames", "PRJ-9 PRJ-10 AGG-29 D5")
def measured_frames(spark, folder):
    frames = T.frames(spark, folder).withColumn("m", FR.measured(bit_depth=32))
    return frames.select(KEY, "frame_index", *[F.round(f"m.{c}", 8).alias(c) for c in (*C.METRICS, "angle_rad")], "m.status")


@query("finite_frames", "FLT-6 FN-14", PX_SQL + "SELECT capture_id, count(DISTINCT frame_index) AS frames, count(*) AS samples FROM px WHERE isfinite(v) GROUP BY 1")
def finite_frames(spark, folder):
    good = F.forall("pixels", lambda v: finite(v))
    return T.frames(spark, folder).where(good).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.size("pixels").cast("long")).alias("samples"))


@query("stack_snr", "AGG-10 PRJ-13 SRT-5 (single-frame SNR scaled to the stack)", SCORE_SQL + NOISE + """
, o AS (SELECT capture_id, frame_index, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) - 1 AS pos, count(*) OVER (PARTITION BY capture_id) AS total FROM score),
pick AS (SELECT DISTINCT capture_id, frame_index FROM o JOIN (SELECT unnest(range(8)) AS j) ON j < least(total, 8)
         AND pos = round_even(j * ((total - 1) / greatest(least(total, 8) - 1, 1)::DOUBLE), 0)),
m AS (SELECT capture_id, count(*) AS frames_sampled, median(signal) AS signal, median(noise) AS noise FROM n JOIN pick USING (capture_id, frame_index) WHERE c >= 4 AND noise > 0 GROUP BY 1),
e AS (SELECT capture_id, sqrt(sum(greatest(quality, 1e-12)) * sum(greatest(quality, 1e-12)) / sum(greatest(quality, 1e-12) * greatest(quality, 1e-12))) AS gain FROM score GROUP BY 1)
SELECT capture_id, frames_sampled, round(signal, 6) AS signal, round(noise, 6) AS noise, round(signal / noise, 6) AS snr, round(gain, 6) AS snr_gain, round(signal / noise * gain, 6) AS estimated_snr FROM e JOIN m USING (capture_id)""")
def stack_snr(spark, folder):
    frames = scored(spark, folder).withColumn("accepted", F.lit(True))
    summary = Q.stack_summary(frames.drop("pixels"), frames.drop("pixels"))
    picks = SEL.evenly_spaced(frames.select(KEY, "frame_index"), [KEY], "frame_index", C.NOISE_SAMPLES)
    sampled = frames.join(materialise(picks, "noise-samples"), [KEY, "frame_index"]).withColumn("n", FR.frame_noise(minimum=4))
    measured = sampled.select(KEY, "n.signal", "n.noise").where("noise is not null")
    out = Q.snr_summary(measured, summary)
    return out.select(KEY, "frames_sampled", *[F.round(c, 6).alias(c) for c in ("signal", "noise", "snr", "snr_gain", "estimated_snr")])


# The mask of 6 x 6 pixels has nine places on a frame of 8 x 8; only about the middle one all neighbours are known.
@query("masked_shifts", "REG-6 FLT-10 (masked correlation against the mean of all frames)", f"""
WITH f AS ({T.PIXELS_SQL}),
ta AS (SELECT o, exp(-0.5 * o * o / 2.25::DOUBLE) / (SELECT sum(exp(-0.5 * q * q / 2.25::DOUBLE)) FROM (SELECT unnest(range(-6, 7)) AS q)) AS w FROM (SELECT unnest(range(-6, 7)) AS o)),
mi AS (SELECT i, CASE WHEN i + o < 0 THEN -1 - i - o WHEN i + o > 7 THEN 15 - i - o ELSE i + o END AS j, sum(w) AS w FROM (SELECT unnest(range(8)) AS i), ta GROUP BY 1, 2),
al AS (SELECT capture_id, frame_index, y, x, v FROM f UNION ALL SELECT NULL, NULL, y, x, avg(v) FROM f GROUP BY y, x),
sm AS (SELECT q.capture_id, q.frame_index, a.i AS y, b.i AS x, sum(a.w * b.w * q.v) AS v FROM al q JOIN mi a ON a.j = q.y JOIN mi b ON b.j = q.x GROUP BY 1, 2, 3, 4),
te AS (SELECT y, x, v - avg(v) OVER () AS t FROM sm WHERE frame_index IS NULL AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6),
sc AS (SELECT s.capture_id, s.frame_index, dy, dx, sum(t * v) / sqrt((SELECT sum(t * t) FROM te) * (sum(v * v) - sum(v) * sum(v) / 36)) AS c
       FROM te JOIN (SELECT unnest([-1, 0, 1]) AS dy) ON true JOIN (SELECT unnest([-1, 0, 1]) AS dx) ON true JOIN sm s ON s.frame_index IS NOT NULL AND s.y = te.y + dy AND s.x = te.x + dx GROUP BY 1, 2, 3, 4),
nb AS (SELECT capture_id, frame_index, max(c) AS peak, sum(c) FILTER (dy = 0 AND dx = 0) AS m, sum(c) FILTER (dy = -1 AND dx = 0) AS u, sum(c) FILTER (dy = 1 AND dx = 0) AS d,
              sum(c) FILTER (dy = 0 AND dx = -1) AS l, sum(c) FILTER (dy = 0 AND dx = 1) AS r,
              (sum(c) FILTER (dy = 1 AND dx = 1) + sum(c) FILTER (dy = -1 AND dx = -1) - sum(c) FILTER (dy = -1 AND dx = 1) - sum(c) FILTER (dy = 1 AND dx = -1)) / 4 AS xy FROM sc GROUP BY 1, 2),
cu AS (SELECT *, (d - u) / 2 AS gy, (r - l) / 2 AS gx, u + d - 2 * m AS yy, l + r - 2 * m AS xx FROM nb),
st AS (SELECT *, CASE WHEN m >= 1 - 1e-12 THEN 0 ELSE (xy * gx - xx * gy) / (yy * xx - xy * xy) END AS sy, CASE WHEN m >= 1 - 1e-12 THEN 0 ELSE (xy * gy - yy * gx) / (yy * xx - xy * xy) END AS sx FROM cu),
ok AS (SELECT *, m = peak AND peak >= 0.8 AND yy * xx - xy * xy > 0 AND yy < 0 AND abs(sy) <= 1 AND abs(sx) <= 1 AS matched FROM st)
SELECT capture_id, frame_index, matched, CASE WHEN matched THEN round(sx, 5) END AS dx, CASE WHEN matched THEN round(sy, 5) END AS dy FROM ok""")
def masked_shifts(spark, folder):
    from framewright.operators import drift as D

    frames = T.frames(spark, folder).withColumn("all", F.lit(0))
    mean = ST.normalise(ST.stack(frames, ["all"], F.col("pixels"), F.lit(1.0)))
    reference = mean.groupBy("all").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("reference"))
    mask = np.zeros((8, 8), dtype=bool)
    mask[1:-1, 1:-1] = True
    matched = frames.join(materialise(reference, "mean-plane"), "all").withColumn("m", D.masked_match(F.col("reference"), mask))
    found = matched.select(KEY, "frame_index", D.masked_displacement(F.col("m")).alias("d"))
    return found.select(KEY, "frame_index", F.col("d").isNotNull().alias("matched"), F.round("d.dx", 5).alias("dx"), F.round("d.dy", 5).alias("dy"))
