"""Moving scenes: stacks at an output epoch, displacement fields and their guards, layers that turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import motion as M
from framewright.functions.geometry import Globe
from framewright.operators import local as LO
from framewright.operators import motion as MO
from framewright.plans.fourier import PX_SQL, scored
from framewright.plans.geometry import GLOBE, RAYS, RINGS, rays
from framewright.plans.registry import query
from framewright.sources import tables as T

KEY = "capture_id"
# A globe of 3.2 pixels on the frames of 8 x 8, one frame for every two seconds.
SMALL = Globe(radius=3.2, flattening=0.1, pole=0.3, latitude=0.2, rate=0.01, epoch=31.0)
MOVING = """
WITH px AS (SELECT label::BIGINT AS capture_id, vec_id AS frame_index, (vec_id % 50) * 2.0::DOUBLE AS t, 1.0::DOUBLE + vec_id % 5 AS q, k, embedding[k + 1]::DOUBLE AS v
            FROM embeddings, (SELECT unnest(range(64)) AS k)),
tm AS (SELECT unnest(range(50)) * 2.0::DOUBLE AS t),
pix AS (SELECT k, k % 8 + 0.5::DOUBLE - 4 AS sx, 4 - (k // 8 + 0.5::DOUBLE) AS sy FROM (SELECT unnest(range(64)) AS k))"""
DEALT = """
sn AS (SELECT * REPLACE (CASE WHEN abs(x - round(x)) < 1e-10 THEN round(x) ELSE x END AS x, CASE WHEN abs(y - round(y)) < 1e-10 THEN round(y) ELSE y END AS y) FROM moved),
co AS (SELECT t, k, gain, floor(y)::BIGINT + cy AS y, floor(x)::BIGINT + cx AS x,
              (CASE WHEN cy = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN cx = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS part
       FROM sn, (SELECT unnest([0, 1]) AS cy), (SELECT unnest([0, 1]) AS cx)),
su AS (SELECT capture_id, y * 8 + x AS pos, sum(q * part * v * gain) AS wv, sum(q * part) AS w FROM px JOIN co USING (t, k)
       WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 AND part > 0 GROUP BY 1, 2)
SELECT capture_id, pos::BIGINT AS pos, round(wv / w, 6) AS value, round(w, 6) AS coverage FROM su WHERE round(w, 6) > 0"""


def moving(spark, folder, **facts):
    frames = T.frames(spark, folder).withColumns({"t_s": (F.col("frame_index") % 50) * 2.0, "quality": F.lit(1.0) + F.col("frame_index") % 5})
    views = MO.views(frames.select(KEY).distinct(), cx=4.0, cy=4.0, epoch_s=31.0, **facts)
    anchors = frames.groupBy(KEY).agg(F.min("frame_index").alias("frame_index"))
    pixels, _ = MO.moving_stack(frames, views, anchors, track=False)
    value, cover = F.round(F.col("sum_wv") / F.col("sum_w"), 6), F.round("sum_w", 6)
    return pixels.where(cover > 0).select(KEY, "pos", value.alias("value"), cover.alias("coverage"))


@query("surface_stack", "REG-16 REG-13 SUP-1 PRJ-23 PRJ-22 AGG-1 (spinning globe, known poses)", MOVING + """,
g AS (SELECT 3.2::DOUBLE AS a, 3.2::DOUBLE * 0.9 AS c, 0.3::DOUBLE + pi() / 2 AS al, 0.2::DOUBLE AS b),
q AS (SELECT *, sin(b) * (cos(al) * sx - sin(al) * sy) AS qx, sin(al) * sx + cos(al) * sy AS qy, -cos(b) * (cos(al) * sx - sin(al) * sy) AS qz FROM pix, g),
s AS (SELECT *, cos(b) * cos(b) / (a * a) + sin(b) * sin(b) / (c * c) AS aa, 2 * (qx * cos(b) / (a * a) + qz * sin(b) / (c * c)) AS bb,
             (qx * qx + qy * qy) / (a * a) + qz * qz / (c * c) - 1 AS cc FROM q),
d AS (SELECT *, (sqrt(greatest(bb * bb - 4 * aa * cc, 0)) - bb) / (2 * aa) AS depth FROM s),
p AS (SELECT *, qx + depth * cos(b) AS xb, qz + depth * sin(b) AS zb FROM d),
n AS (SELECT *, xb * cos(b) / (a * a) + zb * sin(b) / (c * c) AS toward, sqrt((xb * xb + qy * qy) / power(a, 4) + zb * zb / power(c, 4)) AS steep FROM p),
h AS (SELECT *, bb * bb - 4 * aa * cc >= 0 AND toward >= -1e-12 AS hit, toward / steep AS mu FROM n),
r AS (SELECT *, cos(0.01::DOUBLE * (t - 31)) * xb - sin(0.01::DOUBLE * (t - 31)) * qy AS x2, sin(0.01::DOUBLE * (t - 31)) * xb + cos(0.01::DOUBLE * (t - 31)) * qy AS y2 FROM h, tm),
e AS (SELECT *, (x2 * cos(b) / (a * a) + zb * sin(b) / (c * c)) / steep AS mu2, sin(b) * x2 - cos(b) * zb AS across FROM r),
w AS (SELECT *, hit AND mu2 >= -1e-12 AS seen FROM e),
moved AS (SELECT t, k, CASE WHEN seen THEN power(greatest(mu2, 0.2) / greatest(mu, 0.2), 0.6) ELSE 1 END AS gain,
                 4 + CASE WHEN seen THEN cos(al) * across + sin(al) * y2 ELSE sx END - 0.5 AS x,
                 4 - CASE WHEN seen THEN -sin(al) * across + cos(al) * y2 ELSE sy END - 0.5 AS y FROM w WHERE NOT hit OR seen),""" + DEALT)
def surface_stack(spark, folder):
    return moving(spark, folder, mode="surface", radius=SMALL.radius, flattening=SMALL.flattening, pole=SMALL.pole, latitude=SMALL.latitude,
                  rate=SMALL.rate, limb_power=0.6)


@query("field_stack", "REG-16 REG-13 SUP-1 PRJ-17 PRJ-23 (turning field, known poses)", MOVING + """,
moved AS (SELECT t, k, 1.0::DOUBLE AS gain, 4 + cos(-0.02::DOUBLE * (t - 31)) * sx - sin(-0.02::DOUBLE * (t - 31)) * sy - 0.5 AS x,
                 4 - (sin(-0.02::DOUBLE * (t - 31)) * sx + cos(-0.02::DOUBLE * (t - 31)) * sy) - 0.5 AS y FROM pix, tm),""" + DEALT)
def field_stack(spark, folder):
    return moving(spark, folder, mode="field", field_rate=0.02)


@query("layered_motion_map", "PRJ-21 SUP-8 (globe and rings in one map)", RAYS + """
, tn AS (SELECT *, 1.76e-4::DOUBLE * (t - 900) AS spin, sqrt((xb * xb + qy * qy) / (a * a * a * a) + zb * zb / (c * c * c * c)) AS steep FROM ring),
g2 AS (SELECT *, cos(spin) * xb - sin(spin) * qy AS x2, sin(spin) * xb + cos(spin) * qy AS y2, cos(spin) * rx - sin(spin) * ry AS x3, sin(spin) * rx + cos(spin) * ry AS y3,
              -cos(b) * (cos(al) * sx - sin(al) * sy) + sin(b) * rt AS z3 FROM tn),
g3 AS (SELECT *, (x2 * cos(b) / (a * a) + zb * sin(b) / (c * c)) / steep AS mu2, sin(b) * x2 - cos(b) * zb AS ac2, sin(b) * x3 - cos(b) * z3 AS ac3 FROM g2),
g4 AS (SELECT *, coalesce(on_globe AND mu2 >= -1e-12, false) AS seen, cos(al) * ac2 + sin(al) * y2 AS gx, -sin(al) * ac2 + cos(al) * y2 AS gy,
              cos(al) * ac3 + sin(al) * y3 AS tx, -sin(al) * ac3 + cos(al) * y3 AS ty,
              sqrt(cos(b) * cos(b) + power(sin(b) * a / c, 2)) AS n1, cos(0.3::DOUBLE) * cos(0.5::DOUBLE) AS vx, cos(0.3::DOUBLE) * sin(0.5::DOUBLE) AS vy, sin(0.3::DOUBLE) AS vz FROM g3),
g5 AS (SELECT *, least(power(least(greatest(CASE WHEN seen THEN mu0 ELSE 0 END / 0.4, 0), 1), 2), 1) AS u1, least(power(least(greatest(CASE WHEN seen THEN mu2 ELSE 0 END / 0.4, 0), 1), 2), 1) AS u2,
              least(greatest((r0 - 36) / 8, 0), 1) AS u3, least(greatest((82 - r0) / 8, 0), 1) AS u4, greatest(6 * 2 * abs(sin(spin / 2)) * r0, 10) AS span,
              sqrt(greatest(r0 * r0 - power(rx * cos(b) / n1, 2), 0)) - a AS clear1, (rx * vx + ry * vy) / sqrt(vx * vx + vy * vy + power(vz * a / c, 2)) AS sunward FROM g4),
g6 AS (SELECT *, u1 * u1 * (3 - 2 * u1) * u2 * u2 * (3 - 2 * u2) AS blend, least(greatest((clear1 - 4) / span, 0), 1) AS u5,
              CASE WHEN sunward >= 0 THEN 1 ELSE least(greatest((sqrt(greatest(r0 * r0 - sunward * sunward, 0)) - a - 4) / span, 0), 1) END AS u6 FROM g5),
g7 AS (SELECT *, u3 * u3 * (3 - 2 * u3) * u4 * u4 * (3 - 2 * u4) * u5 * u5 * (3 - 2 * u5) * u6 * u6 * (3 - 2 * u6) AS share FROM g6)
SELECT ray, round(sx + CASE WHEN blend > 0 THEN blend * (gx - sx) ELSE 0 END + share * (tx - sx), 5) AS ref_x,
       round(sy + CASE WHEN blend > 0 THEN blend * (gy - sy) ELSE 0 END + share * (ty - sy), 5) AS ref_y,
       round(1 + CASE WHEN blend > 0 THEN blend * (power(greatest(mu2, 0.2) / greatest(mu0, 0.2), 0.8) - 1) ELSE 0 END, 5) AS gain FROM g7""")
def layered_motion_map(spark, folder):
    scene, zero = M.Scene(GLOBE, RINGS, limb_power=0.8), F.lit(0.0)
    place = MO.carried_places(scene, F.col("sx"), -F.col("sy"), F.col("t"), zero, (0.0, 0.0), M.Pose(900.0, 0.0, 0.0, 0.0))
    df = rays(spark, folder).withColumn("p", place)
    return df.select("ray", F.round("p.x", 5).alias("ref_x"), F.round(-F.col("p.y"), 5).alias("ref_y"), F.round("p.gain", 5).alias("gain"))


# Fixed-point steps of the inverse, with bilinear samples whose edges repeat.
_AT = """(1 - (py - y0)) * ((1 - (px - x0)) * {u}[y0 * 8 + x0 + 1] + (px - x0) * {u}[y0 * 8 + x0 + 2]) + (py - y0) * ((1 - (px - x0)) * {u}[y0 * 8 + x0 + 9] + (px - x0) * {u}[y0 * 8 + x0 + 10])"""


@query("field_inverse", "FLT-11 FLT-12 (fold guard, inverse of a displacement field)", f"""
WITH RECURSIVE f AS (SELECT label::BIGINT AS capture_id, vec_id AS frame_index, [v::DOUBLE * 1.5 FOR v IN embedding] AS ux, [v::DOUBLE * 1.2 FOR v IN list_reverse(embedding)] AS uy FROM embeddings),
px AS (SELECT frame_index, k, k % 8 AS x, k // 8 AS y, ux, uy FROM f, (SELECT unnest(range(64)) AS k)),
gr AS (SELECT frame_index, (ux[y * 8 + least(x + 1, 7) + 1] - ux[y * 8 + greatest(x - 1, 0) + 1]) / (least(x + 1, 7) - greatest(x - 1, 0)) AS xx,
              (ux[least(y + 1, 7) * 8 + x + 1] - ux[greatest(y - 1, 0) * 8 + x + 1]) / (least(y + 1, 7) - greatest(y - 1, 0)) AS xy,
              (uy[y * 8 + least(x + 1, 7) + 1] - uy[y * 8 + greatest(x - 1, 0) + 1]) / (least(x + 1, 7) - greatest(x - 1, 0)) AS yx,
              (uy[least(y + 1, 7) * 8 + x + 1] - uy[greatest(y - 1, 0) * 8 + x + 1]) / (least(y + 1, 7) - greatest(y - 1, 0)) AS yy FROM px),
jac AS (SELECT frame_index, min((1 + xx) * (1 + yy) - xy * yx) AS j FROM gr GROUP BY 1),
go AS (SELECT capture_id, frame_index, j, CASE WHEN j < 0.25 THEN [0.0::DOUBLE FOR v IN ux] ELSE ux END AS ux, CASE WHEN j < 0.25 THEN [0.0::DOUBLE FOR v IN uy] ELSE uy END AS uy
       FROM f JOIN jac USING (frame_index)),
st(frame_index, k, step, qx, qy) AS (
  SELECT frame_index, k, 0, (k % 8)::DOUBLE, (k // 8)::DOUBLE FROM go, (SELECT unnest(range(64)) AS k)
  UNION ALL
  SELECT frame_index, k, step + 1, k % 8 - ({_AT.format(u='ux')}), k // 8 - ({_AT.format(u='uy')})
  FROM (SELECT s.*, g.ux, g.uy, least(floor(least(greatest(qy, 0), 7)), 6)::INT AS y0, least(floor(least(greatest(qx, 0), 7)), 6)::INT AS x0,
               least(greatest(qy, 0), 7) AS py, least(greatest(qx, 0), 7) AS px FROM st s JOIN go g USING (frame_index)) WHERE step < 9),
er AS (SELECT frame_index, max(greatest(abs(a.qx - b.qx), abs(a.qy - b.qy))) AS residual, sum(a.qx) AS sx, sum(a.qy) AS sy
       FROM st a JOIN st b USING (frame_index, k) WHERE a.step = 8 AND b.step = 9 GROUP BY 1)
SELECT capture_id, frame_index, round(j, 6) AS least_jacobian, round(residual, 6) AS residual, round(CASE WHEN residual > 0.01 THEN 224 ELSE sx END, 5) AS sum_x,
       round(CASE WHEN residual > 0.01 THEN 224 ELSE sy END, 5) AS sum_y FROM go JOIN er USING (frame_index)""")
def field_inverse(spark, folder):
    ux = F.transform("pixels", lambda v: v.cast("double") * 1.5)
    uy = F.transform(F.reverse("pixels"), lambda v: v.cast("double") * 1.2)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 5)
    found = T.frames(spark, folder).select(KEY, "frame_index", MO.guarded_inverse(ux, uy, 8, 8).alias("f"))
    return found.select(KEY, "frame_index", F.round("f.least_jacobian", 6).alias("least_jacobian"), F.round("f.residual", 6).alias("residual"),
                        total(F.col("f.x")).alias("sum_x"), total(F.col("f.y")).alias("sum_y"))


@query("mid_exposure_error", "REG-18 (five moments of an exposure against its frozen middle)", f"""
WITH f AS ({T.FRAMES_SQL}), nodes AS (SELECT unnest([2.0, 6.0, 10.0, 14.0, 18.0])::DOUBLE AS s),
at0 AS (SELECT s, k, 4 + cos(-0.01 * s) * (k % 8 + 0.5 - 4) - sin(-0.01 * s) * (4 - (k // 8 + 0.5)) - 0.5 AS x,
               4 - (sin(-0.01 * s) * (k % 8 + 0.5 - 4) + cos(-0.01 * s) * (4 - (k // 8 + 0.5))) - 0.5 AS y FROM nodes, (SELECT unnest(range(64)) AS k)),
at1 AS (SELECT s, k, floor(y)::BIGINT + cy AS y, floor(x)::BIGINT + cx AS x, (CASE WHEN cy = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) *
               (CASE WHEN cx = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS part FROM at0, (SELECT unnest([0, 1]) AS cy), (SELECT unnest([0, 1]) AS cx)),
im AS (SELECT capture_id, frame_index, s, k, sum(CASE WHEN y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 THEN part * pixels[y * 8 + x + 1]::DOUBLE ELSE 0 END) AS v FROM f, at1 GROUP BY 1, 2, 3, 4),
mn AS (SELECT capture_id, frame_index, k, avg(v) AS mean, sum(v) FILTER (WHERE s = 10) AS mid FROM im GROUP BY 1, 2, 3)
SELECT capture_id, frame_index, round(sqrt(sum((mid - mean) * (mid - mean)) / sum(mean * mean)), 6) AS error FROM mn WHERE abs(mean) > 1e-12 GROUP BY 1, 2""")
def mid_exposure_error(spark, folder):
    ref = M.Pose(0.0, 0.0, 4.0, 4.0)
    return T.frames(spark, folder).select(KEY, "frame_index", F.round(MO.exposure_error(M.Scene(), ref, ref, 20.0, 0.01), 6).alias("error"))


@query("point_blended_stack", "REG-5 WIN-4 (each point's own best frames, blended by footprints)", PX_SQL + """
, t AS (SELECT o, exp(-0.5 * o * o / 2.25::DOUBLE) / (SELECT sum(exp(-0.5 * q * q / 2.25::DOUBLE)) FROM (SELECT unnest(range(-6, 7)) AS q)) AS w FROM (SELECT unnest(range(-6, 7)) AS o)),
m AS (SELECT i, least(greatest(i + o, 0), 7) AS j, sum(w) AS w FROM (SELECT unnest(range(8)) AS i), t GROUP BY 1, 2),
sm AS (SELECT q.capture_id, q.frame_index, a.i AS y, b.i AS x, sum(a.w * b.w * q.v) AS v FROM px q JOIN m a ON a.j = q.y JOIN m b ON b.j = q.x GROUP BY 1, 2, 3, 4),
lp AS (SELECT c.capture_id, c.frame_index, c.y, c.x, c.v, CASE WHEN c.y BETWEEN 1 AND 6 AND c.x BETWEEN 1 AND 6 THEN sum(n.v) - 5 * c.v ELSE 0 END AS l
       FROM sm c JOIN sm n ON n.frame_index = c.frame_index AND abs(n.y - c.y) + abs(n.x - c.x) <= 1 GROUP BY 1, 2, 3, 4, 5),
pt AS (SELECT * FROM (VALUES (0, 2, 2), (1, 2, 5), (2, 5, 2), (3, 5, 5)) p(point, cy, cx)),
sc AS (SELECT capture_id, frame_index, point, sum(g * l * l) / sum(g) / greatest(power(sum(g * v) / sum(g), 2), 1e-30) AS score
       FROM (SELECT *, exp(-0.5 * ((y - cy) * (y - cy) + (x - cx) * (x - cx)) / 4.0::DOUBLE) AS g FROM lp, pt) GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY capture_id, point ORDER BY score DESC, frame_index) <= 20 AS chosen FROM sc),
fp AS (SELECT point, k, exp(-0.5 * (power((k // 8 - cy) / 1.8::DOUBLE, 2) + power((k % 8 - cx) / 1.8::DOUBLE, 2))) AS g FROM pt, (SELECT unnest(range(64)) AS k)),
ft AS (SELECT k, sum(g) AS total, least(sum(g) / 0.5::DOUBLE, 1) AS cover FROM fp GROUP BY 1),
ws AS (SELECT r.capture_id, r.frame_index, p.k, sum(CASE WHEN chosen THEN p.g ELSE 0 END) * any_value(cover) / greatest(any_value(total), 1e-12)
              + (1 - any_value(cover)) * (CASE WHEN r.frame_index % 3 = 0 THEN 1 ELSE 0 END) AS w
       FROM rk r JOIN fp p USING (point) JOIN ft USING (k) GROUP BY 1, 2, 3)
SELECT capture_id, k::BIGINT AS pos, round(sum(w * q * v) / sum(w * q), 6) AS value, round(sum(w * q), 6) AS coverage
FROM ws JOIN (SELECT frame_index, y * 8 + x AS k, v, 1.0::DOUBLE + frame_index % 5 AS q FROM px) USING (frame_index, k) GROUP BY 1, 2 HAVING round(sum(w * q), 6) > 0""")
def point_blended_stack(spark, folder):
    frames = scored(spark, folder).withColumn("selected", F.col("frame_index") % 3 == 0)
    total = LO.blended_stack(frames, [(2, 2), (2, 5), (5, 2), (5, 5)], 8, 8, sigma=2.0, spacing=3.0, count=20, weight=F.lit(1.0) + F.col("frame_index") % 5)
    value, cover = F.round(F.col("sum_wv") / F.col("sum_w"), 6), F.round("sum_w", 6)
    return total.where(cover > 0).select(KEY, F.col("pos").cast("long").alias("pos"), value.alias("value"), cover.alias("coverage"))


@query("assumed_views_dropped", "SUP-9 (estimates that rest on an assumed view of rings)", """
WITH e AS (SELECT o_orderkey AS capture_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1e6::DOUBLE END AS latitude, o_custkey / 1e4::DOUBLE AS rate, o_totalprice / 1e7::DOUBLE AS field_rate,
           (o_custkey % 7)::DOUBLE AS pole, o_totalprice / 1e3::DOUBLE AS radius, 'estimated' AS status, o_orderstatus = 'O' AS assumed FROM orders)
SELECT capture_id, CASE WHEN NOT (assumed AND latitude IS NOT NULL) THEN latitude END AS latitude, CASE WHEN NOT (assumed AND latitude IS NOT NULL) THEN rate END AS rate,
       CASE WHEN NOT (assumed AND latitude IS NOT NULL) THEN field_rate END AS field_rate, CASE WHEN NOT (assumed AND latitude IS NOT NULL) THEN pole END AS pole, radius,
       CASE WHEN assumed AND latitude IS NOT NULL THEN 'unresolved' ELSE status END AS status FROM e""")
def assumed_views_dropped(spark, folder):
    price = F.col("o_totalprice")
    rows = T.load(spark, folder, "orders").select(
        F.col("o_orderkey").alias(KEY), F.when(F.col("o_orderkey") % 5 != 0, price / 1e6).alias("latitude"), (F.col("o_custkey") / 1e4).alias("rate"),
        (price / 1e7).alias("field_rate"), (F.col("o_custkey") % 7).cast("double").alias("pole"), (price / 1e3).alias("radius"), F.lit("estimated").alias("status"), "o_orderstatus")
    return MO.without_assumed_view(rows, F.col("o_orderstatus") == "O").drop("o_orderstatus")
