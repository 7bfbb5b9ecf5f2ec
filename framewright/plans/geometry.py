"""Globe, ring and field geometry evaluated for every line item or frame."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.functions.numeric import kolmogorov_psd, kolmogorov_structure, smoothstep, zernike_order
from framewright.operators import fits
from framewright.operators import screening
from framewright.plans.registry import query
from framewright.plans.screening import SCREENED
from framewright.sources import tables as T

GLOBE = G.Globe(radius=40.0, flattening=0.065, pole=0.3, latitude=0.35, longitude0=0.2, rate=1.76e-4, epoch=600.0)
RINGS = G.Rings(inner=48.0, outer=70.0, transmission=0.35, sun_longitude=0.5, sun_latitude=0.3)

RAYS = """
WITH ray AS (SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS ray, l_suppkey AS capture_id, (l_quantity - 25.5) * 2.2 AS sx, (l_partkey % 101 - 50) * 1.1::DOUBLE AS sy,
                    l_linenumber * 180.0::DOUBLE AS t, l_extendedprice AS light FROM lineitem),
k AS (SELECT 40.0::DOUBLE AS a, 40.0::DOUBLE * (1 - 0.065::DOUBLE) AS c, 0.3::DOUBLE + pi() / 2 AS al, 0.35::DOUBLE AS b),
q AS (SELECT ray.*, k.*, sin(b) * (cos(al) * sx - sin(al) * sy) AS qx, sin(al) * sx + cos(al) * sy AS qy, -cos(b) * (cos(al) * sx - sin(al) * sy) AS qz,
             0.2::DOUBLE + 1.76e-4::DOUBLE * (t - 600) AS turn FROM ray, k),
s AS (SELECT *, cos(b) * cos(b) / (a * a) + sin(b) * sin(b) / (c * c) AS aa, 2 * (qx * cos(b) / (a * a) + qz * sin(b) / (c * c)) AS bb,
             (qx * qx + qy * qy) / (a * a) + qz * qz / (c * c) - 1 AS cc FROM q),
h AS (SELECT *, CASE WHEN bb * bb - 4 * aa * cc >= 0 THEN (-bb + sqrt(greatest(bb * bb - 4 * aa * cc, 0))) / (2 * aa) END AS d0 FROM s),
g AS (SELECT *, qx + d0 * cos(b) AS xb, qz + d0 * sin(b) AS zb FROM h),
m AS (SELECT *, xb * cos(b) / (a * a) + zb * sin(b) / (c * c) AS nz FROM g),
hit AS (SELECT *, coalesce(nz >= -1e-12, false) AS on_globe, greatest(nz / sqrt((xb * xb + qy * qy) / (a * a * a * a) + zb * zb / (c * c * c * c)), 0) AS mu0,
               atan2(sin(turn) * xb + cos(turn) * qy, cos(turn) * xb - sin(turn) * qy) AS lon0, atan2(zb / c, sqrt(xb * xb + qy * qy) / a) AS lat0 FROM m),
ringed AS (SELECT *, -(-cos(al) * cos(b) * sx + sin(al) * cos(b) * sy) / sin(b) AS rt FROM hit),
rr AS (SELECT *, sin(b) * (cos(al) * sx - sin(al) * sy) + cos(b) * rt AS rx, qy AS ry FROM ringed),
ring AS (SELECT *, sqrt(rx * rx + ry * ry) BETWEEN 48 AND 70 AS on_ring, sqrt(rx * rx + ry * ry) AS r0 FROM rr),
lay AS (SELECT *, CASE WHEN on_ring AND rt >= 0 THEN 'near_ring' WHEN on_globe THEN 'globe' WHEN on_ring THEN 'far_ring' ELSE 'background' END AS layer FROM ring)
"""


def rays(spark, folder):
    return T.load(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ray"), F.col("l_suppkey").alias("capture_id"),
        ((F.col("l_quantity") - 25.5) * 2.2).alias("sx"), ((F.col("l_partkey") % 101 - 50) * 1.1).alias("sy"),
        (F.col("l_linenumber") * 180.0).alias("t"), F.col("l_extendedprice").alias("light"))


def hits(spark, folder):
    return G.with_globe_hit(rays(spark, folder), GLOBE, "sx", "sy", "t")


def _r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


@query("globe_hits", "PRJ-18 SUP-5 SUP-4", RAYS + """
SELECT ray, on_globe, round(CASE WHEN on_globe THEN lon0 END, 6) AS lon, round(CASE WHEN on_globe THEN lat0 END, 6) AS lat,
       round(CASE WHEN on_globe THEN mu0 ELSE 0 END, 6) AS mu, round(CASE WHEN on_globe THEN d0 END, 6) AS depth FROM hit""")
def globe_hits(spark, folder):
    return hits(spark, folder).select("ray", "on_globe", *_r("lon", "lat", "mu", "depth"))


@query("globe_round_trip", "PRJ-18 (body to sky)", RAYS + """
SELECT ray, round(sx, 5) AS sx, round(sy, 5) AS sy, round(mu0, 5) AS mu FROM hit WHERE on_globe""")
def globe_round_trip(spark, folder):
    on = hits(spark, folder).where("on_globe")
    sx, sy, mu = G.body_to_sky(GLOBE, F.col("lon"), F.col("lat"), F.col("t"))
    return on.select("ray", F.round(sx, 5).alias("sx"), F.round(sy, 5).alias("sy"), F.round(mu, 5).alias("mu"))


@query("ring_hits", "PRJ-19", RAYS + """
SELECT ray, on_ring, round(CASE WHEN on_ring THEN r0 END, 6) AS ring_radius, round(CASE WHEN on_ring THEN atan2(ry, rx) END, 6) AS ring_azimuth,
       round(CASE WHEN on_ring THEN rt END, 6) AS ring_depth FROM ring""")
def ring_hits(spark, folder):
    return G.with_ring_hit(rays(spark, folder), GLOBE, RINGS, "sx", "sy").select(
        "ray", "on_ring", *_r("ring_radius", "ring_azimuth", "ring_depth"))


def layered(spark, folder):
    df = G.with_ring_hit(hits(spark, folder), GLOBE, RINGS, "sx", "sy").withColumn("layer", G.layer())
    return G.with_shadows(df, GLOBE, RINGS, "sx", "sy")


SHADOWS = RAYS + """
, sun AS (SELECT cos(0.3::DOUBLE) * cos(0.5::DOUBLE) AS ux, cos(0.3::DOUBLE) * sin(0.5::DOUBLE) AS uy, sin(0.3::DOUBLE) AS uz),
z AS (SELECT lay.*, sun.*, -cos(b) * (cos(al) * sx - sin(al) * sy) + sin(b) * rt AS rz, sin(b) * (cos(al) * sx - sin(al) * sy) + cos(b) * d0 AS gx,
             -cos(b) * (cos(al) * sx - sin(al) * sy) + sin(b) * d0 AS gz FROM lay, sun),
y AS (SELECT *, (ux * ux + uy * uy) / (a * a) + uz * uz / (c * c) AS sa, 2 * ((rx * ux + ry * uy) / (a * a) + rz * uz / (c * c)) AS sb,
             (rx * rx + ry * ry) / (a * a) + rz * rz / (c * c) - 1 AS sc, -gz / uz AS u FROM z),
sh AS (SELECT *, coalesce(on_ring AND sb * sb - 4 * sa * sc >= 0 AND (-sb + sqrt(greatest(sb * sb - 4 * sa * sc, 0))) / (2 * sa) > 1e-4, false) AS globe_shadow,
              coalesce(on_globe AND u > 1e-4 AND sqrt((gx + u * ux) * (gx + u * ux) + (qy + u * uy) * (qy + u * uy)) BETWEEN 48 AND 70, false) AS ring_shadow FROM y)
"""


@query("scene_layers", "PRJ-20 PRJ-19 SUP-6", SHADOWS + "SELECT ray, layer, globe_shadow, ring_shadow FROM sh")
def scene_layers(spark, folder):
    return layered(spark, folder).select("ray", "layer", "globe_shadow", "ring_shadow")


@query("scene_regions", "PRJ-20 FLT-16 AGG-5", SHADOWS + """
, mo AS (SELECT *, sqrt(power(sx + 50 - (20 + 0.01 * (t - 600)), 2) + power(50 - sy - (30 - 0.005 * (t - 600)), 2)) <= 6 AS moon FROM sh)
SELECT CASE WHEN moon THEN -1 WHEN on_globe THEN CASE WHEN ring_shadow THEN 3 ELSE 1 END WHEN layer IN ('near_ring', 'far_ring') THEN CASE WHEN globe_shadow THEN 4 ELSE 2 END ELSE 0 END::BIGINT AS region,
       count(*) AS samples, round(sum(light), 2) AS light FROM mo GROUP BY 1""")
def scene_regions(spark, folder):
    fifty = F.lit(50.0)
    moon = G.moon_hit(F.col("sx") + 50, 50 - F.col("sy"), 20.0, 30.0, 6.0, 0.01, -0.005, F.col("t"), 600.0, fifty, fifty, F.lit(0.0))
    df = layered(spark, folder).withColumn("moon", moon)
    region = G.region(F.col("moon"), G.edge_on_band(GLOBE, RINGS, F.col("sx"), F.col("sy")))
    return df.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("light"), 2).alias("light"))


@query("edge_on_rings", "PRJ-19 (edge-on)", RAYS + """
SELECT count(*) FILTER (WHERE abs(-cos(0.3::DOUBLE + pi() / 2) * cos(0.01::DOUBLE) * sx + sin(0.3::DOUBLE + pi() / 2) * cos(0.01::DOUBLE) * sy) <= 70 * sin(0.01::DOUBLE) + 0.5
       AND sqrt(sx * sx + sy * sy) <= 70.5) AS band, 0::BIGINT AS on_ring, round(exp(ln(0.35::DOUBLE) / 0.04), 9) AS transmission FROM ray""")
def edge_on_rings(spark, folder):
    flat = G.Globe(radius=40.0, pole=0.3, latitude=0.01)
    df = G.with_ring_hit(rays(spark, folder), flat, RINGS, "sx", "sy")
    return df.agg(F.count_if(G.edge_on_band(flat, RINGS, F.col("sx"), F.col("sy"))).alias("band"), F.count_if("on_ring").alias("on_ring"),
                  F.round(F.lit(RINGS.line_of_sight(flat)), 9).alias("transmission"))


@query("field_rotation", "PRJ-17 PRJ-21", RAYS + """
SELECT ray, round(10 + cos(0.4::DOUBLE - 1e-4 * t) * (sx - 3) - sin(0.4::DOUBLE - 1e-4 * t) * (4 - sy), 6) AS ref_x,
       round(20 - (sin(0.4::DOUBLE - 1e-4 * t) * (sx - 3) + cos(0.4::DOUBLE - 1e-4 * t) * (4 - sy)), 6) AS ref_y FROM ray""")
def field_rotation(spark, folder):
    src = {"cx": F.lit(3.0), "cy": F.lit(4.0), "angle": F.col("t") * 1e-4}
    ref = {"cx": F.lit(10.0), "cy": F.lit(20.0), "angle": F.lit(0.4)}
    x, y = G.field_map(F.col("sx"), F.col("sy"), src, ref)
    return rays(spark, folder).select("ray", F.round(x, 6).alias("ref_x"), F.round(y, 6).alias("ref_y"))


@query("globe_motion_map", "PRJ-21 PRJ-22 UDF-3", RAYS + """
, b2 AS (SELECT *, lon0 - (0.2::DOUBLE + 1.76e-4::DOUBLE * (900 - 600)) AS rel FROM hit),
b3 AS (SELECT *, a * cos(lat0) * cos(rel) AS px, a * cos(lat0) * sin(rel) AS py, c * sin(lat0) AS pz FROM b2),
b4 AS (SELECT *, cos(al) * (sin(b) * px - cos(b) * pz) + sin(al) * py AS gx, -sin(al) * (sin(b) * px - cos(b) * pz) + cos(al) * py AS gy,
              (px * cos(b) / (a * a) + pz * sin(b) / (c * c)) / sqrt((px * px + py * py) / (a * a * a * a) + pz * pz / (c * c * c * c)) AS mu2 FROM b3),
b5 AS (SELECT *, coalesce(on_globe AND mu2 >= -1e-12, false) AS use FROM b4)
SELECT ray, round(CASE WHEN use THEN gx ELSE sx END, 5) AS ref_x, round(-CASE WHEN use THEN gy ELSE sy END, 5) AS ref_y, NOT on_globe OR use AS valid,
       round(CASE WHEN use THEN power(greatest(mu2, 0.2) / greatest(mu0, 0.2), 0.8) ELSE 1 END, 5) AS gain FROM b5""")
def globe_motion_map(spark, folder):
    zero = F.lit(0.0)
    src = {"cx": zero, "cy": zero, "angle": zero, "t": F.col("t")}
    ref = {"cx": zero, "cy": zero, "angle": zero, "t": F.lit(900.0)}
    df = G.with_globe_map(rays(spark, folder).withColumn("dy", -F.col("sy")), GLOBE, "sx", "dy", src, ref, ld_power=0.8)
    return df.select("ray", *_r("ref_x", "ref_y", digits=5), "valid", F.round("gain", 5).alias("gain"))


@query("globe_backprojection", "AGG-1 PRJ-14 PRJ-21 SUP-1 (geometry stack)", RAYS + """
, b2 AS (SELECT *, lon0 - (0.2::DOUBLE + 1.76e-4::DOUBLE * (900 - 600)) AS rel FROM hit),
b3 AS (SELECT *, a * cos(lat0) * cos(rel) AS px, a * cos(lat0) * sin(rel) AS py, c * sin(lat0) AS pz FROM b2),
b4 AS (SELECT *, cos(al) * (sin(b) * px - cos(b) * pz) + sin(al) * py AS gx, -sin(al) * (sin(b) * px - cos(b) * pz) + cos(al) * py AS gy,
              (px * cos(b) / (a * a) + pz * sin(b) / (c * c)) / sqrt((px * px + py * py) / (a * a * a * a) + pz * pz / (c * c * c * c)) AS mu2 FROM b3),
b5 AS (SELECT light, coalesce(on_globe AND mu2 >= -1e-12, false) AS use, on_globe, gx, gy, sx, sy FROM b4),
b6 AS (SELECT light, 70 + CASE WHEN use THEN gx ELSE sx END AS x, 70 - CASE WHEN use THEN gy ELSE sy END AS y FROM b5 WHERE NOT on_globe OR use),
b7 AS (SELECT light, floor(y)::BIGINT + cy AS y, floor(x)::BIGINT + cx AS x, (CASE WHEN cy = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) *
              (CASE WHEN cx = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS wt FROM b6, (SELECT unnest([0, 1]) AS cy), (SELECT unnest([0, 1]) AS cx))
SELECT y // 10 AS y, x // 10 AS x, round(sum(wt * light) / sum(wt), 3) AS value, round(sum(wt), 4) AS coverage
FROM b7 WHERE y BETWEEN 0 AND 139 AND x BETWEEN 0 AND 139 AND wt > 0 GROUP BY 1, 2""")
def globe_backprojection(spark, folder):
    from framewright.operators.pixels import scatter

    seventy = F.lit(70.0)
    src = {"cx": F.lit(0.0), "cy": F.lit(0.0), "angle": F.lit(0.0), "t": F.col("t")}
    ref = {"cx": seventy, "cy": seventy, "angle": F.lit(0.0), "t": F.lit(900.0)}
    df = G.with_globe_map(rays(spark, folder).withColumn("dy", -F.col("sy")), GLOBE, "sx", "dy", src, ref)
    # Invalid samples get no weight: a filter would be pushed below the map and repeat its expressions.
    used = F.when(F.col("valid"), F.lit(1.0)).otherwise(F.lit(0.0))
    pixels = scatter(df.withColumn("all", F.lit(1)), ["all"], F.col("ref_y"), F.col("ref_x"), F.col("light"), 140, 140,
                     used).where("sum_w > 0")
    blocks = pixels.groupBy(F.floor(F.col("y") / 10).cast("long").alias("y"), F.floor(F.col("x") / 10).cast("long").alias("x")).agg(
        F.sum("sum_wv").alias("wv"), F.sum("sum_w").alias("w"))
    return blocks.select("y", "x", F.round(F.col("wv") / F.col("w"), 3).alias("value"), F.round("w", 4).alias("coverage"))


@query("limb_slope", "AGG-27 JN-10 WIN-14", RAYS + """
, u AS (SELECT capture_id, floor(lat0 / radians(10))::BIGINT AS band, ln(mu0) AS lx, ln(light * power(mu0, 0.6)) AS ly FROM hit WHERE on_globe AND mu0 >= 0.5 AND light > 0),
n AS (SELECT *, count(*) OVER (PARTITION BY capture_id, band) AS nb, lx - avg(lx) OVER (PARTITION BY capture_id, band) AS dx, ly - avg(ly) OVER (PARTITION BY capture_id, band) AS dy FROM u),
f AS (SELECT capture_id, count(*) AS pixels, sum(dx * dy) / sum(dx * dx) AS p0, sum(dx * dx) AS sxx FROM n WHERE nb >= 5 GROUP BY 1),
e AS (SELECT capture_id, any_value(p0) AS p, sqrt(avg((dy - p0 * dx) * (dy - p0 * dx))) AS rms FROM n JOIN f USING (capture_id) WHERE nb >= 5 GROUP BY 1)
SELECT capture_id, pixels, CASE WHEN pixels >= 50 THEN round(least(greatest(p0, 0), 3), 6) ELSE 0 END AS power, CASE WHEN pixels >= 50 THEN round(rms, 6) END AS rms,
       CASE WHEN pixels >= 50 THEN 'fitted' ELSE 'unmeasured' END AS origin FROM f JOIN e USING (capture_id)""")
def limb_slope(spark, folder):
    df = hits(spark, folder)
    mu = F.when(F.col("on_globe") & (F.col("mu") >= 0.5) & (F.col("light") > 0), F.col("mu"))
    band = F.floor(F.col("lat") / math.radians(10)).cast("long")
    out = fits.banded_slope(df, ["capture_id"], band, F.ln(mu), F.ln(F.col("light") * F.pow(mu, F.lit(0.6))), min_band=5, min_total=50)
    return out.select("capture_id", "pixels", *_r("power", "rms"), "origin")


@query("flattening", "AGG-24", SCREENED + """
, r AS (SELECT capture_id, (height_px / 40 + 0.9) AS ratio FROM screened WHERE accepted),
q AS (SELECT capture_id, count(*) AS n_frames, median(ratio) AS axis_ratio FROM r GROUP BY 1),
d AS (SELECT capture_id, any_value(n_frames) AS n_frames, any_value(axis_ratio) AS ar, 1.4826 * median(abs(ratio - axis_ratio)) AS sc FROM r JOIN q USING (capture_id) GROUP BY 1),
p AS (SELECT *, (power(least(ar * 0.75, 1), 2) - power(sin(0.2::DOUBLE), 2)) / power(cos(0.2::DOUBLE), 2) AS p2 FROM d)
SELECT capture_id, n_frames, round(ar * 0.75, 6) AS axis_ratio, round(sc * 0.75, 6) AS scatter,
       CASE WHEN n_frames < 12 OR ar * 0.75 < 0.75 OR ar * 0.75 > 1.02 OR sc * 0.75 > 0.03 OR p2 <= 0 THEN 'unresolved' ELSE 'estimated' END AS status FROM p""")
def flattening(spark, folder):
    screened = screening.screen(T.measurements(spark, folder)).where("accepted")
    shaped = screened.withColumn("height_px", (F.col("height_px") / 40 + 0.9) * 0.75).withColumn("width_px", F.lit(1.0))
    out = fits.flattening(shaped, ["capture_id"], latitude_rad=0.2)
    return out.select("capture_id", "n_frames", *_r("axis_ratio", "scatter"), "status")


@query("flattening_apparent", "AGG-24 (unknown latitude)", """
WITH r AS (SELECT l_suppkey AS capture_id, 0.93 + l_tax / 10 AS ratio FROM lineitem), q AS (SELECT capture_id, count(*) AS n, median(ratio) AS m FROM r GROUP BY 1),
d AS (SELECT capture_id, any_value(n) AS n, any_value(m) AS m, 1.4826 * median(abs(ratio - m)) AS sc FROM r JOIN q USING (capture_id) GROUP BY 1)
SELECT capture_id, n AS n_frames, round(m, 6) AS axis_ratio, round(sc, 6) AS scatter, 'apparent' AS status, round(1 - m, 6) AS flattening FROM d""")
def flattening_apparent(spark, folder):
    rows = T.load(spark, folder, "lineitem").select(F.col("l_suppkey").alias("capture_id"), F.lit(1.0).alias("width_px"),
                                                    (0.93 + F.col("l_tax") / 10).alias("height_px"))
    out = fits.flattening(rows, ["capture_id"])
    return out.select("capture_id", "n_frames", *_r("axis_ratio", "scatter"), "status", F.round("flattening", 6).alias("flattening"))


@query("field_rate", "AGG-26", """
WITH d AS (SELECT o_custkey AS capture_id, (epoch(o_orderdate) - 8e8::DOUBLE) / 86400 AS t, o_totalprice / 1e6::DOUBLE + (o_custkey % 3) * (epoch(o_orderdate) - 8e8::DOUBLE) / 86400 * 1e-3 AS a FROM orders),
f AS (SELECT capture_id, count(*) AS n, regr_slope(a, t) AS slope, regr_syy(a, t) AS syy, regr_sxy(a, t) AS sxy, regr_sxx(a, t) AS sxx FROM d GROUP BY 1)
SELECT capture_id, n AS samples, round(slope, 9) AS slope, CASE WHEN n >= 3 THEN round(sqrt(greatest(syy - slope * sxy, 0) / (n - 2) / sxx), 9) END AS standard_error FROM f""")
def field_rate(spark, folder):
    t = (T.micros("o_orderdate") / 1e6 - 8e8) / 86400
    rows = T.load(spark, folder, "orders").select(F.col("o_custkey").alias("capture_id"), t.alias("t"),
                                                  (F.col("o_totalprice") / 1e6 + (F.col("o_custkey") % 3) * t * 1e-3).alias("a"))
    return fits.significant_slope(rows, ["capture_id"], "t", "a").select("capture_id", "samples", *_r("slope", "standard_error", digits=9))


@query("field_rate_applied", "AGG-26 (significance)", f"""
WITH d AS (SELECT o_custkey AS capture_id, (epoch(o_orderdate) - 8e8::DOUBLE) / 86400 AS t, o_totalprice / 1e6::DOUBLE + (o_custkey % 3) * (epoch(o_orderdate) - 8e8::DOUBLE) / 86400 * 1e-3 AS a FROM orders),
f AS (SELECT capture_id, count(*) AS n, regr_slope(a, t) AS slope, regr_syy(a, t) AS syy, regr_sxy(a, t) AS sxy, regr_sxx(a, t) AS sxx FROM d GROUP BY 1),
q AS (SELECT unnest(range(1, 31)) AS dof, unnest({list(fits.STUDENT_975)}::DOUBLE[]) AS quantile),
e AS (SELECT f.*, CASE WHEN n >= 3 THEN quantile * sqrt(greatest(syy - slope * sxy, 0) / (n - 2) / sxx) END AS threshold FROM f LEFT JOIN q ON dof = n - 2)
SELECT capture_id, round(threshold, 9) AS threshold, round(CASE WHEN n >= 3 AND abs(slope) <= threshold THEN 0 ELSE slope END, 9) AS rate FROM e""")
def field_rate_applied(spark, folder):
    t = (T.micros("o_orderdate") / 1e6 - 8e8) / 86400
    rows = T.load(spark, folder, "orders").select(F.col("o_custkey").alias("capture_id"), t.alias("t"),
                                                  (F.col("o_totalprice") / 1e6 + (F.col("o_custkey") % 3) * t * 1e-3).alias("a"))
    return fits.significant_slope(rows, ["capture_id"], "t", "a").select("capture_id", *_r("threshold", "rate", digits=9))


@query("silhouette_axis", "AGG-28", """
SELECT capture_id, round(atan2(avg(sin(2 * a)), avg(cos(2 * a))) / 2, 6) AS axis_rad, round(sqrt(power(avg(sin(2 * a)), 2) + power(avg(cos(2 * a)), 2)), 6) AS coherence
FROM (SELECT l_suppkey AS capture_id, 0.4::DOUBLE + (l_quantity - 25) * 0.01::DOUBLE AS a FROM lineitem) GROUP BY 1""")
def silhouette_axis(spark, folder):
    rows = T.load(spark, folder, "lineitem").select(F.col("l_suppkey").alias("capture_id"), (0.4 + (F.col("l_quantity") - 25) * 0.01).alias("a"))
    return fits.axis_mean(rows, ["capture_id"], "a").select("capture_id", *_r("axis_rad", "coherence"))


@query("ring_turn_and_taper", "SUP-8 FN-17", RAYS + """
, w AS (SELECT ray, t, least(greatest(power(least(greatest(mu0 / 0.3, 0), 1), 2), 0), 1) AS u, on_globe FROM hit)
SELECT ray, round(2 * abs(sin(1.76e-4::DOUBLE * (t - 900) / 2)), 9) AS chord, round(CASE WHEN on_globe THEN u * u * (3 - 2 * u) ELSE 0 END, 6) AS taper FROM w""")
def ring_turn_and_taper(spark, folder):
    return hits(spark, folder).select("ray", F.round(G.ring_turn_chord(GLOBE, F.col("t"), F.lit(900.0)), 9).alias("chord"),
                                      F.round(G.limb_taper(F.col("mu"), 0.3), 6).alias("taper"))


@query("turbulence_models", "FN-18 FN-17", """
SELECT p_partkey AS part, round(0.023 * power(0.1::DOUBLE, -5.0 / 3) * power(sqrt(power(p_size * 0.5::DOUBLE, 2) + power(p_retailprice / 100, 2)), -11.0::DOUBLE / 3), 9) AS psd,
       round(6.88 * power(p_size / 0.1::DOUBLE, 5.0::DOUBLE / 3), 4) AS structure, round(power(least(p_size / 40.0::DOUBLE, 1), 2) * (3 - 2 * least(p_size / 40.0::DOUBLE, 1)), 8) AS step FROM part""")
def turbulence_models(spark, folder):
    size = F.col("p_size").cast("double")
    return T.load(spark, folder, "part").select(
        F.col("p_partkey").alias("part"), F.round(kolmogorov_psd(size * 0.5, F.col("p_retailprice") / 100, 0.1), 9).alias("psd"),
        F.round(kolmogorov_structure(size, 0.1), 4).alias("structure"), F.round(smoothstep(size / 40), 8).alias("step"))


@query("zernike_orders", "FN-16", """
WITH n AS (SELECT unnest(range(0, 80)) AS n), m AS (SELECT n, unnest(range(n % 2, n + 1, 2)) AS am FROM n),
e AS (SELECT n, am, CASE WHEN am = 0 THEN 1 ELSE 2 END AS c FROM m),
s AS (SELECT n, am, c, sum(c) OVER (ORDER BY n, am) - c + 1 AS first FROM e),
j AS (SELECT n, am, first AS j FROM s UNION ALL SELECT n, am, first + 1 FROM s WHERE c = 2)
SELECT p_partkey AS part, n, CASE WHEN am = 0 THEN 0 WHEN j % 2 = 0 THEN am ELSE -am END AS m FROM part JOIN j ON j.j = p_partkey % 3000 + 1""")
def zernike_orders(spark, folder):
    j = F.col("p_partkey") % 3000 + 1
    n, m = zernike_order(j)
    return T.load(spark, folder, "part").select(F.col("p_partkey").alias("part"), n.alias("n"), m.alias("m"))
