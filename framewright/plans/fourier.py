"""Registration, frequency rings and frequency-space estimators over 8x8 frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions import kernels as K
from framewright.operators import fourier as FO
from framewright.operators import frames as FR
from framewright.operators import local as LO
from framewright.operators import selection as SEL
from framewright.operators import stacking as ST
from framewright.plans.frames import BINNED, PX_SQL, SCORE_SQL, binned_frames, scored
from framewright.plans.registry import query
from framewright.session import materialise
from framewright.sources import tables as T

KEY = "capture_id"
WINDOW = np.outer(np.hanning(10)[1:-1], np.hanning(10)[1:-1])

DFT = PX_SQL + """
, dft AS (SELECT capture_id, frame_index, f, sum(v * cos(2 * pi() * ((f // 8) * y + (f % 8) * x) / 8)) AS re,
                 -sum(v * sin(2 * pi() * ((f // 8) * y + (f % 8) * x) / 8)) AS im FROM px, (SELECT unnest(range(64)) AS f) GROUP BY 1, 2, 3),
fq AS (SELECT f, CASE WHEN f // 8 < 4 THEN f // 8 ELSE f // 8 - 8 END / 8.0::DOUBLE AS fy, CASE WHEN f % 8 < 4 THEN f % 8 ELSE f % 8 - 8 END / 8.0::DOUBLE AS fx
       FROM (SELECT unnest(range(64)) AS f))
"""


def with_spectrum(frames, pixels="pixels", prefix=""):
    return frames.withColumn("_s", FO.spectrum(F.col(pixels), 8, 8)).withColumns(
        {f"{prefix}re": F.col("_s.re"), f"{prefix}im": F.col("_s.im")}).drop("_s")


@query("ring_power", "PRJ-26 PRJ-27 FN-18", DFT + """
, pos AS (SELECT f, least(sqrt(fy * fy + fx * fx), 0.5) / 0.01 AS p FROM fq),
w AS (SELECT f, least(floor(p + 1e-9), 50)::BIGINT AS band, power(cos(0.5 * pi() * greatest(p - floor(p + 1e-9), 0)), 2) AS w FROM pos
      UNION ALL SELECT f, floor(p + 1e-9)::BIGINT + 1, power(sin(0.5 * pi() * greatest(p - floor(p + 1e-9), 0)), 2) FROM pos)
SELECT capture_id, band, round(sum(w * (re * re + im * im)), 6) AS power FROM dft JOIN w USING (f) WHERE band <= 50 AND w > 1e-9 GROUP BY 1, 2""")
def ring_power(spark, folder):
    filters = K.ring_filters(8, 8).reshape(FO.RINGS, -1)
    shares = [F.struct(F.lit(int(b)).cast("long").alias("band"), F.lit(int(f)).alias("f"), F.lit(float(filters[b, f])).alias("w"))
              for b, f in zip(*np.nonzero(filters > 1e-9))]
    power = F.transform(F.arrays_zip("re", "im"), lambda c: c["re"] * c["re"] + c["im"] * c["im"])
    total = ST.stack(with_spectrum(T.frames(spark, folder)), [KEY], power, F.lit(1.0))
    cells = total.select(KEY, "pos", "sum_wv", F.inline(F.array(*shares))).where("f = pos")
    return cells.groupBy(KEY, "band").agg(F.round(F.sum(F.col("w") * F.col("sum_wv")), 6).alias("power"))


WIENER = DFT + """
, n AS (SELECT frame_index, avg(greatest(v, 0)) + 0.01::DOUBLE AS s2 FROM px GROUP BY 1),
h AS (SELECT capture_id, frame_index, f, re, im, s2, exp(-(1 + frame_index % 4) * (fy * fy + fx * fx) * 2) AS h FROM dft JOIN fq USING (f) JOIN n USING (frame_index)),
s AS (SELECT capture_id, f, sum(h * re / s2) AS nr, sum(h * im / s2) AS ni, sum(h * h / s2) AS p FROM h GROUP BY 1, 2)
"""


def transfers(spark, folder):
    fy, fx = np.fft.fftfreq(8)[:, None], np.fft.fftfreq(8)[None, :]
    radius2 = F.array(*[F.lit(float(v)) for v in (fy**2 + fx**2).ravel()])
    frames = with_spectrum(T.frames(spark, folder), prefix="i_")
    return frames.withColumn("h_re", F.transform(radius2, lambda r: F.exp(-(1 + F.col("frame_index") % 4) * r * 2))).withColumn(
        "h_im", F.transform(radius2, lambda r: r * 0)).withColumn("sigma2", FO.noise_variance(F.col("pixels"), read_rms=0.1))


@query("noise_variance", "AGG-16", PX_SQL + """
SELECT capture_id, frame_index, round(avg(greatest(v, 0)) + 4, 8) AS sigma2 FROM px GROUP BY 1, 2""")
def noise_variance(spark, folder):
    return T.frames(spark, folder).select(KEY, "frame_index", F.round(FO.noise_variance(F.col("pixels")), 8).alias("sigma2"))


@query("wiener_sums", "AGG-14 AGG-15", WIENER + "SELECT capture_id, f AS pos, round(nr, 6) AS num_re, round(ni, 6) + 0.0 AS num_im, round(p, 6) AS power FROM s")
def wiener_sums(spark, folder):
    sums = FO.wiener_sums(transfers(spark, folder), [KEY])
    return sums.select(KEY, F.col("pos").cast("long").alias("pos"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("num_re", "num_im", "power")])


@query("wiener_estimate", "NUM-3 NUM-4", WIENER + """
SELECT capture_id, k AS pos, round(sum((nr * cos(2 * pi() * ((f // 8) * (k // 8) + (f % 8) * (k % 8)) / 8) - ni * sin(2 * pi() * ((f // 8) * (k // 8) + (f % 8) * (k % 8)) / 8)) / (p + 0.03)) / 64, 6) + 0.0 AS value
FROM s, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2""")
def wiener_estimate(spark, folder):
    image = FO.wiener_estimate(FO.wiener_sums(transfers(spark, folder), [KEY]), [KEY], 0.03, 8, 8)
    return image.select(KEY, F.posexplode("pixels").alias("pos", "value")).select(
        KEY, F.col("pos").cast("long").alias("pos"), (F.round("value", 6) + 0.0).alias("value"))


@query("constrained_estimate", "NUM-5 NUM-6 SUP-21 (non-negative, band-limited)")
def constrained_estimate(spark, folder):
    support = np.hypot(np.fft.fftfreq(8)[:, None], np.fft.fftfreq(8)[None, :]) <= 0.5
    image = FO.constrained_estimate(FO.wiener_sums(transfers(spark, folder), [KEY]), [KEY], 0.03, support, iterations=64)
    return image.select(KEY, F.posexplode("pixels").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("data_residual", "AGG-17 NUM-11", WIENER + """
, o AS (SELECT capture_id, f, nr / (p + 0.03) AS orr, ni / (p + 0.03) AS oi FROM s)
SELECT h.capture_id, count(DISTINCT frame_index) AS frames, round(sum(((h.h * orr - h.re) * (h.h * orr - h.re) + (h.h * oi - h.im) * (h.h * oi - h.im)) / s2) / 64 / count(DISTINCT frame_index), 6) AS residual
FROM h JOIN o ON h.capture_id = o.capture_id AND h.f = o.f GROUP BY 1""")
def data_residual(spark, folder):
    frames = transfers(spark, folder)
    image = FO.wiener_estimate(FO.wiener_sums(frames, [KEY]), [KEY], 0.03, 8, 8)
    model = materialise(with_spectrum(image, prefix="o_").drop("pixels"), "estimate")
    return LO.data_residual(frames.join(model, KEY), [KEY]).withColumn("residual", F.round("residual", 6))


EH_MASK = [float(np.clip(1 - r, 0, 1) ** 2) if C.HIGH_BAND[0] <= r <= C.HIGH_BAND[1] and 1 - r >= C.HIGH_BAND_MTF_MIN else 0.0
           for r in (np.hypot(np.fft.fftfreq(8)[:, None], np.fft.fftfreq(8)[None, :]) / 0.5).ravel()]


@query("high_band_error", "AGG-22 PRJ-27 SUP-23", DFT + """
, b AS (SELECT capture_id, f, avg(re) AS br, avg(im) AS bi FROM dft GROUP BY 1, 2),
m AS (SELECT f, CASE WHEN r >= 0.5 AND r <= 1 AND 1 - r >= 0.05 THEN (1 - r) * (1 - r) ELSE 0 END AS w FROM (SELECT f, sqrt(fy * fy + fx * fx) / 0.5 AS r FROM fq))
SELECT dft.capture_id, round(sum(w * ((re - br) * (re - br) + (im - bi) * (im - bi))) / sum(w * (br * br + bi * bi)), 5) AS e_h
FROM dft JOIN b ON dft.capture_id = b.capture_id AND dft.f = b.f JOIN m ON m.f = dft.f GROUP BY 1""")
def high_band_error(spark, folder):
    frames = T.frames(spark, folder)
    mean = ST.planes_of(ST.normalise(ST.stack(frames, [KEY], F.col("pixels"), F.lit(1.0))), [KEY])
    truth = materialise(with_spectrum(mean, prefix="b_").drop("pixels"), "truth-spectrum")
    return FO.relative_high_band(with_spectrum(frames, prefix="a_").join(truth, KEY), [KEY], EH_MASK).withColumn("e_h", F.round("e_h", 5))


@query("band_powers", "AGG-22 (R_H) PRJ-27 PRJ-12", DFT + """
SELECT capture_id, frame_index, round(sum(re * re + im * im), 6) AS total, round(sum(CASE WHEN r BETWEEN 0.5 AND 1 THEN re * re + im * im ELSE 0 END), 6) AS high,
       round(sum(CASE WHEN r BETWEEN 0.2 AND 0.5 THEN re * re + im * im ELSE 0 END), 6) AS mid
FROM dft JOIN (SELECT f, sqrt(fy * fy + fx * fx) / 0.5 AS r FROM fq) USING (f) GROUP BY 1, 2""")
def band_powers(spark, folder):
    rho = (np.hypot(np.fft.fftfreq(8)[:, None], np.fft.fftfreq(8)[None, :]) / 0.5).ravel()
    within = lambda band: F.array(*[F.lit(int(i)) for i in np.flatnonzero((rho >= band[0]) & (rho <= band[1]))])
    out = FO.band_powers(with_spectrum(T.frames(spark, folder)), [KEY, "frame_index"], {"high": within(C.HIGH_BAND), "mid": within(C.MID_BAND)})
    return out.select(KEY, "frame_index", *[F.round(c, 6).alias(c) for c in ("total", "high", "mid")])


@query("high_band_amplitude", "PRJ-12", DFT + """
SELECT capture_id, frame_index, round(avg(sqrt(re * re + im * im)), 8) AS mean_amplitude
FROM dft JOIN (SELECT f, sqrt(fy * fy + fx * fx) / 0.5 AS r FROM fq) USING (f) WHERE r BETWEEN 0.5 AND 1 GROUP BY 1, 2""")
def high_band_amplitude(spark, folder):
    rho = (np.hypot(np.fft.fftfreq(8)[:, None], np.fft.fftfreq(8)[None, :]) / 0.5).ravel()
    inside = F.array(*[F.lit(int(i)) for i in np.flatnonzero((rho >= C.HIGH_BAND[0]) & (rho <= C.HIGH_BAND[1]))])
    size = F.transform(inside, lambda i: F.hypot(F.get("re", i), F.get("im", i)))
    mean = F.aggregate(size, F.lit(0.0), lambda a, v: a + v) / F.size(inside)
    return with_spectrum(T.frames(spark, folder)).select(KEY, "frame_index", F.round(mean, 8).alias("mean_amplitude"))


def bin_values(spark, folder):
    """Per supplier: mean price by line number, best first - seven bins of a rank trend."""
    item = T.load(spark, folder, "lineitem")
    bins = item.groupBy(F.col("l_suppkey").alias("unit"), F.col("l_linenumber").alias("bin")).agg(F.avg(F.col("l_extendedprice") / 1000).alias("v"))
    return bins.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("r")).select(
        "unit", F.transform("r", lambda r: r["v"]).alias("v"), F.transform("r", lambda r: r["bin"] - 1).alias("bins"))


BIN_SQL = """
WITH b AS (SELECT l_suppkey AS unit, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) - 1 AS i, l_linenumber - 1 AS bin, avg(l_extendedprice / 1000) AS v
           FROM lineitem GROUP BY l_suppkey, l_linenumber)
"""


@query("monotone_fit", "WIN-9", BIN_SQL + """
, c AS (SELECT unit, i, v, sum(v) OVER (PARTITION BY unit ORDER BY i) AS s FROM b),
m AS (SELECT p.unit, p.i, a.i AS st, (e.s - a.s + a.v) / (e.i - a.i + 1) AS mean FROM c p JOIN c a ON a.unit = p.unit AND a.i <= p.i JOIN c e ON e.unit = p.unit AND e.i >= p.i),
x AS (SELECT unit, i, st, max(mean) AS top FROM m GROUP BY 1, 2, 3)
SELECT unit, i, round(min(top), 6) AS fit FROM x GROUP BY 1, 2""")
def monotone_fit(spark, folder):
    return bin_values(spark, folder).select("unit", F.posexplode(FO.non_increasing(F.col("v"))).alias("i", "fit")).select(
        "unit", F.col("i").cast("long").alias("i"), F.round("fit", 6).alias("fit"))


@query("rank_trend", "WIN-11", BIN_SQL + """
, p AS (SELECT unit, i, bin / greatest(max(bin) OVER (PARTITION BY unit), 1)::DOUBLE AS x, ln(v) AS y FROM b),
s AS (SELECT unit, count(*)::DOUBLE AS n, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM p GROUP BY 1),
d AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM s),
k AS (SELECT unit, (t0*(s2*s4-s3*s3) - s1*(t1*s4-t2*s3) + s2*(t1*s3-t2*s2)) / det AS c0, (n*(t1*s4-t2*s3) - t0*(s1*s4-s2*s3) + s2*(s1*t2-s2*t1)) / det AS c1,
             (n*(s2*t2-s3*t1) - s1*(s1*t2-s2*t1) + t0*(s1*s3-s2*s2)) / det AS c2 FROM d)
SELECT unit, i, round(exp(c0 + c1 * x + c2 * x * x), 6) AS trend FROM p JOIN k USING (unit)""")
def rank_trend(spark, folder):
    return bin_values(spark, folder).select("unit", F.posexplode(FO.quadratic_log_trend(F.col("bins"), F.col("v"))).alias("i", "trend")).select(
        "unit", F.col("i").cast("long").alias("i"), F.round("trend", 6).alias("trend"))


@query("ring_smoothing", "WIN-10", """
WITH b AS (SELECT p_brand AS unit, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n, avg(p_retailprice) AS v FROM part GROUP BY p_brand, p_size),
t AS (SELECT o, exp(-0.5 * o * o / 2.25::DOUBLE) / (SELECT sum(exp(-0.5 * q * q / 2.25::DOUBLE)) FROM (SELECT unnest(range(-6, 7)) AS q)) AS w FROM (SELECT unnest(range(-6, 7)) AS o))
SELECT b.unit, b.i, round(sum(w * e.v), 6) AS smooth FROM b, t JOIN b e ON e.unit = b.unit AND e.i = least(greatest(b.i + o, 0), b.n - 1) GROUP BY 1, 2""")
def ring_smoothing(spark, folder):
    sizes = T.load(spark, folder, "part").groupBy(F.col("p_brand").alias("unit"), "p_size").agg(F.avg("p_retailprice").alias("v"))
    rows = sizes.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_size", "v"))), lambda r: r["v"]).alias("v"))
    return rows.select("unit", F.posexplode(FO.ring_smooth(F.col("v"))).alias("i", "smooth")).select(
        "unit", F.col("i").cast("long").alias("i"), F.round("smooth", 6).alias("smooth"))


def accumulated(spark, folder):
    return ST.stack(binned_frames(spark, folder), [KEY, "bin", "half"], F.col("pixels"), F.col("w"))


RING_SHARES = """
, rp AS (SELECT f, least(sqrt(fy * fy + fx * fx), 0.5) / 0.01 AS p FROM (
    SELECT f, CASE WHEN f // 8 < 4 THEN f // 8 ELSE f // 8 - 8 END / 8.0::DOUBLE AS fy, CASE WHEN f % 8 < 4 THEN f % 8 ELSE f % 8 - 8 END / 8.0::DOUBLE AS fx
    FROM (SELECT unnest(range(64)) AS f))),
share AS (SELECT f, least(floor(p + 1e-9), 50)::BIGINT AS band, power(cos(0.5 * pi() * greatest(p - floor(p + 1e-9), 0)), 2) AS s FROM rp
          UNION ALL SELECT f, floor(p + 1e-9)::BIGINT + 1, power(sin(0.5 * pi() * greatest(p - floor(p + 1e-9), 0)), 2) FROM rp WHERE p < 50)
"""

TRANSFER = BINNED + RING_SHARES + """
, win AS (SELECT k, (0.5 - 0.5 * cos(2 * pi() * (k // 8 + 1) / 9)) * (0.5 - 0.5 * cos(2 * pi() * (k % 8 + 1) / 9)) AS win FROM (SELECT unnest(range(64)) AS k)),
hv AS (SELECT capture_id, bin, k, coalesce(sum(wv) FILTER (half = 0), 0) AS v0, coalesce(sum(w) FILTER (half = 0), 0) AS w0,
              coalesce(sum(wv) FILTER (half = 1), 0) AS v1, coalesce(sum(w) FILTER (half = 1), 0) AS w1 FROM acc GROUP BY 1, 2, 3),
al AS (SELECT capture_id, k, sum(wv) AS v, sum(w) AS w FROM acc GROUP BY 1, 2),
covered AS (SELECT capture_id, bin, sum(w0 * win) / sum(win) AS d0, sum(w1 * win) / sum(win) AS d1 FROM hv JOIN win USING (k) GROUP BY 1, 2 HAVING min(least(w0, w1)) > 0),
pl AS (SELECT capture_id, bin, k, win, unnest(['a', 'b', 'own', 'rest']) AS part,
              unnest([v0 / w0, v1 / w1, (v0 + v1) / (w0 + w1), CASE WHEN al.w - w0 - w1 > 0 THEN (al.v - v0 - v1) / (al.w - w0 - w1) ELSE 0 END]) AS v
       FROM hv JOIN covered USING (capture_id, bin) JOIN al USING (capture_id, k) JOIN win USING (k)),
q AS (SELECT capture_id, bin, k, part, (v - sum(v * win) OVER m / sum(win) OVER m) * win AS v FROM pl WINDOW m AS (PARTITION BY capture_id, bin, part)),
ft AS (SELECT capture_id, bin, part, f, sum(v * cos(2 * pi() * ((f // 8) * (k // 8) + (f % 8) * (k % 8)) / 8)) AS re,
              -sum(v * sin(2 * pi() * ((f // 8) * (k // 8) + (f % 8) * (k % 8)) / 8)) AS im FROM q, (SELECT unnest(range(1, 64)) AS f) GROUP BY 1, 2, 3, 4),
fr AS (SELECT capture_id, bin, f, o.re * r.re + o.im * r.im AS shared, r.re * r.re + r.im * r.im AS rest, power(a.re - b.re, 2) + power(a.im - b.im, 2) AS split
       FROM ft o JOIN ft r USING (capture_id, bin, f) JOIN ft a USING (capture_id, bin, f) JOIN ft b USING (capture_id, bin, f)
       WHERE o.part = 'own' AND r.part = 'rest' AND a.part = 'a' AND b.part = 'b'),
sums AS (SELECT capture_id, bin, band, sum(s * shared) AS shared, sum(s * rest) AS rest, sum(s * split) AS split FROM fr JOIN share USING (f) GROUP BY 1, 2, 3),
cells AS (SELECT band, sum(s) AS cells FROM share GROUP BY 1),
measured AS (
  SELECT capture_id, bin, band, d0 + d1 AS depth, coalesce(shared / greatest(rest, 1e-300), 0) AS transfer,
         coalesce(split / greatest(cells, 1e-300), 0) / (1 / d0 + 1 / d1) / (d0 + d1) AS residual
  FROM covered CROSS JOIN (SELECT unnest(range(51)) AS band) LEFT JOIN sums USING (capture_id, bin, band) LEFT JOIN cells USING (band))
"""


@query("ring_transfer", "AGG-12 SUP-12", TRANSFER + """
SELECT capture_id, bin, band::INT AS band, round(depth, 6) AS depth, round(transfer, 6) + 0.0 AS transfer, round(residual, 8) + 0.0 AS residual FROM measured""")
def ring_transfer(spark, folder):
    measured = FO.bin_planes(accumulated(spark, folder), [KEY]).withColumn("m", FO.measure_rings(8, 8, WINDOW))
    rows = measured.where("m.transfer is not null").select(KEY, "bin", "m.depth", F.posexplode(
        F.arrays_zip(F.col("m.transfer").alias("t"), F.col("m.residual").alias("v"))).alias("band", "r"))
    return rows.select(KEY, "bin", "band", F.round("depth", 6).alias("depth"),
                       (F.round("r.t", 6) + 0.0).alias("transfer"), (F.round("r.v", 8) + 0.0).alias("residual"))


@query("fourier_weighted_stack", "NUM-1 NUM-2 AGG-13 SUP-1")
def fourier_weighted_stack(spark, folder):
    planes = materialise(FO.bin_planes(accumulated(spark, folder), [KEY]), "bin-planes")
    measured = planes.withColumn("m", FO.measure_rings(8, 8, WINDOW)).select(KEY, "bin", "m.*")
    combined = FO.combine_bins(planes, FO.ring_weights(measured, [KEY], 4.0), [KEY], 8, 8)
    return combined.select(KEY, F.posexplode("weighted").alias("pos", "value")).withColumn("value", F.round("value", 8))


SHIFTS = SCORE_SQL + """
, best AS (SELECT capture_id, frame_index AS ref FROM score QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY quality DESC, frame_index) = 1),
c AS (SELECT px.*, v - avg(v) OVER (PARTITION BY frame_index) AS u FROM px),
dft AS (SELECT capture_id, frame_index, f, sum(u * cos(2 * pi() * ((f // 8) * y + (f % 8) * x) / 8)) AS re, -sum(u * sin(2 * pi() * ((f // 8) * y + (f % 8) * x) / 8)) AS im
        FROM c, (SELECT unnest(range(64)) AS f) GROUP BY 1, 2, 3),
g AS (SELECT f, exp(-4 * pi() * pi() * 2.25 * (power(CASE WHEN f // 8 < 4 THEN f // 8 ELSE f // 8 - 8 END / 8.0::DOUBLE, 2) + power(CASE WHEN f % 8 < 4 THEN f % 8 ELSE f % 8 - 8 END / 8.0::DOUBLE, 2))) AS g FROM (SELECT unnest(range(64)) AS f)),
x AS (SELECT a.capture_id, a.frame_index, a.f, (a.re * r.re + a.im * r.im) * g AS xr, (a.im * r.re - a.re * r.im) * g AS xi
      FROM dft a JOIN best ON best.capture_id = a.capture_id JOIN dft r ON r.frame_index = best.ref AND r.capture_id = a.capture_id AND r.f = a.f JOIN g ON g.f = a.f),
s AS (SELECT capture_id, frame_index, k, sum(xr * cos(2 * pi() * ((f // 8) * (k // 8) + (f % 8) * (k % 8)) / 8) - xi * sin(2 * pi() * ((f // 8) * (k // 8) + (f % 8) * (k % 8)) / 8)) AS c
      FROM x, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2, 3),
p AS (SELECT capture_id, frame_index, arg_max(k, c) AS k, max(c) AS c0 FROM s GROUP BY 1, 2),
n AS (SELECT p.*, u.c AS up, d.c AS dn, l.c AS lf, r.c AS rt FROM p
      JOIN s u ON u.frame_index = p.frame_index AND u.k = ((p.k // 8 + 7) % 8) * 8 + p.k % 8 JOIN s d ON d.frame_index = p.frame_index AND d.k = ((p.k // 8 + 1) % 8) * 8 + p.k % 8
      JOIN s l ON l.frame_index = p.frame_index AND l.k = (p.k // 8) * 8 + (p.k % 8 + 7) % 8 JOIN s r ON r.frame_index = p.frame_index AND r.k = (p.k // 8) * 8 + (p.k % 8 + 1) % 8),
shifts AS (SELECT capture_id, frame_index, CASE WHEN k % 8 < 4 THEN k % 8 ELSE k % 8 - 8 END + CASE WHEN lf - 2 * c0 + rt < 0 THEN least(greatest(0.5 * (lf - rt) / (lf - 2 * c0 + rt), -0.5), 0.5) ELSE 0 END AS dx,
       CASE WHEN k // 8 < 4 THEN k // 8 ELSE k // 8 - 8 END + CASE WHEN up - 2 * c0 + dn < 0 THEN least(greatest(0.5 * (up - dn) / (up - 2 * c0 + dn), -0.5), 0.5) ELSE 0 END AS dy FROM n)
"""


@query("registration_shifts", "REG-1 FLT-7 JN-12", SHIFTS + "SELECT capture_id, frame_index, round(dx, 5) + 0.0 AS dx, round(dy, 5) + 0.0 AS dy FROM shifts")
def registration_shifts(spark, folder):
    frames = scored(spark, folder)
    references = materialise(LO.reference_planes(frames), "references")
    shifts = frames.join(references, KEY).withColumn("s", FR.translation_to(F.col("reference")))
    return shifts.select(KEY, "frame_index", (F.round("s.dx", 5) + 0.0).alias("dx"), (F.round("s.dy", 5) + 0.0).alias("dy"))


@query("registered_stack", "SUP-1 REG-1 REG-13 AGG-1 (translation stack)", SHIFTS + """
, near AS (SELECT capture_id, frame_index, CASE WHEN abs(dx) < 1e-10 THEN 0 ELSE dx END AS dx, CASE WHEN abs(dy) < 1e-10 THEN 0 ELSE dy END AS dy, greatest(quality, 1e-12) AS q
           FROM shifts JOIN score USING (capture_id, frame_index) WHERE abs(dx) <= 2 AND abs(dy) <= 2),
put AS (SELECT px.capture_id, q, v, y - floor(dy)::BIGINT - cy AS ty, x - floor(dx)::BIGINT - cx AS tx,
               (CASE WHEN cy = 0 THEN 1 - (dy - floor(dy)) ELSE dy - floor(dy) END) * (CASE WHEN cx = 0 THEN 1 - (dx - floor(dx)) ELSE dx - floor(dx) END) AS wt
        FROM px JOIN near USING (capture_id, frame_index), (SELECT unnest([0, 1]) AS cy), (SELECT unnest([0, 1]) AS cx)),
a AS (SELECT capture_id, ty AS y, tx AS x, sum(q * wt * v) AS wv, sum(q * wt) AS w FROM put WHERE ty BETWEEN 0 AND 7 AND tx BETWEEN 0 AND 7 GROUP BY 1, 2, 3)
SELECT g.capture_id, g.y, g.x, round(CASE WHEN w > 0 THEN wv / w ELSE 0 END, 6) AS value, coalesce(w > 0, false) AS valid
FROM (SELECT DISTINCT capture_id, y, x FROM px) g LEFT JOIN a USING (capture_id, y, x)""")
def registered_stack(spark, folder):
    frames = scored(spark, folder)
    total = LO.registered_stack(frames, materialise(LO.reference_planes(frames), "references"), max_shift=2.0)
    return ST.place(ST.normalise(total), 8, 8).select(KEY, "y", "x", F.round("value", 6).alias("value"), "valid")


def _pass_sql(k: int, reference: str) -> str:
    """Shifts of all frames against a plane (capture_id, y, x, v) and the mean of the frames moved by them, as tables named with ``k``."""
    spin = "2 * pi() * ((f // 8) * {0} + (f % 8) * {1}) / 8"
    ahead, back = spin.format("y", "x"), spin.format("(k // 8)", "(k % 8)")
    return f"""
, rc{k} AS (SELECT capture_id, y, x, v - avg(v) OVER (PARTITION BY capture_id) AS u FROM {reference}),
rd{k} AS (SELECT capture_id, f, sum(u * cos({ahead})) AS re, -sum(u * sin({ahead})) AS im FROM rc{k}, (SELECT unnest(range(64)) AS f) GROUP BY 1, 2),
x{k} AS (SELECT a.capture_id, a.frame_index, a.f, (a.re * r.re + a.im * r.im) * g AS xr, (a.im * r.re - a.re * r.im) * g AS xi FROM dft a JOIN rd{k} r USING (capture_id, f) JOIN g USING (f)),
s{k} AS (SELECT capture_id, frame_index, k, sum(xr * cos({back}) - xi * sin({back})) AS c FROM x{k}, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2, 3),
p{k} AS (SELECT capture_id, frame_index, arg_max(k, c) AS k, max(c) AS c0 FROM s{k} GROUP BY 1, 2),
n{k} AS (SELECT p.*, u.c AS up, d.c AS dn, l.c AS lf, r.c AS rt FROM p{k} p
      JOIN s{k} u ON u.frame_index = p.frame_index AND u.k = ((p.k // 8 + 7) % 8) * 8 + p.k % 8 JOIN s{k} d ON d.frame_index = p.frame_index AND d.k = ((p.k // 8 + 1) % 8) * 8 + p.k % 8
      JOIN s{k} l ON l.frame_index = p.frame_index AND l.k = (p.k // 8) * 8 + (p.k % 8 + 7) % 8 JOIN s{k} r ON r.frame_index = p.frame_index AND r.k = (p.k // 8) * 8 + (p.k % 8 + 1) % 8),
e{k} AS (SELECT *, CASE WHEN lf - 2 * c0 + rt < 0 THEN least(greatest(0.5 * (lf - rt) / (lf - 2 * c0 + rt), -0.5), 0.5) ELSE 0 END AS sx,
                CASE WHEN up - 2 * c0 + dn < 0 THEN least(greatest(0.5 * (up - dn) / (up - 2 * c0 + dn), -0.5), 0.5) ELSE 0 END AS sy FROM n{k}),
m{k} AS (SELECT capture_id, frame_index, CASE WHEN k % 8 < 4 THEN k % 8 ELSE k % 8 - 8 END + CASE WHEN abs(sx) < 1e-10 THEN 0 ELSE sx END AS dx,
                CASE WHEN k // 8 < 4 THEN k // 8 ELSE k // 8 - 8 END + CASE WHEN abs(sy) < 1e-10 THEN 0 ELSE sy END AS dy FROM e{k}),
t{k} AS (SELECT px.capture_id, v, y - floor(dy)::BIGINT - cy AS ty, x - floor(dx)::BIGINT - cx AS tx,
               (CASE WHEN cy = 0 THEN 1 - (dy - floor(dy)) ELSE dy - floor(dy) END) * (CASE WHEN cx = 0 THEN 1 - (dx - floor(dx)) ELSE dx - floor(dx) END) AS wt
        FROM px JOIN m{k} USING (capture_id, frame_index), (SELECT unnest([0, 1]) AS cy), (SELECT unnest([0, 1]) AS cx) WHERE abs(dx) <= 2 AND abs(dy) <= 2),
a{k} AS (SELECT capture_id, ty AS y, tx AS x, sum(wt * v) AS wv, sum(wt) AS w FROM t{k} WHERE ty BETWEEN 0 AND 7 AND tx BETWEEN 0 AND 7 GROUP BY 1, 2, 3),
ref{k} AS (SELECT g.capture_id, g.y, g.x, CASE WHEN w > 0 THEN wv / w ELSE 0 END AS v FROM (SELECT DISTINCT capture_id, y, x FROM px) g LEFT JOIN a{k} USING (capture_id, y, x))"""


@query("refined_reference", "REG-3 (two passes)", SHIFTS[: SHIFTS.index("x AS (SELECT a.capture_id")].rstrip().rstrip(",") + """
, ref0 AS (SELECT px.capture_id, y, x, v FROM px JOIN best ON best.capture_id = px.capture_id AND best.ref = px.frame_index)""" + _pass_sql(1, "ref0") + _pass_sql(2, "ref1") + """
SELECT capture_id, (y * 8 + x)::INT AS pos, round(v, 6) AS value FROM ref2""")
def refined_reference(spark, folder):
    frames = scored(spark, folder)
    out = LO.refined_reference(frames, passes=2, max_shift=2.0)
    return out.select(KEY, F.posexplode("reference").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("local_quality", "REG-4 WIN-4 UDF-7", PX_SQL + """
, t AS (SELECT o, exp(-0.5 * o * o / 2.25::DOUBLE) / (SELECT sum(exp(-0.5 * q * q / 2.25::DOUBLE)) FROM (SELECT unnest(range(-6, 7)) AS q)) AS w FROM (SELECT unnest(range(-6, 7)) AS o)),
m AS (SELECT i, least(greatest(i + o, 0), 7) AS j, sum(w) AS w FROM (SELECT unnest(range(8)) AS i), t GROUP BY 1, 2),
sm AS (SELECT q.capture_id, q.frame_index, a.i AS y, b.i AS x, sum(a.w * b.w * q.v) AS v FROM px q JOIN m a ON a.j = q.y JOIN m b ON b.j = q.x GROUP BY 1, 2, 3, 4),
lp AS (SELECT c.capture_id, c.frame_index, c.y, c.x, c.v, CASE WHEN c.y BETWEEN 1 AND 6 AND c.x BETWEEN 1 AND 6 THEN sum(n.v) - 5 * c.v ELSE 0 END AS l
       FROM sm c JOIN sm n ON n.frame_index = c.frame_index AND abs(n.y - c.y) + abs(n.x - c.x) <= 1 GROUP BY 1, 2, 3, 4, 5),
pt AS (SELECT * FROM (VALUES (0, 2, 2), (1, 2, 5), (2, 5, 2), (3, 5, 5)) p(point, cy, cx)),
sc AS (SELECT capture_id, frame_index, point, sum(g * l * l) / sum(g) / greatest(power(sum(g * v) / sum(g), 2), 1e-30) AS score
       FROM (SELECT *, exp(-0.5 * ((y - cy) * (y - cy) + (x - cx) * (x - cx)) / 4.0::DOUBLE) AS g FROM lp, pt) GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY capture_id, point ORDER BY score DESC, frame_index) AS rank, least(20, count(*) OVER (PARTITION BY capture_id, point)) AS kept FROM sc)
SELECT capture_id, point, frame_index, rank, least((rank - 1) * 4 // kept, 3) AS bin, round(ln(score), 4) AS score FROM rk WHERE rank <= kept""")
def local_quality(spark, folder):
    frames = scored(spark, folder)
    scores = LO.local_scores(frames, [(2, 2), (2, 5), (5, 2), (5, 5)], sigma=2.0)
    best = SEL.per_point_best(scores, [KEY], "point", 20, bins=4)
    return best.select(KEY, "point", "frame_index", "rank", "bin", F.round(F.ln("score"), 4).alias("score"))


@query("bin_planes", "D8 AGG-4 (planes)", BINNED + """
SELECT capture_id, bin, round(sum(wv) FILTER (WHERE half = 0), 6) AS first, round(sum(w) FILTER (WHERE half = 0), 6) AS first_w, round(sum(wv) FILTER (WHERE half = 1), 6) AS second FROM acc GROUP BY 1, 2""")
def bin_planes(spark, folder):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6)
    planes = FO.bin_planes(accumulated(spark, folder), [KEY])
    return planes.select(KEY, "bin", total("h0_wv").alias("first"), total("h0_w").alias("first_w"), total("h1_wv").alias("second"))
