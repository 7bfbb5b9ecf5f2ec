"""Frequency weighting of rank-binned stacks, and estimators that live in frequency space.

Rank bins of a stack are compared ring by ring in radial frequency. The planes of
one bin are one frame in size whatever the number of frames behind them; every
(capture, bin) pair is measured in its own row, and the small (bin, ring) tables
are fitted with array expressions in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions import kernels as K
from framewright.functions.numeric import let
from framewright.operators.frames import _lists

RINGS = int(round(C.RING_LIMIT / C.RING_STEP)) + 1


def effective_share(accumulated: DataFrame, weights: DataFrame, key: str = "capture_id") -> DataFrame:
    """Share of frames a band effectively uses: (sum w n)^2 / (sum n sum w^2 n) over bins of size n."""
    sizes = accumulated.groupBy(key, "bin").agg(F.sum("sum_w").alias("n"))
    wn = F.col("weight") * F.col("n")
    return sizes.join(weights, [key, "bin"]).groupBy(key, "band").agg(
        (F.sum(wn) * F.sum(wn) / (F.sum("n") * F.sum(F.col("weight") * wn))).alias("share"))


def bin_planes(accumulated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (key, bin) with the two half planes and the planes of the whole stack."""
    keys = list(keys)

    def gather(df, by, prefix):
        entry = F.struct("pos", "sum_wv", "sum_w")
        out = df.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_p"))
        return out.select(*by, F.transform("_p", lambda p: p["sum_wv"]).alias(f"{prefix}_wv"),
                          F.transform("_p", lambda p: p["sum_w"]).alias(f"{prefix}_w"))

    halves = gather(accumulated, [*keys, "bin", "half"], "h")
    pick = lambda h, c: F.max(F.when(F.col("half") == h, F.col(c)))
    pairs = halves.groupBy(*keys, "bin").agg(*[pick(h, f"h_{c}").alias(f"h{h}_{c}") for h in (0, 1) for c in ("wv", "w")])
    whole = accumulated.groupBy(*keys, "pos").agg(F.sum("sum_wv").alias("sum_wv"), F.sum("sum_w").alias("sum_w"))
    joined = pairs.join(gather(whole, keys, "all"), keys)
    empty = F.transform("all_w", lambda v: v * 0)  # a half without frames contributes nothing
    return joined.withColumns({c: F.coalesce(c, empty) for c in ("h0_wv", "h0_w", "h1_wv", "h1_w")})


def _divide(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)


def _planes(values: pa.Array, height: int, width: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, height, width)


def _ring_sums(planes: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """(n, rings): each plane summed under each radial filter."""
    return planes.reshape(len(planes), filters[0].size) @ filters.reshape(len(filters), -1).T


def measure_rings(height: int, width: int, window: np.ndarray | None = None) -> Column:
    """STRUCT<transfer, residual: ARRAY, depth> of one bin against the stack of the other bins.

    ``window`` replaces the target taper where the frame is too small to have one. Transfer and
    residual are null where the taper is empty, a half does not cover it, or a value is not finite.
    """

    @F.arrow_udf("transfer array<double>, residual array<double>, depth double")
    def run(h0_wv: pa.Array, h0_w: pa.Array, h1_wv: pa.Array, h1_w: pa.Array, all_wv: pa.Array, all_w: pa.Array) -> pa.Array:
        columns = (h0_wv, h0_w, h1_wv, h1_w, all_wv, all_w)
        known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
        planes = np.stack([_planes(c.filter(pa.array(known)), height, width) for c in columns])
        values, cover = planes[[0, 2, 4]], planes[[1, 3, 5]]  # first half, second half, whole stack
        tapers = K.tapers(_divide(values[2], cover[2])) if window is None else np.broadcast_to(window, values[2].shape)
        filters = K.ring_filters(height, width)
        table = np.full((2, len(known), len(filters)), np.nan)
        depth = np.zeros(len(known))
        with np.errstate(divide="ignore", invalid="ignore"):
            each = np.nan_to_num((cover[:2] * tapers).sum(axis=(2, 3)) / tapers.sum(axis=(1, 2)))
            half = [K.inside_spectra(_divide(v, w), tapers) for v, w in zip(values[:2], cover[:2])]
            both = K.inside_spectra(_divide(values[:2].sum(axis=0), cover[:2].sum(axis=0)), tapers)
            others = K.inside_spectra(_divide(values[2] - values[:2].sum(axis=0), cover[2] - cover[:2].sum(axis=0)), tapers)
            table[0, known] = _ring_sums((both * others.conj()).real, filters) / np.maximum(_ring_sums(np.abs(others) ** 2, filters), 1e-300)
            cells = np.maximum(filters.sum(axis=(1, 2)), 1e-300)
            table[1, known] = _ring_sums(np.abs(half[0] - half[1]) ** 2, filters) / cells / ((1 / each).sum(axis=0) * each.sum(axis=0))[:, None]
        depth[known] = each.sum(axis=0)
        good = np.isfinite(table).all(axis=(0, 2))
        good[known] &= ((cover[:2].min(axis=0) > 0) | (tapers <= 0)).all(axis=(1, 2)) & (tapers > 0).any(axis=(1, 2))
        bounds = pa.array(np.concatenate([[0], np.cumsum(good * len(filters))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(t[good].ravel()), mask=pa.array(~good)) for t in table]
        return pa.StructArray.from_arrays([*lists, pa.array(depth)], names=["transfer", "residual", "depth"], mask=pa.array(~known))

    return run("h0_wv", "h0_w", "h1_wv", "h1_w", "all_wv", "all_w")


def ring_smooth(values: Column) -> Column:
    """Gaussian smoothing along an array with repeated ends."""
    taps = K._gaussian_taps(C.RING_SMOOTH)
    reach = len(taps) // 2
    last = F.size(values) - 1
    at = lambda i, o: F.get(values, F.least(F.greatest(i + o, F.lit(0)), last))
    return F.transform(F.sequence(F.lit(0), last),
                       lambda i: sum((at(i, o) * float(taps[o + reach]) for o in range(-reach, reach + 1)), F.lit(0.0)))


def non_increasing(values: Column) -> Column:
    """Non-increasing least-squares fit of an array, best rank first.

    The fit at i is min over starts a <= i of max over ends b >= i of mean(a..b),
    which equals pooling adjacent violators; an array holds at most 16 bins.
    """
    def fit(prefix: Column) -> Column:
        n = F.size(prefix) - 1

        def best_end(a: Column, i: Column) -> Column:
            return F.array_max(F.transform(F.sequence(i, n - 1), lambda b: (F.get(prefix, b + 1) - F.get(prefix, a)) / (b - a + 1)))

        return F.transform(F.sequence(F.lit(0), n - 1),
                           lambda i: F.array_min(F.transform(F.sequence(F.lit(0), i), lambda a: best_end(a, i))))

    running = F.aggregate(values, F.array(F.lit(0.0)), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))
    return let(running, fit)


def _moment(points: Column, f) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + f(p))


def quadratic_log_trend(ranks: Column, values: Column) -> Column:
    """exp of a quadratic fitted to log(values) over scaled ranks, evaluated at the ranks.

    Closed-form normal equations with the fit centred on the mean rank; fewer
    than three points are fitted by a line or kept.
    """
    top = F.greatest(F.array_max(ranks), F.lit(1)).cast("double")
    scaled = F.zip_with(ranks, values, lambda r, v: F.struct((r / top).alias("x"), F.ln(v).alias("y")))

    def coefficients(points: Column) -> Column:
        n = F.size(points).cast("double")
        mean = _moment(points, lambda p: p["x"]) / n
        d = lambda p: p["x"] - mean
        sums = F.struct(
            n.alias("n"), mean.alias("mean"), _moment(points, lambda p: d(p) * d(p)).alias("s2"), _moment(points, lambda p: d(p) * d(p) * d(p)).alias("s3"),
            _moment(points, lambda p: d(p) * d(p) * d(p) * d(p)).alias("s4"), _moment(points, lambda p: p["y"]).alias("sy"),
            _moment(points, lambda p: d(p) * p["y"]).alias("sxy"), _moment(points, lambda p: d(p) * d(p) * p["y"]).alias("sx2y"))
        return let(sums, _solve_centred)

    def evaluate(points: Column) -> Column:
        return let(coefficients(points), lambda k: F.transform(points, lambda p: F.exp(
            k["c"] + k["b"] * (p["x"] - k["mean"]) + k["a"] * (p["x"] - k["mean"]) * (p["x"] - k["mean"]))))

    return F.when(F.size(ranks) >= 2, let(scaled, evaluate)).otherwise(values)


def _solve_centred(s: Column) -> Column:
    """Coefficients of y = c + b d + a d^2 from centred moments (sum d = 0)."""
    q2 = s["s4"] - s["s2"] * s["s2"] / s["n"]
    rhs = s["sx2y"] - s["s2"] * s["sy"] / s["n"]
    det = s["s2"] * q2 - s["s3"] * s["s3"]
    quadratic = (s["n"] >= 3) & (F.abs(det) > 1e-300)
    a = F.when(quadratic, (s["s2"] * rhs - s["s3"] * s["sxy"]) / det).otherwise(0.0)
    b = F.when(quadratic, (q2 * s["sxy"] - s["s3"] * rhs) / det).otherwise(F.when(s["s2"] > 0, s["sxy"] / s["s2"]).otherwise(0.0))
    return F.struct(a.alias("a"), b.alias("b"), ((s["sy"] - a * s["s2"]) / s["n"]).alias("c"), s["mean"].alias("mean"))


def ring_weights(measured: DataFrame, keys: Sequence[str], power: float) -> DataFrame:
    """(key, bin, band, weight): T^power / (V D), scaled per band so that its largest weight is 1.

    ``measured`` has one row per (key, bin) with transfer, residual and depth. T is
    smoothed over rings and made non-increasing over rank, V follows a quadratic
    trend over rank; an unmeasured bin (no target, an empty half, a value that is not finite) borrows its nearest measured neighbour. A
    band without measurable transfer keeps equal weights, as does every band of a
    key where no bin could be measured.
    """
    keys = list(keys)
    smoothed = measured.where("transfer is not null").select(
        *keys, "bin", "depth", F.posexplode(F.arrays_zip(ring_smooth(F.col("transfer")).alias("t"),
                                                         ring_smooth(F.col("residual")).alias("v"))).alias("band", "m"))
    per_band = smoothed.groupBy(*keys, "band").agg(F.array_sort(F.collect_list(F.struct(
        "bin", F.col("m.t").alias("t"), F.greatest(F.col("m.v"), F.lit(1e-300)).alias("v"), "depth"))).alias("rows"))
    column = lambda name: F.transform("rows", lambda r: r[name])
    fitted = per_band.withColumn("t", non_increasing(column("t"))).withColumn(
        "v", quadratic_log_trend(column("bin"), column("v"))).withColumn("d", column("depth")).withColumn("bins", column("bin"))
    raw = F.transform(F.arrays_zip("t", "v", "d", "bins"), lambda r: F.struct(
        r["bins"].alias("bin"), (F.pow(F.greatest(r["t"], F.lit(0.0)), F.lit(float(power))) / (r["v"] * r["d"])).alias("w")))
    weighted = fitted.select(*keys, "band", raw.alias("w"))
    peak = F.array_max(F.transform("w", lambda r: r["w"]))
    scaled = F.transform("w", lambda r: F.struct(
        r["bin"].alias("bin"), F.when(peak > 0, r["w"] / F.greatest(peak, F.lit(1e-300))).otherwise(F.lit(1.0)).alias("w")))
    known = weighted.select(*keys, "band", scaled.alias("w"))
    bins = measured.select(*keys, "bin")
    unmeasured = bins.join(known.select(*keys).distinct(), keys, "left_anti").select(
        *keys, "bin", F.explode(F.sequence(F.lit(0), F.lit(RINGS - 1))).alias("band"), F.lit(1.0).alias("weight"))
    pairs = known.join(bins, keys)
    nearest = F.array_min(F.transform("w", lambda r: F.struct(
        F.abs(r["bin"] - F.col("bin")).alias("gap"), r["bin"].alias("at"), r["w"].alias("weight"))))
    return pairs.select(*keys, "bin", "band", nearest["weight"].alias("weight")).unionByName(unmeasured)


def combine_bins(planes: DataFrame, weights: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """The ordinary stack plus each band's weighted difference from it, as a plane per key.

    ``planes`` comes from :func:`bin_planes`. One row gathers the at most 16 bins
    of a key; its size is fixed by the frame, not by the number of frames.
    """
    keys = list(keys)
    vectors = weights.groupBy(*keys, "bin").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("band", "weight"))), lambda r: r["weight"]).alias("bands"))
    joined = planes.join(vectors, [*keys, "bin"]).select(
        *keys, F.struct("bin", "h0_wv", "h0_w", "h1_wv", "h1_w", "bands").alias("b"))
    gathered = joined.groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("bins"))
    column = lambda name: F.flatten(F.transform("bins", lambda b: b[name]))

    @F.arrow_udf("weighted array<double>, first array<double>, second array<double>")
    def run(h0v: pa.Array, h0w: pa.Array, h1v: pa.Array, h1w: pa.Array, bands: pa.Array) -> pa.Array:
        filters = K.ring_filters(height, width)
        out: list = [[], [], []]
        for row in zip(h0v, h0w, h1v, h1w, bands):
            parts = [np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=float) for v in row]
            halves = np.stack(parts[:4]).reshape(2, 2, -1, height, width)  # half, value or cover, bin
            table = parts[4].reshape(halves.shape[2], -1)
            for place, (values, cover) in zip(out, (halves.sum(axis=0), *halves)):
                place.append(_by_bands(values, cover, table, filters))
        return pa.StructArray.from_arrays([_lists(place) for place in out], names=["weighted", "first", "second"])

    planes_out = run(column("h0_wv"), column("h0_w"), column("h1_wv"), column("h1_w"), column("bands"))
    return gathered.select(*keys, planes_out.alias("r")).select(*keys, "r.*")


def _by_bands(values: np.ndarray, cover: np.ndarray, table: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """The stack of all bins, changed in each group of bands by what the group's bin weights change.

    Bands of proportional weights need one plane together, and those of equal bin weights none.
    """
    vectors, member = np.unique(table / np.maximum(table.max(axis=0), 1e-300), axis=1, return_inverse=True)
    vectors, member = vectors.T, member.ravel()
    changed = np.ptp(vectors, axis=1) > 0
    passed = np.zeros((len(vectors), *filters.shape[1:]))
    np.add.at(passed, member, filters)
    plain, seen = _divide(values.sum(axis=0), cover.sum(axis=0)), cover.sum(axis=0) > 0
    other = _divide(np.tensordot(vectors[changed], values, axes=1), np.tensordot(vectors[changed], cover, axes=1))
    change = np.fft.fft2(np.where(seen, other - plain, 0.0), axes=(1, 2)) * passed[changed]
    return np.where(seen, plain + np.fft.ifft2(change.sum(axis=0)).real, 0.0)


def ring_snr(combined: DataFrame, keys: Sequence[str], height: int, width: int, window: np.ndarray | None = None) -> DataFrame:
    """(key, band, snr) from the ring correlation of the two half stacks."""
    keys = list(keys)

    @F.arrow_udf("array<double>")
    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        filters = K.ring_filters(height, width)
        halves = [_planes(v, height, width) for v in (first, second)]
        tapers = K.tapers(halves[0] + halves[1]) if window is None else np.broadcast_to(window, halves[0].shape)
        a, b = (K.inside_spectra(p, tapers) for p in halves)
        power = np.sqrt(_ring_sums(np.abs(a) ** 2, filters) * _ring_sums(np.abs(b) ** 2, filters))
        shared = np.divide(_ring_sums((a * b.conj()).real, filters), power, out=np.zeros_like(power), where=power > 0)
        shared = np.clip(shared, 0.0, 1 - 1e-12)
        return _lists(list(2 * shared / (1 - shared)))

    return combined.select(*keys, F.posexplode(run("first", "second")).alias("band", "snr"))


# --- frequency-space estimators -------------------------------------------------


def spectrum(pixels: Column, height: int, width: int) -> Column:
    """STRUCT<re, im: ARRAY<DOUBLE>> of the 2-D discrete Fourier transform of an array column."""

    @F.arrow_udf("re array<double>, im array<double>")
    def run(values: pa.Array) -> pa.Array:
        offsets = values.offsets.to_numpy().astype(int)
        flat = values.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0]:offsets[-1]]
        f = np.fft.fft2(flat.reshape(-1, height, width), axes=(1, 2)).reshape(len(values), -1)
        bounds = pa.array((offsets - offsets[0]).astype(np.int32))
        parts = [pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(part).ravel())) for part in (f.real, f.imag)]
        return pa.StructArray.from_arrays(parts, names=["re", "im"])

    return run(pixels)


def inverse_spectrum(re: Column, im: Column, height: int, width: int) -> Column:
    """Real part of the inverse transform of two plane columns."""

    @F.arrow_udf("array<double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        planes = [np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=float)[v.offsets[0].as_py():v.offsets[-1].as_py()] for v in (a, b)]
        out = np.fft.ifft2((planes[0] + 1j * planes[1]).reshape(-1, height, width), axes=(1, 2)).real
        offsets = (a.offsets.to_numpy().astype(int) - a.offsets[0].as_py()).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return run(re, im)


def wiener_sums(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Multi-frame Wiener numerator and denominator per frequency.

    ``frames`` carries re/im of the image spectrum (i_re, i_im), of the transfer
    (h_re, h_im) and ``sigma2``. Each task folds its frames into planes per key, so
    only (key, frequency) sums are exchanged.
    """
    from framewright.operators.stacking import partial_planes

    keys = list(keys)
    cell = F.arrays_zip("i_re", "i_im", "h_re", "h_im")
    re = F.transform(cell, lambda c: c["h_re"] * c["i_re"] + c["h_im"] * c["i_im"])
    im = F.transform(cell, lambda c: c["h_re"] * c["i_im"] - c["h_im"] * c["i_re"])
    power = F.transform(cell, lambda c: c["h_re"] * c["h_re"] + c["h_im"] * c["h_im"])
    weight = 1 / F.greatest(F.col("sigma2"), F.lit(C.DENOMINATOR_FLOOR))
    sums = partial_planes(frames, keys, F.concat(re, im, power), weight)
    cells = sums.select(*keys, (F.size("sum_wv") / 3).cast("int").alias("n"), F.posexplode("sum_wv").alias("p", "v"))
    place = F.pmod(F.col("p"), F.col("n"))
    part = F.floor(F.col("p") / F.col("n"))
    pick = lambda k: F.sum(F.when(part == k, F.col("v")).otherwise(0.0))
    return cells.groupBy(*keys, place.alias("pos")).agg(pick(0).alias("num_re"), pick(1).alias("num_im"), pick(2).alias("power"))


def wiener_estimate(sums: DataFrame, keys: Sequence[str], lam: float, height: int, width: int) -> DataFrame:
    """Closed-form estimate per key: inverse transform of num / (power + lambda)."""
    keys = list(keys)
    den = F.greatest(F.col("power") + lam, F.lit(C.DENOMINATOR_FLOOR))
    cells = sums.select(*keys, "pos", (F.col("num_re") / den).alias("re"), (F.col("num_im") / den).alias("im"))
    gathered = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "re", "im"))).alias("c"))
    plane = lambda n: F.transform("c", lambda c: c[n])
    return gathered.select(*keys, inverse_spectrum(plane("re"), plane("im"), height, width).alias("pixels"))


def noise_variance(expected: Column, read_rms: float = C.READ_NOISE_E) -> Column:
    """Mean of the non-negative expected counts plus the read-noise variance."""
    total = F.aggregate(expected, F.lit(0.0), lambda acc, v: acc + F.greatest(v.cast("double"), F.lit(0.0)))
    return total / F.size(expected) + read_rms**2


def band_powers(frames: DataFrame, keys: Sequence[str], bands: dict[str, Column]) -> DataFrame:
    """Spectral power per named set of frequency positions, plus the total, summed inside each row."""
    cell = F.transform(F.arrays_zip("re", "im"), lambda c, i: F.struct(i.alias("i"), (c["re"] * c["re"] + c["im"] * c["im"]).alias("p")))
    def total(cells: Column) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c["p"])

    def within(positions: Column) -> Column:
        return F.filter(cell, lambda c: F.array_contains(positions, c["i"]))

    return frames.select(*keys, total(cell).alias("total"), *[total(within(p)).alias(name) for name, p in bands.items()])


def relative_high_band(frames: DataFrame, keys: Sequence[str], mask: list[float]) -> DataFrame:
    """Weighted high-band discrepancy of spectrum a against b: sum m|a-b|^2 / sum m|b|^2 per row group."""
    keys = list(keys)
    cells = F.zip_with(F.arrays_zip("a_re", "a_im", "b_re", "b_im"), F.array(*[F.lit(float(m)) for m in mask]), lambda c, m: F.struct(
        (m * ((c["a_re"] - c["b_re"]) * (c["a_re"] - c["b_re"]) + (c["a_im"] - c["b_im"]) * (c["a_im"] - c["b_im"]))).alias("n"),
        (m * (c["b_re"] * c["b_re"] + c["b_im"] * c["b_im"])).alias("d")))
    total = lambda part: F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c[part])
    per_row = frames.select(*keys, total("n").alias("n"), total("d").alias("d"))
    return per_row.groupBy(*keys).agg(F.when(F.sum("d") > 0, F.sum("n") / F.sum("d")).otherwise(F.lit(float("inf"))).alias("e_h"))


def constrained_estimate(sums: DataFrame, keys: Sequence[str], lam: float, support: np.ndarray, *, smoothing: float = 0.0,
                         iterations: int = 512, tolerance: float = 1e-8) -> DataFrame:
    """Non-negative, band-limited estimate per key from the same Wiener sums.

    The frames enter only through the distributed sums; what is left is a problem
    of one plane per key, solved by accelerated projected gradient steps. With
    ``smoothing`` an isotropic, rounded total variation is added.
    """
    keys = list(keys)
    height, width = support.shape
    gathered = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "num_re", "num_im", "power"))).alias("c"))
    part = lambda n: F.transform("c", lambda c: c[n])

    @F.arrow_udf("array<double>")
    def solve(re: pa.Array, im: pa.Array, power: pa.Array) -> pa.Array:
        out = []
        for row in zip(re, im, power):
            r, i, p = (np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=float).reshape(height, width) for v in row)
            out.append(_projected_solution(r + 1j * i, p + lam, support, smoothing, iterations, tolerance).ravel().tolist())
        return pa.array(out, type=pa.list_(pa.float64()))

    return gathered.select(*keys, solve(part("num_re"), part("num_im"), part("power")).alias("pixels"))


def project_feasible(plane: np.ndarray, support: np.ndarray, rounds: int = 256, tolerance: float = 1e-12) -> np.ndarray:
    """Nearest plane that is both non-negative and limited to ``support`` in frequency (Dykstra's alternation)."""
    x, p, q = plane, np.zeros_like(plane), np.zeros_like(plane)
    for _ in range(rounds):
        y = np.maximum(x + p, 0.0)
        p = x + p - y
        z = np.fft.ifft2(np.fft.fft2(y + q) * support).real
        q = y + q - z
        if np.linalg.norm(z - x) <= tolerance * max(np.linalg.norm(z), 1e-30):
            return z
        x = z
    return x


def _variation_slope(plane: np.ndarray, rounding: float = 1.0) -> np.ndarray:
    dx, dy = np.roll(plane, -1, 1) - plane, np.roll(plane, -1, 0) - plane
    size = np.sqrt(dx * dx + dy * dy + rounding * rounding)
    ux, uy = dx / size, dy / size
    return -(ux - np.roll(ux, 1, 1)) - (uy - np.roll(uy, 1, 0))


def _projected_solution(numerator, power, support, smoothing, iterations, tolerance) -> np.ndarray:
    step = 1.0 / (power.max() + 8.0 * smoothing)
    x = project_feasible(np.fft.ifft2(numerator / np.maximum(power, C.DENOMINATOR_FLOOR)).real, support)
    ahead, momentum = x, 1.0
    for _ in range(iterations):
        slope = np.fft.ifft2(power * np.fft.fft2(ahead) - numerator).real
        if smoothing:
            slope = slope + smoothing * _variation_slope(ahead)
        following = project_feasible(ahead - step * slope, support, rounds=48, tolerance=1e-9)
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = following + (momentum - 1) / grown * (following - x)
        done = np.linalg.norm(following - x) <= tolerance * max(np.linalg.norm(following), 1e-30)
        x, momentum = following, grown
        if done:
            break
    return project_feasible(x, support)
