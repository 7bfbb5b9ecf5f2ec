"""Kernels and stacks against brute force and analytic scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import kernels as K
from framewright.operators import fourier as FO
from framewright.operators import frames as FR
from framewright.operators import local as LO
from framewright.operators import stacking as ST
from framewright.sources.captures import from_arrays


def planet(height=96, width=112, cx=56.0, cy=48.0, a=23.0, b=18.0, blur=1.0):
    y, x = np.indices((height, width))
    disc = 200 + 30000.0 * (((x - cx) / a) ** 2 + ((y - cy) / b) ** 2 <= 1) * (1 + 0.2 * np.sin(x / 3) * np.cos(y / 4))
    return K.gaussian(disc[None], blur)[0]


def test_measure_finds_extent_and_ranks_blur(spark):
    frames = np.stack([planet(blur=s) for s in (0.8, 1.6, 3.0)] + [np.full((96, 112), 200.0)])
    rows = from_arrays(spark, "p", frames).withColumn("m", FR.measured()).orderBy("frame_index").select("m.*").collect()
    assert [r.status for r in rows] == ["ok", "ok", "ok", "no_target"]
    assert rows[0].quality > rows[1].quality > rows[2].quality
    assert rows[0].width_px == pytest.approx(47, abs=4) and rows[0].height_px == pytest.approx(37, abs=4)


def test_measure_routes_bad_frames(spark):
    hot = np.full((32, 32), 65535.0)
    edge = np.zeros((40, 40))
    edge[:, :12] = 20000
    rows = from_arrays(spark, "p", hot[None]).withColumn("m", FR.measured()).select("m.status").collect()
    assert rows[0].status == "saturated"
    edge = K.gaussian(edge[None], 1.0)[0]
    assert from_arrays(spark, "p", edge[None]).withColumn("m", FR.measured()).first().m.status in ("clipped_target", "no_target")


def test_components_equal_flood_fill():
    rng = np.random.default_rng(0)
    mask = rng.random((40, 37)) > 0.45
    lab = K.components(mask)
    seen, want = np.full(mask.shape, -1), 0
    for y, x in np.argwhere(mask):
        if seen[y, x] >= 0:
            continue
        todo, want = [(y, x)], y * mask.shape[1] + x
        while todo:
            j, i = todo.pop()
            if 0 <= j < mask.shape[0] and 0 <= i < mask.shape[1] and mask[j, i] and seen[j, i] < 0:
                seen[j, i] = want
                todo += [(j + 1, i), (j - 1, i), (j, i + 1), (j, i - 1)]
    assert np.array_equal(lab, seen)


def test_shift_matches_bilinear_sampling():
    rng = np.random.default_rng(1)
    plane = rng.random((9, 11))
    y, x = np.indices(plane.shape, dtype=float)
    for dx, dy in ((0.0, 0.0), (1.25, -2.5), (-3.0, 0.5), (20.0, 0.0)):
        got = K.shift_linear(plane[None], np.array([dx]), np.array([dy]))[0]
        assert np.allclose(got, K.sample_bilinear(plane, y + dy, x + dx))


def test_translation_recovers_known_shift(spark):
    base = planet()
    moved = np.stack([K.shift_linear(base[None], np.array([-dx]), np.array([-dy]))[0] for dx, dy in ((0.0, 0.0), (3.0, -2.0), (1.5, 2.25))])
    rows = from_arrays(spark, "p", np.rint(moved)).withColumn("s", FR.translation(base)).orderBy("frame_index").select("s.*").collect()
    assert np.allclose([[r.dx, r.dy] for r in rows], [[0, 0], [3, -2], [1.5, 2.25]], atol=0.15)


def test_stack_equals_weighted_mean_for_mixed_keys(spark):
    rng = np.random.default_rng(2)
    data = rng.random((30, 12))
    rows = [(int(i % 3), int(i), float(i % 5 + 1), data[i].tolist()) for i in range(30)]
    frames = spark.createDataFrame(rows, "k int, i int, w double, pixels array<double>").repartition(4)
    got = ST.normalise(ST.stack(frames, ["k"], F.col("pixels"), F.col("w"))).toPandas().set_index(["k", "pos"]).value
    for k in range(3):
        pick = [i for i in range(30) if i % 3 == k]
        want = np.average(data[pick], axis=0, weights=[i % 5 + 1 for i in pick])
        assert np.allclose(got.loc[k].sort_index(), want)


def test_ring_filters_are_a_partition_of_unity():
    for shape in ((66, 124), (63, 64), (5, 7)):
        assert np.allclose(K.ring_filters(*shape).sum(axis=0), 1.0)


@pytest.mark.parametrize("values, fit", [([3., 1., 2., 0.], [3, 1.5, 1.5, 0]), ([1., 2.], [1.5, 1.5]), ([2., 2., 5., 1.], [3, 3, 3, 1])])
def test_non_increasing_fit(spark, values, fit):
    row = spark.createDataFrame([(values,)], "v array<double>").select(FO.non_increasing(F.col("v")).alias("f")).first()
    assert row.f == pytest.approx(fit)


def test_rank_trend_equals_polyfit(spark):
    rng = np.random.default_rng(3)
    ranks, values = [0, 1, 2, 4, 5, 7], (rng.random(6) + 0.5).tolist()
    row = spark.createDataFrame([(ranks, values)], "r array<int>, v array<double>").select(
        FO.quadratic_log_trend(F.col("r"), F.col("v")).alias("t")).first()
    x = np.array(ranks) / 7
    assert row.t == pytest.approx(np.exp(np.polyval(np.polyfit(x, np.log(values), 2), x)))


def test_equal_bin_weights_reproduce_the_ordinary_stack(spark):
    rng = np.random.default_rng(5)
    frames = spark.createDataFrame([(1, i % 4, (i // 4) % 2, rng.random(64).tolist()) for i in range(40)],
                                   "capture_id int, bin int, half int, pixels array<double>")
    acc = ST.stack(frames, ["capture_id", "bin", "half"], F.col("pixels"), F.lit(1.0)).cache()
    planes = FO.bin_planes(acc, ["capture_id"])
    weights = spark.range(4).selectExpr("1 AS capture_id", "cast(id AS int) AS bin", f"explode(sequence(0, {FO.RINGS - 1})) AS band",
                                        "1.0D AS weight")
    got = FO.combine_bins(planes, weights, ["capture_id"], 8, 8).first().weighted
    total = acc.groupBy("pos").agg((F.sum("sum_wv") / F.sum("sum_w")).alias("v")).orderBy("pos").toPandas().v
    assert np.allclose(got, total)


def test_wiener_recovers_a_blurred_scene(spark):
    rng = np.random.default_rng(0)
    truth = K.gaussian(rng.random((1, 32, 32)) * 100, 1.5)[0]
    rows = []
    for s in (0.6, 0.8, 1.0, 1.2):
        otf = np.exp(-2 * (np.pi * s) ** 2 * (np.fft.fftfreq(32)[:, None] ** 2 + np.fft.fftfreq(32)[None, :] ** 2))
        image = np.fft.fft2(truth) * otf
        rows.append((1, *[p.ravel().tolist() for p in (image.real, image.imag, otf, np.zeros_like(otf))], 1.0))
    frames = spark.createDataFrame(rows, "k int, i_re array<double>, i_im array<double>, h_re array<double>, h_im array<double>, sigma2 double")
    got = np.array(FO.wiener_estimate(FO.wiener_sums(frames, ["k"]), ["k"], 1e-8, 32, 32).first().pixels).reshape(32, 32)
    assert np.linalg.norm(got - truth) / np.linalg.norm(truth) < 0.02


def test_footprints_blend_local_and_global():
    near = LO.Footprints(20, 20, np.array([5.0, 14.0]), np.array([5.0, 14.0]), 8.0)
    assert np.allclose(near.weights(np.array([1.0, 1.0]), True), 1.0) and np.allclose(near.weights(np.zeros(2), False), 0.0)
    plane = near.weights(np.array([1.0, 0.0]), False)
    assert plane[5, 5] > 0.9 and plane[14, 14] < 0.1


def test_noise_of_a_known_scene(spark):
    rng = np.random.default_rng(3)
    y, x = np.indices((120, 144))
    disc = 500 + 2000.0 * ((x - 72) ** 2 + (y - 60) ** 2 < 45**2)
    frame = np.rint(K.gaussian(disc[None], 2.0)[0] + rng.normal(0, 8, disc.shape))
    row = from_arrays(spark, "n", frame[None]).withColumn("n", FR.frame_noise()).first().n
    assert row.noise == pytest.approx(8, rel=0.1) and row.signal == pytest.approx(2000, rel=0.1)


def test_feasible_projection_meets_both_constraints():
    rng = np.random.default_rng(8)
    support = np.hypot(np.fft.fftfreq(16)[:, None], np.fft.fftfreq(16)[None, :]) <= 0.3
    plane = rng.normal(1, 1, (16, 16))
    x = FO.project_feasible(plane, support, rounds=4000)
    assert x.min() > -1e-6 and np.allclose(np.fft.fft2(x) * ~support, 0, atol=1e-9)
    feasible = np.full((16, 16), 2.0)
    assert np.allclose(FO.project_feasible(feasible, support), feasible)


def test_constrained_estimate_keeps_a_feasible_scene(spark):
    support = np.hypot(np.fft.fftfreq(16)[:, None], np.fft.fftfreq(16)[None, :]) <= 0.4
    y, x = np.indices((16, 16))
    truth = 3 + np.cos(2 * np.pi * x / 16) + np.sin(2 * np.pi * y / 8)
    spectrum = np.fft.fft2(truth)
    rows = [(1, k, float(v.real), float(v.imag), 1.0) for k, v in enumerate(spectrum.ravel())]
    sums = spark.createDataFrame(rows, "k int, pos int, num_re double, num_im double, power double")
    for smoothing in (0.0, 1e-9):
        got = np.array(FO.constrained_estimate(sums, ["k"], 0.0, support, smoothing=smoothing).first().pixels).reshape(16, 16)
        assert np.allclose(got, truth, atol=1e-4)


def test_a_frame_without_weight_is_left_out_whole(spark):
    from framewright.operators import stacking as ST

    rows = [(1, 1.0, [1.0, 2.0]), (1, 0.0, [float("nan"), 5.0]), (1, None, [float("nan"), 5.0]), (1, 3.0, [5.0, 2.0]), (2, 0.0, [9.0, 9.0])]
    frames = spark.createDataFrame(rows, "k int, w double, v array<double>")
    got = {(r.k, r.pos): (r.value, r.valid) for r in ST.normalise(ST.stack(frames, ["k"], F.col("v"), F.col("w"))).collect()}
    assert got == {(1, 0): (4.0, True), (1, 1): (2.0, True), (2, 0): (0.0, False), (2, 1): (0.0, False)}


def test_settings_that_the_job_cannot_honour_are_errors(spark):
    from framewright.config import Settings
    from framewright.plans import pipeline

    for settings in (Settings(local_alignment=True, fourier_power=2), Settings(geometry="field", fourier_power=2)):
        with pytest.raises(ValueError):
            pipeline._refuse(settings)
    for facts in ([("a", "RGGB")], [("a", "RGB")], [("a", "mono"), ("b", "mono")]):
        with pytest.raises(ValueError, match="one mono capture"):
            pipeline._fourier_stack(spark, "a.ser", None, spark.createDataFrame(facts, "capture_id string, pattern string"), Settings(fourier_power=4))
    for missing in ({"geometry": "surface"}, {"geometry": "saturn", "radius_px": 3.0}, {"cadence_s": 0.0}, {"calibration": {"sky": "x"}}):
        with pytest.raises(ValueError):
            Settings.from_dict(missing)
    pipeline._refuse(Settings(fourier_power=4, brightness_percent=50))
    pipeline._refuse(Settings(local_alignment=True, geometry="surface", radius_px=30.0))


def test_digest_tree_does_not_depend_on_its_depth(spark):
    import hashlib

    from framewright.operators import provenance as PV

    leaves = spark.createDataFrame([(1, k, f"{k:02d}") for k in range(20)] + [(2, 0, "x")], "g int, at long, d string")
    got = {r.g: (r.leaves, r.digest) for r in PV.ordered_digest(leaves, ["g"], "at", "d", block=3).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def up(nodes):
        return [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]

    nodes = up(up([f"{k:02d}" for k in range(20)]))
    while len(nodes) > 1:
        nodes = up(nodes)
    assert got == {1: (20, nodes[0]), 2: (1, sha(sha("x")))}


def test_measure_judges_each_plane_of_a_block_on_its_own():
    y, x = np.indices((41, 45))
    disc = 100 + 5000.0 * ((x - 22) ** 2 / 81 + (y - 20) ** 2 / 25 <= 1)
    turned = 100 + 5000.0 * ((x - 22) ** 2 / 25 + (y - 20) ** 2 / 81 <= 1)
    block = np.stack([disc, np.full(disc.shape, 100.0), np.roll(disc, 18, axis=1), turned])
    found, status = K.measure(block, bayer=False)
    assert status.tolist() == ["ok", "no_target", "clipped_target", "ok"]
    assert np.isnan(found[1:3]).all() and found[0, 1] > found[0, 2] and found[3, 3] == pytest.approx(np.pi / 2, abs=0.1)
    for k, plane in enumerate(block):
        alone, one = K.measure(plane[None])
        assert one[0] == status[k] and np.allclose(alone[0], found[k], equal_nan=True)


def test_rings_of_bins_without_cover_or_target_are_unmeasured(spark):
    rng = np.random.default_rng(9)
    cell = lambda a: np.asarray(a, float).ravel().tolist()
    parts = [rng.random((8, 8)) + 1 for _ in range(3)]
    one, gap = np.ones((8, 8)), np.where(np.indices((8, 8))[0] == 4, 0.0, 1.0)
    rows = [(k, cell(parts[0]), cell(one), cell(parts[1]), cell(w1), cell(sum(parts)), cell(3 * one)) for k, w1 in ((0, one), (1, gap))]
    rows.append((2, None, *rows[0][2:]))
    names = ["h0_wv", "h0_w", "h1_wv", "h1_w", "all_wv", "all_w"]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} array<double>" for n in names)).coalesce(1)
    window = np.outer(np.hanning(10), np.hanning(10))[1:-1, 1:-1]
    got = [r.m for r in df.withColumn("m", FO.measure_rings(8, 8, window)).orderBy("k").collect()]
    assert got[2] is None and got[1].transfer is None and got[1].depth > 0
    spectra = [np.fft.fft2((p - (p * window).sum() / window.sum()) * window) for p in (sum(parts[:2]) / 2, parts[2], parts[0], parts[1])]
    own, rest, a, b = spectra
    filters = K.ring_filters(8, 8)
    want = [((own * rest.conj()).real * f).sum() / (abs(rest) ** 2 * f).sum() for f in filters[12:14]]
    assert got[0].depth == pytest.approx(2) and got[0].transfer[12:14] == pytest.approx(want) and got[0].transfer[0] == 0
    assert got[0].residual[12] == pytest.approx((abs(a - b) ** 2 * filters[12]).sum() / filters[12].sum() / 4)


def test_digests_of_any_size(spark):
    """Above block^4 leaves the tree still ends in one digest."""
    import hashlib

    from framewright.operators import provenance as PV

    sizes = {1: 40, 2: 16, 3: 5, 4: 1}
    leaves = spark.createDataFrame([(g, k, f"{k:02d}") for g, n in sizes.items() for k in range(n)], "g int, at long, d string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def up(nodes):
        return [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]

    trees = {}
    for g, n in sizes.items():
        blocks = up([f"{k:02d}" for k in range(n)])
        nodes = up(blocks)
        while len(nodes) > 1:
            nodes = up(nodes)
        trees[g] = (n, nodes[0])
    assert [(r.g, (r.leaves, r.digest)) for r in PV.ordered_digest(leaves, ["g"], "at", "d", block=2).orderBy("g").collect()] == list(trees.items())
    assert PV.ordered_digest(leaves.limit(0), ["g"], "at", "d").count() == 0
