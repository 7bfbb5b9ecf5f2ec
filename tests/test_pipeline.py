"""Whole jobs over a synthetic capture, and local alignment of a known field."""

import numpy as np
import pytest

from framewright import schemas
from framewright.config import Settings
from framewright.functions import kernels as K
from framewright.operators import points as PT
from framewright.plans import pipeline
from framewright.sources import ser
from framewright.sources.captures import from_arrays
from tests.test_frames import planet


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    rng = np.random.default_rng(5)
    frames = []
    for k in range(24):
        base = planet(blur=1.0 + 0.05 * (k % 8))
        moved = K.shift_linear(base[None], np.array([rng.uniform(-2, 2)]), np.array([rng.uniform(-2, 2)]))[0]
        frames.append(np.clip(moved + rng.normal(0, 300, moved.shape), 0, 65000))
    frames[7] = np.full_like(frames[7], 300.0)
    folder = tmp_path_factory.mktemp("capture")
    return ser.write_ser(str(folder / "p.ser"), np.rint(frames).astype(np.uint16)), folder


def test_preprocess_then_stack(spark, capture):
    path, folder = capture
    selected = pipeline.preprocess(spark, path, str(folder / "sel"))
    assert schemas.schema_errors(selected, schemas.MEASUREMENTS) == []
    rows = {r.frame_index: r for r in selected.collect()}
    assert len(rows) == 24 and rows[7].status == "no_target" and not rows[7].accepted
    again = pipeline.load_selection(spark, path, str(folder / "sel"))
    result, summary = pipeline.stack(spark, path, again, Settings(stack_percent=80, selection_mode="frame_count"))
    s = summary.first()
    assert s.frames_stacked == -(-s.screened_frames * 80 // 100)
    plane = np.array([r.value for r in result.orderBy("pos").collect()]).reshape(96, 112)
    sky = plane[5:15, 40:70]
    assert sky.std() < 200  # one frame has a noise of 300
    inner = plane[40:56, 44:68]
    assert inner.mean() > 20000
    pipeline.save(result, summary, Settings(), str(folder / "out"))


def test_fourier_stack_runs(spark, capture):
    path, folder = capture
    from framewright.operators import screening

    screened = screening.screen(spark.createDataFrame(
        [("p.ser", i, 10.0 - i * 0.1, 40.0, 30.0, 0.0, "ok") for i in range(24) if i != 7], schemas.MEASUREMENTS))
    result, _ = pipeline.stack(spark, path, screened, Settings(fourier_power=4.0, reference_passes=0))
    values = np.array([r.value for r in result.orderBy("pos").collect()])
    assert np.isfinite(values).all() and values.size == 96 * 112


def test_settings_are_checked():
    assert Settings.from_dict(Settings(stack_percent=50).to_dict()).stack_percent == 50
    for bad in ({"stack_percent": 0}, {"geometry": "x"}, {"unknown": 1}, {"point_size": 8}):
        with pytest.raises(ValueError):
            Settings.from_dict(bad)


def test_local_field_is_recovered(spark):
    rng = np.random.default_rng(1)
    h, w = 120, 160
    scene = 4000 + 400 * K.gaussian(rng.normal(0, 1, (1, h, w)), 2.0)[0] / 0.14
    y, x = np.indices((h, w), dtype=float)
    fx, fy = 1.2 * np.sin(2 * np.pi * y / 120), 1.2 * np.cos(2 * np.pi * x / 160)
    warped = K.sample_bilinear(scene, y - fy, x - fx)
    points = PT.place_points(scene, 32)
    assert len(points.centres) > 10
    shift = K.translations(warped[None], scene)[0]
    found = PT.match_frame(warped, shift, points)
    assert found[:, 5].mean() > 0.8
    gx, gy = PT.displacement(found, points)
    inner = np.s_[30:-30, 30:-30]
    assert np.sqrt(np.mean((shift[0] + gx - fx)[inner] ** 2 + (shift[1] + gy - fy)[inner] ** 2)) < 0.5
    rows = PT.match_rows(from_arrays(spark, "f", np.rint(warped)[None]), points)
    assert rows.count() == len(points.centres) and rows.where("ok").count() > 0.8 * len(points.centres)
