"""Motion references against brute force, with a hot capture, short captures, ties, repeated rows and missing values."""

import numpy as np
import pandas as pd
import pytest

from framewright import constants as C
from framewright.operators import timing as TM

SCHEMA = "capture_id long, frame_index long, ts_ticks long, quality double"


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    capture = np.concatenate([np.zeros(900), rng.integers(1, 30, 500), [40, 41, 41, 42, 42, 42, 42, 42]]).astype("int64")
    ticks = rng.integers(0, 500, capture.size) * C.TICKS_PER_SECOND
    ticks[-5:] = np.array([0, 1, 2, 3, 1000]) * C.TICKS_PER_SECOND  # nothing near the middle
    rows = pd.DataFrame({"capture_id": capture, "frame_index": rng.permutation(capture.size), "ts_ticks": ticks,
                         "quality": np.round(rng.normal(10, 2, capture.size), 1)})
    return pd.concat([rows, rows.iloc[[3, 950, -1]]], ignore_index=True)


@pytest.fixture(scope="module")
def frames(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("timing") / "measured_frames")
    missing = [(None, 5000, 7, 1.0), (0, 5001, 250 * C.TICKS_PER_SECOND, None), (50, 5002, None, 3.0), (51, 5003, 9, None)]
    whole = [tuple(r) for r in table.itertuples(index=False, name=None)] + missing
    spark.createDataFrame(whole, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def anchor(rows, policy):
    t = (rows.ts_ticks - rows.ts_ticks.min()) / C.TICKS_PER_SECOND
    rows = rows.assign(t=t, d=(t - t.max() / 2).abs(), w=-rows.quality)
    pool = rows[rows.d <= 0.1 * t.max()]
    if policy == "best":
        first, pool = rows.sort_values(["w", "frame_index"]).iloc[0], rows
    else:
        if len(pool) < min(4, len(rows)):
            pool = rows.sort_values(["d", "w", "frame_index"]).head(4)
        first = pool[pool.quality >= pool.quality.median()].sort_values(["d", "w", "frame_index"]).iloc[0]
    return int(first.frame_index), first.t, len(pool)


def test_motion_reference_equals_brute_force(table, frames):
    got = {r.capture_id: (r.anchor_index, r.anchor_s, r.pool) for r in TM.motion_reference(frames, partitions=9).collect()}
    pools = {k: anchor(g, "middle") for k, g in table.groupby("capture_id")}
    index, t, n = pools[0]
    pools[0] = index, t, n + 1  # the frame without quality is near the middle and counts, but is no anchor
    # A lone frame without a time is its capture's anchor; a capture without any quality has none.
    assert got == pools | {50: (5002, None, 1)}


def test_best_reference_equals_brute_force(table, frames):
    got = {r.capture_id: (r.anchor_index, r.anchor_s, r.pool) for r in TM.motion_reference(frames.where("frame_index < 5000"), policy="best").collect()}
    assert got == {k: anchor(g, "best") for k, g in table.groupby("capture_id")}


def test_last_choice_reads_the_written_pool(frames):
    """The frames are not read, joined and sorted anew for every step of the last choice: it takes four written tables."""
    out = TM.motion_reference(frames)
    assert not any("measured_frames" in f for f in out.inputFiles())
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 4


def test_best_reference_reads_frames_once(frames):
    assert TM.motion_reference(frames, policy="best")._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_seconds_join_a_written_table(table, frames):
    out = TM.with_seconds(frames.where("frame_index < 5000"))
    first = table.groupby("capture_id").ts_ticks.min()
    assert {r.frame_index: r.t_s for r in out.collect()} == {
        r.frame_index: (r.ts_ticks - first[r.capture_id]) / C.TICKS_PER_SECOND for r in table.itertuples()}
    assert not any("Aggregate" in line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines())
