"""Hand-computed screening and selection rules."""

import pandas as pd
import pytest

from framewright.operators import evaluation as EV
from framewright.operators import quality, screening, selection


def measured(spark, rows):
    frame = pd.DataFrame(rows, columns=["quality", "width_px", "height_px"]).astype(float)
    frame["capture_id"], frame["frame_index"], frame["status"], frame["angle_rad"] = 1, range(len(frame)), "ok", 0.0
    return spark.createDataFrame(frame)


def accepted(df):
    return [r.frame_index for r in df.where("accepted").orderBy("frame_index").collect()]


def test_two_sigma_rules(spark):
    rows = [[10, 40, 30] for _ in range(30)]
    rows[0][0], rows[1][0], rows[2][1], rows[3][1], rows[4][2], rows[5][2] = 0, 20, 60, 20, 45, 15
    kept = accepted(screening.screen(measured(spark, rows)))
    assert kept == [1, *range(6, 30)]  # high quality stays, everything else outside two sigma goes


def test_limits_are_inclusive(spark):
    rows = [[0, 40, 30]] + [[10, 40, 30]] * 4  # row 0 lies exactly two sigma below
    assert accepted(screening.screen(measured(spark, rows))) == [0, 1, 2, 3, 4]
    assert accepted(screening.screen(measured(spark, [[5, 1, 1]]))) == [0]


def ranked_fixture(spark):
    q, a = [1, 8, 99, 8, 2, 3], [True, True, False, True, True, True]
    return spark.createDataFrame([(1, i, float(x), y) for i, (x, y) in enumerate(zip(q, a))],
                                 "capture_id int, frame_index int, quality double, accepted boolean")


@pytest.mark.parametrize("target", [None, 2])
def test_count_selection_ties(spark, target):
    frames = ranked_fixture(spark)
    pick = lambda p: sorted(r.frame_index for r in selection.select_by_count(frames, p, partitions=target).collect())
    assert pick(21) == [1, 3] and pick(1) == [1] and pick(100) == [0, 1, 3, 4, 5]


def test_threshold_equals_selection(spark):
    frames = ranked_fixture(spark)
    cut = selection.count_thresholds(frames, 21)
    kept = frames.where("accepted").join(cut, "capture_id").where(selection.within_threshold())
    assert sorted(r.frame_index for r in kept.collect()) == [1, 3]


def test_percent_is_checked(spark):
    for bad in (0, 101, 2.5, True):
        with pytest.raises(ValueError):
            selection.select_by_count(ranked_fixture(spark), bad)


def test_flat_range_keeps_all(spark):
    frames = screening.screen(measured(spark, [[5, 1, 1]] * 6))
    assert selection.select_by_range(frames, 30).where("selected").count() == 6
    counts = {r.percent: r.retained for r in selection.retained_counts(frames).collect()}
    assert set(counts.values()) == {6} and len(counts) == 100


def test_top_fraction_sizes_and_ties(spark):
    scores = spark.range(500).selectExpr("1 AS g", "id", "cast(id AS double) AS s")
    sizes = {r.p: r["count"] for r in selection.top_fractions(scores, ["g"], "s", "id").groupBy("p").count().collect()}
    assert sizes == {5: 25, 10: 50, 25: 125, 50: 250, 100: 500}
    flat = spark.range(5).selectExpr("1 AS g", "id", "1.0D AS s")
    pick = lambda **k: sorted(r.id for r in selection.top_fractions(flat, ["g"], "s", "id", (50,), **k).collect())
    assert pick() == [3, 4] and pick(higher_is_better=False) == [0, 1]  # 2.5 rounds to 2


def test_rank_bin_edges_match_bins(spark):
    frames = spark.range(100).selectExpr("1 AS capture_id", "id AS frame_index", "cast((id * 37) % 11 AS double) AS quality", "true AS accepted")
    direct = {r.frame_index: r.bin for r in selection.assign_rank_bins(frames, 5).collect()}
    edges = selection.rank_bin_edges(frames, 5)
    placed = {r.frame_index: r.b for r in frames.join(edges, "capture_id").select("frame_index", selection.bin_from_edges().alias("b")).collect()}
    assert placed == direct


def test_effective_frames(spark):
    used = spark.createDataFrame([(1, i, float(q)) for i, q in enumerate([1, 2, 3, 4])], "capture_id int, frame_index int, quality double")
    row = quality.stack_summary(used).first()
    assert row.effective_frames == pytest.approx(100 / 30)
    assert quality.stack_summary(used, quality_weighting=False).first().effective_frames == pytest.approx(4)


@pytest.mark.parametrize("gaps, flags, label", [
    ([.12] * 8 + [.11] * 4, [False] * 12, "strong"), ([.01] * 10 + [-.02, .02], [False] * 12, "negative"),
    ([.07] * 12, [False] * 12, "inconclusive"), ([0.] * 8 + [.15] * 4, [False] * 12, "inconclusive"),
    ([.2] * 12, [True] + [False] * 11, "pathological"), ([float("nan")] * 3, [False] * 3, "inconclusive")])
@pytest.mark.parametrize("target", [None, 3])
def test_gap_classes(spark, gaps, flags, label, target):
    rows = spark.createDataFrame([(4.0, g, f) for g, f in zip(gaps, flags)], "regime double, g double, pathological boolean")
    assert EV.classify_gaps(rows, ["regime"], partitions=target).first().label == label


def test_predicates(spark):
    rows = spark.createDataFrame([(.20, .12), (.11, .12), (.50, .04)], "a double, b double")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(EV.oracle_sensitive(F.col("a"), F.col("b"))).collect()] == [True, False, False]
