"""Ordering across parts against brute force, with a hot group, heavy ties, null groups and many small parts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.operators import ordering as O


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    n = 3000
    capture = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n))
    value = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.normal(10, 5, n), 1))  # one value is very common
    return pd.DataFrame({"capture_id": capture, "frame_index": rng.permutation(n), "q": value})


@pytest.fixture(scope="module")
def frames(spark, table):
    return spark.createDataFrame(table).repartition(7)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("tie_descending", [True, False])
def test_rank_is_exact_across_segments(table, frames, descending, tie_descending):
    got = O.rank_rows(frames, ["capture_id"], "q", "frame_index", descending=descending, tie_descending=tie_descending,
                      partitions=50).toPandas().set_index("frame_index")["rank"]
    ordered = table.sort_values(["capture_id", "q", "frame_index"], ascending=[True, not descending, not tie_descending])
    want = (ordered.groupby("capture_id").cumcount() + 1).set_axis(ordered.frame_index)
    assert (got.sort_index() == want.sort_index()).all()


def test_parts_stay_small(frames):
    rows = O.dealt(frames, ["capture_id"], "q", "frame_index", partitions=50)
    sizes = rows.groupBy("_part").count()
    assert sizes.count() > 40 and sizes.agg(F.max("count")).first()[0] < 200  # the hot group has 1800 rows, 40 % of them equal


def test_few_leaves_and_one_plan(spark, frames):
    """No plan depends on the size of the input, and ranks of ranks do not multiply what is read."""
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    ranked = O.rank_rows(frames, ["capture_id"], "q", "frame_index", size="n")
    assert leaves(ranked) == 2 and leaves(O.rank_rows(ranked, ["capture_id"], "n", "frame_index", name="again")) == 2
    assert leaves(O.medians(frames, ["capture_id"], {"m": "q", "f": "frame_index"})) == 1
    one = O.rank_rows(frames, ["capture_id"], "q", "frame_index", partitions=1)
    many = O.rank_rows(frames, ["capture_id"], "q", "frame_index", partitions=80)
    assert one.exceptAll(many).count() == 0


def test_null_groups_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 3, 1.0), (None, 1, 2.0), (1, 2, None), (1, 4, 5.0)], "capture_id int, frame_index int, q double")
    got = {r.frame_index: (r["rank"], r.n) for r in O.rank_rows(rows, ["capture_id"], "frame_index", "frame_index", size="n", partitions=3).collect()}
    assert got == {1: (1, 2), 3: (2, 2), 2: (1, 2), 4: (2, 2)}
    sums = {r.frame_index: r.s for r in O.running_sum(rows, ["capture_id"], "frame_index", "frame_index", F.col("q"), name="s", partitions=3).collect()}
    assert sums[1] == 2.0 and sums[3] == 3.0 and sums[4] == 5.0
    before = {r.frame_index: r.b for r in O.previous_row(rows, ["capture_id"], "frame_index", "frame_index", "q", name="b", partitions=3).collect()}
    assert before == {1: None, 3: 2.0, 2: None, 4: None}
    none = rows.limit(0)
    assert O.rank_rows(none, ["capture_id"], "q", "frame_index").count() == 0 and O.quantiles(none, ["capture_id"], "q", {"m": 0.5}).count() == 0


def test_running_sum_and_previous_row(table, frames):
    s = O.running_sum(frames, ["capture_id"], "frame_index", "frame_index", F.col("q"), name="total", partitions=40)
    p = O.previous_row(s, ["capture_id"], "frame_index", "frame_index", "q", name="before", partitions=40)
    got = p.toPandas().sort_values(["capture_id", "frame_index"])
    want = table.sort_values(["capture_id", "frame_index"])
    assert np.allclose(got.total, want.groupby("capture_id").q.cumsum())
    before = want.groupby("capture_id").q.shift()
    assert np.array_equal(got.before.to_numpy(dtype=float), before.to_numpy(), equal_nan=True)


def test_quantiles_match_numpy(table, frames):
    got = O.quantiles(frames, ["capture_id"], "q", {"a": 0.5, "b": 0.16, "c": 0.84}, partitions=30).toPandas().set_index("capture_id")
    for capture, rows in table.groupby("capture_id"):
        assert np.allclose(got.loc[capture, ["a", "b", "c"]].astype(float), np.percentile(rows.q, [50, 16, 84]))
