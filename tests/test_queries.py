"""Every registered query with SQL must agree with it on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_queries import canonical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not available")
# One or two per area here; tools/check_queries.py checks all of them.
SAMPLE = ("screen_two_sigma", "select_frame_count", "retained_counts", "top_fraction_grid", "weighted_pixel_stack", "binned_pixel_stack",
          "complete_colours", "registration_shifts", "wiener_estimate", "monotone_fit", "classify_gaps", "closure_summary", "motion_reference",
          "unwrapped_angles", "scene_layers", "globe_backprojection", "capture_digest", "streamed_stack")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = contract.queries()[name](spark, FOLDER)
    relation = con.sql(contract.oracle_sql()[name])
    assert canonical(df.collect(), df.columns) == canonical(relation.fetchall(), relation.columns)


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
