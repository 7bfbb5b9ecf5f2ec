"""Columns of a caller whose names a stage uses itself, and equal benchmark rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import decontam, exact, minhash


@pytest.fixture(scope="module")
def docs(spark):
    draw = np.random.default_rng(1)
    base = [f"w{k}" for k in draw.integers(0, 500, 80)]
    near = [*base[:40], "other", *base[41:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, None), (5, "")]
    names = ("gone_id", "d_id", "d_sha", "found", "sha", "kept", "cid", "d", "a", "b")
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})


def test_clashing_names_pass_through(docs):
    near, equal = minhash.deduplicated(docs, size=2), exact.deduplicated(docs)
    assert near.columns == equal.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == [1, 4, 5] and sorted(r.doc_id for r in equal.collect()) == [2, 3, 5]
    assert near.where("gone_id <> 'gone_id' OR a <> 'a'").count() == 0 and equal.where("d_sha <> 'd_sha'").count() == 0


def test_equal_benchmark_rows_count_once(spark, docs):
    item = " ".join(docs.where("doc_id = 1").first().text.split()[:20])
    many = spark.createDataFrame([(7, item)] * 300, "item_id long, text string")
    one = decontam.decontaminated(docs, many.limit(1), block_bytes=64).select("doc_id")
    all_of_them = decontam.decontaminated(docs, many, block_bytes=64).select("doc_id")
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in all_of_them.collect()) == [4, 5]
