"""What joins broadcast: only tables that were counted, never one that Spark takes for small."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import common, components, minhash
from framewright.session import materialise


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_not_broadcast(spark):
    """Spark takes an exploded table to be as small as its arrays in their compressed files."""
    lists = materialise(spark.range(40).select("id", F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda k: (k + F.col("id")) % 30_000).alias("ks")), "lists")
    rows = lists.select("id", F.explode("ks").alias("key"))
    facts = materialise(spark.range(30_000).select(F.col("id").alias("key"), F.lit(7).cast("bigint").alias("c"), F.hash("id").alias("more")), "facts")
    met = common.met(rows, facts, ["key"], rows.count())
    assert planned(met).count("BroadcastHashJoin") == 2 and planned(met).count("SortMergeJoin") == 1  # two with the frequent keys
    assert met.count() == rows.join(facts.select("key"), "key").count() > 100_000


@pytest.mark.parametrize("most_rows, kind", [(10, "BroadcastHashJoin"), (9, "SortMergeJoin")])
def test_more_rows_than_allowed_are_shuffled(spark, most_rows, kind):
    joined = spark.range(30).join(common.sized(spark.range(10), most_rows), "id")
    assert re.findall(r"\w+Join\b", planned(joined)) == [kind] and joined.count() == 10


def test_near_duplicates_broadcast_counted_tables_only(spark, monkeypatch):
    """With no table small enough by count, all joins of op 1 are shuffled but those of frequent keys, two in each ``met``."""
    draw, rows = np.random.default_rng(8), []
    for k in range(12):
        base = [f"w{i}" for i in draw.integers(0, 300, 60)]
        rows += [(10 * k + j, " ".join([*base[:j], f"other{j}", *base[j + 1 :]] if j else base)) for j in range(4)]
    plans = []

    def seen(df, name="table"):
        plans.append((name, planned(df)))
        return materialise(df, name)

    for module in (minhash, components):
        monkeypatch.setattr(module, "materialise", seen)
    monkeypatch.setattr(components, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(minhash, "sized", lambda small, *_: common.sized(small, -1))
    found, links = minhash.grouped(spark.createDataFrame([*rows, (500, None)], "doc_id long, text string"), size=2)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(d, d // 10 * 10) for d, _ in rows] + [(500, 500)]
    plans += [("found", planned(found)), ("links", planned(links))]
    sent = {(name, joins) for name, plan in plans if (joins := len(re.findall("BroadcastHashJoin|BroadcastNestedLoopJoin", plan)))}
    assert sent == {("buckets", 2), ("judged", 2), ("found", 2)}, sent
