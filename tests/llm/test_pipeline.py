"""The pipeline stage by stage against brute force, and the queries against their SQL, on the smallest tables."""

import glob
import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm.queries import QUERIES
from tests.llm.test_operators import sets
from tools.check_queries import canonical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not available")


@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    plan, sql = QUERIES[name]
    df, relation = plan(spark, FOLDER), con.sql(sql)
    assert canonical(df.collect(), df.columns) == canonical(relation.fetchall(), relation.columns)


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = [r for r in QUERIES["op7_language_id"][0](spark, FOLDER).collect() if r.held_out and docs[r.doc_id]]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in found)
    assert sum(r.lang_pred == docs[r.doc_id] for r in found) >= 0.97 * len(found)
    folder = FOLDER.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in QUERIES["op4_quality"][0](spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(spark.createDataFrame(
        [(10_000, "123 ...", None, "x", 7), (10_001, None, None, None, None), (10_002, "Lo que dice la gente", "es", "x", 20), (10_002, "Lo que dice la gente", "es", "x", 20)],
        "doc_id long, text string, lang string, source string, n_chars long")).withColumn("kept", F.lit("mine"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(k)))
        assert out.columns[: len(docs.columns)] == docs.columns
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    languages, copies, near, clean, coded = kept
    assert set(texts) - set(languages) == {10_000, 10_001} and languages.count(10_002) == 2
    best = {}
    for d in languages:
        best[texts[d]] = max(d, best.get(texts[d], d))
    assert copies == sorted(best.values())
    own, label = {d: sets(texts[d], 5) for d in copies}, {d: d for d in copies}
    for _ in range(3):
        for a in copies:
            for b in copies:
                if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert near == sorted(d for d in copies if label[d] == d)
    judged = {r.doc_id: r.contaminated for r in QUERIES["op8_decontamination"][0](spark, FOLDER).collect()}
    assert clean == [d for d in near if not judged.get(d)] and coded == clean
    assert docs.where(~F.col("round_trip")).count() == 0 and hashlib.sha256(b"").hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
