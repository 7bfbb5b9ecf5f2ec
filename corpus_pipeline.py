"""A corpus pipeline: language, exact copies, near copies, benchmark passages, tokens.

Each stage takes what its predecessor kept, as a table of the columns of ``documents``
(the last adds its tokens), and its decisions take effect.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, decontam, exact, language, minhash
from framewright.llm.common import table
from framewright.session import shared_folder, ship_package

LEAST_SCORE = 0.5
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is a guess; learns from the labelled ones."""
    ship_package(spark)
    name = decontam.fresh(docs, "found")
    judged = docs.withColumn(name, language.identified(docs, language.learn(docs)))
    found = F.col(name)
    unsure = found.lang_pred.isNotNull() & (found.score < LEAST_SCORE)
    return judged.where(~F.coalesce(found.lang_pred == "und", F.lit(False)) & ~unsure).drop(name)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text."""
    ship_package(spark)
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of documents linked by near-equal sets of five-word shingles."""
    ship_package(spark)
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which one word in twenty or more stands in a benchmark passage."""
    ship_package(spark)
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids, their number, and whether they decode to the text again."""
    ship_package(spark)
    done = bpe.coded(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.withColumns({"n_tokens": F.size("ids").cast("bigint"), "round_trip": F.col("decoded") == text}).drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

# Naive Bayes scores and token ids are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
