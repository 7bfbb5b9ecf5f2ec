"""The supplied tables seen as captures, frames, measurements and evaluation rows.

Each binding is a narrow projection over one parquet table, so column pruning and
filters reach the scan. Keys follow one convention everywhere: ``capture_id``
groups frames, ``frame_index`` orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp read in the session zone (UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as measured frames: one supplier is one capture."""
    tax = F.round(F.col("l_tax") * 100).cast("int")
    status = (
        F.when(tax == 8, "saturated").when(tax == 7, "clipped_target").when(tax == 0, "no_target")
        .when((tax == 1) & (F.col("l_linenumber") == 7), "invalid").otherwise("ok")
    )
    index = F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return load(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("capture_id"),
        index.alias("frame_index"),
        (F.col("l_extendedprice") / 1000).alias("quality"),
        F.col("l_quantity").alias("width_px"),
        (F.col("l_discount") * 100 + F.col("l_quantity") / 2).alias("height_px"),
        (F.col("l_linenumber") * 0.1).alias("angle_rad"),
        status.alias("status"),
    )


MEASUREMENTS_SQL = """
SELECT l_suppkey AS capture_id,
       l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS frame_index,
       l_extendedprice / 1000 AS quality, l_quantity AS width_px,
       l_discount * 100 + l_quantity / 2 AS height_px, l_linenumber * 0.1::DOUBLE AS angle_rad,
       CASE WHEN round(l_tax * 100)::INT = 8 THEN 'saturated' WHEN round(l_tax * 100)::INT = 7 THEN 'clipped_target'
            WHEN round(l_tax * 100)::INT = 0 THEN 'no_target'
            WHEN round(l_tax * 100)::INT = 1 AND l_linenumber = 7 THEN 'invalid' ELSE 'ok' END AS status
FROM lineitem"""


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding vectors as 8x8 frames: element k is pixel (k div 8, k mod 8)."""
    return load(spark, folder, "embeddings").select(
        F.col("label").cast("long").alias("capture_id"),
        F.col("vec_id").alias("frame_index"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.col("embedding").alias("pixels"),
    )


FRAMES_SQL = "SELECT label::BIGINT AS capture_id, vec_id AS frame_index, embedding AS pixels FROM embeddings"

PIXELS_SQL = """
SELECT label::BIGINT AS capture_id, vec_id AS frame_index, k, k // 8 AS y, k % 8 AS x, embedding[k + 1]::DOUBLE AS v
FROM embeddings, (SELECT unnest(range(64)) AS k)"""


def timed_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Events as time-stamped frames: one user is one capture; ticks are 100 ns since year 1."""
    return load(spark, folder, "events").select(
        F.col("user_id").alias("capture_id"),
        F.col("event_id").alias("frame_index"),
        (micros("ts") * 10 + F.lit(621_355_968_000_000_000)).alias("ts_ticks"),
        F.col("value").alias("quality"),
        F.col("event_type"),
        F.col("props"),
    )


TIMED_SQL = """
SELECT user_id AS capture_id, event_id AS frame_index, epoch_us(ts) * 10 + 621355968000000000 AS ts_ticks,
       value AS quality, event_type, props
FROM events"""


def gap_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as reconstruction gaps: priority is the regime, the customer is the seed."""
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("seed"),
        F.col("o_orderpriority").alias("regime"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(float("nan")))
        .otherwise(F.col("o_totalprice") / 1_000_000 - (F.length("o_orderpriority") - 5) * 0.02).alias("g"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "2-HIGH")).alias("pathological"),
    )


GAPS_SQL = """
SELECT o_orderkey AS row_id, o_custkey AS seed, o_orderpriority AS regime,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL
            ELSE o_totalprice / 1000000 - (length(o_orderpriority) - 5) * 0.02::DOUBLE END AS g,
       o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' AS pathological
FROM orders"""


def closure_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as closure trials: high-band errors of three estimators per trial."""
    return load(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("trial"),
        F.col("l_suppkey").alias("seed"),
        F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("regime"),
        (F.col("l_extendedprice") / 100_000 + 0.5).alias("eh_baseline"),
        (F.col("l_extendedprice") / 100_000 + 0.5 - F.col("l_discount") * 3 - F.col("l_tax")).alias("eh_blind"),
        (F.col("l_extendedprice") / 100_000 + 0.3 - F.col("l_tax") * 4).alias("eh_reference"),
        F.when(F.col("l_linenumber") == 7, "incomplete").otherwise("valid").alias("status"),
    )


CLOSURE_SQL = """
SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS trial, l_suppkey AS seed,
       l_returnflag || '-' || l_linestatus AS regime,
       l_extendedprice / 100000 + 0.5::DOUBLE AS eh_baseline,
       l_extendedprice / 100000 + 0.5::DOUBLE - l_discount * 3 - l_tax AS eh_blind,
       l_extendedprice / 100000 + 0.3::DOUBLE - l_tax * 4 AS eh_reference,
       CASE WHEN l_linenumber = 7 THEN 'incomplete' ELSE 'valid' END AS status
FROM lineitem"""
