"""Progressive stacks: micro-batches of frames folded into durable accumulators.

Each micro-batch writes its own partial sums under its batch id, so a replayed
batch overwrites itself and a restarted query goes on from the checkpoint. The
stack so far is the sum over the committed batches; nothing is kept in memory
between them. An identity file ties the accumulators to their settings.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import stacking as ST


def identity(settings: dict) -> str:
    """Canonical digest of the settings that decide what an accumulator means."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, allow_nan=False).encode()).hexdigest()


def check_identity(spark: SparkSession, folder: str, settings: dict) -> None:
    """Claim a new accumulator folder or refuse one made with other settings."""
    path, wanted = f"{folder}/identity", identity(settings)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        found = spark.read.text(path).first()[0]
        if found != wanted:
            raise ValueError("these accumulators belong to other settings")
    else:
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(path)


def fold_stream(frames: DataFrame, folder: str, keys: list[str], values: Column, weight: Column, settings: dict | None = None,
                support: Column | None = None):
    """Start folding a stream of frames into ``folder``; returns the running query."""
    check_identity(frames.sparkSession, folder, settings or {})

    def fold(batch: DataFrame, batch_id: int) -> None:
        sums = ST.stack(batch, keys, values, weight, support)
        used = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_used"))
        sums.write.mode("overwrite").parquet(f"{folder}/sums/batch={batch_id}")
        used.write.mode("overwrite").parquet(f"{folder}/used/batch={batch_id}")

    return (frames.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start())


def stack_so_far(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Accumulated sums over all committed batches."""
    sums = spark.read.parquet(f"{folder}/sums")
    return sums.groupBy(*keys, "pos").agg(F.sum("sum_wv").alias("sum_wv"), F.sum("sum_w").alias("sum_w"))


def frames_used(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(f"{folder}/used").groupBy(*keys).agg(F.sum("n_used").alias("n_used"))
