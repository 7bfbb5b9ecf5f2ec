"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "framewright", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's SQL settings; cluster settings stay with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a fresh local folder only in local mode, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context_dir = spark.sparkContext.getCheckpointDir()
    if context_dir:
        return os.path.dirname(context_dir.rstrip("/"))
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(context, "_framewright_folder"):
        context._framewright_folder = tempfile.mkdtemp(prefix="framewright-")
    return context._framewright_folder


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a small derived table to the shared folder and read it back.

    The files give the optimizer the true size: below the broadcast threshold it
    is joined where the large side is read, above it the join is an ordinary
    shuffle with skew handling. Frames with pixels are therefore not shuffled to
    meet a per-capture table that turned out to be small.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the running application (once)."""
    context = spark.sparkContext
    if getattr(context, "_framewright_shipped", False):
        return
    import shutil

    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="framewright-"), "framewright"), "zip",
                                  root_dir=os.path.dirname(package), base_dir=os.path.basename(package))
    context.addPyFile(archive)
    context._framewright_shipped = True
