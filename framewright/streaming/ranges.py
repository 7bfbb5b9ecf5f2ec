"""Bounded micro-batches of captures: a manifest of frame ranges, streamed file by file.

A Python data source has no say in how much a trigger takes, so a capture is first written down as
small files, each naming up to ``step`` frames. Spark's file stream takes ``per_batch`` of them at a
time, remembers which it has seen, and the frames are read in the tasks that get the ranges. Each batch therefore
holds a bounded number of frames and leaves a stack of all batches so far; a failed one repeats alone.
A manifest can be added to while the stream runs or between its starts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framewright.sources import ser


def write_manifest(spark: SparkSession, captures: str, folder: str, step: int, **options: str) -> int:
    """Add the frames of a capture, or of all captures of a folder, to the manifest in ``folder``; returns the number of ranges."""
    if step < 1:
        raise ValueError("a range needs at least one frame")
    ranges = ser.whole_chunks(spark, captures, step, **options)
    target = f"{folder.rstrip('/')}/part={uuid.uuid4().hex}"
    # One range a file: the file stream counts files.
    ranges.coalesce(1).write.option("maxRecordsPerFile", 1).json(target)
    return spark.read.schema(ser.CHUNKS).json(target).count()


def stream_frames(spark: SparkSession, folder: str, per_batch: int = 1, **options: str) -> DataFrame:
    """A stream of the frames of a manifest, ``per_batch`` ranges in each micro-batch."""
    ranges = spark.readStream.schema(ser.CHUNKS).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").json(folder)
    return ser.read_chunks(ranges, **options)
