"""Opening captures: files by suffix, arrays, calibrated truth tables."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from framewright.session import ship_package
from framewright.sources.avi import AviSource
from framewright.sources.ser import SCHEMA, SerSource

FORMATS = {".ser": "ser", ".avi": "avi", ".parquet": "parquet"}


def register(spark: SparkSession) -> None:
    """Make the capture formats known and let frame filters reach them."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SerSource, AviSource):
        spark.dataSource.register(source)


def open_capture(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Frames of a capture, the format chosen by the file suffix; a folder is read as the SER captures in it."""
    suffix = os.path.splitext(path)[1].lower()
    if not suffix and os.path.isdir(path) and any(n.lower().endswith(".ser") for n in os.listdir(path)):
        suffix = ".ser"
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {suffix or 'a file without a suffix'}; known: {', '.join(FORMATS)}")
    register(spark)
    return spark.read.format(FORMATS[suffix]).options(**options).load(path)


def from_arrays(spark: SparkSession, capture_id: str, frames: np.ndarray, *, colour: str = "mono", depth: int = 16,
                ticks: np.ndarray | None = None) -> DataFrame:
    """Small in-memory captures, mainly for tests."""
    frames = np.asarray(frames)
    rows = pd.DataFrame({
        "capture_id": capture_id, "frame_index": np.arange(len(frames)),
        "ts_ticks": pd.array(ticks if ticks is not None else [None] * len(frames), dtype="Int64"),
        "height": frames.shape[1], "width": frames.shape[2], "channels": frames.shape[3] if frames.ndim == 4 else 1,
        "color_mode": colour, "bit_depth": depth, "pixels": [f.astype("<u2").tobytes() for f in frames]})
    return spark.createDataFrame(rows, SCHEMA)


def read_truth(spark: SparkSession, folder: str, crop: str) -> DataFrame:
    """Truth frames of one crop from the Parquet family; the crop is a partition column."""
    return spark.read.parquet(f"{folder}/truth_frames").where(f"crop = '{crop}'")


def write_truth(frames: DataFrame, folder: str) -> None:
    frames.write.mode("errorifexists").partitionBy("crop", "regime").parquet(f"{folder}/truth_frames")
