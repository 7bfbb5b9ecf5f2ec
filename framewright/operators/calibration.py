"""Detector calibration: bias, dark, flat and gain tables of one frame in size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Calibration:
    """Tables on the detector lattice, flattened row-major; None leaves a step out."""

    bias: np.ndarray | None = None
    dark: np.ndarray | None = None
    flat: np.ndarray | None = None
    gain: float | None = None

    def check(self) -> None:
        for name in ("bias", "dark", "flat"):
            table = getattr(self, name)
            if table is not None and not np.isfinite(table).all():
                raise ValueError(f"{name} must be finite")
        if self.flat is not None and (np.asarray(self.flat) <= 0).any():
            raise ValueError("flat values must be positive")

    def slope_and_offset(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The whole calibration as value * slope - offset * slope per sample."""
        self.check()
        offset, slope = np.zeros(size), np.ones(size)
        for table in (self.bias, self.dark):
            if table is not None:
                offset = offset + np.ravel(table)
        if self.flat is not None:
            relative = np.ravel(self.flat) / np.max(self.flat)
            slope = np.median(relative) / relative
        return slope * (1.0 if self.gain is None else self.gain), offset


def load_calibration(bias: str | None = None, dark: str | None = None, flat: str | None = None,
                     gain: float | None = None) -> Calibration:
    """Read NPY tables without pickled objects."""
    read = lambda path: None if path is None else np.load(path, allow_pickle=False).astype(np.float64)
    tables = Calibration(read(bias), read(dark), read(flat), gain)
    tables.check()
    return tables


def calibrated(pixels: Column, tables: Calibration) -> Column:
    """Calibrated samples of an array column; the tables travel with the UDF and are one frame in size."""

    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        offsets = values.offsets.to_numpy().astype(int)
        flat = values.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0]:offsets[-1]]
        lengths = np.diff(offsets)
        if len(lengths) and (lengths != lengths[0]).any():
            raise ValueError("frames of one calibration must share the detector shape")
        slope, offset = tables.slope_and_offset(int(lengths[0]) if len(lengths) else 0)
        out = (flat.reshape(len(lengths), -1) - offset) * slope
        return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(out.ravel()))

    return run(pixels)
