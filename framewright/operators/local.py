"""Registration against a reference, local quality and blended local weights.

A reference is one plane per capture. It is joined to the frames as a small
table (see ``materialise``), so frames are registered where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.functions import kernels as K
from framewright.functions.numeric import finite
from framewright.operators import frames as FR
from framewright.operators import stacking as ST
from framewright.operators.ordering import rank_rows
from framewright.session import materialise

KEY = "capture_id"


def reference_planes(frames: DataFrame) -> DataFrame:
    """The sharpest frame of each capture (earliest of equals) as its first reference."""
    # The index is chosen first: an aggregate over pixels would carry a whole frame per task and key.
    narrow = frames.groupBy(KEY).agg(F.max_by("frame_index", F.struct(F.col("quality"), -F.col("frame_index"))).alias("frame_index"))
    chosen = materialise(narrow, "reference-index")
    return frames.join(chosen, [KEY, "frame_index"]).select(KEY, F.col("pixels").cast("array<double>").alias("reference"))


def registered_stack(frames: DataFrame, references: DataFrame, *, max_shift: float, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Quality-weighted sums of frames pulled onto their capture's reference; wide shifts are left out."""
    moved = frames.join(references, KEY).withColumn("s", FR.translation_to(F.col("reference"))).drop("reference")
    share, dx, dy = bounded_shift(F.col("s"), max_shift)
    weight = share * F.greatest("quality", F.lit(C.MIN_WEIGHT))
    return ST.stack(moved, keys, FR.shifted(dx, dy), weight, FR.shifted_support(dx, dy))


def bounded_shift(shift: Column, max_shift: float) -> tuple[Column, Column, Column]:
    """(1 or 0, dx, dy): a shift beyond the limit weighs nothing.

    A weight instead of a filter, because a filter on the matching UDF would run it
    a second time below the projection.
    """
    near = (finite(shift["dx"]) & finite(shift["dy"]) & (F.abs(shift["dx"]) <= max_shift) & (F.abs(shift["dy"]) <= max_shift))
    at = lambda c: F.when(near, shift[c]).otherwise(F.lit(0.0))
    return F.when(near, F.lit(1.0)).otherwise(F.lit(0.0)), at("dx"), at("dy")


def refined_reference(frames: DataFrame, *, passes: int, max_shift: float) -> DataFrame:
    """Register and average repeatedly; every pass aligns to the mean of the one before."""
    references = materialise(reference_planes(frames), "references")
    for _ in range(passes):
        mean = ST.normalise(registered_stack(frames.withColumn("quality", F.lit(1.0)), references, max_shift=max_shift))
        references = materialise(ST.planes_of(mean, [KEY]).withColumnRenamed("pixels", "reference"), "references")
    return references


def scores_around(planes: np.ndarray, cy: np.ndarray, cx: np.ndarray, sigma: float, smooth: float = C.POINT_QUALITY_SIGMA) -> np.ndarray:
    """(n, points): Gaussian-weighted squared Laplacian over squared brightness around each point of each plane."""
    _, h, w = planes.shape
    soft = K.gaussian(planes, smooth)
    curve = np.zeros_like(soft)
    curve[:, 1:-1, 1:-1] = K.laplacian(soft)[:, 1:-1, 1:-1]
    wy = np.exp(-0.5 * ((np.arange(h) - cy[:, None]) / sigma) ** 2)
    wx = np.exp(-0.5 * ((np.arange(w) - cx[:, None]) / sigma) ** 2)
    area = wy.sum(axis=1) * wx.sum(axis=1)
    around = lambda p: np.einsum("py,nyx,px->np", wy, p, wx, optimize=True) / area
    return around(curve**2) / np.maximum(around(soft) ** 2, 1e-30)


def local_scores(frames: DataFrame, centres: list[tuple[int, int]], sigma: float, smooth: float = C.POINT_QUALITY_SIGMA) -> DataFrame:
    """(capture, frame, point, score) of fixed points."""
    cy, cx = (np.array([c[i] for c in centres], dtype=float) for i in (0, 1))
    scores = FR.frame_plane(lambda planes: scores_around(planes, cy, cx, sigma, smooth))(*FR.FRAME)
    return frames.select(KEY, "frame_index", F.posexplode(scores).alias("point", "score"))


class Footprints:
    """Gaussian footprints of points: where their cover is thin, the capture-wide choice fills in."""

    def __init__(self, height: int, width: int, cy: np.ndarray, cx: np.ndarray, spacing: float):
        sigma = 0.6 * spacing
        self.wy = np.exp(-0.5 * ((np.arange(height) - cy[:, None]) / sigma) ** 2)
        self.wx = np.exp(-0.5 * ((np.arange(width) - cx[:, None]) / sigma) ** 2)
        total = self.wy.T @ self.wx
        self.cover = np.minimum(total / 0.5, 1.0)
        self.scale = self.cover / np.maximum(total, 1e-12)

    def weights(self, chosen: np.ndarray, everywhere: bool) -> np.ndarray:
        """Weight of every pixel of a frame that some points chose."""
        return (self.wy.T * chosen) @ self.wx * self.scale + (1 - self.cover) * float(everywhere)


def blended_stack(frames: DataFrame, centres: list[tuple[int, int]], height: int, width: int, *, sigma: float, spacing: float, count: int, weight: Column) -> DataFrame:
    """Weighted sums in which every point takes its own best ``count`` frames and the capture's ``selected`` ones fill the rest.

    What goes back to the frames is one score and one index for a point, those of the last frame it takes.
    """
    cy, cx = (np.array([c[i] for c in centres], dtype=float) for i in (0, 1))
    near = Footprints(height, width, cy, cx, spacing)
    scored = frames.withColumn("_s", FR.frame_plane(lambda planes: scores_around(planes, cy, cx, sigma))(*FR.FRAME))
    rows = materialise(scored.select(KEY, "frame_index", F.posexplode("_s").alias("point", "score")), "point-scores")
    last = rank_rows(rows, [KEY, "point"], "score", "frame_index", name="place", descending=True).where(F.col("place") == count)
    cuts = last.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("point", "score", "frame_index"))).alias("_cuts"))
    ready = scored.join(materialise(cuts, "point-cuts"), KEY, "left")

    @F.arrow_udf("array<double>")
    def planes(pixels: pa.Array, frame: pa.Array, everywhere: pa.Array, scores: pa.Array, point: pa.Array, score: pa.Array, index: pa.Array) -> pa.Array:
        values, bounds = FR._flat(pixels)
        out = []
        for k, (f, e, mine, *cuts) in enumerate(zip(*(c.to_pylist() for c in (frame, everywhere, scores, point, score, index)))):
            last, until = np.full(len(cy), -np.inf), np.full(len(cy), np.iinfo(np.int64).max)
            if cuts[0]:
                last[cuts[0]], until[cuts[0]] = cuts[1], cuts[2]
            mine = np.array(mine)
            share = near.weights(((mine > last) | ((mine == last) & (f <= until))).astype(float), bool(e)).ravel()
            out.append(np.concatenate((share * values[bounds[k] : bounds[k + 1]], share)))
        return FR._lists(out)

    both = planes(F.col("pixels"), F.col("frame_index"), F.coalesce("selected", F.lit(False)), F.col("_s"), F.col("_cuts.point"), F.col("_cuts.score"), F.col("_cuts.frame_index"))
    size = height * width
    return ST.stack(ready.withColumn("_both", both), [KEY], F.slice("_both", 1, size), weight, F.slice("_both", size + 1, size))


def data_residual(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Noise-weighted mean squared misfit of H O against I, summed inside each row first."""
    cell = F.arrays_zip("h_re", "h_im", "o_re", "o_im", "i_re", "i_im")

    def square(c):
        re = c["h_re"] * c["o_re"] - c["h_im"] * c["o_im"] - c["i_re"]
        im = c["h_re"] * c["o_im"] + c["h_im"] * c["o_re"] - c["i_im"]
        return re * re + im * im

    misfit = F.aggregate(F.transform(cell, square), F.lit(0.0), lambda a, v: a + v) / F.size("i_re") / F.col("sigma2")
    return frames.select(*keys, misfit.alias("m")).groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.avg("m").alias("residual"))
