"""Operators on pixel rows and on pixel arrays that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.numeric import snap


def explode_pixels(frames: DataFrame) -> DataFrame:
    """One row per sample with y, x and value; for small frames and pixel-level joins."""
    rows = frames.select("capture_id", "frame_index", "width", F.posexplode("pixels").alias("pos", "v"))
    return rows.select("capture_id", "frame_index", F.floor(F.col("pos") / F.col("width")).cast("long").alias("y"),
                       F.pmod(F.col("pos"), F.col("width")).cast("long").alias("x"), F.col("v").cast("double").alias("value"))


def share_at_or_above(pixels: Column, level: float) -> Column:
    """Fraction of the samples of an array that reach ``level``."""
    hits = F.size(F.filter(pixels, lambda v: v.cast("double") >= level))
    return hits / F.size(pixels).cast("double")


def site_colour(pattern: str) -> Column:
    """Colour letter of a detector site from the parity of y and x."""
    letters = F.array(*[F.lit(c) for c in pattern])
    return F.element_at(letters, (F.pmod(F.col("y"), F.lit(2)) * 2 + F.pmod(F.col("x"), F.lit(2)) + 1).cast("int"))


def scatter(rows: DataFrame, keys: Sequence[str], y: Column, x: Column, value: Column, height: int, width: int,
            weight: Column | None = None) -> DataFrame:
    """Push samples onto a grid with bilinear weights: four corners per sample, summed per pixel."""
    keys = list(keys)
    spots = rows.select(*keys, snap(y).alias("_y"), snap(x).alias("_x"), value.alias("_v"),
                        (F.lit(1.0) if weight is None else weight).alias("_w"))
    y0, x0 = F.floor("_y"), F.floor("_x")
    fy, fx = F.col("_y") - y0, F.col("_x") - x0
    corner = lambda dy, dx: F.struct((y0 + dy).alias("y"), (x0 + dx).alias("x"),
                                     ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("share"))
    corners = F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))
    placed = spots.select(*keys, "_v", "_w", F.inline(corners)).where(
        F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1) & (F.col("share") > 0))
    w = F.col("share") * F.col("_w")
    return placed.groupBy(*keys, "y", "x").agg(F.sum(w * F.col("_v")).alias("sum_wv"), F.sum(w).alias("sum_w"))


def structure_function(frames: DataFrame, keys: Sequence[str], height: int, width: int, max_lag: int) -> DataFrame:
    """Mean squared difference at each lag, averaged over the two axes.

    The pairs of one frame are formed inside its own array, so nothing is joined.
    """
    keys = list(keys)
    entries = []
    for lag in range(1, max_lag + 1):
        for axis, step, pairs in (("x", lag, [k for k in range(height * width) if k % width + lag < width]),
                                  ("y", lag * width, [k for k in range(height * width) if k // width + lag < height])):
            entries.append(F.struct(F.lit(lag).alias("lag"), F.lit(axis).alias("axis"),
                                    _lagged_squares(pairs, step).alias("total"), F.lit(len(pairs)).alias("pairs")))
    per_axis = frames.select(*keys, F.inline(F.array(*entries))).groupBy(*keys, "lag", "axis").agg(
        (F.sum("total") / F.sum("pairs")).alias("mean"))
    return per_axis.groupBy(*keys, "lag").agg((F.sum("mean") / 2).alias("measured"))


def _lagged_squares(starts: list[int], step: int) -> Column:
    """Sum of squared differences between samples ``step`` apart."""
    at = lambda k: F.get(F.col("pixels"), k).cast("double")
    return F.aggregate(F.array(*[F.lit(k) for k in starts]), F.lit(0.0),
                       lambda acc, k: acc + F.pow(at(k + step) - at(k), F.lit(2.0)))


def split_half(halves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relative RMS between the two half stacks over their common pixels."""
    keys = list(keys)
    both = halves.where("valid").groupBy(*keys, "pos").agg(
        F.max(F.when(F.col("half") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("value"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    energy = F.sum((a * a + b * b) / 2)
    return both.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("common_samples"),
        F.sqrt(F.sum((a - b) * (a - b)) / F.greatest(energy, F.lit(1e-20))).alias("relative_rms"))


def raw_residual(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relative RMS of the frames against the model plane carried in ``model``; sums inside each row first."""
    keys = list(keys)
    pairs = F.zip_with("pixels", "model", lambda v, m: F.struct(v.cast("double").alias("v"), m.alias("m")))
    usable = F.filter(pairs, lambda p: ~F.isnan(p["v"]) & ~F.isnan(p["m"]))
    error = F.aggregate(usable, F.lit(0.0), lambda acc, p: acc + (p["v"] - p["m"]) * (p["v"] - p["m"]))
    energy = F.aggregate(usable, F.lit(0.0), lambda acc, p: acc + p["v"] * p["v"])
    per_frame = frames.select(*keys, F.size(usable).cast("long").alias("n"), error.alias("error"), energy.alias("energy"))
    return per_frame.groupBy(*keys).agg(
        F.sum("n").alias("samples"), F.count_if(F.col("n") > 0).alias("frames"),
        F.sqrt(F.sum("error") / F.greatest(F.sum("energy"), F.lit(1e-20))).alias("relative_rms"))


def centroids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brightness-weighted centre of each group of pixel rows, relative to the middle of the grid given by y and x."""
    w = F.abs("value")
    return rows.groupBy(*keys).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("cy"))


def place_blocks(pixels: DataFrame, keys: Sequence[str], size: int, *, brightness: float, texture: float, floor: float) -> DataFrame:
    """Blocks of a reference that are bright and textured enough to align on.

    A block needs a share of the largest pixel in brightness, and a share of the
    median block texture with an absolute floor.
    """
    from framewright.operators.ordering import medians

    keys = list(keys)
    blocks = pixels.groupBy(*keys, F.floor(F.col("y") / size).cast("long").alias("block_y"), F.floor(F.col("x") / size).cast("long").alias("block_x")).agg(
        F.avg("value").alias("level"), F.stddev_pop("value").alias("texture"))
    peaks = pixels.groupBy(*keys).agg(F.max("value").alias("peak"))
    bright = blocks.join(peaks, keys).where(F.col("level") >= brightness * F.col("peak"))
    middle = medians(bright, keys, {"typical": "texture"})
    return bright.join(middle, keys).where(
        (F.col("texture") >= texture * F.col("typical")) & (F.col("texture") > floor * F.abs("peak"))).drop("peak", "typical")
