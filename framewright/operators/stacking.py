"""Weighted per-pixel sums over frames.

Frames are never exploded into pixel rows and never shuffled. Each task folds
its own frames into one plane per key (``mapInArrow``), and only those partial
planes are exploded by pixel and summed across tasks. What is shuffled grows
with tasks x keys x pixels of one frame, not with the number of frames, and the
final sum is an ordinary hash aggregate keyed by (key, pixel), so one capture
holding most frames is spread over all tasks that read it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from framewright.functions.numeric import ratio_or_zero

FLUSH_BYTES = 128 << 20


def _fold(keys: Sequence[str], schema: pa.Schema, has_support: bool):
    """Batch iterator -> partial planes per key, emitted early when they outgrow the buffer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple, list] = {}
        held = 0

        def emit() -> pa.RecordBatch:
            columns = [[key[i] for key in planes] for i in range(len(keys))]
            columns += [[p[0] for p in planes.values()], [p[1] for p in planes.values()], [p[2] for p in planes.values()]]
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = batch.select(list(keys)).to_pandas()
            code = table.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
            weight = batch.column("_w").to_numpy(zero_copy_only=False)
            value, bounds = _values(batch.column("_values"))
            support, _ = _values(batch.column("_support")) if has_support else (None, None)
            length = np.diff(bounds)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                at = bounds[rows][:, None] + np.arange(size)
                for group in np.unique(code[rows]):
                    mine = rows[code[rows] == group]
                    pick = at[np.isin(rows, mine)]
                    # A frame without weight is left out whole: its samples may be unknown.
                    w = weight[mine]
                    used = w > 0
                    w, at_used = w[used], pick[used]
                    total = w @ value[at_used]
                    cover = w @ support[at_used] if has_support else np.full(size, w.sum())
                    key = (*table.iloc[mine[0]].tolist(), int(size))
                    if key in planes:
                        planes[key][0] += total
                        planes[key][1] += cover
                        planes[key][2] += len(mine)
                    else:
                        planes[key] = [total, cover, len(mine)]
                        held += 16 * int(size)
            if held > FLUSH_BYTES:
                yield emit()
                planes, held = {}, 0
        if planes:
            yield emit()

    return run


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return (column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy().astype(int))


def partial_planes(frames: DataFrame, keys: Sequence[str], values: Column, weight: Column,
                   support: Column | None = None) -> DataFrame:
    """One row per (task, key): keys, ``sum_wv`` and ``sum_w`` planes and the frame count."""
    keys = list(keys)
    columns = [*keys, weight.cast("double").alias("_w"), values.cast("array<double>").alias("_values")]
    if support is not None:
        columns.append(support.cast("array<double>").alias("_support"))
    ready = frames.select(*columns)
    plane = ArrayType(DoubleType(), True)
    spark_schema = StructType([ready.schema[k] for k in keys] + [
        StructField("sum_wv", plane), StructField("sum_w", plane), StructField("frames", LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    return ready.mapInArrow(_fold(keys, to_arrow_schema(spark_schema), support is not None), spark_schema)


def merge_planes(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum partial planes per pixel: one row per (key, pos)."""
    keys = list(keys)
    exploded = partials.select(*keys, F.posexplode(F.arrays_zip("sum_wv", "sum_w")).alias("pos", "p"))
    return exploded.groupBy(*keys, "pos").agg(F.sum("p.sum_wv").alias("sum_wv"), F.sum("p.sum_w").alias("sum_w"))


def stack(frames: DataFrame, keys: Sequence[str], values: Column, weight: Column, support: Column | None = None) -> DataFrame:
    """Accumulate frames per key: one row per (key, pos) with ``sum_wv`` and ``sum_w``."""
    return merge_planes(partial_planes(frames, keys, values, weight, support), keys)


def normalise(accumulated: DataFrame) -> DataFrame:
    """value = sum_wv / sum_w, 0 where nothing contributed; coverage is the weight."""
    return accumulated.withColumn("value", ratio_or_zero(F.col("sum_wv"), F.col("sum_w"))).withColumn(
        "valid", F.col("sum_w") > 0)


def place(accumulated: DataFrame, height: int, width: int, channels: str = "") -> DataFrame:
    """Turn the flat position into y, x and, for several planes end to end, the channel name."""
    size = height * width
    inside = F.pmod(F.col("pos"), F.lit(size))
    out = accumulated.withColumn("y", F.floor(inside / width).cast("long")).withColumn(
        "x", F.pmod(inside, F.lit(width)).cast("long"))
    if channels:
        names = F.array(*[F.lit(c) for c in channels])
        out = out.withColumn("channel", F.element_at(names, (F.floor(F.col("pos") / size) + 1).cast("int")))
    return out.drop("pos")


def planes_of(pixels: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Gather (key, pos, value) rows into one plane per key; a plane is one frame in size."""
    keys = list(keys)
    gathered = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return pixels.groupBy(*keys).agg(F.transform(gathered, lambda p: p["v"]).alias("pixels"))


def layer_coverage(pixels: DataFrame, keys: Sequence[str], layers: dict[str, Column], weight: Column) -> DataFrame:
    """Weight collected per pixel by each named layer."""
    return pixels.groupBy(*keys).agg(*[F.sum(F.when(flag, weight).otherwise(F.lit(0.0))).alias(n) for n, flag in layers.items()])


def brightness(normalised: DataFrame, keys: Sequence[str], percent: float, full_scale: float | Column) -> DataFrame:
    """One gain per key that maps the supported peak to a percentage of full scale (one for all, or a column of the key's rows)."""
    keys = list(keys)
    usable = F.col("valid") & ~F.isnan("value")
    peaks = normalised.groupBy(*keys).agg(
        F.greatest(F.coalesce(F.max(F.when(usable, F.col("value"))), F.lit(0.0)), F.lit(0.0)).alias("peak"),
        F.max(F.lit(full_scale) if not isinstance(full_scale, Column) else full_scale).alias("full"))
    gain = F.when(F.col("peak") > 0, F.col("full") * percent / 100.0 / F.col("peak")).otherwise(F.lit(1.0))
    gains = peaks.select(*keys, gain.alias("gain"), "peak")
    return normalised.join(gains, keys).withColumn("value", F.col("value") * F.col("gain"))


# Fixed order in which a missing colour looks for its nearest direct sample: the
# four sides first, then the diagonals, each in raster order.
NEIGHBOURS = ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))


def complete_colours(pixels: DataFrame, keys: Sequence[str], region: str | None = None) -> DataFrame:
    """Fill a missing channel from the nearest direct sample at most one pixel away.

    Input rows are (key, y, x, channel, value, coverage, valid). Only direct
    samples are sources, filled ones never are; pixels without any direct channel
    stay empty, and a region boundary is not crossed.
    """
    keys = list(keys)
    offsets = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
                        for i, (dy, dx) in enumerate(NEIGHBOURS)])
    regions = [region] if region else []
    direct = pixels.where("valid")
    footprint = direct.select(*keys, "y", "x").distinct()
    missing = pixels.where(~F.col("valid")).join(footprint, [*keys, "y", "x"], "left_semi")
    offered = direct.select(*keys, "channel", *regions, "value", "coverage", "y", "x", F.inline(offsets)).select(
        *keys, "channel", *regions, F.col("value").alias("from_value"), F.col("coverage").alias("from_coverage"), "rank",
        (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"))
    best = missing.select(*keys, "y", "x", "channel", *regions).join(offered, [*keys, "y", "x", "channel", *regions]).groupBy(
        *keys, "y", "x", "channel").agg(F.min_by(F.struct("from_value", "from_coverage"), "rank").alias("found"))
    joined = pixels.join(best, [*keys, "y", "x", "channel"], "left")
    filled = ~F.col("valid") & F.col("found").isNotNull()
    return joined.select(
        *keys, "y", "x", "channel",
        F.when(filled, F.col("found.from_value")).otherwise(F.col("value")).alias("value"),
        F.when(filled, F.col("found.from_coverage")).otherwise(F.col("coverage")).alias("coverage"),
        (F.col("valid") | filled).alias("valid"), filled.alias("filled"))
