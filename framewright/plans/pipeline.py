"""The two jobs a capture goes through: preprocess (measure, screen, store) and stack."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import constants as C
from framewright.config import Settings
from framewright.operators import calibration as CA
from framewright.operators import fourier as FO
from framewright.operators import frames as FR
from framewright.operators import local as LO
from framewright.operators import motion as MO
from framewright.operators import provenance as PV
from framewright.operators import quality as Q
from framewright.operators import screening, selection
from framewright.operators import stacking as ST
from framewright.session import materialise
from framewright.sources import ser, sinks
from framewright.sources.captures import open_capture

KEY = "capture_id"


def _calibrated(frames: DataFrame, settings: Settings) -> DataFrame:
    """Frames with their samples calibrated, where the settings name tables."""
    if settings.calibration is None:
        return frames
    samples = FR.frame_plane(lambda p: p)(*FR.FRAME)
    return frames.withColumn("pixels", CA.calibrated(samples, CA.load_calibration(**settings.calibration)))


def _refuse(settings: Settings) -> None:
    """Settings that this job cannot honour are errors, never another result than asked for."""
    if settings.fourier_power and (settings.local_alignment or settings.geometry != "none"):
        raise ValueError("fourier_power excludes local_alignment and geometry")


def preprocess(spark: SparkSession, path: str, target: str, settings: Settings = Settings()) -> DataFrame:
    """Measure every frame of a capture, or of all captures of a folder, screen them and store the selection with its identity."""
    frames = open_capture(spark, path)
    kinds = frames.select("bit_depth", F.coalesce(F.lit(settings.pattern), "color_mode").alias("kind")).distinct().limit(64).collect()
    rows = _calibrated(frames, settings)
    measured = None
    for depth, kind in sorted({(k.bit_depth, k.kind) for k in kinds}):
        own = rows.where((F.col("bit_depth") == depth) & (F.coalesce(F.lit(settings.pattern), "color_mode") == kind))
        found = own.withColumn("m", FR.measured(depth, reject_saturated=settings.reject_saturated, bayer=kind in C.BAYER_PATTERNS)).select(KEY, "frame_index", "m.*")
        measured = found if measured is None else measured.unionByName(found)
    if measured is None:
        raise ValueError(f"{path} has no frames")
    measured.write.mode("errorifexists").parquet(f"{target}/measurements")
    screened = screening.screen(spark.read.parquet(f"{target}/measurements"))
    screened.write.mode("errorifexists").parquet(f"{target}/selection")
    digest = PV.ordered_digest(PV.frame_digests(frames), [KEY], "frame_index", "leaf")
    record = json.dumps({"settings": settings.to_dict(), "stamps": PV.file_stamps(path)}, sort_keys=True)
    digest.withColumn("record", F.lit(record)).write.mode("errorifexists").json(f"{target}/identity")
    return spark.read.parquet(f"{target}/selection")


def load_selection(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A stored selection, refused when the capture no longer has the pixels it was made from.

    Size, time and the digest of both ends of each file prove an untouched capture; only a file that
    was moved or rewritten is read and hashed again.
    """
    identity = spark.read.json(f"{target}/identity")
    first = identity.first()
    stamps = json.loads(first["record"])["stamps"] if first is not None and "record" in identity.columns else None
    if stamps is None or stamps != PV.file_stamps(path):
        stored = identity.select(KEY, "digest")
        now = PV.ordered_digest(PV.frame_digests(open_capture(spark, path)), [KEY], "frame_index", "leaf").select(KEY, "digest")
        if stored.exceptAll(now).count() or now.exceptAll(stored).count():
            raise ValueError("the capture changed since it was preprocessed")
    return spark.read.parquet(f"{target}/selection")


def chosen(screened: DataFrame, settings: Settings) -> DataFrame:
    """(capture, frame, quality) of the frames to stack."""
    if settings.minimum_quality is not None:
        picked = selection.select_above(screened, settings.minimum_quality)
    elif settings.selection_mode == "frame_count":
        picked = selection.select_by_count(screened, settings.stack_percent)
    else:
        picked = selection.select_by_range(screened, settings.stack_percent).where("selected")
    return picked.select(KEY, "frame_index", "quality", F.lit(True).alias("accepted"))


def _frames_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The wanted frames with their quality and choice; of SER files no other frame is read and pixels meet no join."""
    if os.path.isdir(path) or path.lower().endswith(".ser"):
        chunks = materialise(ser.chunks_of(wanted, path), "chunks")
        return ser.read_chunks(chunks.repartition(max(1, min(chunks.count(), 4 * spark.sparkContext.defaultParallelism))))
    return open_capture(spark, path).join(wanted, [KEY, "frame_index"])


def _facts(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    """One row of facts for each capture, from its own frames and the settings."""
    heads = open_capture(spark, path, **({"pixels": "false"} if not path.lower().endswith((".avi", ".parquet")) else {}))
    own = heads.groupBy(KEY).agg(F.min("ts_ticks").alias("start_ticks"), F.min("color_mode").alias("color_mode"), F.max("bit_depth").alias("bit_depth"))
    own = materialise(own, "captures")
    s = settings
    return own.select(KEY, "bit_depth").join(MO.views(
        own, mode=s.geometry, pattern=F.coalesce(F.lit(s.pattern), "color_mode"), cadence_s=s.cadence_s, radius=s.radius_px, flattening=s.flattening, pole=s.pole_rad,
        latitude=s.latitude_rad, rate=s.surface_rate_rad_s, inner=s.ring_inner_px, outer=s.ring_outer_px, cx=s.center_x, cy=s.center_y, angle0=s.field_angle_rad,
        field_rate=s.field_rate_rad_s, epoch_s=s.reference_epoch_s, exposure_s=s.exposure_s, limb_power=s.limb_power), KEY)


def stack(spark: SparkSession, path: str, screened: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Stack a capture, or all captures of a folder; returns (result pixels, quality summary of the frames that were used).

    Positions of colour captures run over red, green and blue one after the other.
    """
    _refuse(settings)
    used = materialise(chosen(screened, settings), "chosen")
    if used.isEmpty():
        raise ValueError("no usable frames remain after rejection")
    facts = materialise(_facts(spark, path, settings), "facts")
    if settings.fourier_power:
        result, used = _fourier_stack(spark, path, used, facts, settings)
    else:
        wanted = used.select(KEY, "frame_index", "quality", F.lit(True).alias("selected"))
        if settings.local_alignment:  # points choose among all accepted frames
            rest = screened.where("accepted").select(KEY, "frame_index", "quality").join(used.select(KEY, "frame_index"), [KEY, "frame_index"], "left_anti")
            wanted = wanted.unionByName(rest.withColumn("selected", F.lit(False)))
        frames = _calibrated(_frames_of(spark, path, materialise(wanted, "wanted")), settings)
        best = used.where(~F.isnan("quality")).groupBy(KEY).agg(F.max_by("frame_index", F.struct(F.col("quality"), -F.col("frame_index"))).alias("frame_index"))
        local = MO.Local(size=settings.point_size) if settings.local_alignment else None
        pixels, record = MO.moving_stack(frames, facts.join(best.select(KEY), KEY, "left_semi"), materialise(best, "anchors"), max_shift=settings.max_shift_px,
                                         quality_weighting=settings.quality_weighting, reference_passes=settings.reference_passes, local=local)
        record = MO.checked(record).where("status = 'used'").select(KEY, "frame_index")
        result, used = ST.normalise(pixels), wanted.select(KEY, "frame_index", "quality").join(record, [KEY, "frame_index"])
        if used.isEmpty():
            raise ValueError("no usable frames remain after rejection")
    if settings.brightness_percent is not None:
        full = F.pow(F.lit(2.0), F.col("bit_depth")) - 1
        result = ST.brightness(result.join(F.broadcast(facts.select(KEY, "bit_depth")), KEY), [KEY], settings.brightness_percent, full).drop("bit_depth")
    return result, Q.stack_summary(used, screened, quality_weighting=settings.quality_weighting)


def _fourier_stack(spark: SparkSession, path: str, used: DataFrame, facts: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Rank bins of one mono capture, re-weighted by frequency."""
    if facts.count() > 1 or facts.where("pattern <> 'mono'").count():
        raise ValueError("fourier_power needs one mono capture")
    frames = _calibrated(open_capture(spark, path), settings)
    shape = frames.select("height", "width").first()
    registered = frames.join(used.select(KEY, "frame_index", "quality"), [KEY, "frame_index"]).withColumn("pixels", FR.frame_plane(lambda p: p)(*FR.FRAME))
    reference = LO.reference_planes(registered)
    if settings.reference_passes:
        reference = LO.refined_reference(registered, passes=settings.reference_passes, max_shift=settings.max_shift_px)
    moved = registered.join(materialise(reference, "references"), KEY).withColumn("s", FR.translation_to(F.col("reference"))).drop("reference")
    share, dx, dy = LO.bounded_shift(F.col("s"), settings.max_shift_px)
    weight = share * (F.greatest("quality", F.lit(C.MIN_WEIGHT)) if settings.quality_weighting else F.lit(1.0))
    binned = moved.join(materialise(selection.rank_bin_edges(used), "edges"), KEY).withColumn("bin", selection.bin_from_edges())
    halves = binned.withColumn("half", F.pmod(F.floor(F.col("frame_index") / C.HALF_BLOCK), F.lit(2)))
    acc = materialise(ST.stack(halves, [KEY, "bin", "half"], FR.shifted(dx, dy), weight, FR.shifted_support(dx, dy)), "bins")
    planes = FO.bin_planes(acc, [KEY])
    measured = planes.withColumn("m", FO.measure_rings(shape.height, shape.width)).select(KEY, "bin", "m.*")
    combined = FO.combine_bins(planes, FO.ring_weights(measured, [KEY], settings.fourier_power), [KEY], shape.height, shape.width)
    cover = acc.groupBy(KEY, "pos").agg(F.sum("sum_w").alias("sum_w"))
    image = combined.select(KEY, F.posexplode("weighted").alias("pos", "value")).join(cover, [KEY, "pos"])
    kept = materialise(moved.select(KEY, "frame_index", share.alias("share")), "shares").where("share > 0").select(KEY, "frame_index")
    return image.withColumn("valid", F.col("sum_w") > 0), used.join(kept, [KEY, "frame_index"])


def save(result: DataFrame, summary: DataFrame, settings: Settings, target: str) -> None:
    record = {"settings": settings.to_dict(), "quality": [PV.json_safe(r.asDict()) for r in summary.collect()]}
    sinks.save_snapshot(result, record, target)
