"""Stacks of moving scenes, from captures to pixels: a spinning globe, a turning field, rings, seeing.

``views`` gives the facts of each capture (one narrow row). A frame crosses to Python once in a pass: its pose
follows from its time, its drift from a match with the reference as the model predicts it, and its samples
go straight from where they were measured to where they are at the output epoch, into sums of one plane for each
(task, capture). Those are cut into tiles and merged by (capture, tile), so frames are never shuffled and a capture that
holds most frames is merged by as many tasks as it has tiles.

Tasks need one reference plane for each capture. Captures are taken in ranges of their ids whose
planes together stay below ``group_bytes``; only such a bounded set is ever broadcast, and a range filter
reaches the scan.

With ``local`` each frame is also matched at alignment points to a mean of the best frames in the
reference geometry (two passes that exchange one plane for each capture), the measured field is inverted, and
each point can take its own best frames: scores are ranked per (capture, point), and only the score of the
last frame that a point takes goes back to the tasks, which measure again and compare.

A frame's ``status``: ``used``; ``far`` (moved beyond ``max_shift``); ``unresolved`` (the observed pixels do not fix its
drift); ``outside`` (no sample lands on the output); ``unselected`` (neither the capture nor any point takes it); ``not_finite`` (samples, time or quality unknown). A capture
with unresolved frames is an error in ``checked``, as its result would mix registered and unregistered motion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright import constants as C
from framewright.functions import kernels as K
from framewright.functions import motion as M
from framewright.functions.geometry import Globe, Rings
from framewright.operators import drift as D
from framewright.operators import frames as FR
from framewright.operators import local as LO
from framewright.operators import ordering
from framewright.operators import points as PT
from framewright.session import materialise

KEY = "capture_id"
MODES = ("none", "field", "surface", "combined", "saturn")
TILE = 1 << 14  # samples of a plane that travel together
GROUP_BYTES = 256 << 20
FLUSH_BYTES = 128 << 20
LEAST_TEMPLATE_FRAMES = 4
# Facts of a capture, their types and what they are where nobody says so.
FACTS = {
    "mode": ("string", "none"), "pattern": ("string", "mono"), "start_ticks": ("long", None), "cadence_s": ("double", None), "radius": ("double", None), "flattening": ("double", 0.0), "pole": ("double", 0.0), "latitude": ("double", 0.0),
    "rate": ("double", 0.0), "inner": ("double", None), "outer": ("double", None), "cx": ("double", None), "cy": ("double", None),
    "angle0": ("double", 0.0), "field_rate": ("double", 0.0), "epoch_s": ("double", 0.0), "exposure_s": ("double", 0.0), "limb_power": ("double", 0.0)}
OUT = T.StructType([T.StructField("frame_index", T.LongType()), T.StructField("tile", T.IntegerType()), T.StructField("status", T.StringType()),
                    T.StructField("a", T.ArrayType(T.DoubleType())), T.StructField("b", T.ArrayType(T.DoubleType()))])


@dataclass(frozen=True)
class Local:
    """Alignment points: their size, how many of the best frames make the reference, and how often it is refined."""

    size: int = 64
    template_frames: int = C.REFERENCE_FRAMES
    refinements: int = 1


def views(captures: DataFrame, **facts) -> DataFrame:
    """(capture_id, facts): columns or numbers where given, columns of ``captures`` where it has them, else the usual values."""
    unknown = set(facts) - set(FACTS)
    if unknown:
        raise ValueError(f"unknown facts of a capture: {', '.join(sorted(unknown))}")
    given = {c: v if not isinstance(v, (int, float, str, type(None))) else F.lit(v) for c, v in facts.items()}
    usual = {c: F.coalesce(F.col(c), F.lit(default)) if c in captures.columns else F.lit(default) for c, (_, default) in FACTS.items()}
    return captures.select(KEY, *((given.get(c) if c in given else usual[c]).cast(kind).alias(c) for c, (kind, _) in FACTS.items()))


class Known:
    """What a task knows of a capture: its view, its reference frame, and what earlier passes found."""

    def __init__(self, facts: dict, plane: np.ndarray, anchor_index: int):
        self.facts, self.plane, self.anchor_index = facts, plane, anchor_index
        mode, h, w = facts["mode"], *plane.shape
        if mode not in MODES:
            raise ValueError(f"unknown motion {mode!r}")
        self.mode = mode
        self.cx = w / 2 if facts["cx"] is None else facts["cx"]
        self.cy = h / 2 if facts["cy"] is None else facts["cy"]
        globe = rings = None
        if mode in ("surface", "combined", "saturn"):
            if facts["radius"] is None:
                raise ValueError("a spinning globe needs its radius")
            globe = Globe(facts["radius"], facts["flattening"], facts["pole"], facts["latitude"], 0.0, facts["rate"], facts["epoch_s"])
        if mode == "saturn":
            if facts["inner"] is None or facts["outer"] is None or facts["inner"] <= facts["radius"]:
                raise ValueError("rings need radii beyond the globe")
            rings = Rings(facts["inner"], facts["outer"])
        self.scene = M.Scene(globe, rings, field=mode in ("field", "combined", "saturn"), limb_power=facts["limb_power"])
        self.reference = M.Pose(facts["epoch_s"], facts["angle0"], self.cx, self.cy)
        self.template = self.support = self.points = self.cuts = None

    def anchored(self, t: float | None, capture) -> None:
        """Take the pose of the reference frame."""
        moves = self.mode != "none" and (self.facts["rate"] or self.facts["field_rate"])
        if (t is None and moves) or not np.isfinite(self.plane).all():
            raise ValueError(f"the reference frame of {capture} is not usable: it needs finite samples and, for motion, a time")
        self.anchor = self.pose(0.0 if t is None else t)

    def time(self, frame: int, t: float | None, ticks: int | None) -> float | None:
        """Seconds of a frame: as given, from its recorded ticks (subtracted as integers), or from a stated cadence."""
        f = self.facts
        if t is None and ticks is not None and f["start_ticks"] is not None:
            t = (ticks - f["start_ticks"]) / C.TICKS_PER_SECOND
        if t is None and f["cadence_s"] is not None:
            t = frame * f["cadence_s"]
        return t

    def pose(self, t: float) -> M.Pose:
        f = self.facts
        t = t + f["exposure_s"] / 2
        return M.Pose(t, f["angle0"] + f["field_rate"] * (t - f["epoch_s"]), self.cx, self.cy)

    def placed(self, local: Local) -> None:
        """Fix the alignment points on the finished reference."""
        self.points = PT.place_points(self.template, local.size)
        cy, cx = (self.points.centres[:, i].astype(float) for i in (0, 1))
        self.centres = (cy, cx)
        x, y, valid, _ = M.carried(self.scene, cx + 0.5, cy + 0.5, self.anchor, self.reference)
        self.footprints = LO.Footprints(*self.plane.shape, np.where(valid, y - 0.5, cy), np.where(valid, x - 0.5, cx), local.size // 2)

    def drift(self, plane: np.ndarray, pose: M.Pose) -> tuple[float, float] | None:
        """How far the frame lies from where its pose has it; None where the observed pixels cannot say."""
        if self.scene.still(pose, self.anchor):
            return tuple(K.translations(plane[None], self.plane)[0])
        if self.mode == "saturn":
            return self._ring_drift(plane, pose)
        predicted = M.rendered(self.plane, self.scene, pose, self.anchor)
        h, w = plane.shape
        if self.mode == "field":
            radius = np.hypot(h, w) / 2 if self.facts["radius"] is None else self.facts["radius"]
            if radius <= min(self.cx - 0.5, w - 0.5 - self.cx, self.cy - 0.5, h - 0.5 - self.cy):
                return tuple(K.translations(plane[None], predicted)[0])
            support = M.rendered(np.ones((h, w)), self.scene, pose, self.anchor, light=False)
            return D.judged(D.match(plane[None], predicted, D.shared_support(support, pose.cx, pose.cy, radius), False))
        if not np.any(self.scene.turn(pose, self.anchor)):
            return tuple(K.translations(plane[None], predicted)[0])
        # Only what both the reference and this frame show of the globe may speak, clear of either limb.
        support = M.rendered(D.eroded(self._on_globe(self.anchor), 3).astype(float), self.scene, pose, self.anchor, light=False)
        mask = D.eroded((support >= 1 - 1e-12) & self._on_globe(pose))
        return D.judged(D.match(plane[None], predicted, mask, True))

    def _on_globe(self, pose: M.Pose) -> np.ndarray:
        x, y = M.grid(*self.plane.shape)
        sx, sy = x - pose.cx, pose.cy - y
        if self.scene.field:
            sx, sy = M._rotated(sx, sy, -pose.angle)
        return M.near_side(self.scene.globe, sx, sy)[3]

    def _ring_drift(self, plane: np.ndarray, pose: M.Pose) -> tuple[float, float] | None:
        """Rings are followed clear of the globe; under field rotation a step must gain more than resampling alone loses."""
        f, shape = self.facts, self.plane.shape
        mask = D.annulus(*shape, self.cx, self.cy, f["radius"], f["outer"])
        if pose.angle == self.anchor.angle:
            return D.judged(D.match(plane[None], self.plane, mask, True))
        turning = M.Scene()
        predicted = M.rendered(self.plane, turning, pose, self.anchor)
        support = M.rendered(np.ones(shape), turning, pose, self.anchor, light=False)
        there_and_back = K.gaussian(np.stack([self.plane, M.rendered(predicted, turning, self.anchor, pose)]), C.CORRELATION_SIGMA, "reflect")[:, mask]
        if not there_and_back.size:
            return None
        own, again = there_and_back - there_and_back.mean(axis=1, keepdims=True)
        norm = np.sqrt((own**2).sum() * (again**2).sum())
        if norm <= 1e-12:
            return None
        return D.judged(D.match(plane[None], predicted, mask & D.eroded(support >= 1 - 1e-12), True), 0, max(1e-12, 1 - float((own * again).sum() / norm)))

    def seen_from_here(self, plane: np.ndarray, pose: M.Pose) -> tuple[np.ndarray, np.ndarray]:
        """The frame in the reference frame's geometry, and its support."""
        image = M.rendered(plane, self.scene, self.anchor, pose)
        support = M.rendered(np.ones(plane.shape), self.scene, self.anchor, pose, light=False)
        if self.points is not None and len(self.points.centres):
            fx, fy = PT.displacement(PT.match_frame(image, np.zeros(2), self.points), self.points)
            y, x = np.indices(plane.shape, dtype=float)
            image, support = (K.sample_bilinear(p, y + fy, x + fx) for p in (image, support))
        return image, support

    def scores(self, plane: np.ndarray, pose: M.Pose, size: int) -> np.ndarray:
        """Local quality at every point, where the model has it in this frame."""
        cy, cx = self.centres
        x, y, valid, _ = M.carried(self.scene, cx + 0.5, cy + 0.5, self.anchor, pose)
        y = np.where(valid, y, cy + 0.5 + pose.cy - self.anchor.cy) - 0.5
        x = np.where(valid, x, cx + 0.5 + pose.cx - self.anchor.cx) - 0.5
        return LO.scores_around(plane[None], y, x, size / 4)[0]

    def weights(self, plane: np.ndarray, pose: M.Pose, size: int, frame: int, selected: bool) -> np.ndarray | None:
        """Weight of each output pixel by the points that take this frame; None where nobody ranked them."""
        if self.cuts is None:
            return None
        last, index = self.cuts
        mine = self.scores(plane, pose, size)
        return self.footprints.weights(((mine > last) | ((mine == last) & (frame <= index))).astype(float), selected)

    def measured_places(self, plane: np.ndarray, pose: M.Pose, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where this frame's pixels would be without seeing: the field against the predicted reference, inverted."""
        predicted = M.rendered(self.template, self.scene, pose, self.anchor)
        seen = M.rendered(self.support.astype(float), self.scene, pose, self.anchor, light=False)
        points = PT.place_points(predicted, size, support=seen >= 1 - 1e-9)
        if not len(points.centres):
            return M.grid(*plane.shape)
        fx, fy = PT.displacement(PT.match_frame(plane, np.zeros(2), points), points)
        qx, qy, _ = M.inverse_field(fx[None], fy[None])
        return qx[0] + 0.5, qy[0] + 0.5


def _channels(raw: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(channels, own samples of each channel or None for all, plane to register) of a raw frame."""
    if raw.ndim == 3:
        planes = np.moveaxis(raw, -1, 0)
        planes = planes[::-1] if pattern == "BGR" else planes
        return planes, None, np.tensordot(np.array(C.LUMINANCE), planes, 1)
    if pattern in C.BAYER_PATTERNS:
        sites = K.site_colours(*raw.shape, pattern)
        return np.stack([raw] * 3), np.stack([sites == c for c in range(3)]), K.green_proxy(raw[None], pattern)[0]
    return raw[None], None, raw


def _pass(kind: str, shared, schema: pa.Schema, *, max_shift: float, weighted: bool, track: bool, local: Local | None):
    """``stack``: sums at the output epoch; ``template``: sums in the reference frame's geometry; ``scores``: one row a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        held = 0

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def tiles() -> Iterator[pa.RecordBatch]:
            for capture, (total, cover) in sums.items():
                for k, at in enumerate(range(0, len(total), TILE)):
                    yield rows_of([(capture, None, k, None, total[at : at + TILE], cover[at : at + TILE])])
            sums.clear()

        def frame(capture, index: int, raw: np.ndarray, t, ticks, quality, selected) -> tuple:
            known: Known = shared.value[capture]
            t = known.time(index, t, ticks)
            if t is None and not (known.facts["rate"] or known.facts["field_rate"]):
                t = 0.0
            if t is None or quality is None or not np.isfinite([t, quality]).all() or not np.isfinite(raw).all():
                return "not_finite", None, None
            planes, own, plane = _channels(raw, known.facts["pattern"])
            if plane.shape != known.plane.shape:
                raise ValueError(f"frame {index} of {capture} is {plane.shape}, its reference {known.plane.shape}")
            pose = known.pose(t)
            moved = (0.0, 0.0)
            if track and index != known.anchor_index:
                moved = known.drift(plane, pose)
            if moved is None:
                return "unresolved", None, None
            if not np.isfinite(moved).all() or np.abs(moved).max() > max_shift:
                return "far", list(map(float, moved)), None
            pose, (h, w) = pose.moved(*moved), plane.shape
            if kind == "scores":
                return "used", list(map(float, moved)), known.scores(plane, pose, local.size).tolist()
            if capture not in sums:
                size = h * w * (len(planes) if kind == "stack" else 1)
                sums[capture] = (np.zeros(size), np.zeros(size))
            total, cover = sums[capture]
            if kind == "template":
                image, support = known.seen_from_here(plane, pose)
                total += image.ravel()
                cover += support.ravel()
                return "used", list(map(float, moved)), None
            score = max(quality, C.MIN_WEIGHT) if weighted else 1.0
            blend = known.weights(plane, pose, local.size, index, selected) if local else None
            if not selected if blend is None else not blend.any():
                return "unselected", None, None
            x, y = known.measured_places(plane, pose, local.size) if local else M.grid(h, w)
            x, y, valid, gain = M.carried(known.scene, x, y, pose, known.reference)
            spread = valid.astype(float)
            landed, flat = False, lambda c: slice(c * h * w, (c + 1) * h * w)
            for c, channel in enumerate(planes):
                add, wt = M.scattered((channel * gain).ravel(), (spread if own is None else spread * own[c]).ravel(), (y - 0.5).ravel(), (x - 0.5).ravel(), h, w)
                landed = landed or bool((wt > 0).any())
                each = score if blend is None else score * blend.ravel()
                total[flat(c)] += each * add
                cover[flat(c)] += each * wt
            return ("used" if landed else "outside"), list(map(float, moved)), [score if landed else 0.0]

        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(n) for n in batch.schema.names}
            captures, indices = column[KEY].to_pylist(), column["frame_index"].to_pylist()
            rest = [column[n].to_pylist() for n in ("t_s", "ts_ticks", "quality", "selected")]
            records = []
            for rows, block in FR.planes_by_shape(column["pixels"], column["height"], column["width"]):
                for k, r in enumerate(rows.tolist()):
                    records.append((captures[r], indices[r], -1, *frame(captures[r], indices[r], block[k], *(c[r] for c in rest))))
            yield rows_of(records)
            held = sum(16 * len(total) for total, _ in sums.values())
            if held > FLUSH_BYTES:
                yield from tiles()
        yield from tiles()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for capture, tile, a, b in zip(*(batch.column(n).to_pylist() for n in (KEY, "tile", "a", "b"))):
            own = held.setdefault((capture, tile), [0.0, 0.0])
            own[0] = own[0] + np.array(a)
            own[1] = own[1] + np.array(b)
    for (capture, tile), (a, b) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([v], schema.field(n).type) for n, v in zip((KEY, "tile", "a", "b"), (capture, tile, a, b))],
                                         schema=pa.schema([schema.field(n) for n in (KEY, "tile", "a", "b")]))


def merged(parts: DataFrame) -> DataFrame:
    """(capture, tile, a, b): the partial tiles of all tasks added up."""
    tiles = parts.where("tile >= 0").select(KEY, "tile", "a", "b")
    return tiles.repartition(KEY, "tile").mapInArrow(_merge, tiles.schema)


def _ranges(frames: DataFrame, group_bytes: int) -> list[tuple]:
    """(lowest, highest) capture of groups whose reference planes stay near ``group_bytes``; one row a group reaches the driver."""
    sizes = frames.groupBy(KEY).agg(F.max(F.col("height").cast("long") * F.col("width") * 8).alias("bytes"))
    sizes = materialise(sizes, "plane-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0]
    if not total:
        return []
    groups = -(-total // group_bytes)
    dealt = sizes.repartitionByRange(groups, KEY).groupBy(F.spark_partition_id().alias("g")).agg(F.min(KEY), F.max(KEY))
    return [(r[1], r[2]) for r in dealt.collect()]


def _planes_of(tiles: DataFrame) -> dict:
    """Collected planes of one group of captures: {capture: (a, b)}."""
    out: dict = {}
    for r in tiles.orderBy(KEY, "tile").collect():
        out.setdefault(r[KEY], []).append((np.array(r.a), np.array(r.b)))
    return {k: tuple(np.concatenate(p) for p in zip(*v)) for k, v in out.items()}


def _last_taken(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """(capture, point, score, frame_index) of the last frame that each point takes, where it does not take all."""
    ranked = ordering.rank_rows(scores, [KEY, "point"], "score", "frame_index", name="place", descending=True)
    return ranked.join(F.broadcast(wanted), KEY).where(F.col("place") == F.col("wanted")).select(KEY, "point", "score", "frame_index")


def moving_stack(frames: DataFrame, facts: DataFrame, anchors: DataFrame, *, max_shift: float = 32.0, quality_weighting: bool = True, track: bool = True,
                 reference_passes: int = 0, local: Local | None = None, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """Pixel sums (capture, pos, sum_wv, sum_w) at each capture's output epoch, and what became of each frame.

    ``frames``: capture_id, frame_index, pixels, height, width, quality, a time (``t_s``, or ``ts_ticks`` with the fact
    ``start_ticks``, or the fact ``cadence_s``) and, where points rank more frames than the capture itself takes, ``selected``.
    ``facts`` comes from ``views``; ``anchors`` (capture_id, frame_index) names the reference frames, which ``reference_passes``
    passes replace by the mean of all frames in their geometry. Positions run over the channels one after the other (one, or
    red, green, blue).
    """
    usual = {"selected": F.lit(True), "t_s": F.lit(None).cast("double"), "ts_ticks": F.lit(None).cast("long")}
    frames = frames.withColumns({c: v for c, v in usual.items() if c not in frames.columns})
    frames = frames.select(KEY, "frame_index", "pixels", "height", "width", F.col("t_s").cast("double").alias("t_s"), F.col("ts_ticks").cast("long").alias("ts_ticks"),
                           F.col("quality").cast("double").alias("quality"), F.coalesce("selected", F.lit(False)).alias("selected"))
    spark = frames.sparkSession
    schema = T.StructType([frames.schema[KEY], *OUT.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    results = []
    for low, high in _ranges(frames, group_bytes):
        own = lambda df: df.where(F.col(KEY).between(F.lit(low), F.lit(high)))  # noqa: B023, E731
        mine = own(frames)
        # At most group_bytes of planes, so few narrow rows: both sides are safe to broadcast and to collect.
        found = mine.join(F.broadcast(own(anchors).select(KEY, "frame_index")), [KEY, "frame_index"]).join(F.broadcast(own(facts)), KEY)
        known: dict = {}
        table = found.toArrow()
        for batch in table.to_batches():
            records = batch.drop_columns(["pixels"]).to_pylist()
            for rows, block in FR.planes_by_shape(batch.column("pixels"), batch.column("height"), batch.column("width")):
                for k, r in enumerate(rows.tolist()):
                    record = records[r]
                    own_facts = {c: record[c] for c in FACTS}
                    own = Known(own_facts, _channels(block[k], own_facts["pattern"])[2], record["frame_index"])
                    own.anchored(own.time(record["frame_index"], record["t_s"], record["ts_ticks"]), record[KEY])
                    known[record[KEY]] = own
        missing = mine.select(KEY).distinct().count() - len(known)
        if missing:
            raise ValueError(f"{missing} captures have no reference frame or no facts")

        def passed(kind: str, rows: DataFrame) -> DataFrame:
            shared = spark.sparkContext.broadcast(known)  # noqa: B023
            work = _pass(kind, shared, arrow, max_shift=max_shift, weighted=quality_weighting, track=track, local=local)
            done = materialise(rows.mapInArrow(work, schema), kind)
            shared.destroy()
            return done

        for _ in range(reference_passes):
            planes = _planes_of(merged(passed("template", mine.where("selected"))))
            for capture, (total, cover) in planes.items():
                k = known[capture]
                total, cover = total.reshape(k.plane.shape), cover.reshape(k.plane.shape)
                k.plane = np.where(cover > 1e-12, total / np.maximum(cover, 1e-12), k.plane)
        if local is not None:
            best = ordering.rank_rows(mine.where("quality is not null").select(KEY, "frame_index", "quality"), [KEY], "quality", "frame_index", name="place", descending=True)
            last = best.where(F.col("place") == local.template_frames).select(KEY, F.col("quality").alias("_q"), F.col("frame_index").alias("_i"))
            ahead = (F.col("quality") > F.col("_q")) | ((F.col("quality") == F.col("_q")) & (F.col("frame_index") <= F.col("_i")))
            sharp = mine.join(F.broadcast(materialise(last, "last-template")), KEY, "left").where(F.col("_q").isNull() | ahead).drop("_q", "_i")
            for again in range(1 + local.refinements):
                parts = passed("template", sharp)
                counts = {r[KEY]: r.n for r in parts.where("status = 'used'").groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).collect()}
                planes = _planes_of(merged(parts))
                for capture, k in known.items():
                    if counts.get(capture, 0) < LEAST_TEMPLATE_FRAMES:
                        raise ValueError(f"capture {capture} has fewer than {LEAST_TEMPLATE_FRAMES} usable reference frames for alignment points")
                    total, cover = (p.reshape(k.plane.shape) for p in planes[capture])
                    k.template = np.where(cover > 1e-12, total / np.maximum(cover, 1e-12), k.plane if again == 0 else k.template)
                    k.support = cover >= LEAST_TEMPLATE_FRAMES - 1e-9
                    k.placed(local)
            wanted = materialise(mine.groupBy(KEY).agg(F.count_if("selected").alias("wanted"), F.count(F.lit(1)).alias("frames")), "wanted")
            if not wanted.where("wanted < frames").isEmpty():
                parts = passed("scores", mine)
                rows = parts.where("status = 'used'").select(KEY, "frame_index", F.posexplode("b").alias("point", "score"))
                cuts = _last_taken(rows, wanted.select(KEY, "wanted"))
                for k in known.values():
                    n = len(k.points.centres)
                    k.cuts = (np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max))
                for r in cuts.collect():  # one row for a point; points are fewer than pixels of the reference planes
                    known[r[KEY]].cuts[0][r.point], known[r[KEY]].cuts[1][r.point] = r.score, r.frame_index
        results.append(passed("stack", mine))
    if not results:
        empty = spark.createDataFrame([], schema)
        results = [empty]
    parts = results[0]
    for more in results[1:]:
        parts = parts.unionByName(more)
    pixels = merged(parts).select(KEY, "tile", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p"))
    pixels = pixels.select(KEY, (F.col("tile").cast("long") * TILE + F.col("at")).alias("pos"), F.col("p.a").alias("sum_wv"), F.col("p.b").alias("sum_w"))
    record = parts.where("tile < 0").select(KEY, "frame_index", "status", F.get("a", F.lit(0)).alias("dx"), F.get("a", F.lit(1)).alias("dy"),
                                            F.coalesce(F.get("b", F.lit(0)), F.lit(0.0)).alias("weight"))
    return pixels, record


def checked(record: DataFrame) -> DataFrame:
    """The frame record, refused when a capture has frames whose drift could not be found."""
    lost = record.where("status = 'unresolved'").groupBy(KEY).agg(F.min("frame_index").alias("first")).limit(1).collect()
    if lost:
        raise ValueError(f"motion of capture {lost[0][KEY]} cannot be followed: the shared pixels do not fix the drift of frame {lost[0].first}")
    return record


def carried_places(scene: M.Scene, x: Column, y: Column, t: Column, angle: Column, centre: tuple[float, float], ref: M.Pose) -> Column:
    """STRUCT<x, y, valid, gain> of rows of rays: where their light is at ``ref``."""
    @F.arrow_udf("x double, y double, valid boolean, gain double")
    def run(x: pa.Array, y: pa.Array, t: pa.Array, angle: pa.Array) -> pa.Array:
        at = [v.to_numpy(zero_copy_only=False).astype(float) for v in (x, y, t, angle)]
        found = M.carried(scene, at[0], at[1], M.Pose(at[2], at[3], *centre), ref)
        return pa.StructArray.from_arrays([pa.array(np.broadcast_to(v, at[0].shape)) for v in found], names=["x", "y", "valid", "gain"])

    return run(x, y, t, angle)


def exposure_error(scene: M.Scene, start: M.Pose, ref: M.Pose, exposure_s: float, field_rate: float) -> Column:
    """How far the frame columns, taken for the scene at ``ref``, smear during an exposure: relative L2 against the frozen middle."""
    return FR.frame_value(lambda planes: np.array([M.mid_exposure_error(p, scene, start, ref, exposure_s, field_rate) for p in planes]))(*FR.FRAME)


def guarded_inverse(ux: Column, uy: Column, height: int, width: int) -> Column:
    """STRUCT<x, y, residual, least_jacobian> of a field in two array columns; x and y are those of the pixels where it cannot be trusted."""
    @F.arrow_udf("x array<double>, y array<double>, residual double, least_jacobian double")
    def run(ux: pa.Array, uy: pa.Array) -> pa.Array:
        fields = [v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), height, width) for v in (ux, uy)]
        jacobian = M.least_jacobian(*fields)
        folded = (jacobian < M.LEAST_JACOBIAN)[:, None, None]
        qx, qy, residual = M.inverse_field(*(np.where(folded, 0.0, f) for f in fields))
        return pa.StructArray.from_arrays([FR._lists(list(qx)), FR._lists(list(qy)), pa.array(residual), pa.array(jacobian)], names=["x", "y", "residual", "least_jacobian"])

    return run(ux, uy)


VIEW_DEPENDENT = ("latitude", "rate", "field_rate", "pole")


def without_assumed_view(estimates: DataFrame, assumed: Column) -> DataFrame:
    """Estimates of ringed captures without what depends on a latitude that was only assumed: an assumed view says nothing of the rings."""
    drop = F.coalesce(assumed, F.lit(False)) & F.col("latitude").isNotNull()
    return estimates.withColumns({**{c: F.when(~drop, F.col(c)) for c in VIEW_DEPENDENT}, "status": F.when(drop, "unresolved").otherwise(F.col("status"))})
