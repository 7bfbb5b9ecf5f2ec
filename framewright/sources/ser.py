"""SER captures as a Spark data source: batch scan, stream and parallel export.

A capture is split into contiguous frame ranges; executors seek to their range.
Filters on ``frame_index`` narrow the ranges before anything is read, and
``pixels=false`` leaves the samples on disk. Files must be visible to all
executors (a shared file system).
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual)

from framewright import constants as C

# Fixed layout: magic, seven little-endian integers, three 40-byte strings, two tick fields.
LAYOUT = struct.Struct("<14s7i40s40s40s2q")
RANGE_BYTES = 64 << 20
BATCH_BYTES = 16 << 20
SCHEMA = ("capture_id string, frame_index bigint, ts_ticks bigint, height int, width int, channels int, "
          "color_mode string, bit_depth int, pixels binary")
NUMBER_OF = {name: number for number, name in C.SER_COLOURS.items()}


@dataclass(frozen=True)
class Header:
    lu_id: int
    colour: int
    endian_flag: int
    width: int
    height: int
    depth: int
    frames: int
    observer: bytes = b""
    instrument: bytes = b""
    telescope: bytes = b""
    local_ticks: int = 0
    utc_ticks: int = 0

    @classmethod
    def parse(cls, blob: bytes) -> Header:
        if len(blob) < C.SER_HEADER_BYTES:
            raise ValueError(f"header has {len(blob)} bytes, expected {C.SER_HEADER_BYTES}")
        magic, *fields = LAYOUT.unpack(blob[: C.SER_HEADER_BYTES])
        if magic != C.SER_MAGIC:
            raise ValueError(f"not a SER capture: {magic!r}")
        header = cls(*fields)
        if header.colour not in C.SER_COLOURS:
            raise ValueError(f"unknown colour id {header.colour}")
        return header

    def pack(self) -> bytes:
        return LAYOUT.pack(C.SER_MAGIC, self.lu_id, self.colour, self.endian_flag, self.width, self.height, self.depth,
                           self.frames, self.observer, self.instrument, self.telescope, self.local_ticks, self.utc_ticks)

    @property
    def channels(self) -> int:
        return 3 if C.SER_COLOURS[self.colour] in ("RGB", "BGR") else 1

    @property
    def sample_bytes(self) -> int:
        return 1 if self.depth <= 8 else 2

    @property
    def frame_bytes(self) -> int:
        return self.height * self.width * self.channels * self.sample_bytes

    @staticmethod
    def text(raw: bytes) -> str:
        return raw.partition(b"\0")[0].decode("utf-8", "replace").strip()


@dataclass
class Capture:
    """What the driver knows about one file, checked again before frames are read."""

    path: str
    header: Header
    frames: int
    trailer: int | None
    little: bool
    colour: str
    identity: tuple

    @classmethod
    def open(cls, path: str, options: dict) -> Capture:
        with open(path, "rb") as file:
            header = Header.parse(file.read(C.SER_HEADER_BYTES))
        body = os.path.getsize(path) - C.SER_HEADER_BYTES
        wanted = header.frames * header.frame_bytes
        frames, trailer = header.frames, None
        if body < wanted:
            frames = body // header.frame_bytes
            if str(options.get("recovercompleteframes", "false")).lower() != "true":
                raise ValueError(f"{path} is truncated: {frames} of {header.frames} frames are complete")
        elif body - wanted == 8 * frames and frames:
            trailer = C.SER_HEADER_BYTES + wanted
        elif body != wanted:
            raise ValueError(f"{path} has an incomplete or oversized timestamp trailer")
        colour = options.get("bayeroverride") or C.SER_COLOURS[header.colour]
        if options.get("bayeroverride") and header.channels != 1:
            raise ValueError("a site pattern needs single-plane samples")
        # In the common convention a zero flag marks little-endian samples; the literal one reads it the other way.
        little = (header.endian_flag == 0) != (options.get("endianconvention", "ecosystem") == "specification")
        if options.get("endianoverride"):
            little = options["endianoverride"] == "little"
        return cls(path, header, frames, trailer, little, colour, cls.stamp(path))

    @staticmethod
    def stamp(path: str) -> tuple:
        s = os.stat(path)
        return s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns

    def ticks(self, file, first: int, count: int) -> np.ndarray | None:
        if self.trailer is None:
            return None
        file.seek(self.trailer + 8 * first)
        return np.frombuffer(file.read(8 * count), dtype="<i8")

    def samples(self, blob: bytes, count: int) -> np.ndarray:
        """(count, samples) little-endian 16-bit, BGR turned to RGB."""
        kind = "u1" if self.header.sample_bytes == 1 else ("<u2" if self.little else ">u2")
        block = np.frombuffer(blob, dtype=kind).astype("<u2").reshape(count, -1)
        if self.colour == "BGR":
            block = block.reshape(count, -1, 3)[:, :, ::-1].reshape(count, -1)
        return np.ascontiguousarray(block)

    def read(self, first: int, stop: int, with_pixels: bool) -> Iterator[pa.RecordBatch]:
        if self.stamp(self.path) != self.identity:
            raise OSError(f"{self.path} changed while it was read")
        h = self.header
        step = max(1, BATCH_BYTES // max(1, h.frame_bytes))
        with open(self.path, "rb") as file:
            for start in range(first, stop, step):
                count = min(step, stop - start)
                ticks = self.ticks(file, start, count)
                pixels = pa.nulls(count, pa.binary())
                if with_pixels:
                    file.seek(C.SER_HEADER_BYTES + start * h.frame_bytes)
                    blob = file.read(count * h.frame_bytes)
                    if len(blob) != count * h.frame_bytes:
                        raise OSError(f"{self.path} was cut short while it was read")
                    pixels = pa.array([row.tobytes() for row in self.samples(blob, count)], type=pa.binary())
                colour = "RGB" if self.colour == "BGR" else self.colour
                same = lambda value, kind: pa.array([value] * count, type=kind)
                yield pa.RecordBatch.from_arrays(
                    [same(os.path.basename(self.path), pa.string()), pa.array(np.arange(start, start + count)),
                     pa.nulls(count, pa.int64()) if ticks is None else pa.array(ticks.astype(np.int64)), same(h.height, pa.int32()),
                     same(h.width, pa.int32()), same(h.channels, pa.int32()), same(colour, pa.string()), same(h.depth, pa.int32()), pixels],
                    names=["capture_id", "frame_index", "ts_ticks", "height", "width", "channels", "color_mode", "bit_depth", "pixels"])


@dataclass
class FrameRange(InputPartition):
    capture: Capture
    first: int
    stop: int


def _ranges(capture: Capture, first: int, stop: int) -> list[FrameRange]:
    step = max(1, RANGE_BYTES // max(1, capture.header.frame_bytes))
    return [FrameRange(capture, a, min(a + step, stop)) for a in range(first, stop, step)]


def _paths(options: dict) -> list[str]:
    path = options["path"]
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if n.lower().endswith(".ser"))
    return [path]


class SerSource(DataSource):
    """``spark.read.format("ser").load(file or folder)``."""

    @classmethod
    def name(cls) -> str:
        return "ser"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SerReader:
        return SerReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> SerStreamReader:
        return SerStreamReader({k.lower(): v for k, v in self.options.items()})


class SerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.first, self.stop = 0, None

    def pushFilters(self, filters: list[Filter]):
        """Narrow the frame range; every other filter stays with Spark."""
        for f in filters:
            bound = None
            if getattr(f, "attribute", None) == ("frame_index",) and isinstance(getattr(f, "value", None), int):
                bound = {EqualTo: (f.value, f.value + 1), GreaterThan: (f.value + 1, None), GreaterThanOrEqual: (f.value, None),
                         LessThan: (0, f.value), LessThanOrEqual: (0, f.value + 1)}.get(type(f))
            if bound is None:
                yield f
                continue
            self.first = max(self.first, bound[0])
            if bound[1] is not None:
                self.stop = bound[1] if self.stop is None else min(self.stop, bound[1])

    def partitions(self) -> list[FrameRange]:
        found = []
        for path in _paths(self.options):
            capture = Capture.open(path, self.options)
            stop = capture.frames if self.stop is None else min(self.stop, capture.frames)
            found += _ranges(capture, self.first, stop)
        return found

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return iter(())
        return partition.capture.read(partition.first, partition.stop, self.options.get("pixels", "true") != "false")


CHUNK_FRAMES = 64
CHUNKS = "path string, frame_indices array<bigint>, quality array<double>, selected array<boolean>"
PICKED = SCHEMA + ", quality double, selected boolean"


def chunks_of(wanted: DataFrame, path: str, step: int = CHUNK_FRAMES) -> DataFrame:
    """Rows (capture_id, frame_index, quality, selected) as lists of up to ``step`` neighbouring frames to read.

    ``path`` is the file, or the folder in which captures have the names of their files.
    """
    place = F.concat(F.lit(path.rstrip("/") + "/"), F.col("capture_id")) if os.path.isdir(path) else F.lit(path)
    frame = F.struct("frame_index", "quality", "selected")
    found = wanted.groupBy("capture_id", F.floor(F.col("frame_index") / step).alias("chunk")).agg(F.array_sort(F.collect_list(frame)).alias("f"))
    return found.select(place.alias("path"), F.col("f.frame_index").alias("frame_indices"), F.col("f.quality").alias("quality"), F.col("f.selected").alias("selected"))


def whole_chunks(spark: SparkSession, path: str, step: int, **options: str) -> DataFrame:
    """Lists of all frames of one capture or of those of a folder."""
    options = {k.lower(): v for k, v in options.items()}
    found = [(p, Capture.open(p, options).frames) for p in _paths({"path": path})]
    starts = spark.createDataFrame(found, "path string, frames bigint").where("frames > 0")
    begin = starts.select("path", "frames", F.explode(F.sequence(F.lit(0), F.col("frames") - 1, F.lit(step))).alias("first"))
    indices = F.sequence(F.col("first"), F.least(F.col("first") + step, F.col("frames")) - 1)
    return begin.select("path", indices.alias("frame_indices"), F.transform(indices, lambda _: F.lit(1.0)).alias("quality"),
                        F.transform(indices, lambda _: F.lit(True)).alias("selected"))


def read_chunks(chunks: DataFrame, **options: str) -> DataFrame:
    """The frames named by rows of ``CHUNKS``, read where the rows are, with their quality and choice; no other frame is read."""
    options = {k.lower(): v for k, v in options.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                capture = Capture.open(row["path"], options)
                indices = np.array(row["frame_indices"], dtype=np.int64)
                if len(indices) and not 0 <= indices.min() <= indices.max() < capture.frames:
                    raise ValueError(f"{row['path']} has {capture.frames} frames; frames {indices.min()} to {indices.max()} were asked for")
                for run in np.split(np.arange(len(indices)), np.flatnonzero(np.diff(indices) != 1) + 1):
                    at = 0
                    for part in capture.read(int(indices[run[0]]), int(indices[run[-1]]) + 1, True) if len(run) else ():
                        mine = run[at : at + part.num_rows]
                        at += part.num_rows
                        extra = [pa.array([row[c][k] for k in mine], t) for c, t in (("quality", pa.float64()), ("selected", pa.bool_()))]
                        yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "quality", "selected"])

    return chunks.select("path", "frame_indices", "quality", "selected").mapInArrow(read, PICKED)


class SerStreamReader(DataSourceStreamReader):
    """Frames of one capture or of all captures of a folder; the offset is the next frame of each file.

    A trigger takes every frame that has arrived. It is not cut into steps: its frames are read
    in ranges of bounded size, and a start with ``availableNow`` asks for the newest offset once.
    """

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: Capture.open(path, self.options).frames for path in sorted(_paths(self.options))}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        return [r for path, stop in end.items() if stop > start.get(path, 0)
                for r in _ranges(Capture.open(path, self.options), start.get(path, 0), stop)]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        return partition.capture.read(partition.first, partition.stop, True)

    def commit(self, end: dict) -> None:
        """Nothing to release: the files stay where they are."""


def write_ser(path: str, frames: np.ndarray, *, colour: str = "mono", ticks: np.ndarray | None = None, telescope: str = "",
              depth: int | None = None, endian_flag: int = 0, utc_ticks: int = 0) -> str:
    """Write a small capture from an array; large ones go through :func:`export_ser`."""
    frames = np.asarray(frames)
    depth = depth or (8 if frames.dtype == np.uint8 else 16)
    header = Header(0, NUMBER_OF[colour], endian_flag, frames.shape[2], frames.shape[1], depth, len(frames),
                    telescope=telescope.encode(), utc_ticks=utc_ticks)
    if header.channels != (frames.shape[3] if frames.ndim == 4 else 1):
        raise ValueError("colour and frame shape disagree")
    if ticks is not None and len(ticks) != len(frames):
        raise ValueError("one timestamp per frame is needed")
    kind = "u1" if header.sample_bytes == 1 else ("<u2" if endian_flag == 0 else ">u2")
    with open(path, "wb") as file:
        file.write(header.pack() + frames.astype(kind).tobytes() + (b"" if ticks is None else np.asarray(ticks, "<i8").tobytes()))
    return path


def export_ser(spark: SparkSession, source: str, selected: DataFrame, destination: str, *, overwrite: bool = False) -> int:
    """Copy selected frames verbatim, in capture order, into a new capture.

    ``selected`` has frame_index. The place of every frame in the output follows
    from its rank, so tasks write their frames straight to their final offset of
    one pre-sized file; a retried task writes the same bytes again. The file gets
    its name only when it is complete and the input has not changed.
    """
    from framewright.operators.ordering import rank_rows

    if os.path.exists(destination) and (not overwrite or os.path.samefile(source, destination)):
        raise FileExistsError(destination)
    capture = Capture.open(source, {})
    placed = rank_rows(selected.select(F.lit(0).alias("capture"), "frame_index").distinct(), ["capture"], "frame_index", "frame_index")
    count = placed.count()
    if not count:
        raise ValueError("no frames are selected")
    size = capture.header.frame_bytes
    with open(source, "rb") as file:
        head = bytearray(file.read(C.SER_HEADER_BYTES))  # text fields stay as they are
    struct.pack_into("<i", head, 38, count)
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(destination)), suffix=".part")
    with os.fdopen(handle, "r+b") as file:
        file.write(head)
        file.truncate(C.SER_HEADER_BYTES + count * (size + (8 if capture.trailer is not None else 0)))

    def copy(rows) -> None:
        with open(source, "rb") as src, open(part, "r+b") as dst:
            for row in rows:
                src.seek(C.SER_HEADER_BYTES + row.frame_index * size)
                dst.seek(C.SER_HEADER_BYTES + (row.rank - 1) * size)
                dst.write(src.read(size))
                ticks = capture.ticks(src, row.frame_index, 1)
                if ticks is not None:
                    dst.seek(C.SER_HEADER_BYTES + count * size + 8 * (row.rank - 1))
                    dst.write(ticks.tobytes())

    placed.select("frame_index", "rank").foreachPartition(copy)
    if Capture.stamp(source) != capture.identity:
        raise OSError("the input capture changed during the export; nothing was published")
    if overwrite:
        os.replace(part, destination)
    else:
        os.link(part, destination)  # fails if another writer was faster
        os.unlink(part)
    return count
