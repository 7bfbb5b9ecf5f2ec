"""Writing results: snapshots, images, tables and text."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_codes(value: Column, valid: Column, black: float, white: float, gamma: float | None = None) -> Column:
    """16-bit code of a linear value: clipped, optional display gamma, nearest with ties upward; invalid is black."""
    if not white > black:
        raise ValueError("white must exceed black")
    unit = F.least(F.greatest((value - black) / (white - black), F.lit(0.0)), F.lit(1.0))
    if gamma is not None:
        unit = F.pow(unit, F.lit(1.0 / gamma))
    return F.when(valid & ~F.isnan(value), F.floor(unit * 65535 + 0.5)).otherwise(F.lit(0)).cast("int")


def export_counts(pixels: DataFrame, keys: list[str], black: float, white: float) -> DataFrame:
    """Invalid and clipped samples of an export."""
    good = F.col("valid") & ~F.isnan("value")
    return pixels.groupBy(*keys).agg(
        F.count_if(~good).alias("invalid_samples"), F.count_if(good & (F.col("value") < black)).alias("clipped_low_samples"),
        F.count_if(good & (F.col("value") > white)).alias("clipped_high_samples"))


def write_png16(pixels: DataFrame, path: str, height: int, width: int, *, black: float, white: float, gamma: float | None = None,
                record: dict | None = None, overwrite: bool = False) -> None:
    """One result plane (pos, value, valid) as a 16-bit grey PNG with its record embedded.

    The driver receives the codes of a single image, never frames.
    """
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    codes = np.zeros(height * width, dtype=">u2")
    for row in pixels.select("pos", to_codes(F.col("value"), F.col("valid"), black, white, gamma).alias("code")).toLocalIterator():
        codes[row.pos] = row.code
    lines = b"".join(b"\0" + line.tobytes() for line in codes.reshape(height, width))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    text = b"Description\0" + json.dumps(record or {}, sort_keys=True).encode("latin-1", "replace")
    staged = path + ".part"
    with open(staged, "wb") as file:
        file.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 16, 0, 0, 0, 0)) + chunk(b"tEXt", text)
                   + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
    os.replace(staged, path)


TIFF_KINDS = {"tiff16": (16, 1, "<u2"), "tiff32": (32, 3, "<f4")}
_FIELD_BYTES = {2: 1, 3: 2, 4: 4, 16: 8}


def _tiff_head(width: int, height: int, channels: int, bits: int, kind: int, description: bytes, rows: int) -> bytes:
    """Everything before the strips of an uncompressed image; beyond 4 GB of samples in the 64-bit variant of the format."""
    row_bytes = width * channels * bits // 8
    strips = -(-height // rows)
    counts = [min(rows, height - k * rows) * row_bytes for k in range(strips)]
    wide = height * row_bytes > (1 << 32) - (1 << 25)
    number, slot, entry, first = (16, 8, 20, 16) if wide else (4, 4, 12, 8)

    def packed(code: int, values: list[int]) -> bytes:
        return struct.pack("<" + {3: "H", 4: "I", 16: "Q"}[code] * len(values), *values)

    fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * channels), (259, 3, [1]), (262, 3, [2 if channels == 3 else 1]), (270, 2, description + b"\0"),
              (273, number, [0] * strips), (274, 3, [1]), (277, 3, [channels]), (278, 4, [rows]), (279, number, counts), (284, 3, [1]), (339, 3, [kind] * channels)]
    directory = (8 if wide else 2) + entry * len(fields) + slot
    spill, at = [], first + directory
    for tag, code, values in fields:
        size = len(values) * _FIELD_BYTES[code]
        spill.append(at if size > slot else None)
        at += size + size % 2 if size > slot else 0
    starts = [at + k * rows * row_bytes for k in range(strips)]
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if wide else struct.pack("<2sHI", b"II", 42, first)
    body, tail = struct.pack("<Q" if wide else "<H", len(fields)), b""
    for (tag, code, values), place in zip(fields, spill):
        raw = values if isinstance(values, bytes) else packed(code, starts if tag == 273 else values)
        body += struct.pack("<HHQ" if wide else "<HHI", tag, code, len(values))
        body += raw.ljust(slot, b"\0") if place is None else struct.pack("<Q" if wide else "<I", place)
        tail += b"" if place is None else raw + b"\0" * (len(raw) % 2)
    return head + body + b"\0" * slot + tail


def write_tiff(pixels: DataFrame, path: str, height: int, width: int, *, channels: int = 1, encoding: str = "tiff32", black: float = 0.0, white: float = 1.0,
               gamma: float | None = None, record: dict | None = None, overwrite: bool = False, strip_bytes: int = 1 << 20) -> dict:
    """One result (pos, value, valid; positions run over channels one after the other) as a TIFF of 16-bit codes or 32-bit floats.

    Samples are ordered by range and written by the tasks that hold them at their place in a file of the final size,
    so an image is never gathered; a repeated task writes the same bytes. Floats are ``value / white``, not clipped and
    reversible; samples without a value are 0. The description holds ``record``, the mapping and the counts of invalid and
    clipped samples, and a file beside it the digest of the whole. The folder must be one that driver and executors share.
    """
    if encoding not in TIFF_KINDS or channels not in (1, 3) or not white > black:
        raise ValueError("write_tiff takes tiff16 or tiff32, one or three channels, and white above black")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    bits, kind, dtype = TIFF_KINDS[encoding]
    good = F.col("valid") & ~F.isnan("value")
    counts = pixels.agg(F.count_if(~good).alias("invalid"), F.count_if(good & (F.col("value") < black)).alias("low"), F.count_if(good & (F.col("value") > white)).alias("high")).first()
    clipped = {"clipped_low": counts.low, "clipped_high": counts.high} if encoding == "tiff16" else {"clipped_low": 0, "clipped_high": 0}
    mapping = {"encoding": encoding, "black": black if encoding == "tiff16" else 0.0, "white": white, "gamma": gamma if encoding == "tiff16" else None}
    described = {**(record or {}), "mapping": mapping, "counts": {"invalid": counts.invalid, **clipped}}
    text = json.dumps(described, sort_keys=True, allow_nan=False).encode("ascii")
    head = _tiff_head(width, height, channels, bits, kind, text, max(1, strip_bytes // (width * channels * bits // 8)))
    start, size, staged = len(head), width * height * channels * bits // 8, path + ".part"
    with open(staged, "wb") as file:
        file.write(head)
        file.truncate(start + size)
    sample = to_codes(F.col("value"), F.col("valid"), black, white, gamma) if encoding == "tiff16" else F.when(good, F.col("value") / white).otherwise(0.0)
    plane = height * width
    place = F.pmod(F.col("pos"), F.lit(plane)) * channels + F.floor(F.col("pos") / plane)
    rows = pixels.select(place.cast("long").alias("place"), sample.alias("sample")).repartitionByRange("place").sortWithinPartitions("place")

    def write(batches):
        import pyarrow as pa

        done = 0
        with open(staged, "r+b") as file:
            for batch in batches:
                places, samples = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for run in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) != 1) + 1):
                    if len(run):
                        file.seek(start + int(places[run[0]]) * bits // 8)
                        file.write(samples[run].astype(dtype).tobytes())
                        done += len(run)
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["written"])

    written = rows.mapInArrow(write, "written long").agg(F.sum("written")).first()[0] or 0
    digest = hashlib.sha256()
    with open(staged, "rb") as file:
        while block := file.read(1 << 22):
            digest.update(block)
    report = {**described, "samples": written, "sha256": digest.hexdigest()}
    with open(path + ".json.part", "w") as file:
        json.dump(report, file, sort_keys=True)
    os.replace(path + ".json.part", path + ".json")
    os.replace(staged, path)
    return report


def save_snapshot(pixels: DataFrame, record: dict, folder: str) -> None:
    """Result pixels and their record; an existing snapshot is never replaced."""
    pixels.write.mode("errorifexists").parquet(f"{folder}/pixels")
    pixels.sparkSession.createDataFrame([(json.dumps(record, sort_keys=True, allow_nan=False),)], "record string").coalesce(1).write.mode(
        "errorifexists").json(f"{folder}/record")


def load_snapshot(spark, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/pixels"), json.loads(spark.read.json(f"{folder}/record").first()["record"])


def write_table(rows: DataFrame, folder: str) -> None:
    """Evaluation rows as CSV with a header."""
    rows.write.mode("errorifexists").option("header", True).csv(folder)


def classification_line() -> Column:
    """One readable line per regime from the columns of the gap classes."""
    return F.format_string("regime %s: %s, n=%d, median %.4f [%.4f, %.4f]", "regime", "label", "n", "median", "p16", "p84")
