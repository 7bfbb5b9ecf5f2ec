"""Capture files, exports, streams and snapshots."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import provenance as PV
from framewright.operators import stacking as ST
from framewright.sources import ser, sinks
from framewright.sources.captures import from_arrays, open_capture, register
from framewright.streaming import stack as SS

RNG = np.random.default_rng(9)


def pixels(rows, shape, dtype="<u2"):
    return np.stack([np.frombuffer(r.pixels, dtype).reshape(shape) for r in rows])


@pytest.mark.parametrize("colour, shape, dtype", [("mono", (3, 6, 8), np.uint8), ("RGGB", (2, 8, 8), np.uint16), ("RGB", (1, 4, 4, 3), np.uint8), ("BGR", (1, 4, 4, 3), np.uint16)])
def test_round_trip(spark, tmp_path, colour, shape, dtype):
    data = RNG.integers(0, 200, shape).astype(dtype)
    path = ser.write_ser(str(tmp_path / "a.ser"), data, colour=colour, ticks=np.arange(shape[0]) * 5 + 10**15)
    rows = open_capture(spark, path).orderBy("frame_index").collect()
    want = data[..., ::-1] if colour == "BGR" else data
    assert np.array_equal(pixels(rows, shape[1:]), want)
    assert [r.ts_ticks for r in rows] == [10**15 + 5 * i for i in range(shape[0])]


@pytest.mark.parametrize("flag", [0, 1])
def test_byte_order(spark, tmp_path, flag):
    data = np.array([[[1, 2], [300, 65535]]], dtype=np.uint16)
    path = ser.write_ser(str(tmp_path / "e.ser"), data, endian_flag=flag)
    assert np.array_equal(pixels(open_capture(spark, path).collect(), (2, 2)), data)
    forced = open_capture(spark, path, endianOverride="big" if flag == 0 else "little").collect()
    assert np.array_equal(pixels(forced, (2, 2)), data.byteswap())


def test_truncation(spark, tmp_path):
    path = ser.write_ser(str(tmp_path / "t.ser"), RNG.integers(0, 9, (4, 4, 4)).astype(np.uint8))
    blob = open(path, "rb").read()
    with open(path, "wb") as file:
        file.write(blob[:-7])
    with pytest.raises(Exception, match="truncated"):
        open_capture(spark, path).count()
    assert open_capture(spark, path, recoverCompleteFrames="true").count() == 3


def test_frame_filter_narrows_the_scan(spark, tmp_path):
    path = ser.write_ser(str(tmp_path / "f.ser"), RNG.integers(0, 9, (50, 4, 4)).astype(np.uint8))
    reader = ser.SerReader({"path": path})
    rest = list(reader.pushFilters([ser.GreaterThanOrEqual(("frame_index",), 10), ser.LessThan(("frame_index",), 13), ser.EqualTo(("height",), 4)]))
    assert len(rest) == 1 and [(p.first, p.stop) for p in reader.partitions()] == [(10, 13)]
    picked = open_capture(spark, path).where("frame_index BETWEEN 10 AND 12")
    assert sorted(r.frame_index for r in picked.collect()) == [10, 11, 12]
    assert open_capture(spark, path, pixels="false").where("pixels IS NOT NULL").count() == 0


def test_filtered_export_keeps_bytes_and_order(spark, tmp_path):
    data = RNG.integers(0, 60000, (20, 5, 6)).astype(np.uint16)
    path = ser.write_ser(str(tmp_path / "in.ser"), data, colour="GBRG", ticks=np.arange(20) * 100, telescope="fps=50 gain=1 exp=10")
    chosen = spark.createDataFrame([(i,) for i in (17, 3, 9, 3)], "frame_index bigint")
    out = str(tmp_path / "out.ser")
    assert ser.export_ser(spark, path, chosen, out) == 3
    rows = open_capture(spark, out).orderBy("frame_index").collect()
    assert np.array_equal(pixels(rows, (5, 6)), data[[3, 9, 17]]) and [r.ts_ticks for r in rows] == [300, 900, 1700]
    assert rows[0].color_mode == "GBRG"
    with pytest.raises(FileExistsError):
        ser.export_ser(spark, path, chosen, out)


def avi_bytes(frames, group=0, start=0):
    """A small movie; with ``group`` its frames stand in nested lists of so many."""
    def chunk(tag, body):
        return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    n, h, w, _ = frames.shape
    stride = (w * 3 + 3) // 4 * 4
    strh = b"vids" + b"DIB " + struct.pack("<IHHIIIIIIII", 0, 0, 0, 0, 1, 25, start, n, 0, 0, 0) + b"\0" * 8
    strf = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    parts = []
    for f in frames:
        rows = np.zeros((h, stride), np.uint8)
        rows[:, : w * 3] = f[::-1, :, ::-1].reshape(h, -1)
        parts.append(chunk(b"00db", rows.tobytes()))
    if group:
        parts = [chunk(b"LIST", b"rec " + b"".join(parts[k : k + group]) + chunk(b"JUNK", b"odd")) for k in range(0, n, group)]
    riff = b"AVI " + chunk(b"LIST", b"INFO" + chunk(b"ISFT", b"x")) + chunk(b"LIST", hdrl) + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"")
    return b"RIFF" + struct.pack("<I", len(riff)) + riff


def test_avi_frames(spark, tmp_path):
    data = RNG.integers(0, 255, (3, 4, 5, 3)).astype(np.uint8)
    path = tmp_path / "m.avi"
    path.write_bytes(avi_bytes(data))
    rows = open_capture(spark, str(path)).orderBy("frame_index").collect()
    assert np.array_equal(pixels(rows, (4, 5, 3)), data) and rows[0].color_mode == "RGB"
    path.write_bytes(avi_bytes(data)[:-4])
    with pytest.raises(Exception, match="RIFF"):
        open_capture(spark, str(path)).count()
    path.write_bytes(avi_bytes(data, start=2))
    with pytest.raises(Exception, match="frame 0"):
        open_capture(spark, str(path)).count()


def test_avi_ranges_start_inside_nested_lists(tmp_path):
    from framewright.sources import avi

    data = RNG.integers(0, 255, (11, 3, 5, 3)).astype(np.uint8)
    path = tmp_path / "m.avi"
    path.write_bytes(avi_bytes(data, group=4))
    ranges = avi.plan(str(path), step=3)
    assert [(r.first, r.count) for r in ranges] == [(0, 3), (3, 3), (6, 3), (9, 2)]
    rows = [batch.to_pylist()[0] for r in ranges for batch in avi.AviReader(str(path)).read(r)]
    assert [r["frame_index"] for r in rows] == list(range(11))
    assert np.array_equal([np.frombuffer(r["pixels"], "<u2").reshape(3, 5, 3) for r in rows], data)
    path.write_bytes(avi_bytes(data[:5], group=4))
    with pytest.raises(ValueError, match="changed"):
        list(avi.AviReader(str(path)).read(ranges[0]))
    bad = avi_bytes(data).replace(b"00db", b"00wb", 1)
    path.write_bytes(bad)
    with pytest.raises(ValueError, match="unsupported"):
        avi.plan(str(path))


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        open_capture(spark, "capture.mov")


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    data = RNG.integers(0, 1000, (31, 4, 4)).astype(np.uint16)
    folder = tmp_path / "captures"
    folder.mkdir()
    ser.write_ser(str(folder / "a.ser"), data)
    ser.write_ser(str(folder / "b.ser"), data[:7])
    register(spark)
    from framewright.operators.frames import FRAME, frame_plane

    def start(settings):
        stream = spark.readStream.format("ser").load(str(folder))
        return SS.fold_stream(stream, str(tmp_path / "acc"), ["capture_id"], frame_plane(lambda p: p)(*FRAME), F.lit(1.0), settings)

    def used():
        return sorted(r.n_used for r in SS.frames_used(spark, str(tmp_path / "acc"), ["capture_id"]).collect())

    start({"w": 1}).awaitTermination(60)
    assert used() == [7, 31]  # one start folds all frames of all files
    start({"w": 1}).awaitTermination(60)
    assert used() == [7, 31]  # a restart counts nothing twice
    ser.write_ser(str(folder / "c.ser"), data[:5])
    start({"w": 1}).awaitTermination(60)
    assert used() == [5, 7, 31]
    total = ST.normalise(SS.stack_so_far(spark, str(tmp_path / "acc"), ["capture_id"])).toPandas().sort_values(["capture_id", "pos"])
    want = [data.mean(axis=0), data[:7].mean(axis=0), data[:5].mean(axis=0)]
    assert np.allclose(total.value, np.array(want).ravel())
    with pytest.raises(ValueError):
        start({"w": 2})


def test_streamed_table_of_one_file_or_a_folder(spark, tmp_path):
    from framewright.plans.records import streamed_stack

    pixels = RNG.random((6, 64))
    rows = [(i, i % 2, [float(v) for v in p]) for i, p in enumerate(pixels)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    table.write.parquet(str(tmp_path / "many" / "embeddings.parquet"))
    table.write.parquet(str(tmp_path / "many" / "others.parquet"))  # never read
    (tmp_path / "one").mkdir()
    table.toPandas().to_parquet(tmp_path / "one" / "embeddings.parquet")
    want = np.array([pixels[0::2].mean(axis=0), pixels[1::2].mean(axis=0)]).ravel()
    for name in ("many", "one"):
        got = streamed_stack(spark, str(tmp_path / name)).orderBy("capture_id", "y", "x").toPandas()
        assert np.allclose(got.value, want, atol=1e-7)


def test_snapshot_and_png(spark, tmp_path):
    frames = from_arrays(spark, "c", RNG.integers(0, 100, (3, 4, 6)))
    from framewright.operators.frames import FRAME, frame_plane

    plane = ST.normalise(ST.stack(frames, ["capture_id"], frame_plane(lambda p: p)(*FRAME), F.lit(1.0)))
    sinks.save_snapshot(plane, {"n": 3}, str(tmp_path / "snap"))
    back, record = sinks.load_snapshot(spark, str(tmp_path / "snap"))
    assert record == {"n": 3} and back.count() == 24
    with pytest.raises(Exception):
        sinks.save_snapshot(plane, {}, str(tmp_path / "snap"))
    sinks.write_png16(back, str(tmp_path / "o.png"), 4, 6, black=0.0, white=100.0)
    assert (tmp_path / "o.png").read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"


def test_digests(spark):
    frames = from_arrays(spark, "c", np.arange(5 * 4).reshape(5, 2, 2))
    whole = PV.ordered_digest(PV.frame_digests(frames), ["capture_id"], "frame_index", "leaf", block=2).first()
    again = PV.ordered_digest(PV.frame_digests(frames.repartition(3)), ["capture_id"], "frame_index", "leaf", block=2).first()
    assert whole == again and whole.leaves == 5
    assert PV.mismatches({"a": 1.0, "b": 2}, {"a": 1.0 + 1e-12, "c": 3}) == ["b", "c"]
    assert PV.json_safe({"x": [float("nan"), 1.0]}) == {"x": [None, 1.0]}
