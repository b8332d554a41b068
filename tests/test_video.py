"""The video source and sinks: ranges, projections, large and growing files, commits and aborts."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import video, y4m


def stream_bytes(w, h, space, frames, extra=""):
    return f"YUV4MPEG2 W{w} H{h} F25:1 Ip A0:0 C{space}{extra}\n".encode() + b"".join(b"FRAME\n" + f for f in frames)


def test_ranges_give_each_frame_once(spark, tmp_path):
    frames = [bytes([k]) * 24 for k in range(50)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.y4m").write_bytes(stream_bytes(4, 4, "420", frames, " XCOLORRANGE=FULL XEXTCS=RG10") + b"FRAME\nshort")
    (tmp_path / "sub" / "b.y4m").write_bytes(stream_bytes(3, 3, "mono10", [b"\1\2" * 9]))
    (tmp_path / "c.txt").write_text("no video")
    for size in (1, 7, 30, 31, 1000, 1 << 20):
        got = video.read_video(spark, str(tmp_path), range_bytes=size)
        rows = sorted((os.path.basename(r.path), r.frame_no, bytes(r.payload)) for r in got.collect())
        assert rows == [("a.y4m", k, f) for k, f in enumerate(frames)] + [("b.y4m", 0, b"\1\2" * 9)]
    one = got.filter("w = 4").first()
    assert (one.h, one.space, one.colorrange, one.extension["EXTCS"], one.depth, one.chroma_w, one.chroma_h) == (4, "420", "FULL", "RG10", 8, 2, 2)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.y4m").option("recursiveFileLookup", "true").load(str(tmp_path))
    old = {(os.path.basename(r.path), r.frame_no): bytes(r.payload) for r in y4m.frames(whole.select("path", "content")).collect()}
    assert old == {(p, n): f for p, n, f in rows}
    (tmp_path / "d.y4m").write_bytes(b"no stream")
    assert sorted((os.path.basename(r.path), r.frames, r.w, r.status.split(": ")[-1]) for r in video.heads(spark, str(tmp_path)).collect()) == [("a.y4m", 50, 4, "ok"), ("b.y4m", 1, 3, "ok"), ("d.y4m", None, None, "no Y4M stream")]
    (tmp_path / "d.y4m").unlink()
    assert {len(r.payload) for r in video.read_video(spark, f"file://{tmp_path}/a.y4m", planes="uv").collect()} == {8}
    assert video.read_video(spark, str(tmp_path), planes="").count() == 51


def test_a_file_of_five_gigabytes(spark, tmp_path):
    """A sparse file, read by many tasks; offsets beyond 32 bits."""
    w, h, n = 3840, 2160, 440
    head = stream_bytes(w, h, "420", [])
    stride = 6 + w * h * 3 // 2
    with open(tmp_path / "big.y4m", "wb") as f:
        f.write(head)
        for k in range(n):
            f.seek(len(head) + k * stride)
            f.write(b"FRAME\n" + bytes([k % 251]))
        f.truncate(len(head) + n * stride)
    assert os.path.getsize(tmp_path / "big.y4m") > 5 << 30
    got = video.read_video(spark, str(tmp_path), planes="")
    assert got.rdd.getNumPartitions() > 30 and got.agg(F.count("*"), F.max("frame_no"), F.countDistinct("frame_no")).first() == (n, n - 1, n)
    luma = video.read_video(spark, str(tmp_path), planes="y").filter(f"frame_no >= {n - 5}").select("frame_no", F.octet_length("payload").alias("n"), F.expr("hex(substring(payload, 1, 2))").alias("s"))
    assert sorted(tuple(r) for r in luma.collect()) == [(k, w * h, f"{k % 251:02X}00") for k in range(n - 5, n)]


def test_broken_files(spark, tmp_path):
    for k, (data, said) in enumerate([(b"nothing at all", "no Y4M"), (b"YUV4MPEG2 W4\n", "without a size"), (b"YUV4MPEG2 W2 H2 Cnone\n", "unknown colour"), (stream_bytes(2, 2, "mono", [b"1234"]) + b"FRANE\n1234", "no frame at byte"), (b"YUV4MPEG2 " + b"x" * 5000, "without an end")]):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / "x.y4m").write_bytes(data)
        with pytest.raises(Exception, match=said):
            video.read_video(spark, str(folder)).collect()
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.y4m").write_bytes(b"")
    assert video.read_video(spark, str(tmp_path / "empty")).count() == 0


def test_write_and_read_back(spark, tmp_path):
    rows = [(f"clip{k}/v.y4m", n, bytearray([16 * k + n] * 24), 4, 4, "420", "full", {"EXTCS": "RG10"}) for k in range(3) for n in range(5)]
    df = spark.createDataFrame(rows, "name string, frame_no long, payload binary, w int, h int, space string, colorrange string, extension map<string,string>")
    video.write_video(df.repartition(4, "frame_no"), str(tmp_path))
    assert (tmp_path / "clip1" / "v.y4m").read_bytes() == stream_bytes(4, 4, "420", [bytes([16 + n] * 24) for n in range(5)], " XEXTCS=RG10 XCOLORRANGE=FULL")
    got = video.read_video(spark, str(tmp_path)).collect()
    assert len(got) == 15 and {r.colorrange for r in got} == {"FULL"}
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".part")]


def test_a_failed_or_repeated_task_leaves_nothing(spark, tmp_path):
    """An attempt that dies after it wrote: the job's second attempt leaves one whole file each, a failed job none."""
    df = spark.createDataFrame([(f"{k}.bin", bytearray([k] * 10)) for k in range(6)], "name string, content binary").repartition(3)
    video.write_whole(df, str(tmp_path / "once"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "once").iterdir()} == {f"{k}.bin": bytes([k] * 10) for k in range(6)}
    # what an attempt without a message leaves is cleared by the commit
    sink = video.FileSink({"path": str(tmp_path / "again")})
    batch = df.limit(2).toArrow().to_batches()
    lost, kept = sink.write(iter(batch)), sink.write(iter(batch))
    assert len(os.listdir(tmp_path / "again")) == 4 and lost.files[0][0] != kept.files[0][0]
    sink.commit([None, kept])
    assert sorted(os.listdir(tmp_path / "again")) == sorted(n for _, n in kept.files)
    bad = df.withColumn("content", F.when(F.col("name") == "4.bin", F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        video.write_whole(bad, str(tmp_path / "never"))
    # a task that is killed late may still leave a hidden part, never a file under its name
    assert not (tmp_path / "never").exists() or all(n.startswith(".") for n in os.listdir(tmp_path / "never"))
    with pytest.raises(Exception, match="same name"):
        video.write_whole(df.withColumn("name", F.lit("one.bin")), str(tmp_path / "twice"))
    assert os.listdir(tmp_path / "twice") == []
    frames = spark.createDataFrame([("a.y4m", 0, bytearray(b"123"), 2, 2, "mono")], "name string, frame_no long, payload binary, w int, h int, space string")
    with pytest.raises(Exception, match="has 3 bytes, not 4"):
        video.write_video(frames, str(tmp_path / "wrong"))


def test_frames_of_a_growing_file(spark, tmp_path):
    """Each frame once, also after a restart in the middle of a file."""
    video.register(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        q = spark.readStream.format("y4m").option("path", str(source)).option("framesPerTask", 2).load().select("path", "frame_no", "payload")
        q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((os.path.basename(r.path), r.frame_no, bytes(r.payload)) for r in spark.read.parquet(out).collect())

    frames = [bytes([k]) * 4 for k in range(9)]
    whole = stream_bytes(2, 2, "mono", frames)
    (source / "a.y4m").write_bytes(stream_bytes(2, 2, "mono", frames[:3]) + b"FRAME\n\3")
    (source / "new.y4m").write_bytes(b"YUV4MPEG2 W2")
    assert run() == [("a.y4m", k, frames[k]) for k in range(3)]
    (source / "a.y4m").write_bytes(whole)
    (source / "new.y4m").write_bytes(whole[: len(whole) - 40])
    assert run() == [("a.y4m", k, frames[k]) for k in range(9)] + [("new.y4m", k, frames[k]) for k in range(5)]
    assert len(run()) == 14
