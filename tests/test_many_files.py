"""Many small files: tasks move them to their names and list them, not the driver."""

from __future__ import annotations

import os

import pytest
from conftest import DATA
from pyspark.sql import functions as F

import tessera.plans.queries  # noqa: F401  registers the queries
from tessera.plans import file_queries
from tessera.sources import images, raw, video


def test_files_are_listed_as_spark_names_them(spark, tmp_path):
    for name in ("a.TXT", "b c.jpg", "e%20.y4m", ".hidden", "_no", "_k=1", "x/d", "x/y/z.png", "x/.h/n", "_temporary/n", "empty/.n", "u._COPYING_"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1" * len(name))
    for path in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/x/", f"{tmp_path}/a.TXT", f"{tmp_path}/empty", f"{tmp_path}/x*"):
        want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
        assert sorted(map(tuple, raw.metadata(spark, path).select("path", "length").collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(FileNotFoundError):
        raw.metadata(spark, str(tmp_path / "none"))


def test_tasks_move_and_list_files(spark, tmp_path, monkeypatch):
    def never(*_):
        raise AssertionError("the driver moves or lists files")

    monkeypatch.setattr(video._Sink, "commit", never)
    monkeypatch.setattr(video, "listed", never)
    df = spark.range(600).select(F.concat("id", F.lit(".bin")).alias("name"), F.when(F.col("id") > 0, F.encode(F.col("id").cast("string"), "UTF-8")).alias("content"))
    video.write_whole(df, f"file://{tmp_path}/many", folders=16)
    got = raw.metadata(spark, f"{tmp_path}/many")
    assert got.rdd.getNumPartitions() <= 4 and sorted(os.listdir(tmp_path / "many")) == sorted(f"{k:x}" for k in range(16))
    assert {os.path.basename(r.path): r.length for r in got.collect()} == {f"{k}.bin": len(str(k)) if k else 0 for k in range(600)}
    video.write_whole(df.limit(3).withColumn("name", F.concat(F.lit("x/y/"), "name")), str(tmp_path / "below"))
    assert sorted(p.name for p in (tmp_path / "below" / "x" / "y").iterdir()) == ["0.bin", "1.bin", "2.bin"] and os.listdir(tmp_path / "below") == ["x"]
    video.write_whole(df.limit(0), str(tmp_path / "nothing"))
    assert os.listdir(tmp_path / "nothing") == []
    with pytest.raises(ValueError, match="same name"):
        video.write_whole(df.unionByName(df.filter("id = 7")), str(tmp_path / "twice"), folders=16)
    assert os.listdir(tmp_path / "twice") == []


def test_documents_lie_in_folders(spark):
    folder = file_queries.whole_files(spark, DATA)
    names = raw.metadata(spark, folder).select(F.element_at(F.split("path", "/"), -2).alias("folder"), file_queries._base().alias("name"))
    found = names.agg(F.count("*"), F.countDistinct("name"), F.countDistinct("folder")).first()
    assert found[:2] == (200, 200) and found[2] > 100


def test_colour_ranges_in_one_pass(spark, tmp_path, monkeypatch):
    """Files are listed once, by tasks; the first bytes of streams alone are read. Names with other signs than letters, and files that are no stream."""

    def never(*_):
        raise AssertionError("the driver lists files")

    monkeypatch.setattr(video, "listed", never)
    whole = b"YUV4MPEG2 W2 H2 Cmono XCOLORRANGE=FULL\nFRAME\n1234"
    made = {"a.y4m": whole, "b%20 c#d?e.y4m": whole, "x/c.y4m": whole.replace(b"FULL", b"LIMITED"), "d.y4m": b"no stream", "e.y4m": b"YUV4MPEG2 W2", "f.y4m": b"", "g.Y4M": whole, "h.JPG": b"", "x/i.jpeg": b"1", "j": whole}
    (tmp_path / "x").mkdir()
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    want = {"a.y4m": "full", "b%20 c#d?e.y4m": "full", "c.y4m": "limited", "h.JPG": "full", "i.jpeg": "full"}
    got = images.colour_range(spark, str(tmp_path))
    assert {os.path.basename(r.path): r.range for r in got.collect()} == {os.path.basename(n): want.get(os.path.basename(n), "unspecified") for n in made}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 2
    status = {os.path.basename(r.path): (r.frames, r.status.split(": ")[-1]) for r in video.heads(spark, f"file://{tmp_path}").collect()}
    assert status == {"a.y4m": (1, "ok"), "b%20 c#d?e.y4m": (1, "ok"), "c.y4m": (1, "ok"), "d.y4m": (None, "no Y4M stream"), "e.y4m": (None, "a header that is not whole"), "f.y4m": (None, "a header that is not whole")}
