"""Y4M video as a Spark data source: files split by byte ranges for reading, frames as they are written for streams, and a sink with commit and abort.

Frames lie a fixed stride apart, which the header gives, so a task finds the frames of its range by arithmetic: a file of any size is read by as many tasks as it has
ranges, each one frame at a time. The driver lists names and sizes only. `planes` picks what of a frame is read ("yuv", "y", "" for frame numbers alone).

    register(spark)
    spark.read.format("y4m").option("path", folder).option("planes", "y").load()
    spark.readStream.format("y4m").option("path", folder).load()          # frames of growing files, each once
    df.write.format("y4m").mode("append").option("path", folder).save()   # name, frame_no, payload, w, h, space
    df.write.format("whole-files").mode("append").option("path", folder).save()  # name, content

Tasks write hidden parts beside the target; the driver moves them to their names when all tasks are done, and removes what failed or repeated attempts left by then. Frames of a stream go to one
task in order (`write_video`), which holds one batch of them. `write_whole` is for many files: tasks, not the driver, move them to their names, and `files` lists them by tasks. Paths are local (a folder that all machines share) or of any file system that pyarrow opens by its scheme.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..functions.formats import COLOUR_SPACES
from .folders import dealt

MAGIC, FRAME, LONGEST_HEADER = b"YUV4MPEG2", b"FRAME\n", 4096
SCHEMA = "path string, frame_no bigint, w int, h int, framerate string, interlace string, aspect string, space string, colorrange string, extension map<string,string>, depth int, chroma_w int, chroma_h int, payload binary"
#: Bytes of a range, and of the frames handed on at once.
RANGE, AT_ONCE = 128 << 20, 16 << 20
_ARROW = pa.schema(
    [("path", pa.string()), ("frame_no", pa.int64()), ("w", pa.int32()), ("h", pa.int32())]
    + [(c, pa.string()) for c in ("framerate", "interlace", "aspect", "space", "colorrange")]
    + [("extension", pa.map_(pa.string(), pa.string())), ("depth", pa.int32()), ("chroma_w", pa.int32()), ("chroma_h", pa.int32()), ("payload", pa.binary())]
)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(urlparse(path).path) if scheme else path
    return pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Head:
    """A stream's header: its length, fields, and where frames lie."""

    length: int
    fields: dict
    depth: int
    luma: int  # bytes of planes
    chroma: int
    chroma_w: int
    chroma_h: int

    @property
    def stride(self) -> int:
        return len(FRAME) + self.luma + 2 * self.chroma

    def frames(self, size: int) -> int:
        """Whole frames of a file of `size` bytes."""
        return max(0, (size - self.length) // self.stride)


def read_head(data: bytes, path: str = "") -> Head | None:
    """None if the header's line is not yet there; an error if it is no Y4M."""
    if not data.startswith(MAGIC[: len(data)]):
        raise ValueError(f"{path}: no Y4M stream")
    end = data.find(b"\n")
    if end < 0:
        if len(data) >= LONGEST_HEADER:
            raise ValueError(f"{path}: a header without an end")
        return None
    parts = data[:end].decode("utf-8", "replace").split(" ")[1:]
    first = {}
    for p in parts:
        first.setdefault(p[:1], p[1:])
    extension = dict(p[1:].partition("=")[::2] for p in parts if p.startswith("X"))
    if "W" not in first or "H" not in first:
        raise ValueError(f"{path}: a header without a size")
    w, h, space = int(first["W"]), int(first["H"]), first.get("C", "420")
    if space not in COLOUR_SPACES:
        raise ValueError(f"{path}: an unknown colour space: {space}")
    kind, depth = COLOUR_SPACES[space]
    cw, ch = {"400": (0, 0), "444": (w, h), "422": ((w + 1) // 2, h), "420": ((w + 1) // 2, (h + 1) // 2)}[kind]
    each = 1 if depth == 8 else 2
    fields = {"w": w, "h": h, "framerate": first.get("F"), "interlace": first.get("I"), "aspect": first.get("A"), "space": space, "colorrange": extension.get("COLORRANGE"), "extension": extension}
    return Head(end + 1, fields, depth, w * h * each, cw * ch * each, cw, ch)


@dataclass(frozen=True)
class Range(InputPartition):
    """Frames whose first byte lies in [start, stop) behind the header, or (by number) frames first..last of a file."""

    path: str
    start: int
    stop: int
    size: int
    by_number: bool = False


def frames_of(part: Range, planes: str) -> Iterator[pa.RecordBatch]:
    fs, path = filesystem(part.path)
    with fs.open_input_file(path) as f:
        head = read_head(f.read(LONGEST_HEADER), part.path)
        if head is None:
            return
        first, last = (part.start, part.stop) if part.by_number else (-(-max(0, part.start - head.length) // head.stride), -(-max(0, part.stop - head.length) // head.stride))
        last = min(last, head.frames(part.size))
        at = {"y": (0, head.luma), "u": (head.luma, head.chroma), "v": (head.luma + head.chroma, head.chroma)}
        wanted = [at[c] for c in planes]
        rows, held = [], 0
        for n in range(first, last):
            f.seek(head.length + n * head.stride)
            if f.read(len(FRAME)) != FRAME:
                raise ValueError(f"{part.path}: no frame at byte {head.length + n * head.stride}")
            base, pieces = f.tell(), []
            for offset, size in wanted:
                f.seek(base + offset)
                pieces.append(f.read(size))
            rows.append((n, b"".join(pieces)))
            held += len(rows[-1][1])
            if held >= AT_ONCE or len(rows) >= 4096:
                yield _batch(part.path, head, rows)
                rows, held = [], 0
        if rows:
            yield _batch(part.path, head, rows)


def _batch(path: str, head: Head, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    same = {"path": path, **head.fields, "extension": list(head.fields["extension"].items()), "depth": head.depth, "chroma_w": head.chroma_w, "chroma_h": head.chroma_h}
    own = {"frame_no": [n for n, _ in rows], "payload": [p for _, p in rows]}
    return pa.RecordBatch.from_arrays([pa.array(own.get(c.name) or [same[c.name]] * len(rows), c.type) for c in _ARROW], schema=_ARROW)


def listed(path: str, suffix: str = ".y4m") -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder with the suffix, by name."""
    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((prefix + i.path, i.size) for i in found if i.type == pafs.FileType.File and i.path.endswith(suffix) and not posixpath.basename(i.path).startswith((".", "_")))


def _named(fs: pafs.FileSystem, path: str, inner: str) -> str:
    """A path as Spark names it, where `inner` is its name in the file system."""
    if isinstance(fs, pafs.LocalFileSystem):
        return "file:" + os.path.abspath(inner)
    return path.rstrip("/")


def _shown(path: str) -> bool:
    """Spark's rule for names that are not hidden."""
    return all((p.startswith(("_metadata", "_common_metadata")) or "=" in p if p.startswith("_") else not p.startswith(".")) and not p.endswith("._COPYING_") for p in path.split("/"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path as Spark names it, length of a file, or of those below a folder that are not hidden. Each folder of the first level is listed, with what is below it, by one task; the driver sees the names of these folders alone."""
    fs, inner = filesystem(path)
    kind = fs.get_file_info(inner).type
    if kind == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    root = (os.path.abspath(inner) if isinstance(fs, pafs.LocalFileSystem) else inner).rstrip("/")
    before = _named(fs, path, inner).removesuffix(root)

    def found(folder: str, below: bool) -> Iterator[pafs.FileInfo]:
        for i in filesystem(path)[0].get_file_info(pafs.FileSelector(folder, recursive=below)):
            if _shown(i.path[len(root) + 1 :]):
                yield i

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"folder": pa.array([i.path for i in found(folder, False) if i.type == pafs.FileType.Directory], pa.string())})

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, below in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if kind == pafs.FileType.File:
                    own = [filesystem(path)[0].get_file_info(folder)]
                else:
                    own = [i for i in found(folder, below) if i.type == pafs.FileType.File]
                yield pa.RecordBatch.from_pydict({"path": pa.array([before + i.path for i in own], pa.string()), "length": pa.array([i.size for i in own], pa.int64())})

    first = [] if kind == pafs.FileType.File else spark.createDataFrame([(root,)], "folder string").mapInArrow(folders, "folder string").collect()
    rows = spark.createDataFrame([(root, False), *((r.folder, True) for r in first)], "folder string, below boolean")
    return dealt(rows, "folder").mapInArrow(names, "path string, length long")


def _planes(options: dict) -> str:
    planes = options.get("planes", "yuv")
    if set(planes) - set("yuv"):
        raise ValueError(f"planes are of y, u and v, not {planes}")
    return planes


class VideoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.planes, self.range = options["path"], _planes(options), int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[Range]:
        return [Range(p, a, min(a + self.range, n), n) for p, n in listed(self.path) for a in range(0, n, self.range)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from frames_of(partition, self.planes)


class VideoStreamReader(DataSourceStreamReader):
    """Offsets are the frames seen of each file, so a file may grow, and a restart goes on inside it."""

    def __init__(self, options: dict):
        self.path, self.planes, self.per_part = options["path"], _planes(options), int(options.get("framespertask", 256))
        self.heads: dict[str, Head] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        seen = {}
        for path, size in listed(self.path):
            if path not in self.heads:
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as f:
                    head = read_head(f.read(LONGEST_HEADER), path) if size else None
                if head is None:
                    continue
                self.heads[path] = head
            if n := self.heads[path].frames(size):
                seen[path] = n
        return {"files": json.dumps(seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return [Range(p, a, min(a + self.per_part, n), 1 << 62, True) for p, n in after.items() for a in range(before.get(p, 0), n, self.per_part)] or [Range("", 0, 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from frames_of(partition, self.planes)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file was written, and its name


class _Sink(DataSourceArrowWriter):
    """Files written beside their names and moved there at the end."""

    def __init__(self, options: dict):
        self.folder, self.job = options["path"], uuid.uuid4().hex

    def beside(self) -> str:
        return f".{self.job}-{uuid.uuid4().hex}.part"

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.folder)
        done = [f for m in messages if m is not None for f in m.files]
        if len({name for _, name in done}) < len(done):
            self.abort(messages)
            raise ValueError("two rows or tasks wrote a file of the same name")
        for part, name in done:
            target = posixpath.join(folder, name)
            fs.create_dir(posixpath.dirname(target), recursive=True)
            fs.move(posixpath.join(folder, part), target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """What attempts of this job left that no message names."""
        fs, folder = filesystem(self.folder)
        for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if posixpath.basename(i.path).startswith(f".{self.job}-"):
                fs.delete_file(i.path)


class FileSink(_Sink):
    """name, content: each row a file."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = filesystem(self.folder)
        fs.create_dir(folder, recursive=True)
        done = []
        for b in iterator:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                part = self.beside()
                with fs.open_output_stream(posixpath.join(folder, part)) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                done.append((part, name))
        return Written(done)


class VideoSink(_Sink):
    """name, frame_no, payload, w, h, space and, where they are there, colorrange, framerate, interlace, aspect, extension. Rows of a stream come together and in order."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = filesystem(self.folder)
        fs.create_dir(folder, recursive=True)
        done, out, at, size, last = [], None, None, 0, None
        try:
            for b in iterator:
                rows = b.select([c for c in b.schema.names if c != "payload"]).to_pylist()
                for row, payload in zip(rows, b.column("payload"), strict=True):
                    if row["name"] != at:
                        if out is not None:
                            out.close()
                        at, part, last = row["name"], self.beside(), None
                        out = fs.open_output_stream(posixpath.join(folder, part))
                        done.append((part, at))
                        line = header_line(row)
                        head = read_head(line, at)
                        size = head.luma + 2 * head.chroma
                        out.write(line)
                    if last is not None and row["frame_no"] <= last:
                        raise ValueError(f"{at}: frame {row['frame_no']} follows frame {last}")
                    data = payload.as_buffer()
                    if data.size != size:
                        raise ValueError(f"{at}: frame {row['frame_no']} has {data.size} bytes, not {size}")
                    last = row["frame_no"]
                    out.write(FRAME)
                    out.write(data)
        finally:
            if out is not None:
                out.close()
        return Written(done)


def header_line(row: dict) -> bytes:
    parts = [MAGIC.decode(), f"W{row['w']}", f"H{row['h']}", f"F{row.get('framerate') or '25:1'}", f"I{row.get('interlace') or 'p'}", f"A{row.get('aspect') or '0:0'}", f"C{row['space']}"]
    extension = dict(row.get("extension") or {})
    said = (row.get("colorrange") or "").upper()
    if said in ("FULL", "LIMITED"):
        extension["COLORRANGE"] = said
    return (" ".join([*parts, *(f"X{k}={v}" for k, v in extension.items())]) + "\n").encode()


class VideoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VideoReader:
        return VideoReader(self.options)

    def streamReader(self, schema) -> VideoStreamReader:  # noqa: N802
        return VideoStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> VideoSink:
        return VideoSink(self.options)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole-files"

    def writer(self, schema, overwrite: bool) -> FileSink:
        return FileSink(self.options)


def register(spark: SparkSession) -> None:
    for source in (VideoSource, FilesSource):
        spark.dataSource.register(source)


def read_video(spark: SparkSession, path: str, planes: str = "yuv", range_bytes: int = RANGE) -> DataFrame:
    register(spark)
    return spark.read.format("y4m").option("path", path).option("planes", planes).option("rangeBytes", range_bytes).load()


_HEADS = pa.schema([("path", pa.string()), ("length", pa.int64()), ("frames", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("space", pa.string()), ("colorrange", pa.string()), ("status", pa.string())])


def heads_of(found: DataFrame) -> DataFrame:
    """One row a file of `files`, where it lies: path, length, frames, w, h, space, colorrange, status. The first bytes of those named .y4m are read; a stream that cannot be read has a status other than ok, files of other names have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = {"path": name, "length": size}
                if name.endswith(".y4m"):
                    row["status"] = "ok"
                    fs, inner = (pafs.LocalFileSystem(), name[len("file:") :]) if name.startswith("file:") else filesystem(name)  # names are not quoted
                    with fs.open_input_file(inner) as f:
                        try:
                            head = read_head(f.read(LONGEST_HEADER), name)
                            row |= {"status": "a header that is not whole"} if head is None else {"frames": head.frames(size), **{k: head.fields[k] for k in ("w", "h", "space", "colorrange")}}
                        except ValueError as e:
                            row["status"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, _HEADS)

    return found.select("path", "length").mapInArrow(read, "path string, length long, frames long, w int, h int, space string, colorrange string, status string")


def heads(spark: SparkSession, path: str) -> DataFrame:
    """One row a stream, as `heads_of` gives them, of the streams below a folder. Files are listed and read by tasks."""
    return heads_of(files(spark, path).filter(F.col("path").endswith(".y4m")))


def write_video(df: DataFrame, folder: str, by: str = "name", order: str = "frame_no") -> None:
    """Frames as one file a stream; each stream is one task's, frames in order, files named by `by`."""
    register(df.sparkSession)
    own = df.withColumnsRenamed({by: "name", order: "frame_no"})
    own.repartition("name").sortWithinPartitions("name", "frame_no").write.format("y4m").mode("append").option("path", folder).save()


_PARTS = "part string, target string, folder string"


def write_whole(df: DataFrame, folder: str, name: str = "name", content: str = "content", folders: int | None = None) -> None:
    """Each row's bytes as a file of its own, under its name; with `folders` in one of so many folders, by a hash of the name, so that tasks can list them side by side.

    Tasks write hidden parts and a table of them. Once that table is whole and no name stands in it twice, tasks move the parts to their names: the driver sees none of them. A job that fails before
    leaves no file under its name."""
    spark, job = df.sparkSession, f".{uuid.uuid4().hex}"
    fs, inner = filesystem(folder)
    beside = posixpath.join(inner, job)
    table = f"{_named(fs, folder, inner)}/{job}/parts"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, own, n = filesystem(folder)[0], uuid.uuid4().hex, 0
        fs.create_dir(posixpath.join(beside, own), recursive=True)
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not name:
                    raise ValueError("a file without a name")
                below = f"{zlib.crc32(name.encode()) % folders:x}" if folders else posixpath.dirname(name)
                rows.append({"part": f"{own}/{n}", "target": posixpath.join(below, name) if folders else name, "folder": below})
                with fs.open_output_stream(posixpath.join(beside, rows[-1]["part"])) as out:
                    if data.is_valid:
                        out.write(data.as_buffer())
                n += 1
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in ("part", "target", "folder")]))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, made = filesystem(folder)[0], set()
        for b in batches:
            for part, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, z = posixpath.join(beside, part), posixpath.join(inner, target)
                if posixpath.dirname(z) not in made:
                    made.add(posixpath.dirname(z))
                    fs.create_dir(posixpath.dirname(z), recursive=True)
                try:
                    fs.move(a, z)
                except FileNotFoundError:  # an attempt before this one moved it
                    if fs.get_file_info(z).type != pafs.FileType.File:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    fs.create_dir(beside, recursive=True)
    try:
        df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(write, _PARTS).write.parquet(table)
        parts = spark.read.schema(_PARTS).parquet(table)
        if parts.groupBy("target").count().filter("count > 1").head(1):
            raise ValueError("two rows or tasks wrote a file of the same name")
        dealt(parts, "folder" if folders else "target").mapInArrow(move, "n long").write.format("noop").mode("overwrite").save()
    finally:
        fs.delete_dir(beside)
