"""Large planes as tables of tiles: each row is a block of samples with the rows and columns around it that a kernel needs, so that one frame is the work of all cores.

`cut` makes tiles of planes that rows hold; `read_mosaics` makes them of raw files, each task reading the byte range of its band of rows, so that a frame is never whole anywhere.
`apply` runs a kernel over tiles; what it gives has no margin, so tiles put side by side are the whole result. Blocks hold two bytes a sample, low first.
Margins at the frame's edges repeat them (`edges`), or are left out.

A tile: the key columns, ty, tx (its place), y0, x0 (its first sample), th, tw (its size), h, w (the frame's), top, left (margin before it in the block), bh, bw (the block's size), and one
binary column a plane.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import canonical
from ..sources.folders import dealt
from . import kernels

PLACE = ("ty", "tx", "y0", "x0", "th", "tw", "h", "w", "top", "left", "bh", "bw")
SIZE = 512


def _spans(n: int, size: int, before: int, after: int, edges: bool) -> list[tuple[int, int, np.ndarray, int]]:
    """(start, length, places of the block, margin before) of the tiles along a side of n samples."""
    out = []
    for a in range(0, n, size):
        m = min(size, n - a)
        places = np.arange(a - before, a + m + after)
        if edges:
            places = np.clip(places, 0, n - 1)
        else:
            places = places[(places >= 0) & (places < n)]
        out.append((a, m, places, before if edges else min(a, before)))
    return out


def _block(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v, "<u2").tobytes()


def _arrow(kinds) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kinds)


def _fields(keys: list[str], df: DataFrame, planes: list[str]) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, IntegerType, StructType

    kinds = StructType([df.schema[k] for k in keys])
    for c in PLACE:
        kinds = kinds.add(c, IntegerType())
    for c in planes:
        kinds = kinds.add(c, BinaryType())
    return kinds, to_arrow_schema(kinds)


def cut(images: DataFrame, keys: list[str], planes: list[str], w: int | str, h: int | str, depth: int = 8, size: int = SIZE, before: int = 1, after: int = 1, edges: bool = True) -> DataFrame:
    """Tiles of planes held as bytes (two a sample, low first, if the depth is over 8). Sizes are numbers or columns. Null planes give no tile."""
    sides = [(F.col(x) if isinstance(x, str) else F.lit(x)).cast("int") for x in (w, h)]
    rows = images.select(*keys, *planes, *[c.alias(f"_{n}") for n, c in zip("wh", sides, strict=True)])
    schema, arrow = _fields(keys, images, planes)
    kind = np.dtype("u1" if depth == 8 else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                data = [b.column(p)[i] for p in planes]
                if not all(x.is_valid for x in data):
                    continue
                width, height = b.column("_w")[i].as_py(), b.column("_h")[i].as_py()
                if any(x.as_buffer().size != width * height * kind.itemsize for x in data):
                    raise ValueError(f"a plane is not of {width} x {height} samples of {kind.itemsize} bytes")
                whole = [np.frombuffer(x.as_buffer(), kind).reshape(height, width) for x in data]
                own = {k: b.column(k)[i].as_py() for k in keys}
                for ty, (y0, th, ys, top) in enumerate(_spans(height, size, before, after, edges)):
                    out = []
                    for tx, (x0, tw, xs, left) in enumerate(_spans(width, size, before, after, edges)):
                        place = dict(zip(PLACE, (ty, tx, y0, x0, th, tw, height, width, top, left, len(ys), len(xs)), strict=True))
                        out.append(own | place | {p: _block(v[ys[:, None], xs]) for p, v in zip(planes, whole, strict=True)})
                    yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, schema)


def spread(tiles: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Tiles dealt out evenly, for few large frames cut from rows."""
    by = [*keys, "ty", "tx"]
    return tiles.repartition(parts, *by) if parts else dealt(tiles, *by)


def read_mosaics(spark: SparkSession, path: str, fmt: str, w: int, h: int, size: int = SIZE, before: int = 1, after: int = 1, edges: bool = True) -> DataFrame:
    """path and tiles (plane v) of raw mosaic files of one size. A task reads the rows of its bands only."""
    from ..sources.video import filesystem, listed

    f = canonical(fmt)
    if f.layout != "packed" or w * f.n_bytes % f.n_samples:
        raise ValueError(f"{f.name}: rows of {w} samples are no whole bytes")
    row = w * f.n_bytes // f.n_samples
    files = spark.createDataFrame(listed(path, ""), "path string, size long")
    bands = files.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit((h - 1) // size)))).repartition("path", "ty")
    schema, arrow = _fields(["path"], files, ["v"])
    across, down = _spans(w, size, before, after, edges), _spans(h, size, before, after, edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, n, ty in zip(*(b.column(c).to_pylist() for c in ("path", "size", "ty")), strict=True):
                if n != row * h:
                    raise ValueError(f"{path}: {n} bytes, not {row * h}")
                y0, th, ys, top = down[ty]
                low, high = int(ys.min()), int(ys.max()) + 1
                fs, inner = filesystem(path)
                with fs.open_input_file(inner) as file:
                    file.seek(low * row)
                    band = kernels.read_samples(np.frombuffer(file.read((high - low) * row), np.uint8), f.codec).reshape(high - low, w)
                yield pa.RecordBatch.from_pylist([
                    {"path": path, "v": _block(band[(ys - low)[:, None], xs])} | dict(zip(PLACE, (ty, tx, y0, x0, th, tw, h, w, top, left, len(ys), len(xs)), strict=True))
                    for tx, (x0, tw, xs, left) in enumerate(across)
                ], arrow)

    return bands.mapInArrow(run, schema)


class Tile:
    """One tile for a kernel: its place and its blocks."""

    def __init__(self, place: dict, blocks: dict[str, np.ndarray]):
        self.__dict__.update(place)
        self.blocks = blocks

    @property
    def ys(self) -> np.ndarray:
        """The frame's row of each row of the block."""
        return np.clip(np.arange(self.y0 - self.top, self.y0 - self.top + self.bh), 0, self.h - 1)

    @property
    def xs(self) -> np.ndarray:
        return np.clip(np.arange(self.x0 - self.left, self.x0 - self.left + self.bw), 0, self.w - 1)


def apply(tiles: DataFrame, keys: list[str], planes: list[str], run: Callable[[Tile], dict], outs: str) -> DataFrame:
    """keys, the tile's place, and what the kernel gives of each tile: a dict with the columns of `outs` (a schema); arrays become blocks."""
    names = [c.split()[0] for c in outs.split(",")]
    schema = ", ".join([f"`{k}` {tiles.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} int" for c in PLACE] + [outs])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = b.select(list(PLACE)).to_pylist()
            for i, place in enumerate(places):
                blocks = {p: np.frombuffer(b.column(p)[i].as_buffer(), "<u2").reshape(place["bh"], place["bw"]).astype(np.int32) for p in planes}
                made = run(Tile(place, blocks))
                made = {k: _block(v) if isinstance(v, np.ndarray) else v for k, v in made.items()}
                head = b.slice(i, 1).select([*keys, *PLACE])
                yield pa.RecordBatch.from_arrays([*head.columns, *[pa.array([made[n]], kinds.field(n).type) for n in names]], schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    own = tiles.select(*keys, *PLACE, *planes)
    kinds = to_arrow_schema(own.select(*keys, *PLACE).limit(0).mapInArrow(lambda x: x, schema).schema)
    return own.mapInArrow(each, schema)


def demosaic(tiles: DataFrame, keys: list[str], order: str, adaptive: bool = False, plane: str = "v") -> DataFrame:
    """r, g, b of mosaic tiles with a margin of one sample."""
    return apply(tiles, keys, [plane], lambda t: kernels.demosaic_block(t.blocks[plane], t.ys, t.xs, order, adaptive), "r binary, g binary, b binary")


def subsample(tiles: DataFrame, keys: list[str], kind: str, plane: str = "v") -> DataFrame:
    """Chroma sampled down, of tiles without margins and of even sizes but for the last."""
    return apply(tiles, keys, [plane], lambda t: {"v": kernels.subsample(t.blocks[plane], kind)}, "v binary")


def match(tiles: DataFrame, keys: list[str], needle: np.ndarray, plane: str = "v") -> DataFrame:
    """keys, y, x, score: where a needle correlates best in each frame; the topmost, then leftmost, of equals. Tiles have a margin behind of the needle's size less one, and edges left out."""
    m, k = needle.shape

    def run(t: Tile) -> dict:
        v = t.blocks[plane]
        if v.shape[0] < m or v.shape[1] < k:
            return {"y": None, "x": None, "score": None}
        y, x, score = kernels.best_place(v, needle)
        return {"y": t.y0 + y, "x": t.x0 + x, "score": score}

    found = apply(tiles, keys, [plane], run, "y int, x int, score double").filter("score is not null")
    best = found.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("m"))
    return best.select(*keys, (-F.col("m.y")).alias("y"), (-F.col("m.x")).alias("x"), "m.score")


def similarity(tiles: DataFrame, keys: list[str], a: str, b: str, top: int = 255, size: int = 11, sigma: float = 1.5) -> DataFrame:
    """keys, ssim: the mean over all windows of both planes. Tiles have a margin behind of the window's size less one, and edges left out."""

    def run(t: Tile) -> dict:
        if min(t.bh, t.bw) < size:
            return {"total": 0.0, "n": 0}
        s = kernels.similarity(t.blocks[a], t.blocks[b], top, size, sigma)[: t.th, : t.tw]
        return {"total": float(s.sum()), "n": s.size}

    sums = apply(tiles, keys, [a, b], run, "total double, n bigint").groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select(*keys, F.when(F.col("n") > 0, F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("ssim"))


def values(block: str) -> Column:
    """A block of a tile as an array of samples, without Python."""
    byte = lambda k: f"cast(conv(substring(hex({block}), 4 * i + {k}, 2), 16, 10) as int)"
    return F.expr(f"transform(sequence(0, octet_length({block}) div 2 - 1), i -> {byte(1)} + 256 * {byte(3)})")


def assemble(tiles: DataFrame, keys: list[str], planes: list[str]) -> DataFrame:
    """keys, w, h and whole planes (two bytes a sample) of tiles without margins: a frame's tiles meet in one row. A task holds one frame at a time, and a few MB of small ones."""
    rows = tiles.select(*keys, *[c for c in PLACE if c not in keys], *planes)
    schema = ", ".join([f"`{k}` {tiles.schema[k].dataType.simpleString()}" for k in keys] + ["w int", "h int"] + [f"{p} binary" for p in planes])
    kinds = _arrow(rows.select(*keys, "w", "h", *planes).schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, frame, done, size = None, None, [], 0
        for b in batches:
            places = b.select([*keys, "y0", "x0", "th", "tw", "h", "w"]).to_pylist()
            for i, r in enumerate(places):
                head = {k: r[k] for k in keys}
                if frame is None or head != at:
                    if frame is not None:
                        done.append(at | side | {p: v.tobytes() for p, v in frame.items()})
                        size += sum(v.nbytes for v in frame.values())
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(done, kinds)
                        done, size = [], 0
                    at, side, frame = head, {"w": r["w"], "h": r["h"]}, {p: np.zeros((r["h"], r["w"]), "<u2") for p in planes}
                for p, v in frame.items():
                    v[r["y0"] : r["y0"] + r["th"], r["x0"] : r["x0"] + r["tw"]] = np.frombuffer(b.column(p)[i].as_buffer(), "<u2").reshape(r["th"], r["tw"])
        if frame is not None:
            done.append(at | side | {p: v.tobytes() for p, v in frame.items()})
            yield pa.RecordBatch.from_pylist(done, kinds)

    return dealt(rows, *keys).sortWithinPartitions(*keys).mapInArrow(whole, schema)
