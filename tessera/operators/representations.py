"""Conversion between any two pixel formats. Formats are nodes of a graph (family, layout, depth, sampling), conversions its edges.

`route` finds the shortest way between two families: mosaic and its differences, mosaic and RGB, RGB and YUV are neighbours. `plan` makes the list of steps
between two formats: unpack, shift the depth, fill chroma up, the route, sample chroma down, pack. `convert` is one Arrow column function that runs them over a column of
buffers, many images at a time; sizes are numbers or columns. Nothing is dealt out. A null buffer stays null; one of a wrong size is an error that names both sizes.

Mosaics of another order keep their planes and place them anew. What comes out of differences or goes into them has the order RGgB.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import ORDERS, Format, canonical
from ..functions.packing import UNSUPPORTED
from . import kernels
from .kernels import Planes

CANONICAL_ORDER = ORDERS["rggb"]


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[Planes], Planes]


def _to_rgb(source: Format, depth: int, adaptive: bool) -> Step:
    order = source.order if source.component == "bayer" else CANONICAL_ORDER
    return Step(f"demosaic {order}" + (" along gradients" if adaptive else ""), lambda p: kernels.demosaic(kernels.merge(p, order), order, adaptive))


def _to_mosaic(target: Format) -> Step:
    order = target.order if target.component == "bayer" else CANONICAL_ORDER
    return Step(f"remosaic {order}", lambda p: kernels.split(kernels.remosaic(p, order), order))


#: Families next to each other and the step between them, given both formats, the depth and the kind of demosaicing.
EDGES: dict[tuple[str, str], Callable[[Format, Format, int, bool], Step]] = {
    ("bayer", "ydgcocg"): lambda a, b, depth, adaptive: Step("differences", lambda p: kernels.to_differences(p, depth)),
    ("ydgcocg", "bayer"): lambda a, b, depth, adaptive: Step("from differences", lambda p: kernels.from_differences(p, depth)),
    ("bayer", "rgb"): lambda a, b, depth, adaptive: _to_rgb(a, depth, adaptive),
    ("rgb", "bayer"): lambda a, b, depth, adaptive: _to_mosaic(b),
    ("rgb", "yuv"): lambda a, b, depth, adaptive: Step("yuv", lambda p: kernels.to_yuv(p, depth)),
    ("yuv", "rgb"): lambda a, b, depth, adaptive: Step("rgb", lambda p: kernels.to_rgb(p, depth)),
}


def route(source: str, target: str) -> list[tuple[str, str]]:
    """The fewest edges from one family to another."""
    seen, queue = {source: []}, deque([source])
    while queue:
        at = queue.popleft()
        if at == target:
            return seen[at]
        for a, b in EDGES:
            if a == at and b not in seen:
                seen[b] = [*seen[at], (a, b)]
                queue.append(b)
    raise ValueError(f"no conversion from {source} to {target}")


def _resampled(f: Format, up: bool) -> Step | None:
    if f.subsample in (None, "444"):
        return None
    chroma, base = ("Cc", "Y") if f.component == "ydgcocg" else ("uv", "y")

    def run(p: Planes) -> Planes:
        h, w = p[base].shape[-2:]
        return p | {c: kernels.upsample(p[c], f.subsample, h, w) if up else kernels.subsample(p[c], f.subsample) for c in chroma}

    return Step(f"chroma {'up' if up else 'down'} {f.subsample}", run)


def planes_plan(source: Format, target: Format, adaptive: bool = False) -> list[Step]:
    """The steps between planes of two formats."""
    for f in (source, target):
        if f.codec in UNSUPPORTED:
            raise NotImplementedError(f"samples packed as {f.codec} cannot be read")
    steps = []
    if source.depth != target.depth:
        steps.append(Step(f"depth {source.depth} to {target.depth}", lambda p: kernels.shift_depth(p, source.depth, target.depth)))
    if not (source.component == target.component and source.subsample == target.subsample):
        steps.append(_resampled(source, True))
        steps += [EDGES[e](source, target, target.depth, adaptive) for e in route(source.component, target.component)]
        steps.append(_resampled(target, False))
    return [s for s in steps if s]


def plan(source: str, target: str, adaptive: bool = False) -> list[str]:
    """What `convert` does between two formats, as text."""
    a, b = canonical(source), canonical(target)
    return [f"unpack {a.name}", *(s.name for s in planes_plan(a, b, adaptive)), f"pack {b.name}"]


def buffer_size(f: Format, w: int, h: int) -> int:
    shapes = kernels.plane_shapes(f, w, h)
    if f.layout == "packed":
        return w * h * f.n_bytes // f.n_samples
    return sum(a * b for a, b in shapes.values()) * (1 if f.depth == 8 else 2)


def run_plan(raw: np.ndarray, source: Format, target: Format, steps: list[Step], w: int, h: int) -> np.ndarray:
    """Buffers (images x bytes) through the steps of a plan."""
    p = kernels.read_buffer(raw, source, w, h)
    for s in steps:
        p = s.run(p)
    return kernels.write_buffer(p, target)


def by_size(buffers: pa.Array, ws: pa.Array, hs: pa.Array, most: int = 1 << 22):
    """(rows, w, h) of buffers of one size, some 4 MB at a time; rows of null buffers are left out."""
    w, h = ws.to_numpy(zero_copy_only=False), hs.to_numpy(zero_copy_only=False)
    there = np.flatnonzero(np.asarray(buffers.is_valid()))
    for a, b in sorted({(int(x), int(y)) for x, y in zip(w[there], h[there], strict=True)}):
        rows = there[(w[there] == a) & (h[there] == b)]
        step = max(1, most // max(1, a * b))
        for k in range(0, len(rows), step):
            yield rows[k : k + step], a, b


def stacked(buffers: pa.Array, rows: np.ndarray, size: int, what: str) -> np.ndarray:
    """The buffers of these rows, each of `size` bytes."""
    data = [buffers[int(k)].as_buffer() for k in rows]
    for b in data:
        if b.size != size:
            raise ValueError(f"{what}: a buffer of {b.size} bytes, not {size}")
    return np.stack([np.frombuffer(b, np.uint8) for b in data])


def converted(content: Column, source: str, target: str, w: int | str, h: int | str, adaptive: bool = False) -> Column:
    """A column of buffers of one format as buffers of another."""
    a, b = canonical(source), canonical(target)
    steps = planes_plan(a, b, adaptive)

    @F.arrow_udf("binary")
    def run(buffers: pa.Array, ws: pa.Array, hs: pa.Array) -> pa.Array:
        out: list[bytes | None] = [None] * len(buffers)
        for rows, width, height in by_size(buffers, ws, hs):
            done = run_plan(stacked(buffers, rows, buffer_size(a, width, height), a.name), a, b, steps, width, height)
            for k, r in zip(rows, done, strict=True):
                out[k] = r.tobytes()
        return pa.array(out, pa.binary())

    return run(content, *[(F.col(x) if isinstance(x, str) else F.lit(x)).cast("int") for x in (w, h)])


def convert(images: DataFrame, source: str, target: str, w: int | str, h: int | str, column: str = "content", out: str | None = None, adaptive: bool = False) -> DataFrame:
    """The rows with their buffers converted. Columns of sizes may differ by row."""
    return images.withColumn(out or column, converted(F.col(column), source, target, w, h, adaptive))


def plane_values(content: Column, fmt: str, w: int | str, h: int | str) -> Column:
    """A map of plane letters to arrays of samples of a buffer."""
    f = canonical(fmt)

    @F.arrow_udf("map<string,array<int>>")
    def run(buffers: pa.Array, ws: pa.Array, hs: pa.Array) -> pa.Array:
        out: list = [None] * len(buffers)
        for rows, width, height in by_size(buffers, ws, hs):
            p = kernels.read_buffer(stacked(buffers, rows, buffer_size(f, width, height), f.name), f, width, height)
            for n, k in enumerate(rows):
                out[k] = [(c, v[n].ravel()) for c, v in p.items()]
        return pa.array(out, pa.map_(pa.string(), pa.list_(pa.int32())))

    return run(content, *[(F.col(x) if isinstance(x, str) else F.lit(x)).cast("int") for x in (w, h)])


def convert_files(spark: SparkSession, path: str, source: str, w: int, h: int, target: str, folder: str, adaptive: bool = False) -> None:
    """Raw files of one format to files of another, one each, under the same names."""
    from ..sources.video import write_whole

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")
    write_whole(convert(files, source, target, w, h, adaptive=adaptive), folder)
