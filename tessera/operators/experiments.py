"""Camera experiments on mosaic images: convert, code, decode, convert back, and compare with the original as mosaic, RGB and YUV.

An experiment says which planes are coded and how a mosaic, RGB and YUV come from what was decoded. A codec is any function of planes, depth and quality
that returns the decoded planes and the coded size of each; `nocodec` returns what it got, `bits` keeps the upper bits. Both kinds are registered by name, so
that users add their own without a change here; functions are sent to the tasks with the job. `run` is one pass over a table of buffers, one row
for each image, experiment and quality; nothing is dealt out before averages. An image, codec or experiment that fails gives a row with `error` and no figures.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import canonical
from . import kernels, results
from .kernels import Planes
from .representations import CANONICAL_ORDER, buffer_size

Codec = Callable[[Planes, int, float], tuple[Planes, dict[str, int]]]


@dataclass(frozen=True)
class Options:
    """codec: a name in `CODECS`, or a function. infinity: the PSNR of equal planes is infinite, else that of a difference of one in one sample."""

    codec: str | Codec = "nocodec"
    qualities: tuple[float, ...] = tuple(results.BAYER_QUALITIES)
    adaptive: bool = False
    infinity: bool = False
    averages: bool = True


def nocodec(planes: Planes, depth: int, quality: float) -> tuple[Planes, dict[str, int]]:
    return planes, {k: v.size * (1 if depth == 8 else 2) for k, v in planes.items()}


def bits(planes: Planes, depth: int, quality: float) -> tuple[Planes, dict[str, int]]:
    """Keeps 1 to `depth` upper bits of each sample, by quality."""
    keep = 1 + int(quality) * (depth - 1) // 100
    return {k: v >> depth - keep << depth - keep for k, v in planes.items()}, {k: -(-v.size * keep // 8) for k, v in planes.items()}


CODECS: dict[str, Codec] = {"nocodec": nocodec, "bits": bits}


@dataclass(frozen=True)
class Experiment:
    """code: the planes to be coded, of (mosaic planes, rgb, yuv, depth). back: mosaic planes, rgb, yuv of what was decoded; None where they follow from the mosaic, or YUV from RGB."""

    code: Callable[[Planes, Planes, Planes, int], Planes]
    back: Callable[[Planes, int], tuple[Planes | None, Planes | None, Planes | None]]


def _halved(p: Planes) -> Planes:
    return p | {c: p[c][..., ::2, ::2] for c in "Cc"}


def _doubled(p: Planes) -> Planes:
    return p | {c: kernels.upsample(p[c], "420", *p["Y"].shape[-2:]) for c in "Cc"}


def _sampled(p: Planes) -> Planes:
    return p | {c: kernels.subsample(p[c], "420") for c in "uv"}


def _filled(p: Planes) -> Planes:
    return p | {c: kernels.upsample(p[c], "420", *p["y"].shape[-2:]) for c in "uv"}


EXPERIMENTS: dict[str, Experiment] = {
    "ydgcocg": Experiment(lambda m, rgb, yuv, d: kernels.to_differences(m, d), lambda p, d: (kernels.from_differences(p, d), None, None)),
    "ydgcocg-420": Experiment(lambda m, rgb, yuv, d: _halved(kernels.to_differences(m, d)), lambda p, d: (kernels.from_differences(_doubled(p), d), None, None)),
    "bayer-packed": Experiment(lambda m, rgb, yuv, d: {"bayer": kernels.merge(m, CANONICAL_ORDER)}, lambda p, d: (kernels.split(p["bayer"], CANONICAL_ORDER), None, None)),
    "bayer-planar": Experiment(lambda m, rgb, yuv, d: m, lambda p, d: (p, None, None)),
    "yuv444": Experiment(lambda m, rgb, yuv, d: yuv, lambda p, d: (None, kernels.to_rgb(p, d), p)),
    "yuv420": Experiment(lambda m, rgb, yuv, d: _sampled(yuv), lambda p, d: (None, kernels.to_rgb(_filled(p), d), _filled(p))),
    "rgb": Experiment(lambda m, rgb, yuv, d: rgb, lambda p, d: (None, p, kernels.to_yuv(p, d))),
}

#: Samples of images of one size that are taken together; a larger image is taken alone.
TOGETHER = 1 << 16
_SIZES = ["encoded_size", "encoded_bpp"]
_PSNR = ["psnr_bayer", "psnr_rgb", "psnr_rgb_r", "psnr_rgb_g", "psnr_rgb_b", "psnr_yuv", "psnr_yuv_y", "psnr_yuv_u", "psnr_yuv_v"]
SCHEMA = "infile string, width int, height int, pix_fmt string, depth int, approach string, codec string, quality double, encoded_size long, encoded_size_breakdown string, encoded_bpp double, " + ", ".join(f"{c} double" for c in _PSNR) + ", error string"


def psnrs(a: np.ndarray, b: np.ndarray, depth: int, infinity: bool) -> list[float]:
    """Of each of a stack of planes."""
    d = a.astype(np.int64) - b
    size = d[0].size
    return [math.inf if not t and infinity else 10 * math.log10(((1 << depth) - 1) ** 2 / (t / size or 1 / size)) for t in (d * d).reshape(len(d), -1).sum(1).tolist()]


def _mean_psnrs(a: Planes, b: Planes, depth: int, infinity: bool) -> list[tuple[float, ...]]:
    each = zip(*[psnrs(a[k], b[k], depth, infinity) for k in a], strict=True)
    return [(sum(e) / len(e), *e) for e in each]


def _one(planes: Planes, i: int) -> Planes:
    return {k: v[i] for k, v in planes.items()}


def _stack(parts: tuple[Planes | None, ...]) -> Planes | None:
    """The images' planes in one array a plane; all of one kind."""
    if all(p is None for p in parts):
        return None
    if any(p is None for p in parts) or len({v.dtype for p in parts for v in p.values()}) > 1:
        raise ValueError("images of one size came back in different kinds")
    return {k: np.stack([p[k] for p in parts]) for k in parts[0]}


def measure(mosaics: Planes, depth: int, experiment: Experiment, codec: Codec, quality: float, options: Options, known: tuple[Planes, Planes]) -> list[dict]:
    """The figures of each of a stack of images of one size, for an experiment and quality. known: the images' own RGB and YUV. Codecs and experiments get one image at a time, the rest is done for all together."""
    rgb, yuv = known
    mosaic_of = lambda p: kernels.merge(p, CANONICAL_ORDER)
    coded = [codec(experiment.code(_one(mosaics, i), _one(rgb, i), _one(yuv, i), depth), depth, quality) for i in range(len(mosaics["R"]))]
    back, back_rgb, back_yuv = map(_stack, zip(*[experiment.back(decoded, depth) for decoded, _ in coded], strict=True))
    if back is None:
        back = kernels.split(kernels.remosaic(back_rgb, CANONICAL_ORDER), CANONICAL_ORDER)
    if back_rgb is None:
        back_rgb = kernels.demosaic(mosaic_of(back), CANONICAL_ORDER, options.adaptive)
    if back_yuv is None:
        back_yuv = kernels.to_yuv(back_rgb, depth)
    n = 4 * mosaics["R"][0].size
    figures = zip(psnrs(mosaic_of(mosaics), mosaic_of(back), depth, options.infinity), _mean_psnrs(rgb, back_rgb, depth, options.infinity), _mean_psnrs(yuv, back_yuv, depth, options.infinity), strict=True)
    sizes = [{"encoded_size": sum(s.values()), "encoded_size_breakdown": ":".join(map(str, s.values())), "encoded_bpp": 8.0 * sum(s.values()) / n} for _, s in coded]
    return [s | dict(zip(_PSNR, (a, *b, *c), strict=True)) for s, (a, b, c) in zip(sizes, figures, strict=True)]


def run(images: DataFrame, fmt: str, w: int | str, h: int | str, approaches: list[str] | None = None, options: Options = Options(), name: str = "infile", content: str = "content") -> DataFrame:  # noqa: B008
    """A row for each mosaic image, experiment and quality, then the averages by experiment and quality. Mosaics of any order are taken as RGgB, plane by plane."""
    f = canonical(fmt)
    if f.component != "bayer":
        raise ValueError(f"{f.name} is no mosaic")
    chosen = {a: EXPERIMENTS[a] for a in approaches or EXPERIMENTS}
    codec = CODECS[options.codec] if isinstance(options.codec, str) else options.codec
    label = options.codec if isinstance(options.codec, str) else getattr(codec, "__name__", "codec")

    def figures(data: list[bytes], width: int, height: int) -> list[list[dict]]:
        """Of each image what its rows say, by experiment and quality. Images that fail together are taken one by one."""
        try:
            mosaics = kernels.read_buffer(np.stack([np.frombuffer(x, np.uint8) for x in data]), f, width, height)
            rgb = kernels.demosaic(kernels.merge(mosaics, CANONICAL_ORDER), CANONICAL_ORDER, options.adaptive)
            known = rgb, kernels.to_yuv(rgb, f.depth)
        except Exception as e:  # noqa: BLE001  any failure is a row
            return [[{"error": f"{type(e).__name__}: {e}"}] * len(steps)] if len(data) == 1 else [figures([x], width, height)[0] for x in data]
        out = []
        for approach, quality in steps:
            try:
                out.append(measure(mosaics, f.depth, chosen[approach], codec, quality, options, known))
            except Exception as e:  # noqa: BLE001
                if len(data) > 1:
                    return [figures([x], width, height)[0] for x in data]
                out.append([{"error": f"{type(e).__name__}: {e}"}])
        return [list(each) for each in zip(*out, strict=True)]

    steps = [(approach, quality) for approach in chosen for quality in options.qualities]

    def some(rows: list[tuple[str, bytes | None, int, int]]) -> list[dict]:
        """The rows of some images, those of one size together."""
        found, sizes = [None] * len(rows), {}
        for i, (_, data, width, height) in enumerate(rows):
            try:
                if data is None or len(data) != buffer_size(f, width, height):
                    raise ValueError(f"a buffer of {0 if data is None else len(data)} bytes, not {buffer_size(f, width, height)}")
                sizes.setdefault((width, height), []).append(i)
            except Exception as e:  # noqa: BLE001
                found[i] = [{"error": f"{type(e).__name__}: {e}"}] * len(steps)
        for (width, height), places in sizes.items():
            many = max(1, TOGETHER // max(1, width * height))
            for at in range(0, len(places), many):
                own = places[at : at + many]
                for i, got in zip(own, figures([rows[i][1] for i in own], width, height), strict=True):
                    found[i] = got
        base = {"pix_fmt": f.name, "depth": f.depth, "codec": label}
        return [
            base | {"infile": infile, "width": width, "height": height, "approach": approach, "quality": float(quality)} | got
            for (infile, _, width, height), each in zip(rows, found, strict=True) for (approach, quality), got in zip(steps, each, strict=True)
        ]

    kinds = pa.schema([(c, t) for c, t in (
        ("infile", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("pix_fmt", pa.string()), ("depth", pa.int32()), ("approach", pa.string()), ("codec", pa.string()),
        ("quality", pa.float64()), ("encoded_size", pa.int64()), ("encoded_size_breakdown", pa.string()), ("encoded_bpp", pa.float64()), *((c, pa.float64()) for c in _PSNR), ("error", pa.string()),
    )])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            infile, data, ws, hs = (b.column(k) for k in range(4))
            at = 0
            while at < len(b):  # some images, of a bounded number of bytes
                part, n = [], 0
                while at < len(b) and len(part) < 1024 and n < 8 * TOGETHER:
                    part.append((infile[at].as_py(), data[at].as_py(), ws[at].as_py(), hs[at].as_py()))
                    n, at = n + len(part[-1][1] or b""), at + 1
                yield pa.RecordBatch.from_pylist(some(part), kinds)

    sides = [(F.col(x) if isinstance(x, str) else F.lit(x)).cast("int") for x in (w, h)]
    rows = images.select(F.col(name).cast("string"), F.col(content), *[c.alias(f"_{k}") for k, c in enumerate(sides)]).mapInArrow(batches, SCHEMA)
    if not options.averages:
        return rows
    means = ["width", "height", *_SIZES, *_PSNR]
    wide = rows.select(*[F.col(c).cast("double").alias(c) if c in means else F.col(c) for c in rows.columns])
    return wide.unionByName(results.averages(wide.filter("error is null"), ["approach", "quality"], means, blank=("encoded_size_breakdown",)))
