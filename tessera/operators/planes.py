"""Images as relations. A plane is an array column `v` of h * w samples (row by row), or one row a sample: image_id, y, x, v.

Operators on a plane's neighbourhood work on the array, by index arithmetic or, where each sample needs several others, by array kernels in Arrow functions
(kernels.py), so they need no shuffle; operators on single samples and on aligned images are projections; joins are on (image_id, y, x). Large frames are cut into tiles (tiles.py). Heights and widths are numbers, or names of columns where images differ in size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels

SIDE = 8
#: Samples of images that a kernel is given at once.
AT_ONCE = 1 << 22


class Size:
    """A height or width that a column holds: arithmetic on it gives SQL, so that images of different sizes stand in one table."""

    def __init__(self, sql: str):
        self.sql = sql

    def __str__(self) -> str:
        return self.sql

    def _with(self, sign: str, other) -> Size:
        return Size(f"({self} {sign} {other})")

    def __add__(self, other) -> Size:
        return self._with("+", other)

    def __sub__(self, other) -> Size:
        return self._with("-", other)

    def __mul__(self, other) -> Size:
        return self._with("*", other)

    def __floordiv__(self, other) -> Size:
        return self._with("div", other)


def sizes(*given: int | str) -> list:
    """Numbers stay numbers; a text is the name of the column that holds each image's own."""
    return [Size(f"`{x}`") if isinstance(x, str) else x for x in given]


def quantised(e: str, depth: int) -> str:
    """A component as a sample of the depth; NaN counts as the largest number, as in the SQL."""
    top = (1 << depth) - 1
    return f"cast(least({top}, greatest(0, floor((nanvl(cast({e} as double), double('Infinity')) + 0.6D) * {850.0 * (top + 0.0) / 1020.0!r}D))) as int)"


def planes(spark: SparkSession, sf_dir: str, depth: int = 8) -> DataFrame:
    """image_id, label, v: the embeddings as 8 x 8 planes of the depth. A longer vector is cut, a shorter one filled with black; null stays null."""
    n = SIDE * SIDE
    whole = f"if(size(embedding) = {n}, embedding, slice(concat(embedding, array_repeat(cast(null as float), {n})), 1, {n}))"
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "label", F.expr(f"transform({whole}, e -> {quantised('e', depth)})").alias("v"))


def samples(df: DataFrame, width: int | str = SIDE, **arrays: str) -> DataFrame:
    """One row a sample: the other columns, y, x and an element of each array, named by the keyword."""
    arrays = arrays or {"v": "v"}
    rest = [c for c in df.columns if c not in arrays.values()]
    zipped = df.select(*rest, F.posexplode(F.arrays_zip(*[F.col(c).alias(k) for k, c in arrays.items()])).alias("p", "s"))
    (width,) = sizes(width)
    return zipped.select(*rest, F.expr(f"p div {width}").cast("int").alias("y"), F.expr(f"p % {width}").cast("int").alias("x"), *[F.col(f"s.{k}").alias(k) for k in arrays])


def with_neighbours(df: DataFrame, count: int) -> DataFrame:
    """Adds v1, v2, ...: the planes of the images that follow in order of id, the first after the last. Images are numbered from 0 without gaps."""
    numbered = df.crossJoin(F.broadcast(df.agg((F.max("image_id") + 1).alias("_n"))))  # one row
    out = df
    for k in range(1, count + 1):
        nxt = numbered.select(F.pmod(F.col("image_id") - k, F.col("_n")).alias("image_id"), F.col("v").alias(f"v{k}"))
        out = out.join(nxt, "image_id")
    return out


def pairs(spark: SparkSession, sf_dir: str, depth: int = 8) -> DataFrame:
    """image_id, y, x, a, b."""
    return samples(with_neighbours(planes(spark, sf_dir, depth).drop("label"), 1), a="v", b="v1")


def triples(spark: SparkSession, sf_dir: str, depth: int = 8) -> DataFrame:
    """image_id, y, x, r, g, b."""
    return samples(with_neighbours(planes(spark, sf_dir, depth).drop("label"), 2), r="v", g="v1", b="v2")


def extremes(df: DataFrame) -> DataFrame:
    """Samples below 110 become 0, above 145 255."""
    return df.withColumn("v", F.expr("transform(v, s -> case when s < 110 then 0 when s > 145 then 255 else s end)"))


def at(v: str, y: str, x: str, h: int | str | Size, w: int | str | Size) -> str:
    """The sample at (y, x) of an array, edges repeated."""
    h, w = sizes(h, w)
    return f"get({v}, cast(least({h - 1}, greatest(0, {y})) * {w} + least({w - 1}, greatest(0, {x})) as int))"


def grid(h: int | str | Size, w: int | str | Size, body: str) -> str:
    """An array of h * w values of `body` over y and x."""
    h, w = sizes(h, w)
    return f"transform(sequence(0, {h * w - 1}), p -> {body.replace('{y}', f'(p div {w})').replace('{x}', f'(p % {w})')})"


def rotate(df: DataFrame, degrees: int, h: int | str = SIDE, w: int | str = SIDE) -> DataFrame:
    """Counter-clockwise by a multiple of 90."""
    h, w = sizes(h, w)
    k = (degrees // 90) % 4
    y, x = {0: ("{y}", "{x}"), 1: ("{x}", f"({w - 1} - {{y}})"), 2: (f"({h - 1} - {{y}})", f"({w - 1} - {{x}})"), 3: (f"({h - 1} - {{x}})", "{y}")}[k]
    oh, ow = (h, w) if k % 2 == 0 else (w, h)
    return df.withColumn("v", F.expr(grid(oh, ow, at("v", y, x, h, w))))


def by_kernel(df: DataFrame, column: str, h: int | str, w: int | str, run: Callable[[np.ndarray], dict[str, np.ndarray]], outs: dict[str, str]) -> DataFrame:
    """Adds the planes that a kernel makes of a plane; outs: their names by the kernel's keys. Null planes stay null, one of a wrong size is an error."""

    @F.arrow_udf("struct<" + ",".join(f"{k}:array<int>" for k in outs) + ">")
    def f(planes_: pa.Array, hs: pa.Array, ws: pa.Array) -> pa.Array:
        there = np.asarray(planes_.is_valid())
        hs, ws = hs.to_numpy(zero_copy_only=False), ws.to_numpy(zero_copy_only=False)
        made: dict[str, list] = {k: [None] * len(planes_) for k in outs}
        for height, width in sorted({(int(a), int(b)) for a, b in zip(hs[there], ws[there], strict=True)}):
            rows = np.flatnonzero(there & (hs == height) & (ws == width))
            step = max(1, AT_ONCE // max(1, height * width))
            for at in range(0, len(rows), step):
                own = rows[at : at + step]
                values = [planes_[int(k)].values.to_numpy(zero_copy_only=False) for k in own]
                if any(len(v) != height * width for v in values):
                    raise ValueError(f"a plane is not of {height} x {width} samples")
                done = run(np.stack(values).astype(np.int32).reshape(-1, height, width))
                for key in outs:
                    for k, v in zip(own, done[key].reshape(len(own), -1).astype(np.int32), strict=True):
                        made[key][k] = v
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(v, kind) for v in made.values()], list(outs))

    sides = [(F.col(x) if isinstance(x, str) else F.lit(x)).cast("int") for x in (h, w)]
    rest = [c for c in df.columns if c not in outs.values()]
    return df.select("*", f(F.col(column), *sides).alias("_made")).select(*rest, *[F.col(f"_made.{k}").alias(c) for k, c in outs.items()])


def subsample(df: DataFrame, kind: str, h: int | str = SIDE, w: int | str = SIDE, column: str = "v", out: str = "v") -> DataFrame:
    """Mean of 2 x 2 (420) or 1 x 2 (422) samples, edges repeated, cut."""
    return by_kernel(df, column, h, w, lambda v: {"v": kernels.subsample(v, kind)}, {"v": out})


def upsample(df: DataFrame, kind: str, h: int | str = SIDE, w: int | str = SIDE, column: str = "v", out: str = "v") -> DataFrame:
    """Each chroma sample for the luma samples it covers; h and w are luma's. Kind 400: the middle value."""
    h, w = sizes(h, w)
    if kind == "400":
        return df.withColumn(out, F.expr(f"array_repeat(128, {h * w})"))
    cw = (w + 1) // 2
    y = "({y} div 2)" if kind == "420" else "{y}"
    return df.withColumn(out, F.expr(grid(h, w, f"get({column}, cast({y} * {cw} + ({{x}} div 2) as int))")))


def decimate(df: DataFrame, h: int | str = SIDE, w: int | str = SIDE, column: str = "v", out: str = "v") -> DataFrame:
    """Every second sample of every second row."""
    h, w = sizes(h, w)
    return df.withColumn(out, F.expr(grid((h + 1) // 2, (w + 1) // 2, f"get({column}, cast(2 * {{y}} * {w} + 2 * {{x}} as int))")))


def mosaic_planes(df: DataFrame, order: str, h: int | str = SIDE, w: int | str = SIDE, column: str = "v") -> DataFrame:
    """A column for each letter of the 2 x 2 cell: the mosaic's quarter planes."""
    h, w = sizes(h, w)
    for k, letter in enumerate(order):
        name = letter + ("1" if letter.islower() else "0")
        df = df.withColumn(name, F.expr(grid(h // 2, w // 2, f"get({column}, cast((2 * {{y}} + {k // 2}) * {w} + 2 * {{x}} + {k % 2} as int))")))
    return df


def demosaic(df: DataFrame, order: str, h: int | str = SIDE, w: int | str = SIDE, column: str = "v", adaptive: bool = False) -> DataFrame:
    """Columns r, g, b of full size. Missing samples are the mean of those of their colour among the 8 neighbours (edges repeated, counted as
    often as they repeat), cut. adaptive: green is the mean along the smaller of the horizontal and vertical gradients."""
    return by_kernel(df, column, h, w, lambda v: kernels.demosaic(v, order, adaptive), {c: c for c in "rgb"})


def demosaic_inner(df: DataFrame, order: str, h: int | str = SIDE, w: int | str = SIDE, column: str = "v") -> DataFrame:
    """Columns r, g, b by rounded means of the 8 neighbours of the colour; the outermost pixels copy the pixel beside them inside."""
    return by_kernel(df, column, h, w, lambda v: kernels.demosaic_inner(v, order), {c: c for c in "rgb"})


#: Ways of demosaicing by name.
DEMOSAIC = {"bilinear": demosaic, "gradient": lambda *a, **k: demosaic(*a, adaptive=True, **k), "inner": demosaic_inner}


def remosaic(order: str) -> Column:
    """The sample that a mosaic keeps of r, g, b at (y, x)."""
    cases = " ".join(f"when {k} then {c.lower()}" for k, c in enumerate(order))
    return F.expr(f"case (y % 2) * 2 + x % 2 {cases} end")
