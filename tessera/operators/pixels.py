"""Filters over samples: one row a pixel in, one row a pixel out. Every filter is a projection or an equi-join on pixel keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, planes

PIXEL = ["image_id", "y", "x"]


def crop(df: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The half-open region x0..x1, y0..y1."""
    return df.filter((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def align(size: str, to: int) -> Column:
    """A size cut down to a multiple."""
    return F.expr(f"{to} * ({size} div {to})")


def gray(df: DataFrame, ins=("r", "g", "b")) -> DataFrame:
    """Rounded luma in three equal components."""
    from ..functions.colour import rounded_yuv
    from ..functions.sql import Spark

    y = F.expr(rounded_yuv(Spark, list(ins))[0])
    return df.withColumns({"_y": y}).withColumns({c: F.col("_y") for c in ins}).drop("_y")


def swap_chroma(df: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    return df.withColumnsRenamed({u: "_u", v: u}).withColumnRenamed("_u", v)


def tint_extremes(df: DataFrame) -> DataFrame:
    """Gray 254 becomes yellowish, gray 1 bluish."""
    flat = (F.col("u") == 128) & (F.col("v") == 128)
    # Fixed values: (y, u, v) of the two tints.
    bright, dark = (129, 48, 160), (128, 160, 48)
    return df.withColumns({c: F.when((F.col("y_") == 254) & flat, bright[i]).when((F.col("y_") == 1) & flat, dark[i]).otherwise(F.col(c)) for i, c in enumerate(("y_", "u", "v"))})


def drawn(*keys: str, seed: int = 0) -> Column:
    """A number below 2^32 that follows from keys and a seed, by their MD5: the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")


def noise(df: DataFrame, level: int, seed: int = 0, column: str = "v", top: int = 255) -> DataFrame:
    """Adds a uniform integer in [-level, level), the same for a pixel whenever it is computed, then clips."""
    draw = F.pmod(drawn(*PIXEL, seed=seed), F.lit(2 * level)) - level
    return df.withColumn(column, F.least(F.lit(top), F.greatest(F.lit(0), F.col(column) + draw)).cast("int"))


def mix(df: DataFrame, definition: str) -> DataFrame:
    """Components of two aligned images by a definition such as y1u2v2; the columns are y1, u1, v1, y2, u2, v2."""
    parts = [definition[i : i + 2] for i in range(0, len(definition), 2)]
    if len(parts) != 3 or any(p[0] not in "yuv" or p[1] not in "12" for p in parts):
        raise ValueError(f"not a mix definition: {definition}")
    return df.select(*PIXEL, *[F.col(p).alias(f"c{i}") for i, p in enumerate(parts)])


def compose(background: DataFrame, needle: DataFrame, x0: int, y0: int, alpha: str | None = None) -> DataFrame:
    """The needle over the background from (x0, y0): blended by alpha / 256, rounded half to even, or half of each, cut. Columns v."""
    own = needle.select("image_id", (F.col("y") + y0).alias("y"), (F.col("x") + x0).alias("x"), F.col("v").alias("over"), *([F.col(alpha).alias("alpha")] if alpha else []))
    both = background.join(own, PIXEL, "left")
    blend = F.expr("bround(v * (1 - alpha / 256D) + over * (alpha / 256D), 0)") if alpha else F.expr("(v + over) div 2")
    return both.select(*PIXEL, F.when(F.col("over").isNull(), F.col("v")).otherwise(blend).cast("int").alias("v"))


def match(image: DataFrame, needle: DataFrame, h: int, w: int, side: int) -> DataFrame:
    """image_id, y, x, score: where a side x side needle correlates best (mean removed, normalised); the topmost, then leftmost, of equals.

    One pass over the images, each beside its needle; a frame too large for a row's task is matched by tiles (tiles.match).
    """

    @F.arrow_udf("struct<y:int,x:int,score:double>")
    def best(images: pa.Array, needles: pa.Array) -> pa.Array:
        rows = []
        for v, t in zip(images, needles, strict=True):
            y, x, score = kernels.best_place(v.values.to_numpy().reshape(h, w), t.values.to_numpy().reshape(side, side))
            rows.append({"y": y, "x": x, "score": score})
        return pa.array(rows, pa.struct([("y", pa.int32()), ("x", pa.int32()), ("score", pa.float64())]))

    both = image.select("image_id", "v").join(needle.select("image_id", F.col("v").alias("t")), "image_id").filter("v is not null and t is not null")
    return both.select("image_id", best("v", "t").alias("m")).select("image_id", "m.y", "m.x", "m.score")


def affine_matrix(points: list[tuple[float, float]], to: list[tuple[float, float]]) -> list[list[float]]:
    """The 2 x 3 matrix that takes three points to three others (on the driver: six numbers)."""
    a = np.array([[x, y, 1.0] for x, y in points])
    return [np.linalg.solve(a, np.array([p[k] for p in to])).tolist() for k in (0, 1)]


def affine(df: DataFrame, matrix: list[list[float]], h: int, w: int) -> DataFrame:
    """Warps an array column v by a 2 x 3 matrix: each output pixel is read bilinearly where the inverse takes it, 0 outside."""
    inverse = np.linalg.inv(np.array([*matrix, [0, 0, 1]]))[:2]
    return planes.by_kernel(df, "v", h, w, lambda v: {"v": kernels.warp(v, inverse)}, {"v": "v"})


def difference(pairs: DataFrame, factor: float = 1.0, invert: bool = False, colour: float | None = None, top: int = 255) -> DataFrame:
    """Absolute difference of a and b times the factor, clipped, rounded half to even; chroma middle gray, or by the signed difference."""
    luma = F.bround(F.least(F.lit(float(top)), F.greatest(F.lit(0.0), F.abs(F.col("a") - F.col("b")) * F.lit(float(factor)))), 0).cast("int")
    out = {"luma": (top - luma).cast("int") if invert else luma}
    if colour is None:
        out |= {"u": F.lit((top + 1) // 2), "v": F.lit((top + 1) // 2)}
    else:
        mid = (F.lit(float(colour)) * (F.col("a") - F.col("b")) + 255) / 2
        cut = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), c.cast("int")))
        out |= {"u": cut(255 - mid), "v": cut(mid)}
    return pairs.select(*PIXEL, *[c.alias(n) for n, c in out.items()])


#: Filters by name, each a function of a DataFrame and its own options.
FILTERS = {"crop": crop, "gray": gray, "xchroma": swap_chroma, "tint": tint_extremes, "noise": noise, "mix": mix, "compose": compose, "match": match, "affine": affine, "diff": difference}


def apply_filter(df: DataFrame, name: str, *args, **options) -> DataFrame:
    if name not in FILTERS:
        raise ValueError(f"an unknown filter: {name}")
    return FILTERS[name](df, *args, **options)
