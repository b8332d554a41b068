"""Raw frames: NV12 with a stride, RGBA, mosaics; metadata-only listings; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import RAW_FACTORS, canonical
from . import video
from .y4m import byte_values, sample_values


def extension(path: str) -> Column:
    """The extension of a column of paths in small letters, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, length of files: their content is not read. A folder is listed by tasks, a pattern of paths by the driver."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path) if set(path) & set("*?[{") else video.files(spark, path)
    return df.select("path", extension("path").alias("extension"), "length")


def frame_of(content: str, w: int, h: int, fmt: str, frame: int = 0) -> Column:
    """The bytes of one frame of a raw video."""
    a, b = RAW_FACTORS[fmt]
    size = w * h * a // b
    return F.expr(f"substring({content}, {frame * size + 1}, {size})")


def nv12_planes(df: DataFrame, content: str, w: int, h: int, stride: int, scanline: int) -> DataFrame:
    """Arrays luma, u, v: luma rows of `stride` bytes, `scanline` rows, then interleaved chroma rows; what pads them is dropped."""
    b = df.withColumn("_b", byte_values(F.col(content)))
    luma = f"transform(sequence(0, {w * h - 1}), p -> get(_b, cast((p div {w}) * {stride} + p % {w} as int)))"
    cw, ch = (w + 1) // 2, (h + 1) // 2
    chroma = lambda k: f"transform(sequence(0, {cw * ch - 1}), p -> get(_b, cast({stride * scanline} + (p div {cw}) * {stride} + 2 * (p % {cw}) + {k} as int)))"
    return b.withColumns({"luma": F.expr(luma), "u": F.expr(chroma(0)), "v": F.expr(chroma(1))}).drop("_b")


def rgba_planes(df: DataFrame, content: str, w: int, h: int) -> DataFrame:
    """Arrays r, g, b; alpha is dropped."""
    b = df.withColumn("_b", byte_values(F.col(content)))
    return b.withColumns({c: F.expr(f"transform(sequence(0, {w * h - 1}), p -> get(_b, cast(4 * p + {k} as int)))") for k, c in enumerate("rgb")}).drop("_b")


def yuv420p10_planes(df: DataFrame, content: str, w: int, h: int) -> DataFrame:
    """Arrays luma, u, v of 10-bit little-endian 4:2:0; bits above the tenth are dropped."""
    s = df.withColumn("_s", F.transform(sample_values(F.col(content), 10), lambda z: z.bitwiseAND(F.lit(1023))))
    n, c = w * h, (w // 2) * (h // 2)
    return s.withColumns({"luma": F.slice("_s", 1, n), "u": F.slice("_s", n + 1, c), "v": F.slice("_s", n + c + 1, c)}).drop("_s")


def mosaic_samples(df: DataFrame, content: str, fmt: str) -> DataFrame:
    """Adds the array `samples` of a packed mosaic format."""
    from ..functions.packing import codec
    from ..functions.sql import Spark

    f = canonical(fmt)
    c = codec(f.codec)
    b = df.withColumn("_b", byte_values(F.col(content)))
    group = ", ".join(c.unpack(Spark, [f"get(_b, cast(g * {c.n_bytes} + {i} as int))" for i in range(c.n_bytes)]))
    return b.withColumn("samples", F.expr(f"flatten(transform(sequence(0, size(_b) div {c.n_bytes} - 1), g -> array({group})))")).drop("_b")


def read_mosaics(spark: SparkSession, path: str, fmt: str, w: int, h: int, strict: bool = True) -> DataFrame:
    """path, samples of raw files. strict: a size other than the format's is an error; else larger files are cut."""
    f = canonical(fmt)
    size = w * h * f.n_bytes // f.n_samples
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length")
    fits = F.col("length") == size if strict else F.col("length") >= size
    checked = files.withColumn("content", F.when(fits, F.expr(f"substring(content, 1, {size})")).otherwise(F.raise_error(F.concat(F.lit(f"a file is not of {size} bytes: "), "path"))))
    return mosaic_samples(checked.select("path", "content"), "content", fmt)
