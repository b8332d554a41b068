"""Reading and converting files by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.formats import canonical
from ..functions.sql import Spark
from ..operators import planes, representations
from . import jpeg, jpeg_pixels, raw, video, y4m

READERS = {".y4m": "frames", ".jpg": "markers", ".jpeg": "markers", ".png": "pixels", ".csv": "table"}


def read(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Files of a kind: frames of Y4M, markers of JPEG, decoded pixels of PNG (Spark's image source), rows of CSV."""
    kind = READERS.get(extension.lower())
    if kind is None:
        raise ValueError(f"no reader for {extension}")
    if kind == "frames":
        return video.read_video(spark, path)
    if kind == "markers":
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*" + extension).option("recursiveFileLookup", "true").load(path)
        return jpeg.markers(files.select("path", "content"))
    if kind == "pixels":
        return spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


#: One schema for pixels of any kind: each plane is an array of samples with its own size.
PLANES = "path string, frame_no bigint, w int, h int, depth int, planes map<string,struct<v:array<int>,w:int,h:int>>, status string"


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """path, frame_no, w, h, depth, planes, status of the Y4M, JPEG, PNG and BMP files below a folder. Files that cannot be read, of other kinds too, have a status other than ok and no planes.

    Y4M frames are read by ranges of bytes (a broken stream is an error), the others file by file.
    """
    plane = lambda v, w, h: F.struct(v.alias("v"), F.expr(w).cast("int").alias("w"), F.expr(h).cast("int").alias("h"))
    frames = video.read_video(spark, path)
    values = lambda a, n: y4m.sample_values(F.expr(f"substring(payload, cast({a} * each + 1 as int), cast({n} * each as int))"), 16)
    narrow = lambda a, n: y4m.sample_values(F.expr(f"substring(payload, cast({a} + 1 as int), cast({n} as int))"), 8)
    luma, chroma = "w * h", "chroma_w * chroma_h"
    each = frames.withColumn("each", F.when(F.col("depth") == 8, 1).otherwise(2))
    parts = []
    for wide in (False, True):
        read = values if wide else narrow
        own = each.filter("depth > 8" if wide else "depth = 8")
        own = own.withColumns({"_y": read("0", luma), "_u": read(luma, chroma), "_v": read(f"({luma} + {chroma})", chroma)})
        three = F.create_map(F.lit("y"), plane(F.col("_y"), "w", "h"), F.lit("u"), plane(F.col("_u"), "chroma_w", "chroma_h"), F.lit("v"), plane(F.col("_v"), "chroma_w", "chroma_h"))
        one = F.create_map(F.lit("y"), plane(F.col("_y"), "w", "h"))
        parts.append(own.select("path", "frame_no", "w", "h", "depth", F.when(F.col("chroma_w") == 0, one).otherwise(three).alias("planes"), F.lit("ok").alias("status")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("kind"), "content")
    jpegs = files.filter(F.col("kind").isin(".jpg", ".jpeg")).select("path", jpeg_pixels.decoded(F.col("content")).alias("d")).select("path", F.lit(0).cast("long").alias("frame_no"), "d.w", "d.h", "d.depth", "d.planes", "d.status")
    pixels = spark.read.format("image").option("pathGlobFilter", "*.{png,bmp,PNG,BMP}").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(path).select("image.*")
    samples = pixels.filter("height > 0").withColumn("s", y4m.byte_values(F.col("data")))
    of = lambda k: F.expr(f"transform(sequence(0, width * height - 1), i -> get(s, i * nChannels + {k}))")
    coloured = F.create_map(*[x for c, k in (("r", 2), ("g", 1), ("b", 0)) for x in (F.lit(c), plane(of(k), "width", "height"))])
    grey = F.create_map(F.lit("y"), plane(F.col("s"), "width", "height"))
    drawn = samples.select(F.col("origin").alias("path"), F.lit(0).cast("long").alias("frame_no"), F.col("width").alias("w"), F.col("height").alias("h"), F.lit(8).alias("depth"), F.when(F.col("nChannels") >= 3, coloured).otherwise(grey).alias("planes"), F.lit("ok").alias("status"))
    broken = pixels.filter("height <= 0").select(F.col("origin").alias("path"), F.lit("no image").alias("status"))
    foreign = files.filter(~F.col("kind").isin(".y4m", ".jpg", ".jpeg", ".png", ".bmp")).select("path", F.concat(F.lit("no reader for "), "kind").alias("status"))
    out = parts[0].unionByName(parts[1]).unionByName(jpegs).unionByName(drawn)
    return out.unionByName(broken.unionByName(foreign), allowMissingColumns=True)


def colour_range(spark: SparkSession, path: str) -> DataFrame:
    """path and colour range by kind: JPEG is full range, Y4M says so itself."""
    names = video.heads_of(raw.metadata(spark, path)).withColumn("extension", raw.extension("path"))
    known = F.coalesce(F.lower("colorrange"), F.when(F.col("extension").isin(".jpg", ".jpeg"), "full"), F.lit("unspecified"))
    return names.select("path", known.alias("range"))


def write_streams(df: DataFrame, folder: str, by: str, w: int, h: int, space: str, parts: list[str], depth: int = 8, order: str = "frame_no", colorrange: str | None = None, extension: dict[str, str] | None = None) -> None:
    """One Y4M file a value of `by`: frames in order, planes from arrays of samples."""
    payload = F.concat(*[y4m.pack_samples(p, depth) for p in parts])
    fields = {"w": F.lit(w), "h": F.lit(h), "space": F.lit(space), "colorrange": F.lit(colorrange).cast("string"), "extension": F.create_map(*[F.lit(x) for kv in (extension or {}).items() for x in kv]).cast("map<string,string>")}
    own = df.select(F.concat(F.col(by).cast("string"), F.lit(".y4m")).alias("name"), F.col(order).cast("long").alias("frame_no"), payload.alias("payload"), *[c.alias(k) for k, c in fields.items()])
    video.write_video(own, folder)


def write_table(df: DataFrame, folder: str) -> None:
    """A result table as CSV with a header; nulls are empty."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


def convert_colour_files(spark: SparkSession, path: str, w: int, h: int, folder: str, name: str = "sdtv.computer", direction: str = "rgb2yuv", source: str = "rgb8.planar", target: str = "yuv444p8") -> None:
    """Raw files of three full planes by a named colour conversion, one each: components are converted sample by sample, then stored from 0 to 255."""
    a, b = canonical(source), canonical(target)
    if (a.depth, b.depth) != (8, 8) or {a.subsample, b.subsample} - {None, "444"}:
        raise ValueError("full planes of 8 bits are read and written")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")
    there = files.withColumn("p", representations.plane_values(F.col("content"), a.name, w, h))
    zipped = there.withColumn("z", F.arrays_zip(*[F.col("p")[c].alias(c) for c in a.order]))
    each = colour.convert_sql(Spark, name, direction, [f"s.{c}" for c in a.order])
    stored = [F.expr(f"transform(z, s -> cast(least(255, greatest(0, {e})) as int))") for e in each]
    out = zipped.select("name", F.concat(*stored).alias("v"))
    video.write_whole(out.select("name", y4m.pack_samples("v").alias("content")), folder)


def demosaiced(spark: SparkSession, path: str, fmt: str, w: int, h: int, **options) -> DataFrame:
    """path, r, g, b arrays of raw mosaic files."""
    f = canonical(fmt)
    return planes.demosaic(raw.read_mosaics(spark, path, fmt, w, h).withColumnRenamed("samples", "v"), f.order, h, w, **options).drop("v")
